"""Values that were cut off before their end, and how often each source cuts.

1. Near-copies: the contents are signed by min-hashes of five-word shingles, over the opening (which a cut copy shares
   with the whole one, wherever it was cut) and over the whole text, and banded; titles meet by their opening words. Pairs
   that meet in a bucket are verified, the closing words of either are aligned with the other, and the copy is flagged
   whose alignment ends early: where the other goes on within the word or sentence.
2. All other values are scored by the terminality of their closing word: how often the word is followed by an end
   (a sentence end or a line end) where it occurs in the corpus, and whether it is a whole word there at all. A value
   that ends without an end mark in running text, or in a word that never ends anything, was cut.

One pass over the texts gives the signatures, the verdicts by form and the counts of words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecframe.llm._common import Stage, hinted
from vecframe.llm.shingles import alnum_table, code_points, mix, shingle_sets, word_hashes, word_spans
from vecframe.llm.vectors import fresh

WIDTH, SIMILARITY = 5, 0.8
#: Bands, and the windows that are signed (shingles from the opening, None for the whole text) with the rows of a band:
#: a copy that was cut shares the opening, one that was edited or reordered the whole.
BANDS, WINDOWS = 4, ((8, 2), (32, 2), (None, 3))
#: Words of a title's opening by which titles meet.
TITLE_WORDS = 4
#: Texts of a bucket up to which all its pairs are listed; of larger ones those that can be near-copies.
BUCKET = 64
#: Words at the end of a text that are aligned, and the share of them that may differ.
ALIGNED, EDITED = 24, 0.25
#: Share of a word's occurrences that are followed by an end, below which the word closes nothing.
TERMINAL = 0.02
#: The same in titles, whose ends bear no mark.
TITLE_TERMINAL = 0.15
#: How often a closing word must stand before other words or an end mark, and how often for each title that it closes:
#: a piece of a word stands nowhere else, whatever the size of the corpus.
ELSEWHERE, ELSEWHERE_RATIO = 3, 3.0
#: Share of the titles with an opening word that end in a question mark, from which all of them should.
QUESTIONS, QUESTION_TITLES = 0.6, 20

# Hints that more text follows, and phrases that a mark of omission properly ends.
HINTS = re.compile(r"(?:\s*(?:\[\s*(?:\.\.\.|…|more|mehr|más|suite)\s*\]|\((?:\.\.\.|…|more|continued|mehr|más|suite)\)|(?:Read|See|Show|Learn) more|Continue reading|Weiterlesen|Mehr lesen|Leer más|Seguir leyendo|Lire la suite|En savoir plus|阅读更多|更多|展开|»|>>)|\s*(?:\.\.\.+|…+|。。。+))+\s*$", re.I)
OMISSION_ENDS = re.compile(r"(?:\band so on|\band so forth|\betc|\bet cetera|\bund so weiter|\busw|\bet ainsi de suite|\by así sucesivamente|\betcétera|等等|等)\s*$", re.I)
#: What a hint can end with; only then is the pattern tried.
_HINT_TAILS = ("]", ")", "...", "…", "。。。", "»", ">>", "more", "reading", "lesen", "más", "leyendo", "suite", "plus", "更多", "展开")
_WORD = re.compile(r"[^\W_]+")
_END_MARK = re.compile(r"[.!?。！？][\"'”’»)\]」』*_`]*$|[.!?。！？]</\w+>$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_LIST = re.compile(r"^\s*(?:[-*+•·]|\d+[.)])\s")
_URL_LINE = re.compile(r"^\s*(?:\w+:?\s+){0,3}<?(?:https?://|www\.)\S+$")
_FULL_URL = re.compile(r"(?:https?://|www\.)[\w-]+(?:\.[\w-]+)+/\S*?(?:\d+|/|\.\w{2,5})>?$")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_CLOSERS, _MARKS = "\"'”’»)]", ".!?。！？"
#: The key of all numbers.
_NUMBER = np.uint64(0x5851F42D4C957F2D)

COMPLETE, CUT, ASK_WORD, ASK_TITLE = 0, 1, 2, 3


def without_hint(text: str) -> str:
    """The text without trailing white space, marks of omission and hints to more; only its end is looked at."""
    text = text.rstrip()
    tail = text[-120:]
    if not tail.lower().endswith(_HINT_TAILS):
        return text
    return (text[:-120] + HINTS.sub("", tail)).rstrip()


def _ends(text: str) -> bool:
    return _END_MARK.search(text[-60:]) is not None


def last_word(text: str) -> str:
    """The closing word in lower case; of scripts without spaces the last two characters."""
    words = _WORD.findall(text[-200:].lower())
    if not words:
        return ""
    w = words[-1]
    if _CJK.search(w):
        return w[-2:]
    return "#" if w.isdigit() else w


def opening(text: str) -> str:
    """The opening word in lower case, and the length in steps of thirty characters: long titles ask otherwise."""
    m = _WORD.search(text)
    w = m.group().lower() if m else ""
    return f"{w[:2] if _CJK.search(w) else w} {len(text.rstrip()) // 30}"


def judge(value: str, title: bool) -> tuple[int, str]:
    """Whether a value is complete or cut by its form alone, or which word to ask the corpus about."""
    s = value.rstrip()
    core = without_hint(s)
    if not core:
        return COMPLETE, ""
    hinted = core != s
    if core[-1] == "�":
        return CUT, ""
    if hinted and OMISSION_ENDS.search(core[-60:]):
        return COMPLETE, ""
    word = last_word(core)
    if title:
        if hinted:
            return COMPLETE if _ends(core) else CUT, ""
        if _ends(s) or s[-1] in ")]}”»\"'":
            return COMPLETE, ""
        if not word or s[-1] in ",;:-–—/(&+":
            return CUT, ""
        return ASK_TITLE, word
    if core.count("```") % 2:
        return CUT, ""
    if _ends(core):
        return COMPLETE, ""
    if hinted:
        return CUT, ""
    if core.endswith("```"):
        return COMPLETE, ""
    lines = core.rsplit("\n", 2)
    line = lines[-1]
    if _URL_LINE.search(line):
        return COMPLETE if _FULL_URL.search(line) else CUT, ""
    if len(lines) > 1 and lines[-2].strip() in ("--", "—", "__"):
        # A signature ends in its number, or in a word that can close.
        return (COMPLETE, "") if line[-1].isdigit() else (CUT, "") if "," in line else (ASK_WORD, word)
    if _TABLE.search(line) or re.search(r"</?\w+[^<>]*>$", line):
        return COMPLETE, ""
    if _LIST.search(line) and not re.search(r"[.!?。！？]\s", line):
        return (ASK_WORD, word) if word and line[-1] not in ",;:-–—/(&+" else (CUT, "")
    # Running text: it has ended sentences before, so the last one should end as well.
    if re.search(r"[.!?][\"'”’»)\]]*\s|[。！？]", core):
        return CUT, ""
    return (ASK_WORD, word) if word else (COMPLETE, "")


def _among(cps: np.ndarray, chars: str) -> np.ndarray:
    out = np.zeros(len(cps), dtype=bool)
    for c in chars:
        out |= cps == ord(c)
    return out


def _next(stops: np.ndarray) -> np.ndarray:
    """For every place the first one from it on that is a stop."""
    at = np.where(stops, np.arange(len(stops)), len(stops) - 1)
    return np.minimum.accumulate(at[::-1])[::-1]


def _is_cjk(cps: np.ndarray) -> np.ndarray:
    return ((cps >= 0x3040) & (cps <= 0x30FF)) | ((cps >= 0x3400) & (cps <= 0x9FFF)) | ((cps >= 0xAC00) & (cps <= 0xD7AF))


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))


def _word_keys(words: list[str]) -> np.ndarray:
    """Keys of closing words as ``last_word`` gives them; equal to the keys under which ``_Words`` counts them."""
    out = np.full(len(words), _NUMBER, dtype=np.uint64)
    pairs = [i for i, w in enumerate(words) if len(w) == 2 and _CJK.search(w)]
    if pairs:
        out[pairs] = _pair_keys(*(np.array([ord(words[i][j]) for i in pairs], dtype=np.uint64) for j in (0, 1)))
    known = set(pairs)
    plain = [i for i, w in enumerate(words) if w and w != "#" and i not in known]
    if plain:
        cps, offsets = code_points([words[i] for i in plain])
        out[plain] = word_hashes(cps, offsets[:-1], offsets[1:] - 1)
    return out


class _Words:
    """The words of lower-cased texts as arrays: keys, places, and what follows them."""

    def __init__(self, texts: list[str], cores: list[int], titles: np.ndarray, hinted_: np.ndarray) -> None:
        cps, offsets = code_points(texts)
        starts, ends = word_spans(cps)
        self.doc = np.searchsorted(offsets, starts, side="right") - 1
        self.hash = word_hashes(cps, starts, ends)
        padded = np.r_[cps, 0]
        behind = _next(~_among(cps, _CLOSERS))[ends]
        after = padded[behind + 1]
        marked = _among(padded[behind], _MARKS) & ~(alnum_table()[after] | _among(after, "._…"))
        line = cps[_next(~_among(cps, " \t\r"))[behind]] == 10
        ended = marked | line
        # The last word of what is left without a hint; nothing says that it was followed by another one.
        last = np.searchsorted(starts, offsets[:-1] + np.array(cores, dtype=np.int64)) - 1
        last = last[(last >= 0) & (self.doc[np.maximum(last, 0)] == np.arange(len(texts)))] if len(starts) else last[:0]
        closing = np.zeros(len(starts), dtype=bool)
        closing[last] = True
        digits = np.r_[0, np.cumsum((cps >= 48) & (cps <= 57))]
        number = digits[ends] - digits[starts] == ends - starts
        keys = np.where(number, _NUMBER, self.hash)
        title = titles[self.doc]
        parts = [(keys, ended, title, closing)]
        # Scripts without spaces: every two neighbouring characters of such a word.
        cjk = np.r_[0, np.cumsum(_is_cjk(cps))]
        which = np.flatnonzero((cjk[ends] > cjk[starts]) & (ends - starts > 1))
        if len(which):
            times = (ends - starts)[which] - 1
            word = np.repeat(which, times)
            at = starts[word] + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            final = at + 2 == ends[word]
            parts.append((_pair_keys(cps[at], cps[at + 1]), final & _among(cps[ends[word]], "。！？\n"), title[word], closing[word] & final))
        keys, ended, title, closing = (np.concatenate([p[i] for p in parts]) for i in range(4))
        doc_hinted = np.concatenate([hinted_[self.doc], *([hinted_[self.doc[word]]] if len(which) else [])])
        self.key, inverse = np.unique(keys, return_inverse=True)
        count = lambda m: np.bincount(inverse, weights=m, minlength=len(self.key)).astype(np.int64)
        #: Occurrences, those followed by an end, those in titles, titles closed, occurrences that are no closing ones.
        self.counts = [count(np.ones(len(keys))), count(ended), count(title), count(title & closing & ~doc_hinted), count(~closing | ended)]

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and place of every run of ``width`` words, in the order of the text."""
        n = len(self.hash) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            h = mix(h * np.uint64(31) + self.hash[i : i + n] + np.uint64(i + 1))
        same = self.doc[:n] == self.doc[width - 1 :]
        h, doc = h[same], self.doc[:n][same]
        return h, doc, np.arange(len(doc)) - np.searchsorted(doc, doc)


def _band_keys(words: _Words, titles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and the keys of the buckets they meet others in: min-hashes of contents, openings of titles."""
    who, keys = [], []
    h, doc, place = words.shingles(WIDTH)
    content = ~titles[doc]
    h, doc, place = h[content], doc[content], place[content]
    seed = 0
    for n, (window, rows) in enumerate(WINDOWS):
        near = slice(None) if window is None else place < window
        own, owner = h[near], doc[near]
        found, first = np.unique(owner, return_index=True)
        for band in range(BANDS if len(found) else 0):
            key = np.full(len(found), n * BANDS + band + 1, dtype=np.uint64)
            for _ in range(rows):
                seed += 1
                least = np.minimum.reduceat(mix(own ^ mix(np.full(1, seed, np.uint64))), first)
                key = mix(key * np.uint64(31) + least)
            who.append(found)
            keys.append(key)
    h, doc, place = words.shingles(TITLE_WORDS)
    opens = titles[doc] & (place == 0)
    who.append(doc[opens])
    keys.append(mix(h[opens] + np.uint64(7)))
    return np.concatenate(who), np.concatenate(keys)


_SCANNED = (
    "kind int, id bigint, source string, field_name string, verdict int, word bigint, opening string, size int, keys array<bigint>, "
    "total bigint, ends bigint, in_titles bigint, title_ends bigint, inner bigint"
)
_VALUE, _WORD_COUNT, _OPENING_COUNT = 0, 1, 2


def _scan(rows: DataFrame) -> DataFrame:
    """One pass over ``(id, source, content, title)``: a row of each value that is not blank, and counts of the corpus.

    Rows of kind 0 hold a value's verdict by form, the word and opening to ask about and its bucket keys; kind 1 counts
    words and kind 2 the openings of titles, and how many of these ask, summed per batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                b = whole.slice(start, 4096)
                columns = b.column(2).to_pylist(), b.column(3).to_pylist()
                at = [(f, i) for f in (0, 1) for i, v in enumerate(columns[f]) if v and not v.isspace()]
                values = [columns[f][i] for f, i in at]
                titles = np.array([f == 1 for f, _ in at], dtype=bool)
                lows = [v.rstrip().lower() for v in values]
                cores = [len(without_hint(v)) for v in lows]
                words = _Words(lows, cores, titles, np.array([n != len(v) for n, v in zip(cores, lows, strict=True)], dtype=bool))
                judged = [judge(v, bool(t)) for v, t in zip(values, titles, strict=True)]
                openings = [opening(v) if t else None for v, t in zip(lows, titles, strict=True)]
                asks: Counter = Counter(o for o in openings if o is not None)
                asked: Counter = Counter(o for o, v in zip(openings, lows, strict=True) if o is not None and v.endswith(("?", "？")))
                who, keys = _band_keys(words, titles)
                order = np.argsort(who, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(who, minlength=len(values)))].astype(np.int32)), pa.array(keys[order].view(np.int64)))
                m, n, o = len(values), len(words.key), len(asks)
                place = pa.array([i for _, i in at], pa.int64())
                none = lambda k, t: pa.nulls(k, t)
                long = lambda x: pa.array(np.asarray(x, dtype=np.int64))
                join = lambda *parts: pa.concat_arrays(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(np.array([_VALUE, _WORD_COUNT, _OPENING_COUNT], np.int32), [m, n, o])),
                        join(b.column(0).take(place), none(n + o, pa.int64())),
                        join(b.column(1).take(place), none(n + o, pa.string())),
                        join(pa.array(["title" if t else "content" for t in titles], pa.string()), none(n + o, pa.string())),
                        join(pa.array([j for j, _ in judged], pa.int32()), none(n + o, pa.int32())),
                        join(pa.array(_word_keys([w for _, w in judged]).view(np.int64)), pa.array(words.key.view(np.int64)), none(o, pa.int64())),
                        join(pa.array([a if j[0] == ASK_TITLE else None for a, j in zip(openings, judged, strict=True)], pa.string()), none(n, pa.string()), pa.array(list(asks), pa.string())),
                        join(pa.array([len(v) for v in values], pa.int32()), none(n + o, pa.int32())),
                        join(lists, none(n + o, lists.type)),
                        join(none(m, pa.int64()), long(words.counts[0]), long(list(asks.values()))),
                        join(none(m, pa.int64()), long(words.counts[1]), long([asked[k] for k in asks])),
                        *[join(none(m, pa.int64()), long(words.counts[i]), none(o, pa.int64())) for i in (2, 3, 4)],
                    ],
                    names=["kind", "id", "source", "field_name", "verdict", "word", "opening", "size", "keys", "total", "ends", "in_titles", "title_ends", "inner"],
                )

    return rows.select("id", "source", "content", "title").mapInArrow(run, _SCANNED)


def _place_of_end(tail: list[str], words: list[str]) -> int | None:
    """Where in ``words`` the closing words ``tail`` end: an alignment with the fewest edits, the last place of those.

    The very last word of ``tail`` may be the beginning of its counterpart. None if too much differs.
    """
    n = len(words)
    steps = np.arange(n + 1)
    cost = np.zeros(n + 1, dtype=np.int64)
    for i, w in enumerate(tail):
        last = i == len(tail) - 1
        differs = np.fromiter((not (v.startswith(w) if last else v == w) for v in words), dtype=np.int64, count=n)
        up = np.r_[i + 1, np.minimum(cost[:-1] + differs, cost[1:] + 1)]
        cost = np.minimum.accumulate(up - steps) + steps
    fits = np.flatnonzero(np.r_[False, differs == 0] & (cost <= EDITED * len(tail)))
    if not len(fits):
        return None
    best = fits[cost[fits] == cost[fits].min()]
    return int(best[-1]) - 1


def breaks_off(short: str, long: str) -> bool:
    """Does ``short`` end where ``long`` goes on within the word or the sentence?

    The closing words of ``short`` are aligned with ``long``; the very last may be the beginning of the word there.
    """
    core = without_hint(short)
    if not core or (core == short.rstrip() and _ends(core)):
        return False
    lowered = core.lower()
    spans = [m.span() for m in _WORD.finditer(lowered, max(0, len(lowered) - 40 * ALIGNED))][-ALIGNED:]
    if len(spans) < 4 or spans[-1][1] < len(lowered.rstrip("�")):
        return False
    whole = long.lower()
    tail = [lowered[a:b] for a, b in spans]
    hit = None
    for hit in re.finditer(r"(?<![^\W_])" + r"[\W_]+".join(map(re.escape, tail[-6:])), whole):
        pass
    if hit is not None:
        end = hit.end()
    else:
        places = [m.span() for m in _WORD.finditer(whole)]
        at = _place_of_end(tail, [whole[a:b] for a, b in places]) if places else None
        if at is None:
            return False
        end = places[at][0] + len(tail[-1])
    rest = whole[end:]
    if not rest.strip():
        return False
    if rest[0].isalnum():
        return True
    return not re.match(r"[\"'”’»)\]`]*(?:[.!?。！？]|\s*\n|\s*$)", rest)


def _likely_copies(texts: list[str], width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts, each once, that hold all in which the smaller set of shingles lies in the larger one to ``similarity``.

    The smaller set cannot reach it without one of its rarest ``n - ceil(similarity n) + 1`` shingles in the larger one. What all texts
    of a bucket share comes last in that order, so it makes no pairs by itself.
    """
    h, doc = shingle_sets(texts, width)
    n = len(texts)
    size = np.bincount(doc, minlength=n)
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    f = times[which]
    order = np.lexsort((h, f, doc))
    place = np.arange(len(h)) - (np.cumsum(size) - size)[doc]
    first = order[(place < (size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1)[doc]) & (f[order] > 1)]
    by = np.argsort(which, kind="stable")
    begins = np.cumsum(times) - times
    found = np.zeros(0, dtype=np.int64)
    turn = np.cumsum(f[first]) >> 20
    for part in np.split(first, np.flatnonzero(np.diff(turn)) + 1):
        count = f[part]
        at = np.repeat(begins[which[part]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x, y = np.repeat(doc[part], count), doc[by[at]]
        keep = (x != y) & (size[x] <= size[y])
        x, y = x[keep], y[keep]
        found = np.union1d(found, np.minimum(x, y) * n + np.maximum(x, y))
    return found // n, found % n


def _title_cuts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``(id, field_name, copies)`` of titles that another title of their bucket goes on from inside a word.

    Titles are ordered with letters and digits before all other characters: if any title goes on so, the next one does.
    """
    held = keys.where("field_name = 'title'").select("id", "key").join(rows.select("id", F.lower(F.rtrim("title")).alias("low")).where("low is not null"), "id")
    held = Stage(held.distinct()).df
    order = F.regexp_replace("low", r"([^\p{L}\p{N}])", "\U0010ffff$1")
    following = F.lead("low").over(Window.partitionBy("key").orderBy("order", "low"))
    goes_on = F.col("next").startswith(F.col("low")) & F.substring("low", -1, 1).rlike(r"[\p{L}\p{N}]") & F.substr("next", F.length("low") + 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    cut = held.select("key", "low").distinct().withColumn("order", order).withColumn("next", following).where(goes_on).select("key", "low")
    return held.join(hinted(Stage(cut)), ["key", "low"]).select("id", F.lit("title").alias("field_name"), F.lit(False).alias("copies"))


def near_copy_cuts(rows: DataFrame, scanned: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """``(id, field_name, copies)`` of values that break off where a near-copy's value goes on.

    All values of a bucket meet. Contents are near-copies if the shorter one's shingles lie in the longer one for the most
    part; then their titles are compared too. Records of the same content and title are represented by the first. In buckets
    of up to ``bucket`` records all pairs are listed, in larger ones those that can be near-copies. Titles that meet by their
    openings alone (not ``copies``) are flagged only inside a word. Both values of a pair are tested.
    """
    keys = scanned.where(f"kind = {_VALUE}").select("id", "field_name", F.explode("keys").alias("key"))
    # Two hashes stand for the texts; a record with two versions stands for itself.
    same = rows.where("content is not null").select("id", F.xxhash64("content", "title").alias("h1"), F.xxhash64(F.lit(1), "title", "content").alias("h2")).distinct()
    same = same.groupBy("id").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.count("*").alias("n")).where("n = 1")
    again = same.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select("h1", "h2", "rep")
    copies = hinted(Stage(same.join(hinted(Stage(again)), ["h1", "h2"]).where("id <> rep").select("id", "rep")))
    met = keys.where("field_name = 'content'").join(copies, "id", "left_anti").select("key", "id").distinct()
    sizes = Stage(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = Stage(met.join(sizes.df, "key"))
    small = met.df.where(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", F.posexplode("ids").alias("at", "a"))
    small = small.select("a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("b"))
    large = met.df.where(F.col("n") > bucket).select("key", "id")

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.sort_values(["id", "text"]).drop_duplicates("id", keep="last")
        ids = one.id.to_numpy()
        a, b = _likely_copies(one.text.tolist(), width, similarity)
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    large_ids = hinted(Stage(large.select("id").distinct()))
    texts_ = rows.join(large_ids, "id", "left_semi").where("content is not null").select("id", F.col("content").alias("text"))
    large = large.join(texts_, "id").groupBy("key").applyInPandas(likely, "a bigint, b bigint")
    pairs = Stage(small.unionByName(large).distinct()).df
    ends = hinted(Stage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()))
    texts = Stage(rows.join(ends, "id", "left_semi").groupBy("id").agg(F.max(F.struct("content", "title")).alias("v"))).df
    left, right = (texts.select(F.col("id").alias(e), F.col("v.content").alias(f"content_{e}"), F.col("v.title").alias(f"title_{e}")) for e in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "content_a", "title_a", "content_b", "title_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                a_ids, b_ids, ca, ta, cb, tb = (c.to_pylist() for c in b.columns)
                n = b.num_rows
                h, doc = shingle_sets([*ca, *cb], width)
                edge = np.searchsorted(doc, np.arange(2 * n + 1))
                out: list[tuple[int, str]] = []
                for i in range(n):
                    x, y = h[edge[i] : edge[i + 1]], h[edge[n + i] : edge[n + i + 1]]
                    if len(np.intersect1d(x, y, assume_unique=True)) < similarity * min(len(x), len(y)):
                        continue
                    out += [(k, "content") for k, s, o in ((a_ids[i], ca[i], cb[i]), (b_ids[i], cb[i], ca[i])) if breaks_off(s, o)]
                    if ta[i] and tb[i]:
                        out += [(k, "title") for k, s, o in ((a_ids[i], ta[i], tb[i]), (b_ids[i], tb[i], ta[i])) if breaks_off(s, o)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([f for _, f in out], pa.string())], names=["id", "field_name"])

    found = Stage(both.mapInArrow(run, "id bigint, field_name string").distinct().withColumn("copies", F.lit(True))).df
    of_copies = found.withColumnRenamed("id", "rep").join(copies, "rep").select("id", "field_name", "copies")
    return found.unionByName(of_copies).unionByName(_title_cuts(rows, keys))


def truncated(df: DataFrame, key: str = "id", version: str | None = "ingested_at") -> DataFrame:
    """``(id, source, field_name, cut, near_copy)`` of every ``content`` and ``title`` that is not blank.

    ``near_copy`` says whether a near-copy that goes on shows the cut. Null and blank values are no values; of rows of
    one key the last by ``version`` counts (null versions first, repeats of it once); rows without a key are left out; a
    null ``source`` stays null. Only the named columns are read, and the texts are scanned once.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    columns = df.select(F.col(key).cast("long").alias("id"), text("source"), text("content"), text("title"), *([F.col(version).alias("ver")] if version else []))
    rows = fresh(columns, "id", "ver" if version else None).select("id", "source", "content", "title")
    scanned = Stage(_scan(rows)).df
    judged = scanned.where(f"kind = {_VALUE}").select("id", "source", "field_name", "verdict", "word", "opening")
    # Few words of the corpus are asked about, and each once, whatever the number of values that end in it.
    asked = hinted(Stage(judged.where(f"verdict >= {ASK_WORD}").select("word").distinct()))
    counts = ("total", "ends", "in_titles", "title_ends", "inner")
    words = scanned.where(f"kind = {_WORD_COUNT}").join(asked, "word", "left_semi").groupBy("word").agg(*[F.sum(c).alias(c) for c in counts])
    closes = (F.col("ends") >= TERMINAL * F.col("total")) & (F.col("ends") > 0)
    elsewhere = F.col("inner") >= F.greatest(F.lit(float(ELSEWHERE)), ELSEWHERE_RATIO * F.col("title_ends"))
    closes_title = F.col("title_ends") >= TITLE_TERMINAL * F.col("in_titles")
    words = words.select("word", closes.alias("closes"), closes_title.alias("closes_title"), elsewhere.alias("whole"))
    opens = scanned.where(f"kind = {_OPENING_COUNT}").groupBy("opening").agg(F.sum("total").alias("total"), F.sum("ends").alias("asking"))
    opens = opens.where((F.col("total") >= QUESTION_TITLES) & (F.col("asking") >= QUESTIONS * F.col("total"))).select("opening", F.lit(True).alias("asks"))
    scored = judged.join(hinted(Stage(words)), "word", "left").join(hinted(Stage(opens)), "opening", "left")
    title = F.col("field_name") == "title"
    # What closes a title, as titles or as sentences go, must be a whole word as well.
    ends = F.when(title, (F.col("closes") | F.col("closes_title")) & F.col("whole")).otherwise(F.col("closes"))
    alone = scored.select("id", "source", "field_name", (F.when(F.col("verdict") < ASK_WORD, F.col("verdict") == CUT).otherwise(~F.coalesce(ends, F.lit(False)) | F.coalesce("asks", F.lit(False)))).alias("cut"), F.coalesce("whole", F.lit(False)).alias("whole"))
    # Titles of one opening can differ by a plural: there the closing word must be no whole word.
    copies = near_copy_cuts(rows, scanned).groupBy("id", "field_name").agg(F.max("copies").alias("copies"))
    both = alone.join(copies, ["id", "field_name"], "left").withColumn("copy", F.col("copies").isNotNull() & (F.col("copies") | ~F.col("whole")))
    out = both.groupBy("id", "field_name").agg(F.max("source").alias("source"), F.max(F.col("cut") | F.col("copy")).alias("cut"), F.max("copy").alias("near_copy"))
    return out.select("id", "source", "field_name", "cut", "near_copy")


def truncation_by_source(df: DataFrame, key: str = "id", version: str | None = "ingested_at") -> DataFrame:
    """``(source, contents, contents_cut, content_share, titles, titles_cut, title_share)``, null sources included."""
    t = truncated(df, key, version)
    of = lambda f, cut: F.sum(F.when((F.col("field_name") == f) & (F.col("cut") | F.lit(not cut)), 1).otherwise(0)).alias(f"{f}s_cut" if cut else f"{f}s")
    out = t.groupBy("source").agg(of("content", False), of("content", True), of("title", False), of("title", True))
    share = lambda f: F.when(F.col(f"{f}s") > 0, F.col(f"{f}s_cut") / F.col(f"{f}s")).alias(f"{f}_share")
    return out.select("source", "contents", "contents_cut", share("content"), "titles", "titles_cut", share("title"))
