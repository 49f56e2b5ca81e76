"""Keyword-stuffed pages, link lists and heaps of tags, found by the shapes of their lines.

Every line is cut into units (sentences, list entries), and every unit reduced to a shape: what it holds (a link,
letters strung apart, words), its word count, its capitals, its separators and its end. Units of one shape are
counted together; a shape is a sentence's if its units carry the small words that no sentence of the language does
without, or, in a language whose small words are not known, if its units begin, end and go on as sentences do. A page is
flagged if more than half of its words stand in shapes that are no sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Articles, pronouns, prepositions, conjunctions and auxiliaries of the languages in the tables.
FUNCTION_WORDS = frozenset(
    """
    a an the this that these those each every any some no its our your my his her their another one
    of to in on at by for from with without within into onto over under between beyond behind beside before after
    across around through during against despite except near past inside about as than until unless because since
    while whereas although so but and or if when where why how what which who whose not cannot
    is are was were be been has have had does do did can could will would shall should may might must we it they you
    der die das den dem des ein eine einen einem einer keine kein jede jeder jedes diese dieser dieses
    und oder aber weil obwohl sobald während wenn ob dass für mit ohne gegen durch über unter um von zu zum zur bei
    nach vor zwischen im am ist sind war wird werden kann nicht auch als wie sich es sie wir ich
    le la les un une des du de ce cette ces chaque aucune aucun et ou mais car donc lorsque puisque quand si que qui
    pour par avec sans sous sur vers contre après avant dans entre est sont était sera peut ne pas aux au il elle nous
    el los las una uno unos unas este esta esto estos estas cada ninguna ninguno ningún y o pero porque aunque mientras
    cuando si que para por con sin bajo sobre hacia contra tras desde entre en del al es son era será puede su sus
    """.split()
)
#: Share of the small words from which a unit of words reads as a sentence, and the share in a page of one shape.
SENTENCE_SHARE = 0.09
#: Different words of prose, as a multiple of the root of all its words.
VARIETY = 2.0
#: How many of a page's largest shapes are reported.
FEW_SHAPES = 24

_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
_TAG = re.compile(r"<[^<>]*>")
_LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|\[?(?:DEBUG|INFO|WARN|WARNING|ERROR|TRACE|FATAL)\b)")
_CODE = re.compile(
    r"^\s*(?:def|class|import|from|return|for|while|if|elif|else|try|except|with|raise|SELECT|INSERT|UPDATE|CREATE|let|const|var|fn|func|public|private)\b[^.]*[:;{(=]"
    r"|[={}]|\(\)|\w\(|::|->|^\s*[$>#%] |^\s*--?\w|;\s*$|^\s*[\w.\-/]+\s*:\s*[\w\"'\[\]./-]+\s*$|^\s*[\"'\[\]]"
)
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_SEPARATOR = re.compile(r"[,;/|~>·•»—–*+]|\s-\s")
#: Marks that string entries together in a line; so many of them make it a list.
_STRING = re.compile(r"\s+[~|/•·»*>–—]+\s+|[;,]\s*(?=\S)")
MANY_MARKS = 5
#: Characters that carry no text but can be strewn between letters.
_APART = re.compile(r"(?<=\w)[\u200b\u200c\u200d\u2060\ufeff\u00ad]+(?=\w)")


def _strung_apart(words: list[str]) -> bool:
    """Words taken apart into letters."""
    if len(words) < 6 or list(map(len, words)).count(1) <= 0.6 * len(words):
        return False
    return sum(len(w) == 1 and w.isalpha() for w in words) > 0.6 * len(words)


def _weight(words: list[str], unspaced: bool = True) -> int:
    """Number of words; scripts without spaces (in a text that has any) write about one in two characters."""
    if not unspaced:
        return len(words)
    return sum((len(w) + 1) // 2 if _CJK.search(w) else 1 for w in words)


def _entries(unit: str) -> list[str]:
    """A unit cut at its marks if they are many, else as it is."""
    marks = [m for m in _STRING.finditer(unit)]
    if len(marks) < MANY_MARKS:
        return [unit]
    return _STRING.split(unit)


def _caps(words: list[str]) -> str:
    letters = [w for w in words if w[0].isalpha()]
    upper = sum(w.isupper() and len(w) > 1 for w in letters)
    title = sum(w[0].isupper() for w in letters)
    if not letters:
        return "0"
    return "U" if upper > 0.6 * len(letters) else "T" if title > 0.6 * len(letters) else "i" if words[0][:1].isupper() else "l"


def _size(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-16" if n < 17 else "17-32" if n < 33 else "33+"


def unit_shape(unit: str, words: list[str]) -> tuple[str, bool]:
    """Shape of a unit of words without a link, and whether it reads as a sentence."""
    seps = len(_SEPARATOR.findall(unit))
    end = unit.rstrip()[-1:]
    runs = [w for w in words if _CJK.search(w)] if _CJK.search(unit) else []
    if 2 * len(runs) > len(words):
        chars = len(_CJK.findall(unit))
        sentence = chars >= 6 * len(runs) and (end in "。！？.!?" or chars >= 8 * len(runs)) and seps <= len(runs)
        return f"c{_size(len(words))}{'s' if seps else ''}{end if end in '。！？' else ''}", sentence
    small = sum(w in FUNCTION_WORDS for w in words)
    shape = f"w{_size(len(words))}{_caps(words)}{'s' if seps else ''}{end if end in '.!?:' else ''}"
    letters = sum(w[0].isalpha() for w in words)
    return shape, small >= max(1.0, SENTENCE_SHARE * letters)


def _built_like_a_sentence(unit: str, words: list[str]) -> bool:
    """Does a unit begin as a sentence, end as one, and hold words of many lengths that are not repeated?"""
    if len(words) < 5 or unit.rstrip()[-1:] not in tuple(".!?…؟۔։।") or len(_SEPARATOR.findall(unit)) > len(words) / 5:
        return False
    cased = [w for w in words if w[0].isupper() or w[0].islower()]
    if cased and not (words[0][0].isupper() and sum(w[0].isupper() for w in cased) <= 1 + 0.3 * len(cased)):
        return False
    lengths = {len(w) for w in words}
    return len(lengths) >= min(4, len(words) // 2) and min(lengths) <= 3 and len({w.lower() for w in words}) >= 0.8 * len(words)


def page_shapes(text: str) -> tuple[Counter, Counter, Counter, int]:
    """Words by shape of units that are links, keywords, and sentences or records; and all words."""
    links: Counter = Counter()
    keywords: Counter = Counter()
    other: Counter = Counter()
    # Units that are built like sentences but hold none of the small words: (shape, words, weight).
    unknown: list[tuple[str, list[str], int]] = []
    total = 0
    fenced = False
    unspaced = _CJK.search(text) is not None
    for line in text.splitlines():
        stripped = line.strip()
        if not stripped:
            continue
        words = _WORD.findall(line)
        if not words:
            fenced ^= stripped.startswith("```")
            continue
        n = _weight(words, unspaced)
        total += n
        if stripped.startswith("```"):
            fenced = not fenced
            other["code"] += n
            continue
        if fenced:
            other["code"] += n
            continue
        if _strung_apart(words):
            glued = _APART.sub("", line)
            keywords[f"x{_size(len(_WORD.findall(glued)))}"] += n
            continue
        urls = _URL.findall(line)
        if urls or "<a " in line or "</a>" in line:
            url_words = sum(len(_WORD.findall(u)) for u in urls)
            rest = _WORD.findall(_URL.sub(" ", _TAG.sub(" ", line)))
            tag_words = len(words) - url_words - len(rest)
            per = len(rest) / max(1, len(urls))
            shape, sentence = unit_shape(_URL.sub(" ", _TAG.sub(" ", line)), [w.lower() for w in rest]) if rest else ("w0", False)
            # A link entry is its link and a title; more text than that is prose that holds a link.
            if per <= 14 and not (sentence and stripped[-1] in ".!?。" and per > 6):
                links[f"a{_size(len(rest))}{'s' if len(urls) > 1 else ''}{'<' if tag_words > 2 else ''}"] += n
            elif sentence:
                links["a"] += url_words
                other[shape] += n - url_words
            else:
                links[f"a{shape}"] += n
            continue
        if _LOG.match(stripped):
            other["log"] += n
            continue
        if stripped[0] == "|" and stripped[-1] == "|" and stripped.count("|") >= 3 or stripped[0] == "#" and not stripped[:2].strip("#").isalnum():
            other["table"] += n
            continue
        for unit in [e for u in _END.split(stripped) for e in _entries(u)]:
            own = _WORD.findall(unit)
            if not own:
                continue
            shape, sentence = unit_shape(unit, [w.lower() for w in own])
            if sentence:
                other[shape] += _weight(own, unspaced)
            elif _CODE.search(unit) or any("_" in w.strip("_") for w in unit.split()):
                other["code"] += _weight(own, unspaced)
            elif _built_like_a_sentence(unit, own):
                unknown.append((shape, own, _weight(own, unspaced)))
            else:
                keywords[shape] += _weight(own, unspaced)
    # A language without known small words: its sentences go on with new words, keywords come again.
    words = [w.lower() for _, own, _ in unknown for w in own]
    prose = len(words) > 0 and len(set(words)) >= VARIETY * len(words) ** 0.5
    for shape, _, n in unknown:
        (other if prose else keywords)[shape] += n
    return links, keywords, other, total


def is_spam(text: str | None) -> bool:
    """Do more than half of the words stand in shapes that are no sentences?"""
    if not text:
        return False
    links, keywords, _, total = page_shapes(text)
    return 2 * (links.total() + keywords.total()) > total > 0


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text", few: int = FEW_SHAPES) -> DataFrame:
    """``(key, words, link_words, keyword_words, top_words, spam)`` of every row, in one pass without a shuffle.

    ``top_words`` are the words in the ``few`` largest shapes that are no sentences; ``spam`` is whether link and
    keyword words, of any number of shapes, are more than half. Null and empty texts have no words and are no spam; repeated rows give repeated results; other
    columns are not read.
    """
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("words", "link_words", "keyword_words", "top_words")]
        + [T.StructField("spam", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                links, keywords, _, total = page_shapes(t or "")
                top = sum(n for _, n in (links + keywords).most_common(few))
                rows.append((total, links.total(), keywords.total(), top, 2 * (links.total() + keywords.total()) > total > 0))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            arrays = [pa.array(c, type=pa.int32()) for c in cols[:4]] + [pa.array(cols[4], type=pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.fieldNames())

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def spam_shapes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(kind, shape, pages, words)``: how the corpus spreads over the shapes; partial sums before the shuffle."""
    schema = "kind string, shape string, pages bigint, words bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages: Counter = Counter()
            words: Counter = Counter()
            for t in batch.column(1).to_pylist():
                for kind, counts in zip(("link", "keyword", "other"), page_shapes(t or "")[:3], strict=True):
                    for shape, n in counts.items():
                        pages[kind, shape] += 1
                        words[kind, shape] += n
            keys = list(words)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([pages[k] for k in keys], pa.int64()), pa.array([words[k] for k in keys], pa.int64())],
                names=["kind", "shape", "pages", "words"],
            )

    parts = df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
    return parts.groupBy("kind", "shape").agg(F.sum("pages").alias("pages"), F.sum("words").alias("words"))
