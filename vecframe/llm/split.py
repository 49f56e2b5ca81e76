"""Splitting of texts over a size limit at the strongest boundaries, with an exact overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecframe.llm.shingles import alnum_table
from vecframe.llm.vectors import fresh

#: Strengths of a cut: before a heading or after a blank line, at a line end, after a sentence, after a clause,
#: at white space, between two characters of a script without spaces, inside a word, inside a character.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, IDEOGRAPH, WORD, NEVER = 7, 6, 5, 4, 3, 2, 1, 0
_STRENGTH_SHIFT = 40
#: Positions indexed at once; longer texts move the index along.
BLOCK = 1 << 18

_CLASSES: dict[str, np.ndarray] | None = None


def _classes() -> dict[str, np.ndarray]:
    """Boolean tables over all code points."""
    global _CLASSES
    if _CLASSES is None:
        import unicodedata

        def table(chars: str) -> np.ndarray:
            t = np.zeros(0x110000, dtype=bool)
            t[[ord(c) for c in chars]] = True
            return t

        joined = np.zeros(0x110000, dtype=bool)
        for i in range(0x300, 0x110000):
            if i in (0x200D, 0xFE0E, 0xFE0F, 0x20E3) or 0x1F3FB <= i <= 0x1F3FF or 0xE0020 <= i <= 0xE007F or unicodedata.combining(chr(i)):
                joined[i] = True
        cjk = np.zeros(0x110000, dtype=bool)
        for a, b in ((0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):
            cjk[a : b + 1] = True
        space = np.fromiter((chr(i).isspace() for i in range(0x110000)), dtype=bool, count=0x110000)
        _CLASSES = {
            "space": space,
            "newline": table("\n\r\x0b\x0c\x85  "),
            "stop": table(".!?…"),
            "wide_stop": table("。！？；"),
            "clause": table(",;:)]}—–"),
            "wide_clause": table("，、："),
            "close": table("\"'”’»)]}」』"),
            "joined": joined,
            "cjk": cjk,
        }
    return _CLASSES


def cut_strengths(cps: np.ndarray) -> np.ndarray:
    """Strength of a cut before each of the code points (index 0 and the end are not asked for)."""
    c = _classes()
    n = len(cps)
    s = np.full(n, WORD, dtype=np.int8)
    if n < 2:
        return s
    prev, cur = cps[:-1], cps[1:]
    alnum = alnum_table()
    out = s[1:]
    p_space, c_space = c["space"][prev], c["space"][cur]
    out[(c["cjk"][prev] | c["cjk"][cur])] = IDEOGRAPH
    out[~(alnum[prev] & alnum[cur]) & ~(c["cjk"][prev] & c["cjk"][cur])] = IDEOGRAPH
    out[p_space & ~c_space] = SPACE
    # What the white space before the cut follows: the last character that is none.
    at = np.where(~c["space"][cps], np.arange(n), -1)
    last = np.maximum.accumulate(at)[:-1]
    before = cps[np.maximum(last, 0)]
    closing = c["close"][before] & (last > 0)
    before = np.where(closing, cps[np.maximum(last - 1, 0)], before)
    after_space = p_space & ~c_space
    out[after_space & c["clause"][before]] = CLAUSE
    out[c["wide_clause"][prev]] = CLAUSE
    out[after_space & c["stop"][before]] = SENTENCE
    out[c["wide_stop"][prev] & ~c["close"][cur] & ~c_space] = SENTENCE
    # Line ends within the white space before the cut; CRLF is one.
    ends = c["newline"][cps].copy()
    ends[1:] &= ~((cps[1:] == 10) & (cps[:-1] == 13))
    lines = np.cumsum(ends)
    count = lines[:-1] - np.where(last >= 0, lines[np.maximum(last, 0)], 0)
    out[after_space & (count >= 1)] = LINE
    out[after_space & (count >= 2)] = PARAGRAPH
    out[c["joined"][cur] | (prev == 0x200D) | ((prev == 13) & (cur == 10))] = NEVER
    return s


class MaxIndex:
    """Sparse table over keys: the largest of any window of up to ``span`` keys in constant time."""

    def __init__(self, keys: np.ndarray, span: int) -> None:
        self.levels = [keys]
        width = 1
        while 2 * width <= min(span, len(keys)):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-width], low[width:]))
            width *= 2

    def query(self, a: int, b: int) -> int:
        """Largest key in ``[a, b]``."""
        k = min((b - a + 1).bit_length() - 1, len(self.levels) - 1)
        level = self.levels[k]
        return int(max(level[a], level[b - (1 << k) + 1]))


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open spans of the pieces of a text.

    Each has at most ``limit`` characters; each but the first starts ``overlap`` characters before the end of the
    one before it. A piece ends at the strongest boundary that leaves it at least half as long as allowed (longer
    than the overlap in any case), the rightmost of equal ones. An overlap of the limit or more counts as one less.
    """
    n, limit = len(text), max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [(0, n)]
    least = max(overlap + 1, (limit + 1) // 2)
    spans: list[tuple[int, int]] = []
    start, base, index = 0, 0, None
    block = max(BLOCK, 8 * limit)
    upto = 0
    while n - start > limit:
        a, b = start + least, start + limit
        if index is None or b >= upto:
            # One character of context on the left, so that the strength at the first position is right.
            base = max(0, start - 1)
            upto = min(n, base + block)
            ahead = min(n, upto + 1)
            cps = np.frombuffer(text[base:ahead].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            keys = (cut_strengths(cps).astype(np.int64) << _STRENGTH_SHIFT) | np.arange(len(cps), dtype=np.int64)
            index, upto = MaxIndex(keys, limit), base + len(keys)
        cut = base + (index.query(a - base, b - base) & ((1 << _STRENGTH_SHIFT) - 1))
        spans.append((start, cut))
        start = cut - overlap
    spans.append((start, n))
    return spans


def split_oversized(
    df: DataFrame,
    limits: DataFrame,
    key: str = "id",
    text: str = "content",
    group: str = "partition_name",
    limit: str = "max_chars",
    overlap: str = "overlap_chars",
    version: str | None = "ingested_at",
    with_text: bool = True,
) -> DataFrame:
    """``(key, piece, start_char, end_char[, piece_text])`` of each text longer than the limit of its group.

    ``limits`` has the limit and overlap per group; a group without a limit (null included) is not cut, nor are null
    texts. Of rows of one key the last by ``version`` counts (ties: any one of them; such rows repeat each other).
    Only texts over their limit are shuffled or handed to Python. Clashing column names do not matter: only the
    named columns are read.
    """
    lim = limits.select(F.col(group).alias("_g"), F.col(limit).cast("int").alias("_max"), F.col(overlap).cast("int").alias("_lap"))
    lim = lim.where("_g is not null and _max is not null").groupBy("_g").agg(F.min(F.struct("_max", "_lap")).alias("_m")).select("_g", "_m._max", "_m._lap")
    rows = df.select(F.col(key).alias("_k"), F.col(group).alias("_g"), F.col(text).cast("string").alias("_t"), (F.col(version) if version else F.lit(0)).alias("_v"))
    if version:
        rows = fresh(rows, "_k", "_v", keep_null=True)
    over = rows.join(lim, "_g").where(F.length("_t") > F.col("_max"))
    if version:
        # Rows of one key and version: any one of them.
        over = over.groupBy("_k").agg(F.max(F.struct("_t", "_max", "_lap")).alias("_r")).select("_k", "_r.*")
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType)]
        + [T.StructField(c, T.IntegerType()) for c in ("piece", "start_char", "end_char")]
        + ([T.StructField("piece_text", T.StringType())] if with_text else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_at, numbers, starts, ends, texts = [], [], [], [], []
            columns = [batch.column(i).to_pylist() for i in (1, 2, 3)]
            for i, (t, m, lap) in enumerate(zip(*columns, strict=True)):
                for j, (a, b) in enumerate(pieces(t, m, lap or 0)):
                    rows_at.append(i)
                    numbers.append(j)
                    starts.append(a)
                    ends.append(b)
                    if with_text:
                        texts.append(t[a:b])
            arrays = [batch.column(0).take(pa.array(rows_at, pa.int64()))] + [pa.array(x, pa.int32()) for x in (numbers, starts, ends)]
            yield pa.RecordBatch.from_arrays(arrays + ([pa.array(texts, pa.string())] if with_text else []), names=schema.fieldNames())

    return over.select("_k", "_t", "_max", "_lap").mapInArrow(run, schema)
