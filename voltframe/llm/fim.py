"""Fill-in-middle: documents cut at line boundaries that a learned rank index finds, rearranged with sentinels.

The index of a document is a piecewise-linear model of all its boundary offsets (rank -> offset) whose segments stay within an
error bound, plus one small residual per boundary. A cut is predicted from its segment and corrected by its residual, so it is exact.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.llm.common import documents

# Residuals of segments within this bound fit one signed byte.
ERROR = 126.0
NEWLINE = 10


@dataclass
class RankIndex:
    """Segments ``(first rank, first offset, slope)`` over boundary offsets and the residual of every boundary."""

    firsts: list[int]
    bases: list[int]
    slopes: list[float]
    residuals: np.ndarray

    @classmethod
    def fit(cls, offsets: Sequence[int], error: float = ERROR) -> RankIndex:
        """One pass: a segment starts at its first boundary and ends where no slope is within ``error`` of all its boundaries."""
        firsts, bases, slopes = [0], [offsets[0]], []
        low, high = -np.inf, np.inf
        first, base = 0, offsets[0]
        for rank in range(1, len(offsets)):
            run, rise = rank - first, offsets[rank] - base
            least, most = (rise - error) / run, (rise + error) / run
            if least > high or most < low:
                slopes.append((low + high) / 2)
                first, base = rank, offsets[rank]
                firsts.append(first)
                bases.append(base)
                low, high = -np.inf, np.inf
            else:
                low, high = max(low, least), min(high, most)
        slopes.append((low + high) / 2 if high < np.inf else 0.0)
        index = cls(firsts, bases, slopes, np.zeros(0, np.int8))
        wide = np.asarray(offsets, np.int64) - index._predict_all(len(offsets))
        reach = int(np.abs(wide).max())
        index.residuals = wide.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if reach <= np.iinfo(t).max))
        return index

    def _predict_all(self, n: int) -> np.ndarray:
        lengths = np.diff([*self.firsts, n])
        run = np.arange(n) - np.repeat(self.firsts, lengths)
        return np.repeat(np.asarray(self.bases, np.int64), lengths) + np.floor(np.repeat(self.slopes, lengths) * run + 0.5).astype(np.int64)

    def predict(self, rank: int) -> int:
        s = bisect_right(self.firsts, rank) - 1
        return self.bases[s] + int(np.floor(self.slopes[s] * (rank - self.firsts[s]) + 0.5))

    def offset(self, rank: int) -> int:
        """The exact offset of a boundary: its prediction and its residual."""
        return self.predict(rank) + int(self.residuals[rank])

    def rank(self, offset: int) -> int:
        """The last boundary at or before an offset: a guess by its segment's slope, walked to the right place."""
        s = max(0, bisect_right(self.bases, offset) - 1)
        end = self.firsts[s + 1] if s + 1 < len(self.firsts) else len(self.residuals)
        guess = self.firsts[s] + (int((offset - self.bases[s]) / self.slopes[s]) if self.slopes[s] > 0 else 0)
        guess = min(max(guess, self.firsts[s]), end - 1)
        while guess + 1 < len(self.residuals) and self.offset(guess + 1) <= offset:
            guess += 1
        while guess > 0 and self.offset(guess) > offset:
            guess -= 1
        return guess


def line_offsets(text: str) -> list[int]:
    """Code-point offsets of all line boundaries: 0, the place after each line feed, and the end of a last line without one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    offsets = [0, *(np.flatnonzero(points == NEWLINE) + 1).tolist()]
    if offsets[-1] != len(text):
        offsets.append(len(text))
    return offsets


@dataclass(frozen=True)
class FimPlan:
    """Seed, shares in per cent of rearranged documents and of suffix-first ones among these, sentinels, the index's error bound."""

    seed: str = "7"
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    error: float = ERROR

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or any(a in b for a, b in permutations(marks, 2)):
            raise ValueError("sentinels must be distinct, not empty, and none may hold another")
        if any(a[-n:] == b[:n] for a, b in product(marks, marks) for n in range(1, min(len(a), len(b)))):
            raise ValueError("no sentinel may begin as another one ends, or texts could not be restored")

    def arrange(self, key: str, text: str) -> tuple[int, str, int | None, int | None, str, int]:
        """``(lines, form, prefix length, middle length, output, segments)`` of a text."""
        offsets = line_offsets(text)
        n = len(offsets) - 1
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not text or h3 % 100 >= self.rate or self.prefix in text or self.suffix in text or self.middle in text:
            return n, "plain", None, None, text, 0
        index = RankIndex.fit(offsets, self.error)
        one, two = h1 % (n + 1), h2 % (n + 1)
        start, end = index.offset(min(one, two)), index.offset(max(one, two))
        head, body, tail = text[:start], text[start:end], text[end:]
        if h4 % 100 < self.spm_rate:
            form, output = "spm", f"{self.suffix}{tail}{self.prefix}{head}{self.middle}{body}"
        else:
            form, output = "psm", f"{self.prefix}{head}{self.suffix}{tail}{self.middle}{body}"
        return n, form, start, end - start, output, len(index.firsts)


def fill_in_middle(docs: DataFrame, plan: FimPlan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output, segments`` per row: the text cut at two line boundaries and rearranged.

    The cuts follow from the seed and the id alone. Empty texts, texts that hold a sentinel and those beyond the rate stay plain
    (null lengths). A null text counts as empty, a null id as an empty key; repeated rows give equal rows. Texts are never shortened;
    one text and its index are in memory at a time besides the Arrow batch.
    """
    plan = plan or FimPlan()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    schema = T.StructType(
        [T.StructField("id", rows.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("prefix_chars", "middle_chars")]
        + [T.StructField("output", T.StringType()), T.StructField("segments", T.LongType())]
    )
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def arranging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(map(plan.arrange, batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            columns = zip(*done) if done else [()] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=schema.names)

    return rows.select("id", key.alias("_key"), "_text").mapInArrow(arranging, schema)


def restored(output: str | Column, form: str | Column, plan: FimPlan | None = None) -> Column:
    """The text that an output came from, rebuilt from output and form alone, with SQL functions."""
    plan = plan or FimPlan()
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    body = F.substring_index(out, plan.middle, -1)
    front = F.substring_index(out, plan.middle, 1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        opening = F.substring_index(front, second, 1)
        return F.substr(opening, F.lit(len(first) + 1)), F.substring_index(front, second, -1)

    head, tail = parts(plan.prefix, plan.suffix)
    last, lead = parts(plan.suffix, plan.prefix)
    return F.when(form == "psm", F.concat(head, body, tail)).when(form == "spm", F.concat(lead, body, last)).otherwise(out)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cuts, and digests of its output and of the text rebuilt from it."""
    return fill_in_middle(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
    FROM documents
), c AS (
    SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM d
), p AS (
    SELECT doc_id, n, form, t, array_to_string(u[1:least(a, b)], '') AS head,
           array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS body, array_to_string(u[greatest(a, b) + 1:], '') AS tail
    FROM c
), o AS (
    SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || body
                   ELSE '<S>' || tail || '<P>' || head || '<M>' || body END AS out
    FROM p
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(head) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(body) END AS middle_chars, sha256(out) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
