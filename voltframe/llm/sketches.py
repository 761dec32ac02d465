"""Bottom-k sketches of word shingles: fingerprints that merge and estimate likeness."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from voltframe.llm.common import documents

K = 128
SHINGLE = 5
SEED = 42
CELLS = 65536
BUCKET_ROWS = 1024
SALTS = 16


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest distinct 64-bit hashes of a text's word shingles, sorted; all of them if there are fewer.

    Letters A-Z count as lower case; a text of fewer words than a shingle is one shingle, one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(joined.__getitem__, map(slice, starts[:n], ends[min(SHINGLE, len(words)) - 1 :]))
    return lowest(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n), k)


def lowest(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Merge: the k smallest distinct of these hashes, sorted."""
    hashes = np.sort(hashes)
    if len(hashes) > 1:
        hashes = hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]
    return hashes[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both; exact if both sketches are complete. Two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[:-1][both[1:] == both[:-1]]
    union = lowest(both, k)
    return float(np.searchsorted(twice, union[-1], side="right")) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: over the hashes of a up to the reach of both sketches."""
    if not len(a):
        return 1.0
    reach = min(s[-1] if len(s) == k else np.uint64(2**64 - 1) for s in (a, b)) if len(b) else np.uint64(2**64 - 1)
    own = a[a <= reach]
    return float(np.isin(own, b).sum()) / len(own) if len(own) else 0.0


def distinct_shingles(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact if the sketch is complete."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**64 / (float(s[-1]) + 1.0)


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), dtype="<u8")


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    names, types = None, None
    for batch in batches:
        names, types = batch.schema.names, batch.schema.types
        *keys, sketches = (c.to_pylist() for c in batch.columns)
        for *key, s in zip(*keys, sketches):
            one = from_text(s) if s else np.zeros(0, dtype="<u8")
            held[tuple(key)] = lowest(np.concatenate([held[tuple(key)], one])) if tuple(key) in held else one
    if names:
        columns = list(zip(*held)) + [tuple(to_text(s) for s in held.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def merge_sketches(parts: DataFrame, keys: list[str], sketch_col: str = "fingerprint") -> DataFrame:
    """One sketch per key from the sketches of its parts: equal to the sketch over all the parts' shingles together.

    Merged in each task, then in ``SALTS`` salted groups by task number, then by key. So a task gets one row per key and
    earlier task at most. Null sketches count as empty.
    """
    rows = parts.select(*keys, F.col(sketch_col).alias("_sketch"))
    local = rows.mapInArrow(_merging, rows.schema)
    salted = local.withColumn("_salt", F.spark_partition_id() % SALTS).repartition(*keys, "_salt").drop("_salt")
    merged = salted.mapInArrow(_merging, rows.schema).repartition(*keys)
    return merged.mapInArrow(_merging, rows.schema).withColumnRenamed("_sketch", sketch_col)


def in_turn(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``_bucket, _after`` for rows ``_id, _text``, dealt so that a bucket is a run of rows by descending id and text,
    closed by a copy of the row (``_after``) that follows its last one; after the last row of all comes the first.

    Ids are counted in at most ``CELLS`` cells of equal width; that histogram is all the driver sees, and its split into buckets
    is broadcast. The texts move once. Null ids come last.
    """
    spark = rows.sparkSession
    ends = rows.agg(F.min("_id"), F.max("_id"), F.count(F.lit(1))).first()
    low, high = (ends[0] - 1, ends[1]) if ends[0] is not None else (0, 0)
    width = (high - low) // CELLS + 1
    key = F.coalesce(F.col("_id"), F.lit(low)).cast("long")
    keyed = rows.select("_id", "_text", key.alias("_key"), F.expr(f"cast((coalesce(_id, {low}L) - {low}L) div {width}L AS int)").alias("_cell"))
    cells = keyed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_key").alias("top")).collect()
    buckets: list[list] = []
    plan = []
    for cell in sorted(cells, key=lambda c: -c["_cell"]):
        if not buckets or buckets[-1][1] >= bucket_rows:
            buckets.append([cell["top"], 0])
        buckets[-1][1] += cell["n"]
        plan.append((cell["_cell"], len(buckets) - 1))
    heads = [(b, (b - 1) % len(buckets)) for b in range(len(buckets))]
    place = spark.createDataFrame(
        [(c, b, buckets[b][0], heads[b][1]) for c, b in plan] or [(0, 0, 0, 0)], "_cell int, _own int, _top long, _before int"
    )
    copies = F.when(
        F.col("_key") == F.col("_top"),
        F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("a")), F.struct(F.col("_before").alias("b"), F.lit(True).alias("a"))),
    ).otherwise(F.array(F.struct(F.col("_own").alias("b"), F.lit(False).alias("a"))))
    dealt = keyed.join(F.broadcast(place), "_cell").select("_id", "_text", "_key", F.explode(copies).alias("_c"))
    return (
        dealt.select("_id", "_text", "_key", F.col("_c.b").alias("_bucket"), F.col("_c.a").alias("_after"))
        .repartition("_bucket")
        .sortWithinPartitions("_bucket", "_after", F.desc("_key"), F.desc("_text"))
        .select("_bucket", "_after", "_id", "_text")
    )


def edited(text: str, after: str) -> str:
    """The last half (rounded down) of a text's code points replaced by as many of the first ones of the next text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _printing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shingles"]
    for batch in batches:
        ids, out, source = [], [], batch.column(2)
        for row, (bucket, after, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
            if held is not None and held[0] == bucket and held[1]:
                continue  # more rows share the id of the row that closes the bucket
            own = sketch(text)
            if held is not None and held[0] == bucket:
                _, _, before, print_before, id_before = held
                change = edited(before, text)
                print_change = sketch(change)
                ids.append(id_before)
                out.append(
                    (
                        len(before), hashlib.sha256(change.encode("utf-8", "surrogatepass")).hexdigest(), to_text(print_before), to_text(print_change),
                        resemblance(print_before, print_change), resemblance(print_before, own), distinct_shingles(print_before),
                    )
                )
            held = (bucket, after, text, own, source[row].as_py())
        columns = list(zip(*out)) if out else [()] * 7
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(ids, source.type), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its sketch, that of its text with the second half taken from the next document, and how near they are.

    The next document is that of the next smaller id (of equal ids, by descending text); after the last comes the first. A single
    row is its own next. Null text counts as empty; empty sketches are alike. Ids are whole numbers; null ids come last.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    schema = T.StructType(
        [T.StructField("id", rows.schema["_id"].dataType), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next", "shingles")]
    )
    return in_turn(rows).mapInArrow(_printing, schema)


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints_with_next(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
