"""Exact deduplication by skew-safe combining: local, per salt, then over the salt winners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm.common import documents, spread_join, stored

SALTS = 16


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normal: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, digest`` (binary).

    Every grouping compares digest and full content. Partial aggregation collapses the copies inside a
    task; a group's remaining rows, one per task, are merged in ``salts`` salted groups by the number of
    the task; the salt winners are merged last. So no task ever sees more than one row per map task of a
    group of copies. Only (id, digest) goes back to the rows: where one digest stands for one content
    that is exact, and digests seen with several contents are joined by content.

    Null text equals empty text. Of equal texts the largest id stays; null ids lose against any other. Rows that
    repeat an id with the same text are one document and share its verdict; ``group_size`` counts rows.
    An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), (normal(text) if normal else text).alias("_text"))
    keyed = rows.select("_id", digest(F.col("_text")).alias("_digest"), "_text")
    salted = (
        keyed.groupBy((F.spark_partition_id() % salts).alias("_salt"), "_digest", "_text")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        .groupBy("_digest", "_text")
        .agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    )
    contents = stored(salted.select("_digest", "_keep", "_n", F.xxhash64("_text").alias("_check")))
    clashing = contents.groupBy("_digest").agg(F.count(F.lit(1)).alias("_contents")).filter("_contents > 1")
    total = contents.agg(F.sum("_n")).first()[0] or 0
    facts = keyed.select("_id", "_digest")
    if clashing.isEmpty():
        joined = spread_join(facts, contents.drop("_check"), ["_digest"], "_n", total, F.col("_id"))
    else:
        shared = stored(clashing.select("_digest"))
        single = contents.drop("_check").join(shared, "_digest", "left_anti")
        clear = spread_join(facts.join(shared, "_digest", "left_anti"), stored(single), ["_digest"], "_n", total, F.col("_id"))
        several = stored(salted.join(shared, "_digest", "left_semi"))
        mixed = spread_join(
            keyed.join(shared, "_digest", "left_semi"), several, ["_digest", "_text"], "_n", total, F.col("_id")
        ).drop("_text")
        joined = clear.unionByName(mixed)
    return joined.select(
        F.col("_id").alias("id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest doc_id of each stays."""
    found = exact_dedup(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""
