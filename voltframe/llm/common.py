"""Shared pieces of the text operators: tables, shared storage, joins that survive hot keys."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.session import configure

# A key with more than 1/HEAVY_KEYS of all rows is heavy, so there are fewer than HEAVY_KEYS heavy keys.
HEAVY_KEYS = 2000
ARROW_ROWS = 512
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators: Arrow batches of a bounded number of documents, and workers that find this package."""
    configure(spark)
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) != str(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share; only local sessions (tests) may do without ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voltframe-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps neither repeat its work nor its lineage."""
    path = f"{shared_folder(df.sparkSession)}/voltframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_join(facts: DataFrame, groups: DataFrame, keys: Sequence[str], weight: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``facts`` with one row per key from ``groups``, whatever the skew of the keys.

    ``groups`` must be stored and name in ``weight`` the number of fact rows of its key, ``total`` of all.
    Heavy keys, of which there are fewer than ``HEAVY_KEYS``, are broadcast; their fact rows take part in
    the shuffled join under a key of their own (``spread``) that matches nothing and is even.
    """
    payload = [c for c in groups.columns if c not in keys]
    heavy = groups.filter(F.col(weight) * HEAVY_KEYS > F.lit(total))
    light = groups.filter(F.col(weight) * HEAVY_KEYS <= F.lit(total))
    hot = heavy.select(*keys, F.struct(*payload).alias("_hot"))
    first = facts.join(F.broadcast(hot), list(keys), "left").withColumn(
        "_lane", F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(F.abs(F.hash(spread)).cast("long") + 1)
    )
    cold = light.select(*keys, F.struct(*payload).alias("_cold")).withColumn("_lane", F.lit(0).cast("long"))
    joined = first.join(cold, [*keys, "_lane"], "left")
    return joined.select(*facts.columns, *[F.coalesce(F.col("_hot")[c], F.col("_cold")[c]).alias(c) for c in payload])
