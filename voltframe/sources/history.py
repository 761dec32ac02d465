"""Historical market tables in Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.functions.hashing import uuid5_url
from voltframe.operators.series import latest_revision, resample, series_summary
from voltframe.schemas import SCHEMA_VERSION, unit_for_target

# Dataset folder per target and the layouts searched, first match wins.
DATASETS = {"demand": "actual_load", "price": "day_ahead_prices"}
LAYOUTS = ("hf_staging/data", "data/processed", "data", "")


def dataset_name(target: str) -> str:
    return DATASETS.get(target, target)


def resolve_dataset(spark: SparkSession, root: str, name: str) -> str:
    """Path of the first layout that holds Parquet files, on any Hadoop file system."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    candidates = ["/".join(p for p in (root.rstrip("/"), layout, name) if p) for layout in LAYOUTS]
    for candidate in candidates:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{candidate}/*.parquet")
        if pattern.getFileSystem(hadoop).globStatus(pattern):
            return candidate
    return candidates[0]


def read_history(spark: SparkSession, root: str, target: str) -> DataFrame:
    """Raw rows with UTC ``timestamp_utc``."""
    df = spark.read.parquet(resolve_dataset(spark, root, dataset_name(target)))
    return df.withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp"))


def filter_history(
    df: DataFrame,
    *,
    country_code: str | None = None,
    zone: str | None = None,
    start_year: int | None = None,
    end_year: int | None = None,
    start_time: Column | None = None,
    end_time: Column | None = None,
) -> DataFrame:
    """Inclusive bounds; every condition is on plain columns, so it reaches the Parquet scan."""
    ts, conditions = F.col("timestamp_utc"), []
    if country_code is not None:
        conditions.append(F.col("country_code") == country_code)
    if zone is not None:
        match = F.col("zone_key") == zone
        conditions.append(match | (F.col("eic_code") == zone) if "eic_code" in df.columns else match)
    if start_year is not None:
        conditions.append(ts >= F.lit(f"{start_year}-01-01 00:00:00").cast("timestamp"))
    if end_year is not None:
        conditions.append(ts <= F.lit(f"{end_year}-12-31 23:59:59").cast("timestamp"))
    if start_time is not None:
        conditions.append(ts >= start_time)
    if end_time is not None:
        conditions.append(ts <= end_time)
    for condition in conditions:
        df = df.filter(condition)
    return df


def ambiguous_zones(df: DataFrame) -> DataFrame:
    """Countries with several bidding zones; they need a chosen zone to give one series."""
    pairs = df.filter(F.col("zone_key").isNotNull()).select("country_code", "zone_key").distinct()
    return pairs.groupBy("country_code").agg(F.count(F.lit(1)).alias("zones")).filter("zones > 1")


def require_single_zone(df: DataFrame, country_code: str) -> None:
    if ambiguous_zones(df.filter(F.col("country_code") == country_code)).head(1):
        raise ValueError(f"country {country_code} has multiple bidding zones; specify a zone")


def load_raw_table(df: DataFrame, *, keys: Sequence[str] = ("country_code", "zone_key"), **filters) -> DataFrame:
    """Filtered rows, newest revision per series and time stamp."""
    chosen = filter_history(df, **filters)
    by = [*[k for k in keys if k in df.columns], "timestamp_utc"]
    if "revision_number" not in df.columns:
        return chosen.dropDuplicates(by)
    ties = ["record_id"] if "record_id" in df.columns else []
    return latest_revision(chosen, by, revision="revision_number", ties=ties)


def value_column(df: DataFrame) -> str:
    return "load" if "load" in df.columns else "price"


def load_series(
    df: DataFrame,
    *,
    keys: Sequence[str] = ("country_code", "zone_key"),
    resample_seconds: int | None = None,
    **filters,
) -> DataFrame:
    """Clean series ``(keys..., valid_time, value)``; resampling fills gaps of up to four steps."""
    rows = load_raw_table(df, keys=keys, **filters).select(
        *keys,
        F.col("timestamp_utc").alias("valid_time"),
        F.col(value_column(df)).cast("double").alias("value"),
    )
    return resample(rows, keys=keys, seconds=resample_seconds) if resample_seconds else rows


def list_zones(df: DataFrame) -> DataFrame:
    return df.select("country_code", "zone_key", "zone_name").distinct().orderBy("country_code", "zone_key")


def summarize(df: DataFrame, target: str, *, keys: Sequence[str] = ("country_code", "zone_key"), **filters) -> DataFrame:
    summary = series_summary(load_series(df, keys=keys, **filters), keys=keys)
    return summary.withColumns(
        {"dataset_type": F.lit(dataset_name(target)), "unit": F.lit(unit_for_target(target))}
    )


def interval_minutes(resolution: Column) -> Column:
    return (
        F.when(resolution.contains("60") | resolution.contains("1H"), 60)
        .when(resolution.contains("30"), 30)
        .otherwise(15)
    )


def load_as_events(
    df: DataFrame, target: str, *, limit: int | None = None, keys: Sequence[str] = ("country_code", "zone_key"), **filters
) -> DataFrame:
    """History rows as canonical events; ``limit`` keeps the first rows by time."""
    rows = load_raw_table(df, keys=keys, **filters)
    if limit:
        rows = rows.orderBy("timestamp_utc", *keys).limit(limit)

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)

    start = F.col("timestamp_utc")
    minutes = interval_minutes(F.coalesce(optional("resolution", "string"), F.lit("PT15M")))
    value = F.col("load" if target == "demand" else "price").cast("double")
    value = F.when(~F.isnan(value), value)
    record = F.coalesce(optional("record_id", "string"), F.lit(""))
    revision = F.coalesce(optional("revision_number", "int"), F.lit(0))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        uuid5_url(F.concat(F.lit("entsoe-hist-"), record)).alias("event_id"),
        F.lit("entsoe_dataset").alias("source"),
        F.lit(target).alias("event_type"),
        F.col("zone_key").alias("area"),
        start.alias("interval_start"),
        F.timestamp_micros(F.unix_micros(start) + minutes.cast("long") * F.lit(60_000_000)).alias("interval_end"),
        start.alias("published_at"),
        start.alias("ingested_at"),
        value.alias("value"),
        F.lit(unit_for_target(target)).alias("unit"),
        F.when(revision == 0, 1).otherwise(revision).alias("revision"),
        F.when(value.isNull(), "missing").otherwise("valid").alias("quality_status"),
        F.lit(None).cast("string").alias("dimension"),
        record.alias("payload_checksum"),
    )
