"""Publication-time joins: values a forecaster could have known at its forecast origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.plans.asof import asof_rows, matched
from voltframe.plans.prefix_median import ROWS_PER_CHUNK, running_median
from voltframe.session import durable


def _require(df: DataFrame, needed: Sequence[str], what: str) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} missing columns: {missing}")


def _ties(measurements: DataFrame) -> list[str]:
    return [c for c in ("interval_start", "revision", "event_id") if c in measurements.columns]


def _rows(measurements: DataFrame, origins: DataFrame, by: Sequence[str], value: str, pieces: int | None, **more) -> DataFrame:
    _require(measurements, ["published_at", "interval_start", value, *by], "measurements")
    _require(origins, ["forecast_origin", "valid_time", *by], "origins")
    return asof_rows(
        origins, measurements, left_on="forecast_origin", right_on="published_at", by=by, tie_break=_ties(measurements), pieces=pieces, **more
    )


def asof_values(
    measurements: DataFrame,
    origins: DataFrame,
    *,
    by: Sequence[str] = (),
    value: str = "value",
    pieces: int | None = None,
) -> DataFrame:
    """Each origin with the whole last measurement published at or before it, and ``is_missing``."""
    joined = matched(_rows(measurements, origins, by, value, pieces), by)
    return joined.withColumn("is_missing", F.col(value).isNull())


def asof_features(
    measurements: DataFrame,
    origins: DataFrame,
    *,
    by: Sequence[str] = (),
    value: str = "value",
    pieces: int | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``asof_values`` with missing values replaced by the median of all earlier publications.

    The median at an origin depends only on how many values were published by then (``_known``), which the as-of pass counts along
    the way. It is computed once per such number, and only for numbers that a missing value asks for.
    """
    keys = list(by)
    # Read several times below, so it is stored once instead of being recomputed.
    rows = durable(_rows(measurements, origins, by, value, pieces, known=F.col(value).isNotNull()))
    joined = matched(rows, by, "_known").withColumn("is_missing", F.col(value).isNull())
    last = (F.col("_known") - 1).alias("seq")
    numbered = rows.filter((F.col("_side") == 0) & F.col("_right")[value].isNotNull()).select(*keys, last, F.col("_right")[value].alias("_value"))
    wanted = joined.filter(F.col("is_missing") & (F.col("_known") > 0)).select(*keys, last).distinct()
    medians = running_median(numbered, wanted, keys=keys, value="_value", rows_per_chunk=rows_per_chunk)
    # One row per number of known values: keys travel as a struct, so that null keys meet as well.
    place = F.struct(*keys, F.col("seq"))
    fallback = medians.select(place.alias("_place"), "running_median")
    out = joined.withColumn("seq", F.when(F.col("is_missing"), F.col("_known") - 1)).withColumn("_place", place)
    out = out.join(fallback, "_place", "left").drop("_place", "seq", "_known")
    filled = F.when(F.col("is_missing"), F.col("running_median")).otherwise(F.col(value))
    method = (
        F.when(~F.col("is_missing"), "none")
        .when(F.col("running_median").isNotNull(), "prior_median")
        .otherwise("unavailable")
    )
    return out.withColumn("imputation_method", method).withColumn(value, filled).drop("running_median")
