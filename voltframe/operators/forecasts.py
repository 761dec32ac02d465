"""Forecast rows as tables: validity, upserts and serving queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltframe.functions.timegrid import local_delivery_date
from voltframe.operators.series import latest_by
from voltframe.schemas import FORECAST_KEY

STALE_AFTER_SECONDS = 30 * 60


def forecast_problem() -> Column:
    """Name of the violated rule, null for a valid forecast row."""
    ordered = (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90"))
    return (
        F.when(~F.coalesce(ordered, F.lit(False)), "quantile_order")
        .when(F.col("valid_to") <= F.col("valid_from"), "interval_order")
    )


def invalid_forecasts(df: DataFrame) -> DataFrame:
    return df.withColumn("problem", forecast_problem()).filter(F.col("problem").isNotNull())


def upsert_by_natural_key(log: DataFrame, *, order: Sequence[str], keys: Sequence[str] = FORECAST_KEY) -> DataFrame:
    """Fold a log of writes: the first ``forecast_id`` of a key survives, later writes replace the rest.

    One aggregation with partial results per task; repeated writes of one key merge before the
    shuffle.
    """
    rest = [c for c in log.columns if c not in (*keys, *order, "forecast_id")]
    position = F.struct(*order)
    folded = log.groupBy(*keys).agg(
        F.min_by("forecast_id", position).alias("forecast_id"),
        F.max_by(F.struct(*rest), position).alias("_latest"),
    )
    return folded.select(
        "forecast_id", *keys, *[F.col("_latest")[c].alias(c) for c in rest]
    )


def upsert_by_id(log: DataFrame, *, order: Sequence[str], key: str = "forecast_id") -> DataFrame:
    """Last write per id."""
    return latest_by(log, [key], [F.col(c) for c in order])


def latest_issue(df: DataFrame, *, by: Sequence[str] = ("target", "area")) -> DataFrame:
    """Newest issue time per product among published (non-shadow) forecasts."""
    return df.filter(~F.col("is_shadow")).groupBy(*by).agg(F.max("issue_time").alias("issue_time"))


def latest_forecasts(
    df: DataFrame,
    *,
    by: Sequence[str] = ("target", "area"),
    issue_time: Column | None = None,
    limit: int | None = None,
    delivery_date: Column | None = None,
) -> DataFrame:
    """Rows of the latest (or given) issue per product, of one local delivery date if asked for.

    ``limit`` keeps the first so many intervals of each product, with all their rows.
    """
    published = df.filter(~F.col("is_shadow"))
    if issue_time is None:
        chosen = published.join(latest_issue(df, by=by), [*by, "issue_time"])
    else:
        chosen = published.filter(F.col("issue_time") == issue_time)
    if delivery_date is not None:
        chosen = chosen.filter(local_delivery_date(F.col("valid_from")) == delivery_date)
    if limit is None:
        return chosen
    order = Window.partitionBy(*by).orderBy("valid_from")
    return chosen.withColumn("_rank", F.dense_rank().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def query_forecasts(
    df: DataFrame, target: str, area: str, *, limit: int | None = None, **options: Column
) -> DataFrame:
    """The single-product form of ``latest_forecasts``, ordered by time."""
    chosen = df.filter((F.col("target") == target) & (F.col("area") == area))
    return latest_forecasts(chosen, limit=limit, **options).orderBy("valid_from")


def demand_horizon(df: DataFrame, hours: int, **options) -> DataFrame:
    """Demand of the latest issue in the 1 to 6 hours from each product's first interval, all model versions."""
    if not 1 <= hours <= 6:
        raise ValueError("hours must be between 1 and 6")
    by = list(options.get("by", ("target", "area")))
    current = latest_forecasts(df.filter(F.col("target") == "demand"), **options)
    first = current.groupBy(*by).agg(F.min("valid_from").alias("_first"))
    near = F.col("valid_from") < F.col("_first") + F.make_interval(hours=F.lit(hours))
    return current.join(first, by).filter(near).drop("_first")


def day_ahead_prices(df: DataFrame, delivery_date: Column, **options) -> DataFrame:
    """One local delivery day of prices, all intervals and model versions."""
    return latest_forecasts(df.filter(F.col("target") == "price"), delivery_date=delivery_date, **options)


def with_staleness(df: DataFrame, now: Column, stale_after: int = STALE_AFTER_SECONDS) -> DataFrame:
    age = F.unix_seconds(now) - F.unix_seconds("issue_time")
    return df.withColumns({"age_seconds": age, "is_stale": age > stale_after})
