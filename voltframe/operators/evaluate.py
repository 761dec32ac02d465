"""Error slices of a pooled evaluation frame ``(keys..., valid_time, actual, predicted)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.functions.metrics import evaluate
from voltframe.functions.timegrid import local_time, market_timezone, season
from voltframe.plans.skew import order_statistics, quantile_rank


def abs_error() -> Column:
    return F.abs(F.col("actual") - F.col("predicted"))


def forecast_metrics(df: DataFrame, *, keys: Sequence[str], allow_wape: Column | bool = True) -> DataFrame:
    """All accuracy metrics per key from columns ``actual, p50, p10, p90``."""
    metrics = evaluate(
        F.col("actual"), F.col("p50"), F.col("p10"), F.col("p90"), allow_wape=allow_wape
    )
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *metrics)


def slice_by_hour(df: DataFrame, *, keys: Sequence[str], country_code: str = "ES") -> DataFrame:
    local = local_time(F.col("valid_time"), market_timezone(country_code))
    return df.groupBy(*keys, F.hour(local).alias("hour")).agg(
        F.avg(abs_error()).alias("mae"), F.count(F.lit(1)).alias("n")
    )


def slice_by_season_and_day_type(df: DataFrame, *, keys: Sequence[str], country_code: str = "ES") -> DataFrame:
    """Both slices from one pass over the data."""
    local = local_time(F.col("valid_time"), market_timezone(country_code))
    labelled = df.withColumns(
        {
            "_season": season(F.month(local)),
            "_day_type": F.when(F.weekday(local) >= 5, "Weekend").otherwise("Weekday"),
            "_error": abs_error(),
        }
    )
    # Sums and counts per (season, day type) are tiny; both slices are rolled up from them.
    cells = labelled.groupBy(*keys, "_season", "_day_type").agg(
        F.sum("_error").alias("_sum"), F.count("_error").alias("_n")
    )
    slices = cells.select(
        *keys,
        "_sum",
        "_n",
        F.explode(
            F.array(
                F.struct(F.lit("season").alias("dimension"), F.col("_season").alias("slice")),
                F.struct(F.lit("day_type").alias("dimension"), F.col("_day_type").alias("slice")),
            )
        ).alias("_s"),
    )
    return slices.groupBy(*keys, F.col("_s.dimension").alias("dimension"), F.col("_s.slice").alias("slice")).agg(
        (F.sum("_sum") / F.sum("_n")).alias("mae"), F.sum("_n").alias("n")
    )


def slice_by_regime(
    df: DataFrame,
    *,
    keys: Sequence[str],
    is_price: Column | bool = False,
    peak_quantile: float = 0.95,
    spike: float = 150.0,
) -> DataFrame:
    """Error at and above the 95th percentile of the actuals and below it; price regimes if present."""
    peaks = order_statistics(
        df, keys=keys, value="actual", ranks={"q95": quantile_rank(peak_quantile)}
    ).select(*keys, "q95")
    price = F.lit(is_price) if isinstance(is_price, bool) else is_price
    marked = df.join(peaks, list(keys)).withColumn("_error", abs_error())
    regimes = F.array_compact(
        F.array(
            F.when(F.col("actual") >= F.col("q95"), "peak").otherwise("normal"),
            F.when(price & (F.col("actual") < 0), "negative_price"),
            F.when(price & (F.col("actual") > spike), "price_spike"),
        )
    )
    return (
        marked.select(*keys, "_error", F.explode(regimes).alias("regime"))
        .groupBy(*keys, "regime")
        .agg(F.avg("_error").alias("mae"), F.count(F.lit(1)).alias("n"))
    )
