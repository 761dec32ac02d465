"""Regular UTC series: revisions, interval expansion, resampling, summaries and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltframe.functions.timegrid import expand_to_quarters, floor_to
from voltframe.plans.skew import grid_position, with_halo_chunks
from voltframe.schemas import WEATHER_DIMENSIONS

FILL_LIMIT = 4


def latest_by(df: DataFrame, keys: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """The row per key that is greatest by ``by`` (nulls lowest).

    An aggregation: each task keeps one row per key before the shuffle, however often a key repeats.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(by)])
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*keys, "_row.*").select(*df.columns)


def latest_revision(
    df: DataFrame, keys: Sequence[str], revision: str = "revision", ties: Sequence[str] = ()
) -> DataFrame:
    """Newest revision per key (keys include the time stamp); ties settle by ``ties``, greatest wins."""
    return latest_by(df, keys, [F.col(revision), *[F.col(c) for c in ties]])


def events_to_series(
    events: DataFrame, target: str | None = None, *, keys: Sequence[str] = ("area",)
) -> DataFrame:
    """Revision-aware quarter-hour series from interval events (null values are skipped)."""
    chosen = events.filter(F.col("value").isNotNull())
    if target is not None:
        chosen = chosen.filter(F.col("event_type") == target)
    quarters = expand_to_quarters(chosen)
    newest = latest_revision(
        quarters, [*keys, "valid_time"], ties=["ingested_at", "event_id"]
    )
    return newest.select(*keys, "valid_time", "value")


def weather_frame(
    events: DataFrame, *, keys: Sequence[str] = ("area",), available_at: Column | None = None
) -> DataFrame:
    """Quarter-hour weather, one column per dimension; optionally only what was published in time."""
    chosen = events.filter(
        (F.col("event_type") == "weather")
        & F.col("value").isNotNull()
        & F.col("dimension").isin(*WEATHER_DIMENSIONS)
    )
    if available_at is not None:
        chosen = chosen.filter(F.col("published_at") <= available_at)
    newest = latest_revision(
        expand_to_quarters(chosen),
        [*keys, "valid_time", "dimension"],
        ties=["ingested_at", "event_id"],
    )
    return (
        newest.groupBy(*keys, "valid_time")
        .pivot("dimension", list(WEATHER_DIMENSIONS))
        .agg(F.avg("value"))
    )


def time_spine(
    df: DataFrame, *, keys: Sequence[str], seconds: int, ts: str = "valid_time"
) -> DataFrame:
    """Every step between each key's first and last time stamp, generated day by day."""
    lo, hi = floor_to(F.col("_lo"), seconds), floor_to(F.col("_hi"), seconds)
    bounds = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    days = bounds.select(
        *keys,
        lo.alias("_lo"),
        hi.alias("_hi"),
        F.explode(F.sequence(lo, hi, F.expr("INTERVAL 1 DAY"))).alias("_day"),
    )
    last = F.least(F.col("_hi"), F.col("_day") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND"))
    step = F.make_interval(secs=F.lit(seconds))
    return days.select(*keys, F.explode(F.sequence(F.col("_day"), last, step)).alias(ts))


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    keys: Sequence[str],
    pos: Column,
    limit: int = FILL_LIMIT,
) -> DataFrame:
    """Fill gaps from at most ``limit`` rows back; ``pos`` is a gapless position inside the key."""
    staged, chunk, own = with_halo_chunks(df.withColumn("_pos", pos), "_pos", before=limit)
    spec = Window.partitionBy(*keys, chunk).orderBy("_pos").rowsBetween(-limit, 0)
    filled = {c: F.last(c, ignorenulls=True).over(spec) for c in columns}
    return staged.withColumns(filled).filter(F.col(own)).select(*df.columns)


def resample(
    df: DataFrame, *, keys: Sequence[str], seconds: int, value: str = "value", limit: int = FILL_LIMIT
) -> DataFrame:
    """Bin means on a full grid, then a bounded forward fill."""
    bins = df.groupBy(*keys, floor_to(F.col("valid_time"), seconds).alias("valid_time")).agg(
        F.avg(value).alias(value)
    )
    grid = time_spine(df, keys=keys, seconds=seconds).join(bins, [*keys, "valid_time"], "left")
    return forward_fill(
        grid, [value], keys=keys, pos=grid_position("valid_time", seconds * 1_000_000), limit=limit
    )


def series_summary(df: DataFrame, *, keys: Sequence[str], value: str = "value", ts: str = "valid_time") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min(ts).alias("start_time"),
        F.max(ts).alias("end_time"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("mean_value"),
    )


def seasonality_profile(df: DataFrame, *, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Mean by weekday (Monday first) and UTC hour, one column per hour."""
    hours = list(range(24))
    pivoted = (
        df.withColumn("day_of_week", F.weekday("valid_time"))
        .withColumn("_hour", F.hour("valid_time"))
        .groupBy(*keys, "day_of_week")
        .pivot("_hour", hours)
        .agg(F.avg(value))
    )
    return pivoted.select(*keys, "day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def persistence_forecast(
    df: DataFrame, *, keys: Sequence[str], steps_lag: int, horizon_steps: int, value: str = "value"
) -> DataFrame:
    """Repeat each series' last ``steps_lag`` values over the horizon; too short a series raises."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("valid_time"))
    last = (
        df.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= steps_lag)
        .select(*keys, value, (F.lit(steps_lag) - F.col("_back")).alias("_slot"))
    )
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat(F.lit("series has too few points; need at least "), F.lit(str(steps_lag)))
    checked = last.withColumn(
        "_ok", F.when(size < steps_lag, F.raise_error(message).cast("boolean")).otherwise(True)
    ).filter("_ok")
    repeats = F.sequence(
        F.col("_slot"), F.lit(horizon_steps - 1).cast("int"), F.lit(steps_lag)
    )
    reaches = checked.filter(F.col("_slot") < horizon_steps)
    steps = F.transform(repeats, lambda slot: slot + 1)
    return reaches.select(
        *keys, F.explode(steps).alias("horizon_step"), F.col(value).cast("double").alias("forecast")
    )
