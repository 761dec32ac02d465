"""Live training and scoring frames: target history, weather and calendar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltframe.functions.timegrid import live_calendar
from voltframe.operators.series import FILL_LIMIT, forward_fill
from voltframe.plans.asof import asof_join
from voltframe.plans.skew import DAY_MICROS, grid_position, time_bucket, with_halo_chunks, with_row_index
from voltframe.schemas import WEATHER_DIMENSIONS

DAY_STEPS, WEEK_STEPS = 96, 672
MINIMUM_ROWS = 480
# The features of the live model.
LIVE_FEATURES = (
    "hour", "quarter", "day_of_week", "month", "is_weekend", "temperature_2m", "wind_speed_10m",
    "relative_humidity_2m", "shortwave_radiation", "lag_96", "lag_672", "rolling_96",
)


def finite(column: Column) -> Column:
    """Null for infinite or not-a-number values."""
    return F.when(~F.isnan(column) & (F.abs(column) != F.lit(float("inf"))), column)


def with_weather(df: DataFrame, weather: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left time join; a dimension the weather frame lacks becomes a null column."""
    missing = {c: F.lit(None).cast("double") for c in WEATHER_DIMENSIONS if c not in weather.columns}
    full = weather.withColumns(missing) if missing else weather
    return df.join(full.select(*keys, "valid_time", *WEATHER_DIMENSIONS), [*keys, "valid_time"], "left")


def training_frame(target: DataFrame, weather: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Complete training rows. Lags count rows, as the target may have gaps.

    An exact row index per series makes row lags local to a chunk of a series.
    """
    ts = F.col("valid_time")
    joined = with_weather(target.withColumnRenamed("value", "target"), weather, keys)
    indexed = with_row_index(joined, keys=keys, bucket=time_bucket(ts), order=[ts], name="_idx")
    staged, chunk, own = with_halo_chunks(indexed, "_idx", before=WEEK_STEPS)
    rows = Window.partitionBy(*keys, chunk).orderBy("_idx")
    recent = rows.rowsBetween(-DAY_STEPS, -1)
    fill = rows.rowsBetween(-FILL_LIMIT, 0)
    staged = staged.withColumns(
        {
            **{c: F.last(c, ignorenulls=True).over(fill) for c in WEATHER_DIMENSIONS},
            "lag_96": F.lag("target", DAY_STEPS).over(rows),
            "lag_672": F.lag("target", WEEK_STEPS).over(rows),
            "rolling_96": F.when(
                F.count("target").over(recent) == DAY_STEPS, F.avg("target").over(recent)
            ),
        }
    ).filter(F.col(own))
    numeric = ["target", *WEATHER_DIMENSIONS, "lag_96", "lag_672", "rolling_96"]
    clean = live_calendar(staged).withColumns({c: finite(F.col(c).cast("double")) for c in numeric})
    return clean.dropna(subset=["target", *LIVE_FEATURES]).select(
        *keys, "valid_time", *LIVE_FEATURES, "target"
    )


def training_readiness(frame: DataFrame, *, keys: Sequence[str], minimum: int = MINIMUM_ROWS) -> DataFrame:
    """Rows per series and whether there are enough of them to train on."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("training_rows")).withColumn(
        "ready", F.col("training_rows") >= minimum
    )


def cover_intervals(
    intervals: DataFrame, weather: DataFrame, *, keys: Sequence[str], limit: int = FILL_LIMIT
) -> DataFrame:
    """Weather at each interval, filled from at most ``limit`` rows of the union of both time axes.

    ``uncovered`` lists the dimensions an interval still lacks.
    """
    ts = F.col("valid_time")
    wanted = intervals.select(*keys, F.col("valid_from").alias("valid_time"), F.lit(True).alias("_wanted")).distinct()
    union = weather.select(*keys, "valid_time", *WEATHER_DIMENSIONS).join(
        wanted, [*keys, "valid_time"], "full_outer"
    )
    indexed = with_row_index(union, keys=keys, bucket=time_bucket(ts), order=[ts], name="_idx")
    filled = forward_fill(indexed, list(WEATHER_DIMENSIONS), keys=keys, pos=F.col("_idx"), limit=limit)
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in WEATHER_DIMENSIONS]))
    return filled.filter("_wanted").drop("_idx", "_wanted").withColumn("uncovered", lacking)


def value_at_or_before(
    intervals: DataFrame, history: DataFrame, *, keys: Sequence[str], interval: str, name: str
) -> DataFrame:
    """Add the history value at or before ``valid_time - interval``; the first value if none is."""
    probe = intervals.withColumn("_probe", F.col("valid_time") - F.expr(interval))
    known = history.select(*keys, F.col("valid_time").alias("_known_at"), F.col("value").alias("_known"))
    first = history.groupBy(*keys).agg(F.min_by("value", "valid_time").alias("_first"))
    matched = asof_join(
        probe, known, left_on="_probe", right_on="_known_at", by=keys, bucket_micros=86_400_000_000
    )
    return (
        matched.join(first, list(keys), "left")
        .withColumn(name, F.coalesce("_known", "_first"))
        .drop("_probe", "_known_at", "_known", "_first")
    )


def trailing_mean(history: DataFrame, *, keys: Sequence[str], rows: int = DAY_STEPS) -> DataFrame:
    newest = Window.partitionBy(*keys).orderBy(F.desc("valid_time"))
    return (
        history.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= rows)
        .groupBy(*keys)
        .agg(F.avg("value").alias("rolling_96"))
    )


def future_frame(
    intervals: DataFrame, history: DataFrame, weather: DataFrame, *, keys: Sequence[str], strict: bool = False
) -> DataFrame:
    """Scoring rows for the requested intervals (``valid_from`` per key).

    Pass weather that was published by the issue time. ``strict`` raises on uncovered intervals.
    """
    frame = cover_intervals(intervals, weather, keys=keys)
    if strict:
        message = F.concat(
            F.lit("live weather does not cover every forecast interval: "), F.array_join("uncovered", ", ")
        )
        complete = F.when(F.size("uncovered") == 0, True).otherwise(F.raise_error(message).cast("boolean"))
        frame = frame.filter(complete)
    frame = live_calendar(frame)
    frame = value_at_or_before(frame, history, keys=keys, interval="INTERVAL 1 DAY", name="lag_96")
    frame = value_at_or_before(frame, history, keys=keys, interval="INTERVAL 7 DAYS", name="lag_672")
    means = trailing_mean(history, keys=keys)
    return frame.join(means, list(keys), "left").select(
        *keys, "valid_time", *LIVE_FEATURES, "uncovered"
    )


def holdout_split(
    frame: DataFrame, *, keys: Sequence[str], lead: int = 0, fraction: float = 0.20, live: bool = False
) -> DataFrame:
    """Label rows ``train``, ``gap`` or ``holdout`` in time order per series.

    The last fraction is held out and ``lead`` rows before it are purged. ``live`` holds out
    ``min(288, max(96, n / 5))`` rows instead.
    """
    ts = F.col("valid_time")
    indexed = with_row_index(frame, keys=keys, order=[ts], name="_idx", total="_n")
    return label_holdout(indexed, "_idx", "_n", lead=lead, fraction=fraction, live=live).drop("_idx", "_n")


def label_holdout(
    rows: DataFrame, index: str, total: str, *, lead: int = 0, fraction: float = 0.20, live: bool = False
) -> DataFrame:
    """``holdout_split`` for rows that already carry their index and the size of their series."""
    i, n = F.col(index), F.col(total)
    if live:
        size = F.least(F.lit(288), F.greatest(F.lit(96), F.floor(n / 5)))
    else:
        size = F.floor(n * F.lit(fraction))
    start = n - size
    part = F.when(i >= start, "holdout").when(i >= start - lead, "gap").otherwise("train")
    return rows.withColumn("split", part)


def dual_training_rows(long_rows: DataFrame, short_rows: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Long-lead training rows plus one-step rows up to the same last training time."""
    limit = long_rows.groupBy(*keys).agg(F.max("valid_time").alias("_last"))
    kept = short_rows.join(limit, list(keys)).filter(F.col("valid_time") <= F.col("_last")).drop("_last")
    return long_rows.unionByName(kept)


def seasonal_baselines(df: DataFrame, *, keys: Sequence[str], lead: int, steps_per_day: int) -> DataFrame:
    """Values one day and one week earlier, never newer than the lead; null where that time has no row. One shuffle for both."""
    shifts = {"baseline_24h": max(lead, steps_per_day), "baseline_7d": max(lead, 7 * steps_per_day)}
    staged = df.withColumn("_pos", grid_position("valid_time", DAY_MICROS // steps_per_day))
    staged, chunk, own = with_halo_chunks(staged, "_pos", before=max(shifts.values()))
    by_time = Window.partitionBy(*keys, chunk).orderBy("_pos")
    added = {name: F.max("value").over(by_time.rangeBetween(-k, -k)) for name, k in shifts.items()}
    return staged.withColumns(added).filter(F.col(own)).drop("_pos", chunk, own)
