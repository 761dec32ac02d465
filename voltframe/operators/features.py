"""Leakage-safe features over many regular series at once.

Every statistic is taken from rows at least ``lead`` steps before the row it describes. Series are
long frames ``(keys..., valid_time, value)`` with one row per step. Each series is cut into chunks
of grid positions with a 14-day halo, so one long series spreads over many tasks.

Rolling windows cost the same for any window length: a window of ``w`` rows that ends inside a block
of ``w`` rows is the tail of one block plus the head of the next, and both parts are running
aggregates. Counts, means, squared deviations, minima and maxima of the two parts merge exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltframe.functions.timegrid import calendar_columns
from voltframe.plans.skew import DAY_MICROS, grid_position, lagged, time_bucket, with_halo_chunks

CALENDAR_FEATURES = (
    "hour", "quarter", "day_of_week", "day_of_year", "month", "is_weekend", "is_holiday",
    "is_morning_peak", "is_evening_peak", "sin_hour", "cos_hour", "sin_day_of_week",
    "cos_day_of_week", "sin_day_of_year", "cos_day_of_year",
)
LAG_FEATURES = (
    "lag_1h", "lag_2h", "lag_3h", "lag_4h", "lag_24h", "lag_48h", "lag_7d", "lag_14d",
    "diff_1h", "diff_2h", "diff_24h", "diff_7d", "acceleration_1h",
)
EMA_FEATURES = ("ema_4step", "ema_12step", "ema_spread")
ROLLING_FEATURES = (
    "rolling_std_4step", "rolling_mean_24h", "rolling_std_24h", "rolling_min_24h",
    "rolling_max_24h", "rolling_mean_7d", "rolling_std_7d", "ratio_24h_mean", "volatility_24h",
)
HISTORY_FEATURES = LAG_FEATURES + EMA_FEATURES + ROLLING_FEATURES
ALL_FEATURES = CALENDAR_FEATURES + HISTORY_FEATURES

# The feature subsets of the short-lead and long-lead models.
SHORT_HORIZON_FEATURES = (
    "hour", "quarter", "day_of_week", "sin_hour", "cos_hour", "is_morning_peak",
    "is_evening_peak", "lag_1h", "lag_2h", "lag_3h", "lag_4h", "diff_1h", "diff_2h",
    "acceleration_1h", "ema_4step", "ema_12step", "rolling_std_4step", "rolling_mean_24h",
)
LONG_HORIZON_FEATURES = (
    "hour", "quarter", "day_of_week", "day_of_year", "month", "is_weekend", "is_holiday",
    "is_morning_peak", "is_evening_peak", "sin_hour", "cos_hour", "sin_day_of_week",
    "cos_day_of_week", "sin_day_of_year", "cos_day_of_year", "lag_24h", "lag_48h", "lag_7d",
    "lag_14d", "diff_24h", "diff_7d", "rolling_mean_24h", "rolling_std_24h", "rolling_min_24h",
    "rolling_max_24h", "rolling_mean_7d", "rolling_std_7d",
)

# Smoothing span of each moving average, in steps.
EMA_SPANS = {"ema_4step": 4, "ema_12step": 12}
EMA_WEEK_ROWS, EMA_BLOCK_ROWS = 1300, 256


def step_micros(steps_per_day: int) -> int:
    if steps_per_day < 24 or steps_per_day % 24:
        raise ValueError("steps_per_day must be a positive multiple of 24")
    return DAY_MICROS // steps_per_day


def series_gaps(df: DataFrame, *, keys: Sequence[str], steps_per_day: int, value: str = "value") -> DataFrame:
    """Rows that break regularity: null value, duplicate, or a step other than the expected one."""
    step = step_micros(steps_per_day)
    ts = F.col("valid_time")
    before = lagged(
        df, keys=keys, bucket=time_bucket(ts), order=[ts], value=ts, name="previous_time"
    )
    gap = F.unix_micros(ts) - F.unix_micros("previous_time")
    violation = (
        F.when(F.col(value).isNull(), "null_value")
        .when(gap == 0, "duplicate")
        .when(gap != step, "gap")
    )
    return (
        before.withColumn("violation", violation)
        .withColumn("missing_steps", F.greatest((gap / F.lit(step)).cast("long") - 1, F.lit(0)))
        .filter(F.col("violation").isNotNull())
    )


def require_regular(df: DataFrame, *, keys: Sequence[str], steps_per_day: int, value: str = "value") -> None:
    """Raise if any series is irregular (one small action; call it before building features)."""
    first = series_gaps(df, keys=keys, steps_per_day=steps_per_day, value=value).head(1)
    if first:
        raise ValueError(f"series must have a regular, unique and complete time index: {first[0]}")


class _Chunked:
    """Window specs over one chunked frame.

    Sorting by the block columns before the position gives the same order as the position alone, so
    the windows below share two sorts (ascending and descending) and no extra shuffle.
    """

    def __init__(self, parts: Sequence[str], day: int, week: int) -> None:
        self.parts = [F.col(p) for p in parts]
        self.day, self.week = day, week

    @staticmethod
    def blocks(pos: Column, day: int, week: int) -> dict[str, Column]:
        def block(size: int) -> Column:
            return ((pos - F.pmod(pos, F.lit(size))) / F.lit(size)).cast("long")

        return {"_wk": block(week), "_dy": block(day), "_rwk": -block(week), "_rdy": -block(day)}

    def ordered(self):
        return Window.partitionBy(*self.parts).orderBy("_wk", "_dy", "_pos")

    def reversed(self):
        return Window.partitionBy(*self.parts).orderBy("_rwk", "_rdy", F.desc("_pos"))

    def head(self, block: str):
        if block == "day":
            spec = Window.partitionBy(*self.parts, "_wk", "_dy").orderBy("_pos")
        else:
            spec = Window.partitionBy(*self.parts, "_wk").orderBy("_dy", "_pos")
        return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def tail(self, block: str):
        if block == "day":
            spec = Window.partitionBy(*self.parts, "_rwk", "_rdy").orderBy(F.desc("_pos"))
        else:
            spec = Window.partitionBy(*self.parts, "_rwk").orderBy("_rdy", F.desc("_pos"))
        return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def week_back(self, n: int):
        return Window.partitionBy(*self.parts).orderBy("_wk").rangeBetween(-n, -n)


def _moments(v: Column, spec, extremes: bool) -> Column:
    n = F.count(v).over(spec)
    fields = [
        n.alias("n"),
        F.avg(v).over(spec).alias("mean"),
        (F.var_pop(v).over(spec) * n).alias("m2"),
    ]
    if extremes:
        fields += [F.min(v).over(spec).alias("lo"), F.max(v).over(spec).alias("hi")]
    return F.struct(*fields)


def _merged(
    head: Column, tail: Column, whole_block: Column, w: int, extremes: bool
) -> dict[str, Column]:
    """Statistics of the union of a tail part and a head part; null unless the frame is full."""

    def either(field: str, combine) -> Column:
        return F.when(whole_block, head[field]).otherwise(combine(tail[field], head[field]))

    nt, nh = tail["n"], head["n"]
    delta = head["mean"] - tail["mean"]
    total = F.when(whole_block, nh).otherwise(nt + nh)
    full = total == w
    mean = F.when(whole_block, head["mean"]).otherwise(
        (tail["mean"] * nt + head["mean"] * nh) / F.lit(float(w))
    )
    m2 = F.when(whole_block, head["m2"]).otherwise(
        tail["m2"] + head["m2"] + delta * delta * nt * nh / F.lit(float(w))
    )
    merged = {
        "mean": F.when(full, mean),
        "std": F.when(full, F.sqrt(F.greatest(m2, F.lit(0.0)) / F.lit(float(w - 1)))),
    }
    if extremes:
        merged["lo"] = F.when(full, either("lo", F.least))
        merged["hi"] = F.when(full, either("hi", F.greatest))
    return merged


def lag_columns(v: Column, spec, steps_per_day: int, lead: int = 1) -> dict[str, Column]:
    """Lags, differences and acceleration; each lag of ``k`` rows becomes ``k + lead - 1``."""
    hour, day = steps_per_day // 24, steps_per_day
    offsets = {
        "lag_1h": hour, "lag_2h": 2 * hour, "lag_3h": 3 * hour, "lag_4h": 4 * hour,
        "lag_24h": day, "lag_48h": 2 * day, "lag_7d": 7 * day, "lag_14d": 14 * day,
    }
    return {name: F.lag(v, k + lead - 1).over(spec) for name, k in offsets.items()}


def difference_columns() -> dict[str, Column]:
    c = F.col
    return {
        "diff_1h": c("lag_1h") - c("lag_2h"),
        "diff_2h": c("lag_1h") - c("lag_3h"),
        "diff_24h": c("lag_24h") - c("lag_48h"),
        "diff_7d": c("lag_7d") - c("lag_14d"),
        "acceleration_1h": (c("lag_1h") - c("lag_2h")) - (c("lag_2h") - c("lag_3h")),
    }


def history_features(
    df: DataFrame,
    *,
    keys: Sequence[str],
    steps_per_day: int,
    lead: int = 1,
    value: str = "value",
    groups: Sequence[str] = ("lag", "ema", "rolling"),
    pos: Column | None = None,
    rows_per_chunk: int | None = None,
    segments: bool = False,
) -> DataFrame:
    """Add lag, EMA and rolling features as known ``lead`` steps before each row.

    ``pos`` defaults to the grid position of ``valid_time``; pass a row index to count rows instead. The series must be regular, or
    ``segments`` be set: then no window reaches over a hole, and the rows between two holes are a segment with a history of its own,
    so features are null until it is long enough, whatever the chunk size. Two rows at one position are then an error. This takes
    one more sort.
    """
    if lead < 1:
        raise ValueError("lead must be positive")
    step = step_micros(steps_per_day)
    day, week = steps_per_day, 7 * steps_per_day
    # Growing weights over a whole week would leave the range of doubles; older blocks weigh less than its precision.
    ema_rows = week if week <= EMA_WEEK_ROWS else EMA_BLOCK_ROWS
    staged = df.withColumn("_pos", grid_position("valid_time", step) if pos is None else pos)
    staged, chunk, own = with_halo_chunks(
        staged, "_pos", before=14 * day + lead - 1, rows_per_chunk=rows_per_chunk
    )
    # One shuffle by (key, chunk) serves every window below.
    staged = staged.repartition(*keys, chunk)
    parts = [*keys, chunk]
    if segments:
        in_turn = Window.partitionBy(*parts).orderBy("_pos")
        jump = F.col("_pos") - F.lag("_pos").over(in_turn)
        twice = F.raise_error(F.lit("two rows of a series at one time")).cast("int")
        # A segment is numbered within its chunk, whose halo holds all rows that a window may reach.
        staged = staged.withColumn("_broken", F.when(jump == 0, twice).when(jump > 1, 1).otherwise(0))
        staged = staged.withColumn("_segment", F.sum("_broken").over(in_turn))
        parts.append("_segment")
    staged = staged.withColumns(_Chunked.blocks(F.col("_pos"), day, week))
    windows = _Chunked(parts, day, week)
    ema_head, ema_back = windows.head("week"), windows.week_back
    if "ema" in groups and ema_rows != week:
        staged = staged.withColumn("_em", F.floor(F.col("_pos") / ema_rows))
        ema_head = Window.partitionBy(*windows.parts, "_em").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def ema_back(n: int):
            return Window.partitionBy(*windows.parts).orderBy("_em").rangeBetween(-n, -n)

    ordered = windows.ordered()
    v = F.col(value)
    out: list[str] = []

    if "ema" in groups or "rolling" in groups:
        running: dict[str, Column] = {}
        if "rolling" in groups:
            running["_h_day"] = _moments(v, windows.head("day"), True)
            running["_h_week"] = _moments(v, windows.head("week"), False)
        if "ema" in groups:
            offset = F.pmod(F.col("_pos"), F.lit(ema_rows)).cast("double")
            for name, span in EMA_SPANS.items():
                keep = 1.0 - 2.0 / (span + 1.0)
                grow = F.pow(F.lit(1.0 / keep), offset)
                fade = F.pow(F.lit(keep), offset)
                run = ema_head
                running[f"_w_{name}"] = F.struct(
                    (fade * F.sum(v * grow).over(run)).alias("num"),
                    (fade * F.sum(F.when(v.isNotNull(), grow)).over(run)).alias("den"),
                )
        staged = staged.withColumns(running)
    if "ema" in groups:
        staged = staged.withColumns(
            {
                f"_b{n}_{name}": F.max_by(F.col(f"_w_{name}"), F.col("_pos")).over(ema_back(n))
                for name in EMA_SPANS
                for n in (1, 2)
            }
        )

    looked_up: dict[str, Column] = {}
    if "lag" in groups:
        looked_up.update(lag_columns(v, ordered, steps_per_day, lead))
    elif "rolling" in groups:
        looked_up["lag_1h"] = F.lag(v, day // 24 + lead - 1).over(ordered)
    if "ema" in groups:
        offset = F.pmod(F.col("_pos"), F.lit(ema_rows)).cast("double")
        for name, span in EMA_SPANS.items():
            keep = 1.0 - 2.0 / (span + 1.0)

            def total(part: str, name: str = name, keep: float = keep) -> Column:
                back1 = F.coalesce(F.col(f"_b1_{name}")[part], F.lit(0.0))
                back2 = F.coalesce(F.col(f"_b2_{name}")[part], F.lit(0.0))
                carried = (back1 + back2 * F.lit(keep**ema_rows)) * F.pow(F.lit(keep), offset + 1)
                return F.coalesce(F.col(f"_w_{name}")[part], F.lit(0.0)) + carried

            looked_up[name] = F.lag(F.try_divide(total("num"), total("den")), lead).over(ordered)
    if "rolling" in groups:
        hour = day // 24
        recent = ordered.rowsBetween(-(hour + lead - 1), -lead)
        looked_up["_hour_std"] = F.when(F.count(v).over(recent) == hour, F.stddev_samp(v).over(recent))
        looked_up["_exists"] = F.lag(F.lit(1), lead - 1).over(ordered) if lead > 1 else F.lit(1)
        for block in ("day", "week"):
            looked_up[f"_head_{block}"] = F.lag(F.col(f"_h_{block}"), lead).over(ordered)
    staged = staged.withColumns(looked_up)
    if "rolling" in groups:
        staged = staged.withColumns(
            {
                "_t_day": _moments(v, windows.tail("day"), True),
                "_t_week": _moments(v, windows.tail("week"), False),
            }
        )
        # In descending order the row ``k`` places further on is the one ``k`` rows earlier.
        staged = staged.withColumns(
            {
                f"_tail_{block}": F.lead(F.col(f"_t_{block}"), w - 1 + lead).over(windows.reversed())
                for block, w in (("day", day), ("week", week))
            }
        )

    final: dict[str, Column] = {}
    if "lag" in groups:
        final.update(difference_columns())
        out += LAG_FEATURES
    if "ema" in groups:
        final["ema_spread"] = F.col("ema_4step") - F.col("ema_12step")
        out += EMA_FEATURES
    if "rolling" in groups:
        final["rolling_std_4step"] = F.when(
            F.col("_exists").isNotNull(), F.coalesce("_hour_std", F.lit(0.0))
        )
        for block, w, label in (("day", day, "24h"), ("week", week, "7d")):
            ends_block = F.pmod(F.col("_pos") - F.lit(lead) + 1, F.lit(w)) == 0
            stats = _merged(
                F.col(f"_head_{block}"), F.col(f"_tail_{block}"), ends_block, w, block == "day"
            )
            for stat, prefix in (("mean", "mean"), ("std", "std"), ("lo", "min"), ("hi", "max")):
                if stat in stats:
                    final[f"rolling_{prefix}_{label}"] = stats[stat]
    staged = staged.filter(F.col(own)).withColumns(final)
    if "rolling" in groups:
        base = F.col("rolling_mean_24h") + F.lit(1e-3)
        staged = staged.withColumns(
            {
                "ratio_24h_mean": F.try_divide(F.col("lag_1h"), base),
                "volatility_24h": F.try_divide(
                    F.col("rolling_max_24h") - F.col("rolling_min_24h"), base
                ),
            }
        )
        out += ROLLING_FEATURES
    return staged.select(*df.columns, *out)


def horizon_features(
    df: DataFrame,
    *,
    keys: Sequence[str],
    lead: int,
    steps_per_day: int = 96,
    value: str = "value",
    country_code: str = "ES",
    drop_incomplete: bool = True,
    refuse_irregular: bool = False,
) -> DataFrame:
    """Calendar at the valid time plus history as known ``lead`` steps earlier, and the target.

    Every segment between two holes starts its history anew; ``refuse_irregular`` raises for a series with a hole, a repeated time or
    a null value instead (one small job).
    """
    if refuse_irregular:
        require_regular(df, keys=keys, steps_per_day=steps_per_day, value=value)
    out = (
        history_features(df, keys=keys, steps_per_day=steps_per_day, lead=lead, value=value, segments=True)
        .withColumns(calendar_columns(F.col("valid_time"), country_code))
        .withColumn("horizon_step", F.lit(lead))
        .withColumnRenamed(value, "target")
    )
    out = out.select(*keys, "valid_time", *ALL_FEATURES, "horizon_step", "target")
    return out.dropna(subset=["target", *ALL_FEATURES]) if drop_incomplete else out


def exogenous_lag(
    exogenous: DataFrame, *, keys: Sequence[str], steps_per_day: int, value: str = "value", name: str = "exog_lag_24h"
) -> DataFrame:
    """The exogenous series moved one day later, as a join table on (keys, valid_time).

    On a regular series a shift by rows is a shift of the time stamp: no window is needed.
    """
    day = F.expr("INTERVAL 1 DAY")
    return exogenous.select(*keys, (F.col("valid_time") + day).alias("valid_time"), F.col(value).alias(name))


def multiscale_features(
    df: DataFrame,
    *,
    keys: Sequence[str],
    steps_per_day: int = 96,
    value: str = "value",
    country_code: str = "ES",
    exogenous: DataFrame | None = None,
    additional: DataFrame | None = None,
) -> DataFrame:
    """One-step-ahead feature frame, optionally joined with exogenous columns on the valid time."""
    out = horizon_features(
        df, keys=keys, lead=1, steps_per_day=steps_per_day, value=value, country_code=country_code
    )
    joined: list[str] = []
    if exogenous is not None:
        shifted = exogenous_lag(exogenous, keys=keys, steps_per_day=steps_per_day)
        out, joined = out.join(shifted, [*keys, "valid_time"], "left"), joined + ["exog_lag_24h"]
    if additional is not None:
        extra = [c for c in additional.columns if c not in (*keys, "valid_time")]
        out, joined = out.join(additional, [*keys, "valid_time"], "left"), joined + extra
    return out.dropna(subset=joined) if joined else out


def short_horizon_features(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return features.select(*keys, "valid_time", *SHORT_HORIZON_FEATURES, "target")


def long_horizon_features(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return features.select(*keys, "valid_time", *LONG_HORIZON_FEATURES, "target")
