"""Queries over features, as-of joins, live frames, calibration, learners and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.functions.metrics import evaluate as evaluate_columns
from voltframe.functions.timegrid import calendar_columns, forecast_intervals
from voltframe.operators import asof, backtest, calibration, evaluate, features, fold_blocks, frames, learners, live, monitoring, series
from voltframe.session import durable
from voltframe.workload.history import CALENDAR_SQL
from voltframe.workload.registry import register
from voltframe.workload.tables import AREA, DAILY, LEARNERS, NOW, PLAN, SERIES, SERIES_KEYS, TYPED

OVER = "PARTITION BY event_type, area ORDER BY valid_time"
KEYS = "event_type, area"
LAGS = {
    "lag_1h": 1, "lag_2h": 2, "lag_3h": 3, "lag_4h": 4, "lag_24h": 24, "lag_48h": 48, "lag_7d": 168, "lag_14d": 336,
}
DIFFS = """lag_1h - lag_2h AS diff_1h, lag_1h - lag_3h AS diff_2h, lag_24h - lag_48h AS diff_24h, lag_7d - lag_14d AS diff_7d,
  (lag_1h - lag_2h) - (lag_2h - lag_3h) AS acceleration_1h"""


def lags_sql(lead: int) -> str:
    return ", ".join(f"lag(value, {k + lead - 1}) OVER ({OVER}) AS {name}" for name, k in LAGS.items())


def frame_sql(w: int, lead: int) -> str:
    return f"({OVER} ROWS BETWEEN {w + lead - 1} PRECEDING AND {lead} PRECEDING)"


def full(expression: str, w: int, lead: int) -> str:
    frame = frame_sql(w, lead)
    return f"CASE WHEN count(value) OVER {frame} = {w} THEN {expression} OVER {frame} END"


def rolling_sql(lead: int) -> str:
    return f"""CASE WHEN lag(1, {lead - 1}) OVER ({OVER}) = 1 THEN 0.0::DOUBLE END AS rolling_std_4step,
    {full('avg(value)', 24, lead)} AS rolling_mean_24h, {full('stddev_samp(value)', 24, lead)} AS rolling_std_24h,
    {full('min(value)', 24, lead)} AS rolling_min_24h, {full('max(value)', 24, lead)} AS rolling_max_24h,
    {full('avg(value)', 168, lead)} AS rolling_mean_7d, {full('stddev_samp(value)', 168, lead)} AS rolling_std_7d"""


RATIOS = """lag_1h / (rolling_mean_24h + 0.001) AS ratio_24h_mean,
  (rolling_max_24h - rolling_min_24h) / (rolling_mean_24h + 0.001) AS volatility_24h"""


def ema_sql(lead: int, source: str = "numbered") -> str:
    """Moving averages by their definition: weights fall by a constant factor per row back."""
    parts = []
    for name, span in (("ema_4step", 4), ("ema_12step", 12)):
        keep = f"(1 - 2.0::DOUBLE / {span + 1})"
        parts.append(f"sum(b.value * power({keep}, a.i - {lead} - b.i)) / sum(power({keep}, a.i - {lead} - b.i)) AS {name}")
    return f"""SELECT a.event_type, a.area, a.valid_time, {', '.join(parts)} FROM {source} a JOIN {source} b
      ON a.event_type = b.event_type AND a.area = b.area AND b.i BETWEEN a.i - {lead} - 400 AND a.i - {lead} GROUP BY 1, 2, 3"""


NUMBERED = f"numbered AS (SELECT *, row_number() OVER ({OVER}) AS i FROM series)"


def hist(t, *groups: str, lead: int = 1) -> DataFrame:
    return features.history_features(t.series, keys=SERIES_KEYS, steps_per_day=24, lead=lead, groups=groups)


@register(
    "lag_features",
    f"WITH {SERIES}, lagged AS (SELECT {KEYS}, valid_time, value, {lags_sql(1)} FROM series) SELECT *, {DIFFS} FROM lagged",
    doubles="diff_1h diff_2h diff_24h diff_7d acceleration_1h",
)
def lag_features(t):
    return hist(t, "lag")


@register(
    "ema_features",
    f"""WITH {SERIES}, {NUMBERED}, ema AS ({ema_sql(1)}) SELECT {KEYS}, s.valid_time, s.value, ema_4step, ema_12step,
    ema_4step - ema_12step AS ema_spread FROM series s LEFT JOIN ema USING (event_type, area, valid_time)""",
    doubles="ema_4step ema_12step ema_spread",
)
def ema_features(t):
    return hist(t, "ema")


@register(
    "rolling_features",
    f"""WITH {SERIES}, rolled AS (SELECT {KEYS}, valid_time, value, {rolling_sql(1)}, lag(value, 1) OVER ({OVER}) AS lag_1h FROM series)
    SELECT * EXCLUDE (lag_1h), {RATIOS} FROM rolled""",
    digits=5,
    doubles="rolling_std_4step rolling_mean_24h rolling_std_24h rolling_mean_7d rolling_std_7d ratio_24h_mean volatility_24h",
)
def rolling_features(t):
    """Rolling statistics with the work independent of the window length."""
    return hist(t, "rolling").drop("lag_1h")


def horizon_sql(lead: int) -> str:
    calendar = CALENDAR_SQL.split("parts AS")[1]
    calendar = calendar.replace("FROM stamped", "FROM stamped").replace("event_id, ", "event_type, area, valid_time, ", 1)
    return f"""WITH {SERIES}, {NUMBERED}, stamped AS (SELECT event_type, area, valid_time,
      (valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l FROM series),
    parts AS {calendar.split("SELECT *, CAST(hour BETWEEN")[0].rstrip()},
    calendar AS (SELECT *, CAST(hour BETWEEN{calendar.split("SELECT *, CAST(hour BETWEEN")[1]}),
    hist AS (SELECT {KEYS}, valid_time, value AS target, {lags_sql(lead)}, {rolling_sql(lead)} FROM series),
    ema AS ({ema_sql(lead)}),
    rich AS (SELECT *, {DIFFS}, {RATIOS} FROM hist)
    SELECT * EXCLUDE (calendar_lag), ema_4step - ema_12step AS ema_spread, CAST({lead} AS INTEGER) AS horizon_step
    FROM (SELECT *, 0 AS calendar_lag FROM rich JOIN calendar USING (event_type, area, valid_time)
      JOIN ema USING (event_type, area, valid_time)) AS wide WHERE lag_14d IS NOT NULL"""


INTEGER_COLUMNS = {
    "hour", "quarter", "day_of_week", "day_of_year", "month", "is_weekend", "is_holiday", "is_morning_peak",
    "is_evening_peak",
}
FEATURE_DOUBLES = " ".join(c for c in features.ALL_FEATURES if c not in INTEGER_COLUMNS)


@register("horizon_features", horizon_sql(24), digits=5, doubles=FEATURE_DOUBLES + " target")
def horizon_features(t):
    """Calendar at the valid time and history as known one day earlier."""
    return features.horizon_features(t.series, keys=SERIES_KEYS, lead=24, steps_per_day=24)


@register(
    "exog_join",
    f"""WITH {SERIES}, lagged AS (SELECT *, lag(value, 336) OVER ({OVER}) AS lag_14d FROM series),
    exog AS (SELECT area, valid_time + INTERVAL 1 DAY AS valid_time, value AS exog_lag_24h FROM series WHERE event_type = 'view'),
    extra AS (SELECT area, valid_time, value AS clicks FROM series WHERE event_type = 'click')
    SELECT s.event_type, s.area, s.valid_time, s.value AS target, lag_14d, exog_lag_24h, clicks FROM lagged s
      JOIN exog USING (area, valid_time) JOIN extra USING (area, valid_time) WHERE lag_14d IS NOT NULL""",
)
def exog_join(t):
    """One-step features joined with a lagged exogenous series and other columns."""
    chosen = t.series
    exog = chosen.filter("event_type = 'view'").select("area", "valid_time", "value")
    extra = chosen.filter("event_type = 'click'").select("area", "valid_time", F.col("value").alias("clicks"))
    # Exogenous inputs are per area, so they are given to every series of the area.
    per_series = chosen.select(*SERIES_KEYS).distinct()
    out = features.multiscale_features(
        chosen, keys=SERIES_KEYS, steps_per_day=24,
        exogenous=exog.join(per_series, "area").select(*SERIES_KEYS, "valid_time", "value"),
        additional=extra.join(per_series, "area").select(*SERIES_KEYS, "valid_time", "clicks"),
    )
    return out.select(*SERIES_KEYS, "valid_time", "target", "lag_14d", "exog_lag_24h", "clicks")


# --- as-of -----------------------------------------------------------------------------------


def publications(t) -> DataFrame:
    return t.events.filter("event_type <> 'view'").select(
        "user_id", F.col("ts").alias("published_at"), F.date_trunc("hour", "ts").alias("interval_start"),
        "event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"),
    )


def origins(t) -> DataFrame:
    return t.events.filter("event_type = 'view'").select(
        "user_id", F.col("event_id").alias("origin_id"), F.col("ts").alias("forecast_origin"),
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("valid_time"),
    )


ASOF = """
pubs AS (SELECT user_id, ts AS published_at, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value
  FROM events WHERE event_type <> 'view'),
origins AS (SELECT user_id, event_id AS origin_id, ts AS forecast_origin FROM events WHERE event_type = 'view')"""


@register(
    "asof_join",
    f"""WITH {ASOF} SELECT o.user_id, origin_id, forecast_origin, p.published_at, p.event_id, p.value,
    p.value IS NULL AS is_missing FROM origins o ASOF LEFT JOIN pubs p
    ON o.user_id = p.user_id AND o.forecast_origin >= p.published_at""",
)
def asof_join(t):
    """Last publication known at each origin; a null inside the match stays a match."""
    joined = asof.asof_values(publications(t), origins(t), by=["user_id"])
    return joined.select("user_id", "origin_id", "forecast_origin", "published_at", "event_id", "value", "is_missing")


@register(
    "asof_join_all",
    f"""WITH {ASOF} SELECT origin_id, p.published_at, p.event_id, p.value FROM origins o ASOF LEFT JOIN pubs p
    ON o.forecast_origin >= p.published_at""",
)
def asof_join_all(t):
    """The same without keys: one global publication stream, still split into pieces of equal size."""
    joined = asof.asof_values(publications(t).drop("user_id"), origins(t).drop("user_id"))
    return joined.select("origin_id", "published_at", "event_id", "value")


@register(
    "asof_impute",
    f"""WITH {ASOF}, matched AS (SELECT o.user_id, origin_id, forecast_origin, p.value FROM origins o ASOF LEFT JOIN pubs p
      ON o.user_id = p.user_id AND o.forecast_origin >= p.published_at),
    prior AS (SELECT user_id, published_at, median(value) OVER (PARTITION BY user_id ORDER BY published_at
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prior_median FROM pubs WHERE value IS NOT NULL)
    SELECT m.user_id, origin_id, coalesce(m.value, p.prior_median) AS value, m.value IS NULL AS is_missing,
      CASE WHEN m.value IS NOT NULL THEN 'none' WHEN p.prior_median IS NOT NULL THEN 'prior_median' ELSE 'unavailable' END
      AS imputation_method
    FROM matched m ASOF LEFT JOIN prior p ON m.user_id = p.user_id AND m.forecast_origin >= p.published_at""",
    doubles="value",
)
def asof_impute(t):
    """Missing values replaced by the exact median of everything published before."""
    filled = asof.asof_features(publications(t), origins(t), by=["user_id"])
    return filled.select("user_id", "origin_id", "value", "is_missing", "imputation_method")


# --- live frames -----------------------------------------------------------------------------


def live_inputs(t) -> tuple[DataFrame, DataFrame]:
    """Quarter-hour target per area (gaps stay) and wide weather from the raw observations."""
    quarter = F.window("valid_time", "15 minutes").start
    target = t.observations.groupBy("area", quarter.alias("valid_time")).agg(
        (F.round(F.sum("value"), 2) / F.count("value")).alias("value")
    )
    events = t.typed_events.withColumn("event_id", F.coalesce("event_id", F.lit("")))
    return target, series.weather_frame(events)


LIVE_SQL = f"""{TYPED},
target AS (SELECT {AREA} AS area, time_bucket(INTERVAL 15 MINUTE, ts) AS valid_time, round(sum(value), 2) / count(value) AS target
  FROM events GROUP BY 1, 2),
quarters AS (SELECT *, unnest(range(interval_start, interval_end, INTERVAL 15 MINUTE)) AS valid_time FROM typed
  WHERE value IS NOT NULL AND event_type = 'weather'),
latest AS (SELECT * FROM quarters QUALIFY row_number() OVER (PARTITION BY area, valid_time, dimension
  ORDER BY revision DESC, ingested_at DESC, event_id DESC NULLS LAST) = 1),
weather AS (SELECT area, valid_time, avg(value) FILTER (dimension = 'temperature_2m') AS temperature_2m,
    avg(value) FILTER (dimension = 'wind_speed_10m') AS wind_speed_10m,
    avg(value) FILTER (dimension = 'relative_humidity_2m') AS relative_humidity_2m,
    avg(value) FILTER (dimension = 'shortwave_radiation') AS shortwave_radiation FROM latest GROUP BY 1, 2)"""
LIVE_CALENDAR = """CAST(hour(l) AS INTEGER) AS hour, CAST(minute(l) // 15 AS INTEGER) AS quarter,
  CAST(isodow(l) - 1 AS INTEGER) AS day_of_week, CAST(month(l) AS INTEGER) AS month, CAST(isodow(l) >= 6 AS INTEGER) AS is_weekend"""
DIMS = ("temperature_2m", "wind_speed_10m", "relative_humidity_2m", "shortwave_radiation")


def fill(c: str) -> str:
    return f"last_value({c} IGNORE NULLS) OVER (PARTITION BY area ORDER BY valid_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS {c}"


@register(
    "training_frame",
    f"""WITH {LIVE_SQL}, joined AS (SELECT * FROM target LEFT JOIN weather USING (area, valid_time)),
    wide AS (SELECT area, valid_time, target, {", ".join(fill(c) for c in DIMS)},
      (valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l,
      lag(target, 96) OVER (PARTITION BY area ORDER BY valid_time) AS lag_96,
      lag(target, 672) OVER (PARTITION BY area ORDER BY valid_time) AS lag_672,
      avg(target) OVER (PARTITION BY area ORDER BY valid_time ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS rolling_96 FROM joined)
    SELECT area, valid_time, target, {", ".join(DIMS)}, lag_96, lag_672, rolling_96, {LIVE_CALENDAR} FROM wide
    WHERE lag_672 IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in DIMS)}""",
    doubles=" ".join(DIMS) + " target lag_96 lag_672 rolling_96",
)
def training_frame(t):
    """Complete live training rows: weather filled up to four rows, calendar, lags by row."""
    return frames.training_frame(*live_inputs(t), keys=["area"])


FUTURE_SQL = f"""{LIVE_SQL},
last_seen AS (SELECT area, max(valid_time) AS cut FROM target GROUP BY 1),
history AS (SELECT t.* FROM target t JOIN last_seen USING (area) WHERE valid_time <= cut - INTERVAL 2 DAY),
wanted AS (SELECT area, unnest(range(cut - INTERVAL 1 DAY, cut, INTERVAL 15 MINUTE)) AS valid_time FROM last_seen),
axis AS (SELECT area, valid_time FROM weather UNION SELECT area, valid_time FROM wanted),
filled AS (SELECT area, valid_time, {", ".join(fill(c) for c in DIMS)} FROM axis LEFT JOIN weather USING (area, valid_time)),
means AS (SELECT area, avg(target) AS rolling_96 FROM (SELECT * FROM history QUALIFY row_number() OVER (
  PARTITION BY area ORDER BY valid_time DESC) <= 96) AS tail GROUP BY 1),
firsts AS (SELECT area, arg_min(target, valid_time) AS first_value FROM history GROUP BY 1),
rows AS (SELECT w.area, w.valid_time, {", ".join("f." + c for c in DIMS)}, (w.valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l
  FROM wanted w JOIN filled f USING (area, valid_time)),
day AS (SELECT r.*, h.target AS d FROM (SELECT *, valid_time - INTERVAL 1 DAY AS p FROM rows) r ASOF LEFT JOIN history h
  ON r.area = h.area AND r.p >= h.valid_time),
week AS (SELECT d.*, h.target AS w FROM (SELECT *, valid_time - INTERVAL 7 DAY AS q FROM day) d ASOF LEFT JOIN history h
  ON d.area = h.area AND d.q >= h.valid_time)"""


@register(
    "future_frame",
    f"""WITH {FUTURE_SQL} SELECT area, valid_time, {LIVE_CALENDAR}, {", ".join(DIMS)}, coalesce(d, first_value) AS lag_96,
    coalesce(w, first_value) AS lag_672, rolling_96,
    array_to_string(list_filter([{", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in DIMS)}], lambda x : x IS NOT NULL), ',') AS uncovered
    FROM week JOIN means USING (area) JOIN firsts USING (area)""",
    doubles=" ".join(DIMS) + " lag_96 lag_672 rolling_96",
)
def future_frame(t):
    """Scoring rows of each area's last day, from history that ends a day before it."""
    # Both inputs are read by several lookups below.
    target, weather = map(durable, live_inputs(t))
    cut = target.groupBy("area").agg(F.max("valid_time").alias("cut"))
    history = target.join(cut, "area").filter(
        F.col("valid_time") <= F.col("cut") - F.expr("INTERVAL 2 DAYS")
    ).drop("cut")
    starts = F.sequence(
        F.col("cut") - F.expr("INTERVAL 1 DAY"), F.col("cut") - F.expr("INTERVAL 1 MICROSECOND"),
        F.expr("INTERVAL 15 MINUTES"),
    )
    intervals = cut.select("area", F.explode(starts).alias("valid_from"))
    frame = frames.future_frame(intervals, history, weather, keys=["area"])
    return frame.withColumn("uncovered", F.array_join("uncovered", ","))


@register(
    "baselines",
    f"""WITH {SERIES} SELECT {KEYS}, valid_time, value, lag(value, 24) OVER ({OVER}) AS baseline_24h,
    lag(value, 168) OVER ({OVER}) AS baseline_7d FROM series""",
)
def baselines(t):
    """Values one day and one week earlier, as equi joins on time."""
    return frames.seasonal_baselines(t.series, keys=SERIES_KEYS, lead=24, steps_per_day=24)


@register(
    "holdout_split",
    f"""WITH {SERIES}, ranked AS (SELECT {KEYS}, valid_time, row_number() OVER ({OVER}) - 1 AS i,
      count(*) OVER (PARTITION BY event_type, area) AS n FROM series)
    SELECT {KEYS}, valid_time, CASE WHEN i >= n - floor(n * 0.2::DOUBLE) THEN 'holdout' WHEN i >= n - floor(n * 0.2::DOUBLE) - 24 THEN 'gap'
      ELSE 'train' END AS split, CASE WHEN i >= n - least(288, greatest(96, n // 5)) THEN 'holdout' ELSE 'train' END AS live_split FROM ranked""",
)
def holdout_split(t):
    """Chronological split with a purged gap, and the live variant."""
    split = frames.holdout_split(t.series, keys=SERIES_KEYS, lead=24)
    first = split.withColumnRenamed("split", "history_split")
    both = frames.holdout_split(first, keys=SERIES_KEYS, live=True)
    return both.select(
        *SERIES_KEYS, "valid_time", F.col("history_split").alias("split"), F.col("split").alias("live_split")
    )


@register(
    "dual_training_rows",
    f"""WITH {SERIES}, lagged AS (SELECT *, lag(value, 336) OVER ({OVER}) AS a, lag(value, 359) OVER ({OVER}) AS b FROM series),
    long AS (SELECT *, row_number() OVER ({OVER}) AS i, count(*) OVER (PARTITION BY event_type, area) AS n FROM lagged WHERE b IS NOT NULL),
    train AS (SELECT * FROM long WHERE i <= n - floor(n * 0.2::DOUBLE) - 24),
    cut AS (SELECT event_type, area, max(valid_time) AS last FROM train GROUP BY 1, 2)
    SELECT {KEYS}, valid_time, 24 AS horizon_step, value AS target, b AS lag_14d FROM train
    UNION ALL SELECT s.event_type, s.area, valid_time, 1, value, a FROM lagged s JOIN cut USING (event_type, area)
      WHERE a IS NOT NULL AND valid_time <= last""",
)
def dual_training_rows(t):
    """Long-lead training rows plus one-step rows up to the same last training time."""
    long = features.horizon_features(t.series, keys=SERIES_KEYS, lead=24, steps_per_day=24)
    short = features.horizon_features(t.series, keys=SERIES_KEYS, lead=1, steps_per_day=24)
    train = frames.holdout_split(long, keys=SERIES_KEYS, lead=24).filter("split = 'train'").drop("split")
    rows = frames.dual_training_rows(train, short, keys=SERIES_KEYS)
    return rows.select(*SERIES_KEYS, "valid_time", "horizon_step", "target", "lag_14d")


# --- evaluation and calibration --------------------------------------------------------------

METRICS = """avg(abs(actual - p50)) AS mae, sqrt(avg(power(actual - p50, 2))) AS rmse,
  {wape} AS wape, avg(CASE WHEN abs(actual) > 0.001 THEN abs(actual - p50) / abs(actual) END) * 100.0 AS mape,
  avg(greatest((actual - p10) * 0.1::DOUBLE, (actual - p10) * (0.1::DOUBLE - 1))) AS pinball_p10,
  avg(greatest((actual - p90) * 0.9::DOUBLE, (actual - p90) * (0.9::DOUBLE - 1))) AS pinball_p90,
  avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0::DOUBLE ELSE 0.0 END) AS interval_coverage,
  avg(p90 - p10 + CASE WHEN actual < p10 THEN (p10 - actual) * 10.0::DOUBLE ELSE 0.0 END
    + CASE WHEN actual > p90 THEN (actual - p90) * 10.0::DOUBLE ELSE 0.0 END) AS winkler_score"""
WAPE = "sum(abs(actual - p50)) / nullif(sum(abs(actual)), 0)"
WAPE_UNLESS_PRICE = f"CASE WHEN event_type <> 'purchase' THEN {WAPE} END"
METRIC_NAMES = "mae rmse wape mape pinball_p10 pinball_p90 interval_coverage winkler_score"


@register(
    "forecast_metrics",
    f"WITH {LEARNERS} SELECT {KEYS}, count(*) AS n, {METRICS.format(wape=WAPE_UNLESS_PRICE)} FROM simple GROUP BY 1, 2",
    doubles=METRIC_NAMES,
)
def forecast_metrics(t):
    return evaluate.forecast_metrics(
        t.intervals_forecast, keys=SERIES_KEYS, allow_wape=F.col("event_type") != "purchase"
    )


SCORED = """scored AS (SELECT *, greatest(p10 - actual, actual - p90) / ((p90 - p10) + 0.0001::DOUBLE) AS score FROM simple),
fitted AS (SELECT event_type, area, list_sort(list(score)) AS scores, count(*) AS n FROM scored GROUP BY 1, 2),
corrected AS (SELECT event_type, area, n,
  scores[CAST(least(n, ceil((n + 1) * 0.8::DOUBLE) + 1) AS BIGINT)] AS q_correction FROM fitted)"""


@register(
    "conformal_fit", f"WITH {LEARNERS}, {SCORED} SELECT {KEYS}, q_correction, n FROM corrected", doubles="q_correction"
)
def conformal_fit(t):
    """Split-conformal correction per series: an exact order statistic."""
    return calibration.conformal_fit(t.intervals_forecast, keys=SERIES_KEYS)


APPLIED = """applied AS (SELECT s.* EXCLUDE (p10, p50, p90), list_sort([p10 - q_correction * ((p90 - p10) + 0.0001::DOUBLE), p50,
  p90 + q_correction * ((p90 - p10) + 0.0001::DOUBLE)]) AS q FROM {source} s JOIN corrected USING (event_type, area))"""
QUANTILES = "q[1] AS p10, q[2] AS p50, q[3] AS p90"


@register(
    "conformal_apply",
    f"WITH {LEARNERS}, {SCORED}, {APPLIED.format(source='simple')} SELECT {KEYS}, valid_time, actual, {QUANTILES} FROM applied",
    doubles="actual p10 p50 p90",
)
def conformal_apply(t):
    rows = t.intervals_forecast
    fitted = calibration.conformal_fit(rows, keys=SERIES_KEYS)
    joined = rows.join(fitted, list(SERIES_KEYS))
    out = calibration.conformal_apply(joined, F.col("q_correction"))
    return out.select(*SERIES_KEYS, "valid_time", "actual", "p10", "p50", "p90")


@register(
    "monotone_quantiles",
    f"WITH {LEARNERS}, sorted AS (SELECT *, list_sort([p10_2, p50_2, p90_2]) AS q FROM learners) SELECT {KEYS}, valid_time, {QUANTILES} FROM sorted",
    doubles="p10 p50 p90",
)
def monotone_quantiles(t):
    crossed = t.learner_outputs.select(
        *SERIES_KEYS, "valid_time", F.col("p10_2").alias("p10"), F.col("p50_2").alias("p50"), F.col("p90_2").alias("p90")
    )
    return calibration.monotone(crossed)


BLEND = ", ".join(
    f"0.45::DOUBLE * {q}_1 + 0.35::DOUBLE * {q}_2 + 0.20::DOUBLE * {q}_3 AS {q}" for q in ("p10", "p50", "p90")
)


@register(
    "stacked_blend",
    f"""WITH {LEARNERS}, blended AS (SELECT {KEYS}, valid_time, actual, {BLEND} FROM learners),
    ordered AS (SELECT {KEYS}, valid_time, actual, list_sort([p10, p50, p90]) AS q FROM blended),
    cut AS (SELECT {KEYS}, valid_time AS start FROM (SELECT *, row_number() OVER ({OVER}) - 1 AS i, count(*) OVER (
      PARTITION BY event_type, area) AS n FROM ordered) x WHERE i = n - greatest(1, floor(n * 0.15::DOUBLE))),
    simple2 AS (SELECT {KEYS}, valid_time, actual, {QUANTILES}, valid_time >= start AS is_calibration FROM ordered JOIN cut USING (event_type, area)),
    {SCORED.replace("FROM simple", "FROM simple2 WHERE is_calibration")}, {APPLIED.format(source="simple2")}
    SELECT {KEYS}, valid_time, actual, is_calibration, {QUANTILES} FROM applied""",
    doubles="actual p10 p50 p90",
)
def stacked_blend(t):
    """Weighted blend, calibrated on the blended output of the last 15 % of distinct periods."""
    blended = calibration.stacked_blend(t.learner_outputs)
    split = learners.split_last_periods(blended, keys=SERIES_KEYS, fraction=0.15)
    fitted = calibration.conformal_fit(split.filter("is_calibration"), keys=SERIES_KEYS)
    out = calibration.conformal_apply(split.join(fitted, list(SERIES_KEYS)), F.col("q_correction"))
    return out.select(*SERIES_KEYS, "valid_time", "actual", "is_calibration", "p10", "p50", "p90")


@register(
    "dual_horizon_blend",
    f"""WITH {LEARNERS}, stepped AS (SELECT *, CAST(hour(valid_time) + 1 AS INTEGER) AS horizon_step FROM learners),
    weighted AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0 - (horizon_step - 1) / 6.0::DOUBLE)) AS a FROM stepped),
    mixed AS (SELECT {KEYS}, valid_time, horizon_step, list_sort([{", ".join(
        f"a * {q}_1 + (1.0 - a) * {q}_3" for q in ("p10", "p50", "p90"))}]) AS q FROM weighted)
    SELECT {KEYS}, valid_time, horizon_step, {QUANTILES} FROM mixed""",
    doubles="p10 p50 p90",
)
def dual_horizon_blend(t):
    """Short and long model mixed by each row's lead."""
    renamed = {f"{q}_1": f"{q}_s" for q in ("p10", "p50", "p90")} | {f"{q}_3": f"{q}_l" for q in ("p10", "p50", "p90")}
    rows = t.learner_outputs.withColumnsRenamed(renamed).withColumn("horizon_step", F.hour("valid_time") + 1)
    out = calibration.dual_horizon_blend(rows, 6)
    return out.select(*SERIES_KEYS, "valid_time", "horizon_step", "p10", "p50", "p90")


LOCAL_DAILY = "(valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid'"


@register(
    "slice_hour",
    f"""WITH {LEARNERS} SELECT {KEYS}, CAST(hour({LOCAL_DAILY}) AS INTEGER) AS hour, avg(abs(actual - predicted)) AS mae, count(*) AS n
    FROM simple GROUP BY 1, 2, 3""",
    doubles="mae",
)
def slice_hour(t):
    return evaluate.slice_by_hour(t.intervals_forecast, keys=SERIES_KEYS)


@register(
    "slice_season_daytype",
    f"""WITH {DAILY}, labelled AS (SELECT o_orderpriority, abs(actual - predicted) AS e, CASE WHEN month({LOCAL_DAILY}) IN (12, 1, 2) THEN 'Winter'
      WHEN month({LOCAL_DAILY}) <= 5 THEN 'Spring' WHEN month({LOCAL_DAILY}) <= 8 THEN 'Summer' ELSE 'Autumn' END AS season,
      CASE WHEN isodow({LOCAL_DAILY}) >= 6 THEN 'Weekend' ELSE 'Weekday' END AS day_type FROM daily)
    SELECT o_orderpriority, 'season' AS dimension, season AS slice, avg(e) AS mae, count(*) AS n FROM labelled GROUP BY 1, 3
    UNION ALL SELECT o_orderpriority, 'day_type', day_type, avg(e), count(*) FROM labelled GROUP BY 1, 3""",
    digits=4,
    doubles="mae",
)
def slice_season_daytype(t):
    return evaluate.slice_by_season_and_day_type(t.daily, keys=["o_orderpriority"])


@register(
    "slice_regime",
    f"""WITH {LEARNERS}, peaks AS (SELECT event_type, area, quantile_cont(actual, 0.95) AS q95 FROM simple GROUP BY 1, 2),
    marked AS (SELECT s.*, abs(actual - predicted) AS e, q95 FROM simple s JOIN peaks USING (event_type, area))
    SELECT {KEYS}, CASE WHEN actual >= q95 THEN 'peak' ELSE 'normal' END AS regime, avg(e) AS mae, count(*) AS n FROM marked GROUP BY 1, 2, 3
    UNION ALL SELECT {KEYS}, 'price_spike', avg(e), count(*) FROM marked WHERE event_type = 'purchase' AND actual > 150 GROUP BY 1, 2
    UNION ALL SELECT {KEYS}, 'negative_price', avg(e), count(*) FROM marked WHERE event_type = 'purchase' AND actual < 0 GROUP BY 1, 2""",
    doubles="mae",
)
def slice_regime(t):
    """Peak (top 5 %), normal and price regimes, with an exact 95th percentile."""
    return evaluate.slice_by_regime(
        t.intervals_forecast, keys=SERIES_KEYS, is_price=F.col("event_type") == "purchase"
    )


@register(
    "feature_drift_psi",
    f"""WITH {SERIES}, cut AS (SELECT event_type, area, min(valid_time) + INTERVAL 15 DAY AS c FROM series GROUP BY 1, 2),
    sides AS (SELECT s.*, valid_time < c AS is_ref FROM series s JOIN cut USING (event_type, area)),
    edges AS (SELECT event_type, area, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM sides WHERE is_ref GROUP BY 1, 2),
    binned AS (SELECT event_type, area, is_ref, len(list_filter(e, lambda x : x < value)) AS bin FROM sides JOIN edges USING (event_type, area)),
    grid AS (SELECT event_type, area, unnest(range(10)) AS bin FROM edges),
    shares AS (SELECT event_type, area, g.bin, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b
      FROM grid g LEFT JOIN binned USING (event_type, area, bin) GROUP BY 1, 2, 3),
    ratios AS (SELECT event_type, area, greatest(a / sum(a) OVER w, 0.0001::DOUBLE) AS pa, greatest(b / sum(b) OVER w, 0.0001::DOUBLE) AS pb
      FROM shares WINDOW w AS (PARTITION BY event_type, area))
    SELECT event_type, area, sum((pa - pb) * ln(pa / pb)) AS psi FROM ratios GROUP BY 1, 2""",
    doubles="psi",
)
def feature_drift_psi(t):
    """Drift of each series: its first 15 days against the rest."""
    cut = t.series.groupBy(*SERIES_KEYS).agg((F.min("valid_time") + F.expr("INTERVAL 15 DAYS")).alias("_c"))
    sides = t.series.join(cut, list(SERIES_KEYS))
    before, after = F.col("valid_time") < F.col("_c"), F.col("valid_time") >= F.col("_c")
    return monitoring.population_stability(
        sides.filter(before), sides.filter(after), keys=SERIES_KEYS, value="value"
    )


# --- backtests -------------------------------------------------------------------------------

P = PLAN
HEAD = 14 * P.steps_per_day + P.lead_steps - 1
FOLDS = f"""{SERIES},
based AS (SELECT {KEYS}, valid_time, value AS target, lag(value, {max(P.lead_steps, 24)}) OVER ({OVER}) AS baseline_24h,
    lag(value, {max(P.lead_steps, 168)}) OVER ({OVER}) AS baseline_7d, row_number() OVER ({OVER}) - 1 - {HEAD} AS row_idx,
    count(*) OVER (PARTITION BY event_type, area) - {HEAD} AS n,
    (valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l FROM series),
folds AS (SELECT DISTINCT event_type, area, unnest(range(0, CAST((n - {P.train_rows + P.test_rows}) // {P.step_rows} + 1 AS BIGINT))) AS k
  FROM based WHERE n >= {P.train_rows + P.test_rows}),
members AS (SELECT b.*, k + 1 AS fold, CAST(hour(l) AS INTEGER) AS hour, isodow(l) >= 6 AS is_weekend,
    CASE WHEN row_idx >= {P.train_rows} + k * {P.step_rows} THEN 'test'
      WHEN row_idx >= {P.train_rows} + k * {P.step_rows} - {P.lead_steps} - {P.calibration_rows} THEN 'calibrate' ELSE 'fit' END AS role
  FROM based b JOIN folds f USING (event_type, area) WHERE row_idx >= 0 AND
    ((row_idx >= k * {P.step_rows} AND row_idx < {P.train_rows} + k * {P.step_rows} - {P.lead_steps})
     OR (row_idx >= {P.train_rows} + k * {P.step_rows} AND row_idx < {P.train_rows + P.test_rows} + k * {P.step_rows})))"""


@register(
    "backtest_folds",
    f"""WITH {FOLDS} SELECT {KEYS}, fold, min(valid_time) FILTER (role <> 'test') AS train_start,
      max(valid_time) FILTER (role <> 'test') AS train_end, min(valid_time) FILTER (role = 'test') AS test_start,
      max(valid_time) FILTER (role = 'test') AS test_end, count(*) FILTER (role = 'fit') AS fit_rows,
      count(*) FILTER (role = 'calibrate') AS calibration_rows, count(*) FILTER (role = 'test') AS test_rows
    FROM members GROUP BY 1, 2, 3""",
)
def backtest_folds(t):
    """Bounds and sizes of each fold; training ends before the first forecast origin."""
    members = backtest.backtest_members(t.series, keys=SERIES_KEYS, plan=P)
    return backtest.fold_windows(members, keys=SERIES_KEYS)


PREDICTED = f"""{FOLDS},
fine AS (SELECT {KEYS}, fold, hour, is_weekend, quantile_cont(target, [0.1, 0.5, 0.9]) AS f FROM members WHERE role = 'fit' GROUP BY ALL),
coarse AS (SELECT {KEYS}, fold, hour, quantile_cont(target, [0.1, 0.5, 0.9]) AS c FROM members WHERE role = 'fit' GROUP BY ALL),
raw AS (SELECT m.*, coalesce(f, c) AS q FROM members m LEFT JOIN fine USING (event_type, area, fold, hour, is_weekend)
  LEFT JOIN coarse USING (event_type, area, fold, hour) WHERE role <> 'fit'),
scores AS (SELECT {KEYS}, fold, list_sort(list(greatest(q[1] - target, target - q[3]) / ((q[3] - q[1]) + 0.0001::DOUBLE))) AS s, count(*) AS n
  FROM raw WHERE role = 'calibrate' GROUP BY 1, 2, 3),
corr AS (SELECT {KEYS}, fold, s[CAST(least(n, ceil((n + 1) * 0.8::DOUBLE) + 1) AS BIGINT)] AS q_correction FROM scores),
cal AS (SELECT r.*, q_correction, list_sort([q[1] - q_correction * ((q[3] - q[1]) + 0.0001::DOUBLE), q[2],
  q[3] + q_correction * ((q[3] - q[1]) + 0.0001::DOUBLE)]) AS z FROM raw r JOIN corr USING (event_type, area, fold) WHERE role = 'test'),
preds AS (SELECT {KEYS}, fold, valid_time, target AS actual, z[1] AS p10, z[2] AS p50, z[3] AS p90, q[1] AS raw_p10, q[3] AS raw_p90,
  q_correction, baseline_24h, baseline_7d, z[2] AS predicted FROM cal)"""
REPORT = f"""{METRICS.format(wape=WAPE_UNLESS_PRICE)},
  avg(abs(actual - baseline_24h)) AS baseline_24h_mae, sqrt(avg(power(actual - baseline_24h, 2))) AS baseline_24h_rmse,
  avg(abs(actual - baseline_7d)) AS baseline_7d_mae, sqrt(avg(power(actual - baseline_7d, 2))) AS baseline_7d_rmse,
  avg(CASE WHEN actual BETWEEN raw_p10 AND raw_p90 THEN 1.0::DOUBLE ELSE 0.0 END) AS uncalibrated_coverage,
  avg(CASE WHEN actual BETWEEN p10 AND p90 THEN 1.0::DOUBLE ELSE 0.0 END) AS calibrated_coverage, count(*) AS test_rows"""
COARSE = "pinball_p10 pinball_p90 winkler_score"
REPORT_NAMES = "mae rmse wape mape interval_coverage" + (
    " baseline_24h_mae baseline_24h_rmse baseline_7d_mae baseline_7d_rmse uncalibrated_coverage calibrated_coverage"
)


def predictions(t) -> DataFrame:
    return backtest.backtest_predictions(t.series, keys=SERIES_KEYS, plan=P)


def not_price():
    return F.col("event_type") != "purchase"


@register(
    "seasonal_quantile_forecast",
    f"WITH {PREDICTED} SELECT * FROM preds",
    doubles="actual p10 p50 p90 raw_p10 raw_p90 q_correction predicted",
)
def seasonal_quantile_forecast(t):
    """Out-of-sample predictions of the seasonal quantile learner, raw and calibrated."""
    return predictions(t)


@register(
    "backtest_fold_metrics",
    f"WITH {PREDICTED} SELECT {KEYS}, fold, min(valid_time) AS test_start, max(valid_time) AS test_end, {REPORT} FROM preds GROUP BY 1, 2, 3",
    digits=8,
    doubles=REPORT_NAMES,
    coarse=COARSE,
)
def backtest_fold_metrics(t):
    return backtest.fold_metrics(predictions(t), keys=SERIES_KEYS, allow_wape=not_price())


SUMMARY = f"""WITH {PREDICTED}, pooled AS (SELECT {KEYS}, {REPORT}, max(fold) AS fold_count FROM preds GROUP BY 1, 2)
SELECT *, (baseline_24h_mae - mae) / baseline_24h_mae * 100.0 AS mae_improvement_vs_24h,
  (baseline_7d_mae - mae) / baseline_7d_mae * 100.0 AS mae_improvement_vs_7d FROM pooled"""


@register(
    "backtest_summary",
    SUMMARY,
    digits=8,
    doubles=REPORT_NAMES + " mae_improvement_vs_24h mae_improvement_vs_7d",
    coarse=COARSE,
)
def backtest_summary(t):
    """Pooled rolling-origin backtest per series with improvement over both baselines."""
    short = backtest.short_series(t.series, keys=SERIES_KEYS, plan=P)
    return backtest.backtest_summary(predictions(t), keys=SERIES_KEYS, allow_wape=not_price(), short=short).drop("reason")


@register(
    "benchmark_table",
    f"""SELECT area AS market, event_type AS target, 24.0::DOUBLE AS lead_hours, mae, baseline_7d_mae, calibrated_coverage * 100 AS coverage_pct,
    fold_count FROM ({SUMMARY}) AS s""",
    digits=8,
    doubles="lead_hours mae baseline_7d_mae coverage_pct",
)
def benchmark_table(t):
    summary = backtest.backtest_summary(predictions(t), keys=SERIES_KEYS, allow_wape=not_price())
    return backtest.benchmark_table(summary, market=F.col("area"), target=F.col("event_type"), plan=P)


LINEAR = f"""WITH {FOLDS},
fits AS (SELECT {KEYS}, fold, regr_intercept(target, baseline_7d) AS a, regr_slope(target, baseline_7d) AS b FROM members WHERE role = 'fit' GROUP BY 1, 2, 3),
raw AS (SELECT m.*, a + b * baseline_7d AS p FROM members m JOIN fits USING (event_type, area, fold) WHERE role <> 'fit' AND target IS NOT NULL),
scores AS (SELECT {KEYS}, fold, list_sort(list(abs(p - target) / 0.0001::DOUBLE)) AS s, count(*) AS n FROM raw WHERE role = 'calibrate' GROUP BY 1, 2, 3),
corr AS (SELECT {KEYS}, fold, s[CAST(least(n, ceil((n + 1) * 0.8::DOUBLE) + 1) AS BIGINT)] * 0.0001::DOUBLE AS amount FROM scores)
SELECT {KEYS}, fold, valid_time, target AS actual, p - amount AS p10, p AS p50, p + amount AS p90 FROM raw JOIN corr USING (event_type, area, fold) WHERE role = 'test'"""


@register("linear_backtest", LINEAR, digits=5, doubles="actual p10 p50 p90")
def linear_backtest(t):
    """A least-squares learner on last week's value in every fold, fitted from block statistics that read each row once."""
    based = backtest.shifted_values(t.series, keys=SERIES_KEYS, steps_per_day=24, offsets={"baseline_7d": 168})
    out = fold_blocks.linear_backtest(based, keys=SERIES_KEYS, plan=P, features=["baseline_7d"])
    return out.select(*SERIES_KEYS, "fold", "valid_time", "actual", "p10", "p50", "p90")


@register(
    "fold_quantiles",
    f"""WITH {FOLDS}, q AS (SELECT {KEYS}, fold, hour, quantile_cont(target, [0.1, 0.5, 0.9]) AS q FROM members WHERE role = 'fit' GROUP BY 1, 2, 3, 4)
    SELECT {KEYS}, fold, hour, {QUANTILES} FROM q""",
    doubles="p10 p50 p90",
)
def fold_quantiles(t):
    """Quantiles by hour of every fold's training window, from value counts per block."""
    rows = backtest.indexed_rows(t.series, keys=SERIES_KEYS, plan=P).withColumn("hour", calendar_columns(F.col("valid_time"))["hour"])
    counts = durable(fold_blocks.count_blocks(rows, keys=SERIES_KEYS, plan=P, by=["hour"], target="value"))
    folds = fold_blocks.folds_of(rows, SERIES_KEYS)
    out = fold_blocks.fold_quantiles(counts, folds, keys=SERIES_KEYS, plan=P, by=["hour"], quantiles=learners.QUANTILES)
    return out.select(*SERIES_KEYS, "fold", "hour", *[F.col("q")[i].alias(n) for i, n in enumerate(learners.QUANTILE_COLUMNS)])


SINGLE = ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in METRIC_NAMES.split())
NO_METRICS = ", ".join(f"CAST(NULL AS DOUBLE) AS {m}" for m in METRIC_NAMES.split()[1:])
SLICED = f"SELECT {KEYS}, '{{section}}' AS section, CAST({{slice}} AS VARCHAR) AS slice, avg(e) AS mae, {NO_METRICS}, count(*) AS n FROM marked {{where}} GROUP BY 1, 2, 4"


@register(
    "backtest_report",
    f"""SELECT * REPLACE ({SINGLE}) FROM (WITH {PREDICTED},
    three AS (SELECT {KEYS}, 'model' AS slice, actual, p10, p50, p90 FROM preds
      UNION ALL SELECT {KEYS}, 'baseline_24h', actual, baseline_24h, baseline_24h, baseline_24h FROM preds WHERE baseline_24h IS NOT NULL
      UNION ALL SELECT {KEYS}, 'baseline_7d', actual, baseline_7d, baseline_7d, baseline_7d FROM preds WHERE baseline_7d IS NOT NULL),
    peaks AS (SELECT event_type, area, quantile_cont(actual, 0.95) AS q95 FROM preds GROUP BY 1, 2),
    marked AS (SELECT p.*, q95, abs(actual - predicted) AS e, {LOCAL_DAILY} AS l FROM preds p JOIN peaks USING (event_type, area))
    SELECT {KEYS}, 'overall' AS section, slice, {METRICS.format(wape=WAPE_UNLESS_PRICE)}, count(*) AS n FROM three GROUP BY 1, 2, 4
    UNION ALL SELECT {KEYS}, 'fold', CAST(fold AS VARCHAR), {METRICS.format(wape=WAPE_UNLESS_PRICE)}, count(*) FROM preds GROUP BY 1, 2, fold
    UNION ALL {SLICED.format(section="hour", slice="hour(l)", where="")}
    UNION ALL {SLICED.format(section="season", slice="CASE WHEN month(l) IN (12, 1, 2) THEN 'Winter' WHEN month(l) <= 5 THEN 'Spring' WHEN month(l) <= 8 THEN 'Summer' ELSE 'Autumn' END", where="")}
    UNION ALL {SLICED.format(section="day_type", slice="CASE WHEN isodow(l) >= 6 THEN 'Weekend' ELSE 'Weekday' END", where="")}
    UNION ALL {SLICED.format(section="regime", slice="CASE WHEN actual >= q95 THEN 'peak' ELSE 'normal' END", where="")}
    UNION ALL {SLICED.format(section="regime", slice="'price_spike'", where="WHERE event_type = 'purchase' AND actual > 150")}
    UNION ALL {SLICED.format(section="regime", slice="'negative_price'", where="WHERE event_type = 'purchase' AND actual < 0")}) AS report""",
)
def backtest_report(t):
    """The composed report: all metrics of model and baselines, every fold, and the error by hour, season, day type and regime."""
    report = backtest.backtest_report(predictions(t), keys=SERIES_KEYS, allow_wape=not_price(), is_price=~not_price())
    # Many of these means end in few digits, where decimal rounding would show the order of summation.
    return report.withColumns({c: F.col(c).cast("float") for c in METRIC_NAMES.split()})


HOLDOUT = f"""WITH {SERIES},
complete AS (SELECT *, lag(value, 168) OVER ({OVER}) AS base, lag(value, 359) OVER ({OVER}) AS b,
  (valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l FROM series),
ranked AS (SELECT {KEYS}, valid_time, value AS target, base, CAST(hour(l) AS INTEGER) AS hour, isodow(l) >= 6 AS is_weekend,
  row_number() OVER ({OVER}) - 1 AS i, count(*) OVER (PARTITION BY event_type, area) AS n FROM complete WHERE b IS NOT NULL),
train AS (SELECT *, row_number() OVER ({OVER}) - 1 AS j, count(*) OVER (PARTITION BY event_type, area) AS m FROM ranked
  WHERE i < n - floor(n * 0.2::DOUBLE) - 24),
fit AS (SELECT * FROM train WHERE j < m - greatest(96, floor(m * 0.15::DOUBLE))),
fine AS (SELECT {KEYS}, hour, is_weekend, quantile_cont(target, [0.1, 0.5, 0.9]) AS f FROM fit GROUP BY ALL),
coarse AS (SELECT {KEYS}, hour, quantile_cont(target, [0.1, 0.5, 0.9]) AS c FROM fit GROUP BY ALL),
scored AS (SELECT t.*, coalesce(f, c) AS q FROM train t LEFT JOIN fine USING (event_type, area, hour, is_weekend)
  LEFT JOIN coarse USING (event_type, area, hour) WHERE j >= m - greatest(96, floor(m * 0.15::DOUBLE))),
sorted AS (SELECT {KEYS}, list_sort(list(greatest(q[1] - target, target - q[3]) / ((q[3] - q[1]) + 0.0001::DOUBLE))) AS s, count(*) AS k
  FROM scored GROUP BY 1, 2),
corr AS (SELECT {KEYS}, s[CAST(least(k, ceil((k + 1) * 0.8::DOUBLE) + 1) AS BIGINT)] AS qc FROM sorted),
held AS (SELECT r.*, coalesce(f, c) AS q, qc FROM ranked r LEFT JOIN fine USING (event_type, area, hour, is_weekend)
  LEFT JOIN coarse USING (event_type, area, hour) JOIN corr USING (event_type, area) WHERE i >= n - floor(n * 0.2::DOUBLE)),
preds AS (SELECT {KEYS}, valid_time, target AS actual, base, list_sort([q[1] - qc * ((q[3] - q[1]) + 0.0001::DOUBLE), q[2],
  q[3] + qc * ((q[3] - q[1]) + 0.0001::DOUBLE)]) AS z FROM held),
final AS (SELECT *, z[1] AS p10, z[2] AS p50, z[3] AS p90 FROM preds)"""


@register(
    "holdout_eval",
    f"""{HOLDOUT} SELECT {KEYS}, count(*) AS n, {METRICS.format(wape=WAPE)}, avg(abs(actual - base)) AS baseline_mae FROM final GROUP BY 1, 2""",
    digits=8,
    doubles="mae rmse wape mape interval_coverage baseline_mae",
    coarse=COARSE,
)
def holdout_eval(t):
    """Historical training: purge, fit, calibrate, score the last 20 % against last week's values."""
    based = backtest.shifted_values(t.series, keys=SERIES_KEYS, steps_per_day=24, offsets={"baseline": 168})
    calendar = calendar_columns(F.col("valid_time"))
    rows = backtest.indexed_rows(based, keys=SERIES_KEYS, plan=P).withColumns(
        {name: calendar[name] for name in ("hour", "is_weekend")}
    )
    split = frames.label_holdout(rows.withColumnRenamed("value", "target"), "row_idx", "row_count", lead=24)
    model = learners.SeasonalQuantileForecaster(keys=SERIES_KEYS).fit(
        split.filter("split = 'train'").drop("split"), feature_names=[], calibration_fraction=0.15
    )
    held = model.predict(split.filter("split = 'holdout'"))
    return held.withColumn("actual", F.col("target")).groupBy(*SERIES_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        *evaluate_columns(F.col("actual"), F.col("p50"), F.col("p10"), F.col("p90")),
        F.avg(F.abs(F.col("actual") - F.col("baseline"))).alias("baseline_mae"),
    )


# --- live chain -------------------------------------------------------------------------------

LIVE_RUN = f"""WITH {LIVE_SQL}, cuts AS (SELECT area, max(valid_time) - INTERVAL 1 DAY AS cut FROM target GROUP BY 1),
known AS (SELECT t.* FROM target t JOIN cuts USING (area) WHERE valid_time <= cut),
hours AS (SELECT area, hour(valid_time) AS h, {", ".join(f"avg({c}) AS {c}" for c in DIMS)} FROM weather GROUP BY 1, 2),
quarter AS (SELECT area, unnest(range(min(valid_time), max(valid_time) + INTERVAL 15 MINUTE, INTERVAL 15 MINUTE)) AS valid_time FROM target GROUP BY 1),
covered AS (SELECT q.area, q.valid_time, {", ".join(f"h.{c}" for c in DIMS)} FROM quarter q LEFT JOIN hours h ON q.area = h.area AND hour(q.valid_time) = h.h),
joined AS (SELECT * FROM known LEFT JOIN covered USING (area, valid_time)),
wide AS (SELECT area, valid_time, target, {", ".join(fill(c) for c in DIMS)}, (valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l,
  lag(target, 672) OVER (PARTITION BY area ORDER BY valid_time) AS lag_672 FROM joined),
frame AS (SELECT area, valid_time, target, lag_672, {LIVE_CALENDAR}, row_number() OVER (PARTITION BY area ORDER BY valid_time) - 1 AS i,
  count(*) OVER (PARTITION BY area) AS n FROM wide WHERE lag_672 IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in DIMS)}),
usable AS (SELECT *, i >= n - least(288, greatest(96, n // 5)) AS held FROM frame WHERE n >= 480),
fine AS (SELECT area, hour, is_weekend, quantile_cont(target, [0.1, 0.5, 0.9]) AS f FROM usable WHERE NOT held GROUP BY ALL),
coarse AS (SELECT area, hour, quantile_cont(target, [0.1, 0.5, 0.9]) AS c FROM usable WHERE NOT held GROUP BY ALL),
judged AS (SELECT area, target AS actual, lag_672, coalesce(f, c) AS q FROM usable LEFT JOIN fine USING (area, hour, is_weekend)
  LEFT JOIN coarse USING (area, hour) WHERE held),
simple AS (SELECT *, q[1] AS p10, q[2] AS p50, q[3] AS p90 FROM judged),
measured AS (SELECT area, {METRICS.format(wape=WAPE)}, avg(abs(actual - lag_672)) AS baseline_mae FROM simple GROUP BY 1),
sizes AS (SELECT area, count(*) AS training_rows, min(valid_time) AS training_start, max(valid_time) AS training_end FROM usable GROUP BY 1),
candidates AS (SELECT *, baseline_mae > 0 AND NOT ((baseline_mae - mae) / baseline_mae < 0.02) AS promoted FROM measured JOIN sizes USING (area))"""


def live_run(t) -> live.LiveRun:
    """The live chain with the seasonal learner, issued a day before the last value of each area.

    The given observations leave most quarter hours without weather, so each gets the mean of its hour of the day.
    """
    target, observed = map(durable, live_inputs(t))
    hours = observed.groupBy("area", F.hour("valid_time").alias("_h")).agg(*[F.avg(c).alias(c) for c in DIMS])
    axis = target.groupBy("area").agg(F.min("valid_time").alias("a"), F.max("valid_time").alias("b")).select(
        "area", F.explode(F.sequence("a", "b", F.expr("INTERVAL 15 MINUTES"))).alias("valid_time")
    )
    weather = axis.withColumn("_h", F.hour("valid_time")).join(hours, ["area", "_h"], "left").drop("_h")
    cuts = target.groupBy("area").agg((F.max("valid_time") - F.expr("INTERVAL 1 DAY")).alias("issue_time"))
    known = target.join(cuts, "area").filter(F.col("valid_time") <= F.col("issue_time")).drop("issue_time")
    intervals = forecast_intervals(cuts, "demand").select("area", "valid_from", "valid_to")
    return live.train_and_forecast(
        known, weather, weather, intervals, lambda: learners.SeasonalQuantileForecaster(keys=["area"]),
        target="demand", issue_time=F.lit(NOW).cast("timestamp"), version="v1",
    )


@register(
    "live_candidates",
    f"""{LIVE_RUN} SELECT area, mae, rmse, wape, mape, interval_coverage, baseline_mae, training_rows, training_start, training_end, promoted,
      CASE WHEN promoted THEN 'champion' ELSE 'candidate_rejected' END AS status FROM candidates""",
    digits=8,
    doubles="mae rmse wape mape interval_coverage baseline_mae",
)
def live_candidates(t):
    """Each area's candidate: validation metrics, lineage of its training rows, outcome of the gate, and the deployment that follows."""
    run = live_run(t)
    status = live.released(run.candidates, None).select("area", "status")
    return run.candidates.join(status, "area").select(
        "area", "mae", "rmse", "wape", "mape", "interval_coverage", "baseline_mae", "training_rows", "training_start", "training_end", "promoted", "status"
    )


@register(
    "live_forecast",
    f"""{LIVE_RUN}, allfine AS (SELECT area, hour, is_weekend, quantile_cont(target, [0.1, 0.5, 0.9]) AS f FROM usable GROUP BY ALL),
    allcoarse AS (SELECT area, hour, quantile_cont(target, [0.1, 0.5, 0.9]) AS c FROM usable GROUP BY ALL),
    wanted AS (SELECT area, promoted, time_bucket(INTERVAL 15 MINUTE, cut) + INTERVAL 15 MINUTE * k AS valid_time FROM cuts JOIN candidates USING (area), range(1, 25) r(k)),
    placed AS (SELECT *, (valid_time AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS l FROM wanted),
    dated AS (SELECT area, promoted, valid_time, {LIVE_CALENDAR} FROM placed),
    scored AS (SELECT d.*, coalesce(f, c) AS q FROM dated d LEFT JOIN allfine USING (area, hour, is_weekend) LEFT JOIN allcoarse USING (area, hour))
    SELECT 'demand' AS target, area, valid_time AS valid_from, valid_time + INTERVAL 15 MINUTE AS valid_to, q[2] AS point, {QUANTILES},
      'MW' AS unit, 'v1' AS model_version, NOT promoted AS is_shadow FROM scored""",
    doubles="point p10 p50 p90",
)
def live_forecast(t):
    """Forecast rows of the run: the next 24 quarter hours of each area with enough history, shadow rows where the gate rejects."""
    rows = live_run(t).forecasts
    return rows.select("target", "area", "valid_from", "valid_to", "point", "p10", "p50", "p90", "unit", "model_version", "is_shadow")


# --- MLlib learners (no SQL counterpart) -----------------------------------------------------

NUMERIC = [c for c in features.ALL_FEATURES if c not in ("quarter", "month", "is_holiday", "rolling_std_4step")]


def learner_rows(t) -> tuple[DataFrame, DataFrame]:
    """Training and holdout rows; every boosting pass rereads them, so they are stored once."""
    rows = features.horizon_features(t.series, keys=SERIES_KEYS, lead=24, steps_per_day=24)
    split = durable(frames.holdout_split(rows, keys=SERIES_KEYS, lead=24))
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'holdout'").drop("split")


@register("gbt_quantile_forecast")
def gbt_quantile_forecast(t):
    """Boosted trees on the median, residual quantiles by hour, conformal calibration."""
    train, held = learner_rows(t)
    model = learners.BoostedTreesForecaster(keys=SERIES_KEYS, iterations=5, depth=4)
    model.fit(train, feature_names=NUMERIC, calibration_fraction=0.15)
    return model.predict(held).select(*SERIES_KEYS, "valid_time", "target", "p10", "p50", "p90")


@register("leaf_quantile_forecast")
def leaf_quantile_forecast(t):
    """All three quantiles straight from the leaves of a forest, filled with values it was not grown on, then calibrated."""
    train, held = learner_rows(t)
    model = learners.LeafQuantileForecaster(keys=SERIES_KEYS, trees=5, depth=4)
    model.fit(train, feature_names=NUMERIC, calibration_fraction=0.15)
    return model.predict(held).select(*SERIES_KEYS, "valid_time", "target", "p10", "p50", "p90")


@register("model_zoo")
def model_zoo(t):
    """Every learner behind the same interface, compared on the same holdout."""
    train, held = learner_rows(t)
    zoo = [
        learners.SeasonalQuantileForecaster(keys=SERIES_KEYS),
        learners.RandomForestForecaster(keys=SERIES_KEYS, trees=5, depth=4),
        learners.RobustLinearForecaster(keys=SERIES_KEYS),
    ]
    scored = []
    for model in zoo:
        model.fit(train, feature_names=NUMERIC, calibration_fraction=0.15)
        scored.append(
            model.predict(held).select(
                F.lit(model.model_name).alias("model"), *SERIES_KEYS, F.col("target").alias("actual"), "p10", "p50", "p90"
            )
        )
    stacked = scored[0].unionByName(scored[1]).unionByName(scored[2])
    return evaluate.forecast_metrics(stacked, keys=["model"])


@register("feature_importance")
def feature_importance(t):
    """Ten most important features of the boosted trees."""
    train, _ = learner_rows(t)
    model = learners.BoostedTreesForecaster(keys=SERIES_KEYS, iterations=3, depth=3).fit(train, feature_names=NUMERIC)
    return model.feature_importances(t.spark).orderBy(F.desc("importance"), "feature").limit(10)
