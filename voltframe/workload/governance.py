"""Queries over forecast storage, serving and model release state."""

from __future__ import annotations

from pyspark.sql import functions as F

from voltframe.operators import forecasts, governance, monitoring
from voltframe.plans.skew import DAY_MICROS, lagged, time_bucket
from voltframe.workload.registry import register
from voltframe.workload.tables import CANDIDATES, NOW, WINDOWS, WRITES

STORED_OUT = """forecast_id, target, area, issue_time, valid_from, model_version, is_shadow, valid_to, point, p10, p50, p90"""
PRODUCT = ["area", "target", "product"]


def stored(t):
    return t.stored_forecasts.select(*[c.strip() for c in STORED_OUT.split(",")])


@register("forecast_upsert", f"WITH {WRITES} SELECT {STORED_OUT} FROM stored", doubles="point p10 p50 p90")
def forecast_upsert(t):
    """Writes folded by natural key: first id survives, last values win."""
    return stored(t)


@register(
    "forecast_upsert_by_id",
    f"""WITH {WRITES}, log AS (SELECT 'id-' || CAST(write_no // 8 AS VARCHAR) AS forecast_id, target, area, valid_from, point, write_no FROM writes)
    SELECT forecast_id, arg_max(target, write_no) AS target, arg_max(area, write_no) AS area, arg_max(valid_from, write_no) AS valid_from,
      arg_max(point, write_no) AS point FROM log GROUP BY 1""",
    doubles="point",
)
def forecast_upsert_by_id(t):
    """Upsert by forecast id: update everything or insert."""
    ids = F.concat(F.lit("id-"), F.floor(F.col("write_no") / 8).cast("string"))
    log = t.forecast_writes.select(
        ids.alias("forecast_id"), "target", "area", "valid_from", "point", "write_no"
    )
    return forecasts.upsert_by_id(log, order=["write_no"]).drop("write_no")


@register(
    "forecast_invalid",
    f"""WITH {WRITES} SELECT write_no, CASE WHEN NOT (p10 <= p50 AND p50 <= p90) THEN 'quantile_order' ELSE 'interval_order' END AS problem
    FROM writes WHERE NOT (p10 <= p50 AND p50 <= p90) OR valid_to <= valid_from""",
)
def forecast_invalid(t):
    return forecasts.invalid_forecasts(t.forecast_writes).select("write_no", "problem")


LATEST = f"""{WRITES}, latest AS (SELECT target, area, max(issue_time) AS issue_time FROM stored WHERE NOT is_shadow GROUP BY 1, 2),
current AS (SELECT s.* FROM stored s JOIN latest USING (target, area, issue_time) WHERE NOT is_shadow
)"""


@register(
    "latest_forecasts",
    f"""WITH {LATEST} SELECT {STORED_OUT}, CAST(epoch(TIMESTAMP '{NOW}') - epoch(issue_time) AS BIGINT) AS age_seconds,
    epoch(TIMESTAMP '{NOW}') - epoch(issue_time) > 1800 AS is_stale FROM current""",
    doubles="point p10 p50 p90",
)
def latest_forecasts(t):
    """Rows of the latest published issue per target and area, with staleness."""
    return forecasts.with_staleness(forecasts.latest_forecasts(stored(t)), t.now)


@register(
    "demand_horizon",
    f"""WITH {LATEST} SELECT {STORED_OUT} FROM current WHERE target = 'demand'
    QUALIFY valid_from < min(valid_from) OVER (PARTITION BY target, area) + INTERVAL 2 HOUR""",
    doubles="point p10 p50 p90",
)
def demand_horizon(t):
    """The next two hours of demand."""
    return forecasts.demand_horizon(stored(t), 2)


@register(
    "day_ahead_prices",
    f"""WITH {WRITES}, chosen AS (SELECT * FROM stored WHERE NOT is_shadow AND target = 'price' AND issue_time = TIMESTAMP '2024-01-20')
    SELECT {STORED_OUT} FROM chosen WHERE CAST((valid_from AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Madrid' AS DATE) = DATE '2024-01-20'""",
    doubles="point p10 p50 p90",
)
def day_ahead_prices(t):
    """One local delivery day of one issue."""
    return forecasts.day_ahead_prices(
        stored(t), F.lit("2024-01-20").cast("date"), issue_time=F.lit("2024-01-20").cast("timestamp")
    )


PREVIOUS = "lag(mae) OVER (PARTITION BY area, target ORDER BY evaluated_at)"


@register(
    "promotion_gate",
    f"""WITH {CANDIDATES}, paired AS (SELECT *, {PREVIOUS} AS champion FROM candidates),
    judged AS (SELECT *, (champion - mae) / champion AS gain, mae - 40.0 AS s1, (mae % 10) / 60.0 AS s2 FROM paired WHERE champion IS NOT NULL),
    reasons AS (SELECT area, target, evaluated_at, CASE WHEN champion <= 0 THEN 'champion error must be positive'
      WHEN gain < 0.02 THEN 'challenger does not improve primary error by 2%'
      WHEN s1 > 0.1 OR s2 > 0.1 THEN 'challenger regresses a critical slice by more than 10%' ELSE 'promotion criteria satisfied' END AS reason FROM judged)
    SELECT *, reason = 'promotion criteria satisfied' AS promote FROM reasons""",
)
def promotion_gate(t):
    """Every candidate against the one before it, with two slice regressions."""
    at = F.col("evaluated_at")
    paired = lagged(
        t.candidates, keys=PRODUCT, bucket=time_bucket(at, 30 * DAY_MICROS), order=[at], value=F.col("mae"),
        name="champion",
    ).filter(F.col("champion").isNotNull())
    slices = F.array(F.col("mae") - 40.0, (F.col("mae") % 10) / 60.0)
    gate = governance.promotion_gate(F.col("champion"), F.col("mae"), slices)
    return paired.withColumns(gate).select("area", "target", "evaluated_at", "reason", "promote")


# The ledger is sequential by nature: plain recursive SQL, one candidate per step.
LEDGER = f"""RECURSIVE {CANDIDATES},
ordered AS (SELECT *, row_number() OVER (PARTITION BY area, target ORDER BY evaluated_at) AS i FROM candidates),
ledger AS (
  SELECT area, target, product, evaluated_at, version, mae, baseline_mae, i, baseline_mae AS reference_error,
    baseline_mae > 0 AND NOT ((baseline_mae - mae) / baseline_mae < 0.02) AS promoted,
    CAST(NULL AS VARCHAR) AS met_version, CAST(NULL AS DOUBLE) AS met_error FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.area, o.target, o.product, o.evaluated_at, o.version, o.mae, o.baseline_mae, o.i,
    coalesce(CASE WHEN l.promoted THEN l.mae ELSE l.met_error END, o.baseline_mae),
    coalesce(CASE WHEN l.promoted THEN l.mae ELSE l.met_error END, o.baseline_mae) > 0 AND NOT (
      (coalesce(CASE WHEN l.promoted THEN l.mae ELSE l.met_error END, o.baseline_mae) - o.mae)
      / coalesce(CASE WHEN l.promoted THEN l.mae ELSE l.met_error END, o.baseline_mae) < 0.02),
    CASE WHEN l.promoted THEN l.version ELSE l.met_version END, CASE WHEN l.promoted THEN l.mae ELSE l.met_error END
  FROM ledger l JOIN ordered o ON o.area = l.area AND o.target = l.target AND o.i = l.i + 1),
released AS (SELECT area, target, product, evaluated_at, version, mae, baseline_mae, promoted, reference_error,
    CASE WHEN promoted THEN version ELSE met_version END AS champion_version,
    CASE WHEN promoted THEN mae ELSE met_error END AS champion_error,
    CASE WHEN promoted THEN met_version END AS previous_version, CASE WHEN promoted THEN met_error END AS previous_error,
    CASE WHEN promoted THEN 'champion' ELSE 'candidate_rejected' END AS status, NOT promoted AS is_shadow FROM ledger)"""


def ledger(t):
    return governance.release_ledger(t.candidates, keys=PRODUCT, order="evaluated_at")


LEDGER_DOUBLES = "mae baseline_mae reference_error champion_error previous_error"


@register("release_ledger", f"WITH {LEDGER} SELECT * FROM released", doubles=LEDGER_DOUBLES)
def release_ledger(t):
    """Champion, previous model and shadow flag after every candidate."""
    return ledger(t).drop("reason")


LAST = f"""{LEDGER}, state AS (SELECT * FROM released QUALIFY row_number() OVER (PARTITION BY area, target ORDER BY evaluated_at DESC) = 1)"""


@register(
    "model_status",
    f"""WITH {LAST} SELECT area || ':' || target || ':' || product AS deployment_key, area, target, product, champion_version,
    champion_error, previous_version, previous_error, version AS candidate_version, mae AS candidate_error,
    baseline_mae AS baseline_error, status, evaluated_at AS last_evaluated_at FROM state""",
    doubles="champion_error previous_error candidate_error baseline_error",
)
def model_status(t):
    """Deployment listing: current release state per product."""
    return governance.deployments(ledger(t), keys=PRODUCT, order="evaluated_at").orderBy(*PRODUCT)


@register(
    "rollback_swap",
    f"""WITH {LEDGER}, promotions AS (SELECT * FROM released WHERE promoted QUALIFY row_number() OVER (
      PARTITION BY area, target ORDER BY evaluated_at DESC) = 1)
    SELECT area || ':' || target || ':' || product AS deployment_key, previous_version AS champion_version, previous_error AS champion_error,
    champion_version AS previous_version, champion_error AS previous_error, 'rolled_back' AS status,
    CAST('{NOW}' AS TIMESTAMP) AS last_evaluated_at FROM promotions WHERE previous_version IS NOT NULL""",
    doubles="champion_error previous_error",
)
def rollback_swap(t):
    """State after each product's last promotion, rolled back where a previous model exists."""
    promoted = governance.deployments(ledger(t).filter("promoted"), keys=PRODUCT, order="evaluated_at")
    swapped = governance.rollback(promoted, strict=False, at=t.now)
    return swapped.select(
        "deployment_key", "champion_version", "champion_error", "previous_version", "previous_error", "status", "last_evaluated_at"
    )


@register(
    "breach_streaks",
    f"""WITH {WINDOWS}, flagged AS (SELECT *, champion_error > reference_error * 1.2::DOUBLE AS degraded FROM windows),
    islands AS (SELECT *, sum(CASE WHEN degraded THEN 0 ELSE 1 END) OVER (PARTITION BY area, target ORDER BY window_start) AS island FROM flagged)
    SELECT area, target, window_start, degraded, CAST(CASE WHEN degraded THEN sum(CASE WHEN degraded THEN 1 ELSE 0 END) OVER (
      PARTITION BY area, target, island ORDER BY window_start) ELSE 0 END AS BIGINT) AS consecutive_breaches,
      CASE WHEN degraded THEN sum(CASE WHEN degraded THEN 1 ELSE 0 END) OVER (PARTITION BY area, target, island ORDER BY window_start)
      ELSE 0 END >= 3 AS rollback FROM islands""",
)
def breach_streaks(t):
    """Consecutive degraded windows and the rollback flag."""
    streaks = governance.breach_streaks(t.windows, keys=["area", "target"], order="window_start")
    return streaks.select("area", "target", "window_start", "degraded", "consecutive_breaches", "rollback")


@register(
    "error_ratio",
    f"""WITH {WINDOWS}, status AS (SELECT area, target, sum(champion_error) / count(*) AS rolling_error, CASE WHEN target = 'error' THEN 0.0::DOUBLE ELSE 41.0::DOUBLE END
      AS baseline_error FROM windows GROUP BY 1, 2)
    SELECT *, CASE WHEN baseline_error > 0 THEN rolling_error / baseline_error END AS error_ratio,
      coalesce(CASE WHEN baseline_error > 0 THEN rolling_error / baseline_error END > 1.2, FALSE) AS is_breach FROM status""",
    doubles="rolling_error baseline_error error_ratio",
)
def error_ratio(t):
    status = t.windows.groupBy("area", "target").agg(
        (F.sum("champion_error") / F.count(F.lit(1))).alias("rolling_error")
    ).withColumn("baseline_error", F.when(F.col("target") == "error", 0.0).otherwise(41.0))
    return monitoring.error_ratio(status)
