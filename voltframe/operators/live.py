"""The live chain: training frame, validation, forecast rows with their lineage, release gate, deployment state.

All series of a target are trained, judged and forecast together; each is a product of its own in the gate. Everything comes out as
tables: candidates (one row per series and run), forecast rows, and the deployments that follow from the candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.functions.hashing import iso_utc, uuid5_url
from voltframe.functions.metrics import evaluate
from voltframe.operators.frames import LIVE_FEATURES, MINIMUM_ROWS, future_frame, holdout_split, training_frame
from voltframe.operators.governance import MIN_IMPROVEMENT, apply_updates, promotion_gate
from voltframe.operators.learners import QuantileForecaster
from voltframe.schemas import FORECAST_SCHEMA, unit_for_target
from voltframe.session import durable

PRODUCT = "operational"
CHAMPION = ("champion_version", "champion_artifact_uri", "champion_error")
PREVIOUS = ("previous_version", "previous_artifact_uri", "previous_error")
# Where the rows of a live run come from.
LINEAGE_FLAGS = ("real_source_data", "entsoe_actuals", "open_meteo_historical_forecast")


@dataclass(frozen=True)
class LiveRun:
    """Tables of one run and the model that was fitted on all rows."""

    model: QuantileForecaster
    candidates: DataFrame
    forecasts: DataFrame
    skipped: DataFrame


def deployment_key(area: Column, target: str, product: str) -> Column:
    return F.concat_ws(":", area, F.lit(target), F.lit(product))


def train_and_forecast(
    series: DataFrame,
    weather: DataFrame,
    live_weather: DataFrame,
    intervals: DataFrame,
    make: Callable[[], QuantileForecaster],
    *,
    target: str,
    issue_time: Column,
    version: str,
    product: str = PRODUCT,
    artifact_uri: str | None = None,
    snapshots: DataFrame | None = None,
    deployments: DataFrame | None = None,
    minimum_rows: int = MINIMUM_ROWS,
    minimum_improvement: float = MIN_IMPROVEMENT,
    allow_wape: bool = True,
) -> LiveRun:
    """Train on ``series`` (``area, valid_time, value``), judge the candidate and forecast the ``intervals``
    (``area, valid_from, valid_to``), whose weather must have been published by the issue time.

    The last ``min(288, max(96, n / 5))`` rows of a series judge a model fitted on the rows before; its error is compared with that
    of the area's champion, or with the value of a week ago where there is none. The forecast comes from a model fitted on all rows;
    it is a shadow forecast unless the gate promotes the candidate. Series with fewer than ``minimum_rows`` complete rows are
    skipped and say why. ``snapshots`` (``area, snapshot_id``) names the source data of each row.
    """
    keys = ["area"]
    frame = durable(training_frame(series, weather, keys=keys))
    counts = frame.groupBy("area").agg(F.count(F.lit(1)).alias("training_rows"), F.min("valid_time").alias("training_start"), F.max("valid_time").alias("training_end"))
    counted = durable(series.select("area").distinct().join(counts, "area", "left").fillna(0, ["training_rows"]))
    enough = F.col("training_rows") >= minimum_rows
    reason = F.format_string(f"%d complete training rows, {minimum_rows} needed", "training_rows")
    skipped = counted.filter(~enough).select("area", F.lit(target).alias("target"), "training_rows", reason.alias("reason"))
    ready = counted.filter(enough)
    usable = frame.join(ready.select("area"), "area", "left_semi")

    split = durable(holdout_split(usable, keys=keys, live=True))
    judge = make().fit(split.filter("split = 'train'").drop("split"), feature_names=LIVE_FEATURES)
    held = judge.predict(split.filter("split = 'holdout'")).withColumn("actual", F.col("target"))
    c = F.col
    metrics = evaluate(c("actual"), c("p50"), c("p10"), c("p90"), allow_wape=allow_wape)
    measured = held.groupBy("area").agg(*metrics, F.avg(F.abs(c("actual") - c("lag_672"))).alias("baseline_mae"))
    candidates = _judged(measured.join(ready, "area"), deployments, target, product, minimum_improvement).withColumns(
        {"version": F.lit(version), "artifact_uri": F.lit(artifact_uri).cast("string"), "evaluated_at": issue_time}
    )
    if snapshots is None:
        candidates = candidates.withColumn("data_snapshot_id", F.lit(None).cast("string"))
    else:
        candidates = candidates.join(snapshots.select("area", F.col("snapshot_id").alias("data_snapshot_id")), "area", "left")
    candidates = durable(candidates)

    model = make()
    model.model_version = version
    model.fit(usable, feature_names=LIVE_FEATURES)
    asked = intervals.join(ready.select("area"), "area", "left_semi")
    scored = model.predict(future_frame(asked, series, live_weather, keys=keys))
    rows = scored.join(asked.select("area", F.col("valid_from").alias("valid_time"), "valid_to"), ["area", "valid_time"])
    decided = candidates.select("area", "data_snapshot_id", (~c("promoted")).alias("is_shadow"))
    return LiveRun(model, candidates, forecast_rows(rows.join(decided, "area"), model, target=target, issue_time=issue_time), skipped)


def _judged(measured: DataFrame, deployments: DataFrame | None, target: str, product: str, minimum_improvement: float) -> DataFrame:
    """Metrics with the outcome of the gate and the champion each candidate met."""
    keyed = measured.withColumns(
        {"target": F.lit(target), "product": F.lit(product), "deployment_key": deployment_key(F.col("area"), target, product)}
    )
    if deployments is None:
        current = {n: F.lit(None).cast("double" if n.endswith("error") else "string") for n in CHAMPION}
        met = keyed.withColumns(current)
    else:
        met = keyed.join(deployments.select("deployment_key", *CHAMPION), "deployment_key", "left")
    reference = F.coalesce("champion_error", "baseline_mae")
    gate = promotion_gate(reference, F.col("mae"), minimum_improvement=minimum_improvement)
    # An unknown error promotes nothing.
    return met.withColumn("reference_error", reference).withColumns({"promoted": F.coalesce(gate["promote"], F.lit(False)), "reason": gate["reason"]})


def forecast_rows(
    scored: DataFrame, model: QuantileForecaster, *, target: str, issue_time: Column, flags: Sequence[str] = LINEAGE_FLAGS
) -> DataFrame:
    """Rows of the forecast table from ``area, valid_time, valid_to, p10, p50, p90, data_snapshot_id, is_shadow``.

    The id follows from what the row forecasts, so that a repeated run writes the same rows again.
    """
    c = F.col
    name = F.concat_ws("|", F.lit(target), "area", iso_utc(issue_time), iso_utc(c("valid_time")), F.lit(model.model_version), c("is_shadow").cast("string"))
    values = {
        "forecast_id": uuid5_url(name), "target": F.lit(target), "area": c("area"), "issue_time": issue_time, "valid_from": c("valid_time"),
        "valid_to": c("valid_to"), "point": c("p50"), "p10": c("p10"), "p50": c("p50"), "p90": c("p90"), "unit": F.lit(unit_for_target(target)),
        "model_name": F.lit(model.model_name), "model_version": F.lit(model.model_version), "data_snapshot_id": c("data_snapshot_id"),
        "quality_flags": F.array(*[F.lit(f) for f in flags]), "is_shadow": c("is_shadow"),
    }
    return scored.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in FORECAST_SCHEMA])


def released(candidates: DataFrame, deployments: DataFrame | None) -> DataFrame:
    """Deployments after a run: a promoted candidate becomes champion and the champion it beat the previous model; any other candidate
    leaves both as they are. Products without a candidate keep their row."""
    c = F.col
    own = {"champion_version": c("version"), "champion_artifact_uri": c("artifact_uri"), "champion_error": c("mae")}
    update = candidates.select(
        "deployment_key", "area", "target", "product",
        *[F.when(c("promoted"), own[n]).otherwise(c(n)).alias(n) for n in CHAMPION],
        *[F.when(c("promoted"), c(n)).alias(p) for n, p in zip(CHAMPION, PREVIOUS, strict=True)],
        c("version").alias("candidate_version"), c("artifact_uri").alias("candidate_artifact_uri"), c("mae").alias("candidate_error"),
        c("baseline_mae").alias("baseline_error"), F.when(c("promoted"), "champion").otherwise("candidate_rejected").alias("status"),
        c("evaluated_at").alias("last_evaluated_at"),
    )
    return update if deployments is None else apply_updates(deployments, update, key="deployment_key")


def forecast_with(
    model: QuantileForecaster, series: DataFrame, live_weather: DataFrame, intervals: DataFrame, *, target: str, issue_time: Column,
    deployments: DataFrame, product: str = PRODUCT, snapshots: DataFrame | None = None,
) -> DataFrame:
    """Forecast rows from an approved model, without training: only for areas whose champion is this model version."""
    approved = deployments.filter(F.col("champion_version") == model.model_version).select("deployment_key")
    asked = intervals.withColumn("deployment_key", deployment_key(F.col("area"), target, product)).join(approved, "deployment_key", "left_semi")
    asked = asked.drop("deployment_key")
    scored = model.predict(future_frame(asked, series, live_weather, keys=["area"]))
    rows = scored.join(asked.select("area", F.col("valid_from").alias("valid_time"), "valid_to"), ["area", "valid_time"])
    named = F.lit(None).cast("string")
    rows = rows.withColumn("is_shadow", F.lit(False))
    rows = rows.withColumn("data_snapshot_id", named) if snapshots is None else rows.join(
        snapshots.select("area", F.col("snapshot_id").alias("data_snapshot_id")), "area", "left"
    )
    return forecast_rows(rows, model, target=target, issue_time=issue_time, flags=("approved_model", "real_source_data"))
