"""The live chain end to end: candidates, forecast rows, skipped series, the gate against champions, forecasts without training."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.operators import forecasts, governance, learners, live
from voltframe.schemas import FORECAST_SCHEMA, WEATHER_DIMENSIONS

START = datetime(2025, 1, 1)
ISSUE = START + timedelta(days=16)


@pytest.fixture(scope="module")
def inputs(spark):
    rng = np.random.default_rng(4)
    n = 96 * 16
    parts, weather = [], []
    times = [START + timedelta(minutes=15 * i) for i in range(n + 96)]
    for area, days in (("ES", 16), ("PT", 16), ("FR", 8)):
        hour = np.array([t.hour for t in times])
        day = np.array([t.timetuple().tm_yday for t in times])
        # PT repeats last week closely, so that the week before beats the seasonal learner.
        noise = rng.normal(0, 5, n + 96) if area == "ES" else np.tile(rng.normal(0, 5, 672), 3)[: n + 96] + rng.normal(0, 0.1, n + 96)
        value = 100 + 20 * np.sin(hour / 24 * 6.28) + noise + (30 * np.sin(day % 7) if area != "ES" else 0)
        parts.append(pd.DataFrame({"area": area, "valid_time": times, "value": value})[: 96 * days])
        weather.append(pd.DataFrame({"area": area, "valid_time": times, **{d: 10.0 for d in WEATHER_DIMENSIONS}}))
    intervals = pd.DataFrame([(a, ISSUE + timedelta(minutes=15 * k), ISSUE + timedelta(minutes=15 * (k + 1))) for a in ("ES", "PT", "FR") for k in range(24)], columns=["area", "valid_from", "valid_to"])
    series, frames = spark.createDataFrame(pd.concat(parts)), spark.createDataFrame(pd.concat(weather))
    return series.cache(), frames.cache(), spark.createDataFrame(intervals)


def run(inputs, **more):
    series, weather, intervals = inputs
    return live.train_and_forecast(
        series, weather, weather, intervals, lambda: learners.SeasonalQuantileForecaster(keys=["area"]),
        target="demand", issue_time=F.lit(ISSUE), version=more.pop("version", "v2"), **more,
    )


@pytest.fixture(scope="module")
def first(inputs, spark):
    snapshots = spark.createDataFrame([("ES", "live-1"), ("PT", "live-2")], "area string, snapshot_id string")
    return run(inputs, snapshots=snapshots, artifact_uri="file:///models/v2")


def test_candidates_carry_metrics_lineage_and_the_outcome_of_the_gate(first):
    got = {r.area: r for r in first.candidates.collect()}
    assert got.keys() == {"ES", "PT"}
    assert got["ES"].promoted and got["ES"].mae < got["ES"].baseline_mae and got["ES"].reference_error == got["ES"].baseline_mae
    assert not got["PT"].promoted and "2%" in got["PT"].reason
    assert got["ES"].training_rows == 96 * 16 - 672 and got["ES"].training_end == ISSUE - timedelta(minutes=15)
    assert (got["ES"].data_snapshot_id, got["ES"].deployment_key) == ("live-1", "ES:demand:operational")


def test_short_series_are_skipped_and_say_why(first):
    assert [(r.area, r.training_rows, r.reason) for r in first.skipped.collect()] == [("FR", 96, "96 complete training rows, 480 needed")]


def test_forecast_rows_fit_the_table_and_shadow_rows_are_not_served(first):
    rows = first.forecasts
    assert [(f.name, f.dataType) for f in rows.schema] == [(f.name, f.dataType) for f in FORECAST_SCHEMA]
    got = rows.collect()
    assert len(got) == 48 == len({r.forecast_id for r in got}) and {r.area: r.is_shadow for r in got} == {"ES": False, "PT": True}
    assert forecasts.invalid_forecasts(rows).count() == 0 and {r.data_snapshot_id for r in got} == {"live-1", "live-2"}
    assert {r.unit for r in got} == {"MW"} and {r.model_version for r in got} == {"v2"}
    served = forecasts.latest_forecasts(rows).collect()
    assert {r.area for r in served} == {"ES"} and len(served) == 24
    again = forecasts.upsert_by_id(rows.withColumn("w", F.lit(1)).unionByName(rows.withColumn("w", F.lit(2))), order=["w"])
    assert again.count() == 48


def test_deployments_follow_from_runs_and_can_be_rolled_back(inputs, first, spark):
    state = live.released(first.candidates, None)
    by = {r.area: r for r in state.collect()}
    assert (by["ES"].champion_version, by["ES"].status, by["ES"].previous_version) == ("v2", "champion", None)
    assert (by["PT"].champion_version, by["PT"].status, by["PT"].candidate_version) == (None, "candidate_rejected", "v2")
    second = run(inputs, version="v3", deployments=state)
    met = {r.area: r for r in second.candidates.collect()}
    assert met["ES"].reference_error == by["ES"].champion_error and not met["ES"].promoted  # no better than itself
    worse = state.withColumn("champion_error", F.col("champion_error") * 2)
    third = run(inputs, version="v4", deployments=worse)
    after = live.released(third.candidates, worse)
    es = after.filter("area = 'ES'").collect()[0]
    assert (es.champion_version, es.previous_version, es.champion_artifact_uri, es.previous_artifact_uri) == ("v4", "v2", None, "file:///models/v2")
    back = governance.rollback(after.filter("area = 'ES'")).collect()[0]
    assert (back.champion_version, back.previous_version, back.status) == ("v2", "v4", "rolled_back")


def test_an_approved_model_forecasts_without_training(inputs, first):
    series, weather, intervals = inputs
    state = live.released(first.candidates, None)
    rows = live.forecast_with(first.model, series, weather, intervals, target="demand", issue_time=F.lit(ISSUE), deployments=state).collect()
    assert len(rows) == 24 and {r.area for r in rows} == {"ES"} and not any(r.is_shadow for r in rows)
    assert {tuple(r.quality_flags) for r in rows} == {("approved_model", "real_source_data")}
    want = {r.valid_from: r.p50 for r in first.forecasts.filter("area = 'ES'").collect()}
    assert {r.valid_from: r.p50 for r in rows} == want
