from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from voltframe.functions import hashing, timegrid
from voltframe.operators import backtest, calibration, evaluate, forecasts, frames, governance, monitoring, series
from voltframe.plans.skew import time_bucket
from voltframe.schemas import WEATHER_DIMENSIONS

START = datetime(2025, 1, 1)


def times(spark, *stamps):
    return spark.createDataFrame([(s,) for s in stamps], "s string").select(F.to_timestamp("s").alias("ts"))


# --- time grid -------------------------------------------------------------------------------


@pytest.mark.parametrize(("day", "count"), [("2025-06-01", 96), ("2025-03-30", 92), ("2025-10-26", 100)])
def test_delivery_day_length(spark, day, count):
    df = spark.createDataFrame([(date.fromisoformat(day),)], "d date")
    rows = timegrid.explode_delivery_day(df, "d").orderBy("interval_number").collect()
    assert len(rows) == count
    assert rows[0].valid_from.hour in (22, 23)
    assert all(a.valid_to == b.valid_from for a, b in zip(rows, rows[1:], strict=False))


def test_interval_number_and_alignment(spark):
    df = times(spark, "2025-06-01T22:00:00", "2025-10-26T22:45:00")
    got = [r[0] for r in df.select(timegrid.interval_number(F.col("ts"))).collect()]
    assert got == [1, 100]
    off = times(spark, "2025-06-01T22:01:00")
    assert off.select(timegrid.interval_number(F.col("ts"), strict=False)).collect()[0][0] is None
    with pytest.raises(PySparkException, match="not aligned"):
        off.select(timegrid.interval_number(F.col("ts"))).collect()


def test_forecast_intervals(spark):
    df = times(spark, "2025-10-25T10:07:00").withColumnRenamed("ts", "issue_time")
    demand = timegrid.forecast_intervals(df, "demand").orderBy("horizon_step").collect()
    assert len(demand) == 24 and demand[0].valid_from == datetime(2025, 10, 25, 10, 15)
    assert timegrid.forecast_intervals(df, "price").count() == 100


def test_unknown_market_raises(spark):
    df = spark.createDataFrame([("XX",)], "c string")
    with pytest.raises(PySparkException, match="unsupported country_code"):
        df.select(timegrid.market_timezone_column(F.col("c"))).collect()


def test_uuid5_equals_the_standard_library(spark):
    import uuid

    names = ["entsoe-hist-", "entsoe-hist-42", "äöü"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(hashing.uuid5_url(F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]


# --- series and live frames ------------------------------------------------------------------


def events(spark, rows):
    """rows: (type, start offset minutes, length minutes, value, revision, dimension, published offset)"""
    out = []
    for i, (kind, start, length, value, revision, dimension, published) in enumerate(rows):
        begin = START + timedelta(minutes=start)
        out.append(
            (
                f"e{i}", kind, "ES", begin, begin + timedelta(minutes=length),
                START + timedelta(minutes=published), begin, float(value), revision, dimension, f"sum{i}",
            )
        )
    return spark.createDataFrame(
        out,
        "event_id string, event_type string, area string, interval_start timestamp, interval_end timestamp, "
        "published_at timestamp, ingested_at timestamp, value double, revision int, dimension string, payload_checksum string",
    )


def test_hour_becomes_four_quarters_and_newest_revision_wins(spark):
    df = events(spark, [("price", 0, 60, 50, 1, None, 0), ("demand", 0, 15, 100, 1, None, 0), ("demand", 0, 15, 110, 2, None, 5)])
    prices = series.events_to_series(df, "price").orderBy("valid_time").collect()
    assert [r.value for r in prices] == [50.0] * 4 and prices[3].valid_time.minute == 45
    assert [r.value for r in series.events_to_series(df, "demand").collect()] == [110.0]


def test_weather_revision_after_cut_off_is_ignored(spark):
    df = events(spark, [("weather", 60, 60, 10, 1, "temperature_2m", -5), ("weather", 60, 60, 99, 2, "temperature_2m", 5)])
    known = series.weather_frame(df, available_at=F.lit(START)).collect()
    assert {r.temperature_2m for r in known} == {10.0}
    assert {r.temperature_2m for r in series.weather_frame(df).collect()} == {99.0}


def nine_days(spark):
    n = 9 * 96
    target = pd.DataFrame({"area": "ES", "valid_time": pd.date_range(START, periods=n, freq="15min"), "value": 20000.0 + np.arange(n)})
    hourly = pd.DataFrame({"area": "ES", "valid_time": pd.date_range(START, periods=10 * 24, freq="60min")})
    for name, value in zip(WEATHER_DIMENSIONS, (15.0, 3.0, 60.0, 100.0), strict=True):
        hourly[name] = value
    as_ts = lambda df: spark.createDataFrame(df).withColumn("valid_time", F.col("valid_time").cast("timestamp"))
    return as_ts(target), as_ts(hourly)


def test_training_frame_first_row(spark):
    target, weather = nine_days(spark)
    rows = frames.training_frame(target, weather, keys=["area"]).orderBy("valid_time").collect()
    assert len(rows) == 9 * 96 - 672
    assert rows[0].lag_672 == 20000.0 and rows[0].temperature_2m == 15.0
    assert rows[0].rolling_96 == pytest.approx(np.mean(20000 + np.arange(672 - 96, 672)))
    ready = frames.training_readiness(frames.training_frame(target, weather, keys=["area"]), keys=["area"]).collect()[0]
    assert (ready.training_rows, ready.ready) == (192, False)


def test_future_frame_lags_and_coverage(spark):
    target, weather = nine_days(spark)
    issue = START + timedelta(days=9)
    steps = [("ES", issue + timedelta(minutes=15 * i)) for i in range(24)]
    intervals = spark.createDataFrame(steps, "area string, valid_from timestamp")
    rows = frames.future_frame(intervals, target, weather, keys=["area"], strict=True).orderBy("valid_time").collect()
    assert len(rows) == 24
    assert rows[0].lag_96 == 20000.0 + 8 * 96 and rows[0].lag_672 == 20000.0 + 2 * 96
    early = weather.filter(F.col("valid_time") < F.lit(issue - timedelta(days=1)))
    loose = frames.future_frame(intervals, target, early, keys=["area"]).orderBy("valid_time").collect()
    assert list(loose[10].uncovered) == list(WEATHER_DIMENSIONS)
    with pytest.raises(PySparkException, match="does not cover"):
        frames.future_frame(intervals, target, early, keys=["area"], strict=True).collect()


def test_forward_fill_stops_after_four_rows(spark):
    values = [1.0] + [None] * 6 + [2.0]
    rows = [
        ("a", START + timedelta(minutes=15 * i), v)
        for i, v in enumerate(values)
        if v is not None
    ]
    df = spark.createDataFrame(rows, "k string, valid_time timestamp, value double")
    got = [r.value for r in series.resample(df, keys=["k"], seconds=900).orderBy("valid_time").collect()]
    assert got == [1.0] * 5 + [None, None, 2.0]


def test_snapshot_id_ignores_order_and_duplicates(spark):
    import hashlib

    a = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "b"), ("y", None), ("z", "c")], "k string, payload_checksum string")
    got = {r.k: r.snapshot_id for r in monitoring.snapshot_id(a, keys=["k"]).collect()}
    assert got == {k: "live-" + hashlib.sha256(v).hexdigest()[:20] for k, v in (("x", b"a|b"), ("z", b"c"))}


def test_persistence_needs_enough_points(spark):
    rows = [("a", START + timedelta(hours=i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, valid_time timestamp, value double")
    got = series.persistence_forecast(df, keys=["k"], steps_lag=3, horizon_steps=7).orderBy("horizon_step").collect()
    assert [r.forecast for r in got] == [2, 3, 4, 2, 3, 4, 2]
    with pytest.raises(PySparkException, match="too few points"):
        series.persistence_forecast(df, keys=["k"], steps_lag=6, horizon_steps=7).collect()


# --- calibration and metrics -----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 99, 250])
def test_conformal_correction_equals_numpy_higher(spark, n):
    rng = np.random.default_rng(n)
    y, lo = rng.normal(size=n), rng.normal(-1, 0.2, n)
    hi = lo + rng.random(n) + 0.5
    scores = np.maximum(lo - y, y - hi) / ((hi - lo) + 1e-4)
    level = min(1.0, np.ceil((n + 1) * 0.8) / n)
    want = np.quantile(scores, level, method="higher")
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "actual": y, "p10": lo, "p90": hi}))
    for fit in (calibration.conformal_fit, calibration.conformal_fit_small):
        assert fit(df, keys=["k"]).collect()[0].q_correction == pytest.approx(want, abs=1e-15)


def test_stacked_blend_values(spark):
    row = {}
    for i, base in ((1, 0.0), (2, 10.0), (3, 20.0)):
        row |= {f"p10_{i}": base, f"p50_{i}": base + 1, f"p90_{i}": base + 2}
    df = calibration.stacked_blend(spark.createDataFrame([row]))
    got = df.collect()[0]
    assert (got.p10, got.p90) == (pytest.approx(7.5), pytest.approx(9.5))
    wider = calibration.conformal_apply(df, F.lit(0.5)).collect()[0]
    assert wider.p10 < got.p10 and wider.p90 > got.p90


def test_dual_blend_depends_on_the_row_only(spark):
    rows = [(s, 8.0, 10.0, 12.0, 18.0, 20.0, 22.0) for s in (24, 1, 48)]
    df = spark.createDataFrame(rows, "horizon_step int, p10_s double, p50_s double, p90_s double, p10_l double, p50_l double, p90_l double")
    batch = {r.horizon_step: r.p50 for r in calibration.dual_horizon_blend(df, 24).collect()}
    single = calibration.dual_horizon_blend(df.filter("horizon_step = 24"), 24).collect()[0].p50
    assert batch[24] == single and batch[24] > batch[1] == 10.0 and batch[48] == 20.0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("a", 10.0, 8.0, 6.0, 9.0), ("a", 0.0, 1.0, 0.0, 2.0)], "k string, actual double, p50 double, p10 double, p90 double")
    got = evaluate.forecast_metrics(df, keys=["k"]).collect()[0]
    assert (got.mae, got.wape, got.mape, got.interval_coverage) == (1.5, 0.3, 20.0, 0.5)
    assert got.rmse == pytest.approx(np.sqrt(2.5))
    assert got.pinball_p10 == pytest.approx((0.4 + 0.0) / 2) and got.pinball_p90 == pytest.approx((0.9 + 0.2) / 2)
    assert got.winkler_score == pytest.approx((3 + 10 + 2) / 2)
    price = evaluate.forecast_metrics(df, keys=["k"], allow_wape=False).collect()[0]
    assert price.wape is None


# --- backtest --------------------------------------------------------------------------------


def test_folds_match_slicing_and_purge_the_gap(spark):
    plan = backtest.BacktestPlan(train_days=20, test_days=5, step_days=5, steps_per_day=24, lead=24)
    n = 24 * 62
    pdf = pd.DataFrame({"area": "ES", "valid_time": pd.date_range(START, periods=n, freq="60min"), "value": 100 + np.sin(np.arange(n) / 24)})
    df = spark.createDataFrame(pdf).withColumn("valid_time", F.col("valid_time").cast("timestamp"))
    members = backtest.backtest_members(df, keys=["area"], plan=plan)
    got = {r.fold: r for r in backtest.fold_windows(members, keys=["area"]).collect()}
    rows = pdf.valid_time.iloc[14 * 24 + 23 :].reset_index(drop=True)
    want = {}
    for fold, start in enumerate(range(480, len(rows) - 120 + 1, 120), start=1):
        train, test = rows[start - 480 : start - 24], rows[start : start + 120]
        want[fold] = (train.min(), train.max(), test.min(), test.max(), len(train), len(test))
    assert len(want) >= 2
    assert {k: (r.train_start, r.train_end, r.test_start, r.test_end, r.fit_rows + r.calibration_rows, r.test_rows) for k, r in got.items()} == want
    assert all(r.train_end < r.test_start - timedelta(days=1) for r in got.values())
    assert all(r.calibration_rows == 96 for r in got.values())
    report = backtest.backtest_summary(backtest.backtest_predictions(df, keys=["area"], plan=plan), keys=["area"]).collect()[0]
    assert report.fold_count == len(want) and report.mae > 0


def test_short_series_are_named_and_null_keys_refused(spark):
    plan = backtest.BacktestPlan(train_days=20, test_days=5, step_days=5, steps_per_day=24, lead=24)

    def series(area, days):
        pdf = pd.DataFrame({"valid_time": pd.date_range(START, periods=24 * days, freq="60min"), "value": 100 + np.sin(np.arange(24 * days) / 24)})
        return spark.createDataFrame(pdf).select(F.lit(area).cast("string").alias("area"), F.col("valid_time").cast("timestamp"), "value")

    df = series("ES", 62).unionByName(series("FR", 39)).unionByName(series("PT", 3))
    predictions = backtest.backtest_predictions(df, keys=["area"], plan=plan)
    short = backtest.short_series(df, keys=["area"], plan=plan)
    got = {r.area: r for r in backtest.backtest_summary(predictions, keys=["area"], short=short).collect()}
    assert got.keys() == {"ES", "FR", "PT"} and got["ES"].fold_count > 0 and got["ES"].reason is None
    assert got["FR"].fold_count == got["PT"].fold_count == got["PT"].test_rows == 0 and got["FR"].mae is None
    assert got["FR"].reason == "too short for one fold: 577 complete rows, 600 needed" and "0 complete rows" in got["PT"].reason
    with pytest.raises(Exception, match="null in series key area"):
        backtest.indexed_rows(df.unionByName(series(None, 62)), keys=["area"], plan=plan).count()


def test_backtest_arguments_are_checked():
    with pytest.raises(ValueError):
        backtest.BacktestPlan(train_days=0)
    with pytest.raises(ValueError):
        backtest.BacktestPlan(train_days=1, steps_per_day=24, lead=24)


# --- forecasts and governance ----------------------------------------------------------------


def test_upsert_keeps_the_first_id(spark):
    rows = [("id1", "demand", 1.0, 1), ("id2", "demand", 2.0, 2), ("id3", "price", 3.0, 3)]
    log = spark.createDataFrame(rows, "forecast_id string, target string, point double, batch int")
    got = {(r.forecast_id, r.point) for r in forecasts.upsert_by_natural_key(log, order=["batch"], keys=["target"]).collect()}
    assert got == {("id1", 2.0), ("id3", 3.0)}


def forecast_rows(spark, target, starts):
    rows = [(f"{target}{i}", target, "ES", START, s.to_pydatetime(), "v1", False) for i, s in enumerate(starts)]
    rows += [(f"shadow{i}", target, "ES", datetime(2026, 1, 1), s.to_pydatetime(), "v2", True) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, "forecast_id string, target string, area string, issue_time timestamp, valid_from timestamp, model_version string, is_shadow boolean")


def test_two_hours_of_demand_are_eight_rows(spark):
    df = forecast_rows(spark, "demand", pd.date_range(START, periods=24, freq="15min"))
    assert forecasts.demand_horizon(df, 2).count() == 8
    with pytest.raises(ValueError):
        forecasts.demand_horizon(df, 7)
    aged = forecasts.with_staleness(df, F.lit(datetime(2025, 1, 1, 0, 31))).filter("not is_shadow").collect()[0]
    assert (aged.age_seconds, aged.is_stale) == (1860, True)


def test_clock_change_day_has_100_prices(spark):
    day = spark.createDataFrame([(date(2025, 10, 26),)], "d date")
    starts = [pd.Timestamp(r.valid_from) for r in timegrid.explode_delivery_day(day, "d").collect()]
    df = forecast_rows(spark, "price", starts)
    assert forecasts.day_ahead_prices(df, F.lit(date(2025, 10, 26))).count() == 100
    assert forecasts.query_forecasts(df, "price", "ES", issue_time=F.lit(START)).count() == 100


def test_promotion_gate(spark):
    df = spark.createDataFrame([(100.0, 97.0, [0.05]), (100.0, 99.0, [0.0]), (100.0, 90.0, [0.2]), (0.0, 1.0, [])], "c double, m double, s array<double>")
    gate = governance.promotion_gate(F.col("c"), F.col("m"), F.col("s"))
    assert [r.promote for r in df.withColumns(gate).collect()] == [True, False, False, False]


def ledger_of(spark, rows):
    df = spark.createDataFrame(rows, "area string, target string, product string, evaluated_at timestamp, version string, mae double, baseline_mae double")
    return governance.release_ledger(
        df, keys=["area", "target", "product"], order="evaluated_at", bucket=time_bucket("evaluated_at")
    )


def test_release_and_rollback(spark):
    def row(area, day, version, mae):
        return (area, "demand", "operational", datetime(2025, 1, day), version, mae, 100.0)

    ledger = ledger_of(spark, [row("ES", 1, "v1", 80.0), row("ES", 2, "v2", 85.0), row("ES", 3, "v3", 70.0), row("PT", 1, "p1", 99.5)])
    out = {(r.area, r.version): r for r in ledger.collect()}
    assert out["ES", "v1"].promoted and not out["ES", "v1"].is_shadow
    assert out["ES", "v2"].is_shadow and out["ES", "v2"].champion_version == "v1"
    assert (out["ES", "v3"].champion_version, out["ES", "v3"].previous_version) == ("v3", "v1")
    assert out["PT", "p1"].champion_version is None and out["PT", "p1"].is_shadow
    state = governance.deployments(ledger, keys=["area", "target", "product"], order="evaluated_at")
    back = governance.rollback(state, strict=False).collect()
    assert [(r.champion_version, r.champion_error, r.previous_error) for r in back] == [("v1", 80.0, 70.0)]
    with pytest.raises(PySparkException, match="no previous model for PT:demand:operational"):
        governance.rollback(state).collect()


def test_ledger_equals_sequential_replay(spark):
    rng = np.random.default_rng(8)
    rows = []
    for area in ("hot", "b"):
        level = 100.0
        for i in range(400 if area == "hot" else 60):
            level *= 1 - 0.004 * rng.random()
            when = START + timedelta(hours=7 * i)
            rows.append((area, "demand", "x", when, f"m{i}", float(level + rng.normal(0, 3)), 90.0))
    got = {(r.area, r.version): r for r in ledger_of(spark, rows).collect()}
    champion: dict = {}
    promotions = 0
    for area, _, _, _, version, mae, base in rows:
        met = champion.get(area)
        reference = met[1] if met else base
        promoted = reference > 0 and not (reference - mae) / reference < 0.02
        r = got[area, version]
        assert (r.promoted, r.reference_error) == (promoted, reference), version
        assert (r.previous_version, r.previous_error) == (met if promoted and met else (None, None))
        if promoted:
            champion[area] = (version, mae)
            promotions += 1
        assert (r.champion_version, r.champion_error) == champion.get(area, (None, None))
    assert promotions > 5


def test_three_breaches_call_for_rollback(spark):
    rows = [("ES", datetime(2025, 1, 1 + i), e, 100.0) for i, e in enumerate([125.0, 125.0, 90.0, 125.0, 125.0, 125.0, 120.0])]
    df = spark.createDataFrame(rows, "area string, at timestamp, champion_error double, reference_error double")
    out = governance.breach_streaks(df, keys=["area"], order="at", bucket=time_bucket("at")).orderBy("at").collect()
    assert [r.consecutive_breaches for r in out] == [1, 2, 0, 1, 2, 3, 0]
    assert [r.rollback for r in out] == [False] * 5 + [True, False]


def test_state_updates_touch_only_given_columns(spark):
    state = spark.createDataFrame([("demand", "v1", 1.0), ("price", "p1", 2.0)], "target string, version string, error double")
    update = spark.createDataFrame([("demand", None), ("weather", 9.0)], "target string, error double")
    got = {r.target: (r.version, r.error) for r in governance.apply_updates(state, update, key="target").collect()}
    assert got == {"demand": ("v1", None), "price": ("p1", 2.0), "weather": (None, 9.0)}


def test_latest_forecasts_keep_every_version_of_every_interval(spark):
    import datetime as dt

    start = dt.datetime(2025, 6, 1, tzinfo=dt.timezone.utc)
    rows = [
        (f"{v}-{i}", target, "ES", start, start + dt.timedelta(minutes=15 * i), f"v{v}", False)
        for target in ("price", "demand")
        for v in (1, 2)
        for i in range(-8, 96)
    ]
    df = spark.createDataFrame(
        rows, "forecast_id string, target string, area string, issue_time timestamp, valid_from timestamp, model_version string, is_shadow boolean"
    )
    from voltframe.operators import forecasts

    assert forecasts.latest_forecasts(df).count() == 2 * 2 * 104
    assert forecasts.day_ahead_prices(df, F.lit("2025-06-01").cast("date")).count() == 2 * 96
    assert forecasts.demand_horizon(df, 2).count() == 2 * 8
    assert forecasts.query_forecasts(df, "price", "ES", limit=3).count() == 2 * 3
