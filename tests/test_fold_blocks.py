"""Folds as sums of blocks: windows, least squares and quantiles against direct computation; the composed report; any learner."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.operators import backtest, fold_blocks, learners
from voltframe.operators.backtest import BacktestPlan
from voltframe.operators.fold_blocks import FoldBlocks

PLANS = [
    BacktestPlan(train_days=20, test_days=5, step_days=5, steps_per_day=24, lead=24),
    BacktestPlan(train_days=11, test_days=4, step_days=3, steps_per_day=24, lead=30, calibration_fraction=0.3),
    BacktestPlan(train_days=9, test_days=2, step_days=7, steps_per_day=24, lead=1, calibration_fraction=0.0),
]


def starts(plan):
    fit_end = plan.train_rows - plan.lead_steps - plan.calibration_rows
    return fit_end, [k * plan.step_rows for k in range(6)]


@pytest.mark.parametrize("plan", PLANS)
def test_training_windows_are_exact_runs_of_blocks(spark, plan):
    shape = FoldBlocks(plan)
    fit_end, firsts = starts(plan)
    number = np.array([shape.number(i) for i in range(firsts[-1] + fit_end + 5)])
    for k, first in enumerate(firsts):
        inside = (number >= k * len(shape.offsets)) & (number < k * len(shape.offsets) + shape.fit_blocks)
        assert np.flatnonzero(inside).tolist() == list(range(first, first + fit_end))
    got = spark.range(len(number)).select(shape.column(F.col("id")).alias("b")).collect()
    assert [r.b for r in got] == number.tolist()


def series(spark, days=62, areas=("ES", "PT")):
    rng = np.random.default_rng(6)
    parts = []
    for i, area in enumerate(areas):
        n = 24 * (days - 7 * i)
        x1, x2 = rng.normal(50, 5, n), rng.normal(0, 1e-3, n)
        value = 3 + 2 * i + 0.5 * x1 - 900 * x2 + rng.normal(0, 1, n)
        parts.append(pd.DataFrame({"area": area, "valid_time": pd.date_range("2025-01-01", periods=n, freq="60min"), "value": value.round(1), "x1": x1, "x2": x2}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf).withColumn("valid_time", F.col("valid_time").cast("timestamp"))


@pytest.mark.parametrize("plan", PLANS)
def test_every_fold_equals_a_direct_fit(spark, plan):
    pdf, df = series(spark)
    rows = backtest.indexed_rows(df, keys=["area"], plan=plan).withColumnRenamed("value", "target")
    got = fold_blocks.linear_folds(rows, keys=["area"], plan=plan, features=["x1", "x2"]).collect()
    fit_end, firsts = starts(plan)
    head, checked = backtest._head(plan), 0
    for r in got:
        part = pdf[pdf.area == r.area].iloc[head:]
        window = part.iloc[(r.fold - 1) * plan.step_rows :][:fit_end]
        want = np.linalg.lstsq(np.column_stack([np.ones(fit_end), window.x1, window.x2]), window.value, rcond=None)[0]
        assert r["rows"] == fit_end and np.allclose(r.coefficients, want, rtol=1e-6)
        checked += 1
    assert checked == len({(r.area, r.fold) for r in got}) == sum(max(0, (len(pdf[pdf.area == a]) - head - plan.train_rows - plan.test_rows) // plan.step_rows + 1) for a in ("ES", "PT"))


def test_missing_features_and_constant_ones(spark):
    plan = PLANS[0]
    pdf, df = series(spark, areas=("ES",))
    holed = df.withColumn("x1", F.when(F.hour("valid_time") != 3, F.col("x1"))).withColumn("x2", F.lit(1.0))
    rows = backtest.indexed_rows(holed, keys=["area"], plan=plan).withColumnRenamed("value", "target")
    r = fold_blocks.linear_folds(rows, keys=["area"], plan=plan, features=["x1", "x2"]).filter("fold = 1").collect()[0]
    part = pdf.iloc[backtest._head(plan) :][: starts(plan)[0]]
    part = part[part.valid_time.dt.hour != 3]
    slope, level = np.polyfit(part.x1, part.value, 1)
    assert r["rows"] == len(part) and r.coefficients[1] == pytest.approx(slope) and r.coefficients[0] + r.coefficients[2] == pytest.approx(level)
    out = fold_blocks.linear_backtest(holed, keys=["area"], plan=plan, features=["x1", "x2"])
    assert out.filter(F.hour("valid_time") == 3).count() == 0 and out.filter("p10 > p50 or p50 > p90").count() == 0


def test_fold_quantiles_equal_numpy_and_read_rows_once(spark):
    plan = PLANS[1]
    pdf, df = series(spark)
    rows = backtest.indexed_rows(df, keys=["area"], plan=plan).withColumn("hour", F.hour("valid_time"))
    counts = fold_blocks.count_blocks(rows, keys=["area"], plan=plan, by=["hour"], target="value")
    got = fold_blocks.fold_quantiles(counts, fold_blocks.folds_of(rows, ["area"]), keys=["area"], plan=plan, by=["hour"], quantiles=[0.1, 0.5]).collect()
    fit_end, _ = starts(plan)
    for r in got:
        part = pdf[pdf.area == r.area].iloc[backtest._head(plan) :].iloc[(r.fold - 1) * plan.step_rows :][:fit_end]
        values = part[part.valid_time.dt.hour == r.hour].value
        assert np.allclose(r.q, np.quantile(values, [0.1, 0.5]))
    assert counts.agg(F.sum("_c")).first()[0] == rows.count() and len(got) > 100


def test_linear_backtest_feeds_the_summary_and_covers(spark):
    plan = PLANS[0]
    _, df = series(spark)
    based = backtest.shifted_values(df, keys=["area"], steps_per_day=24, offsets={"baseline_24h": 24, "baseline_7d": 168})
    out = fold_blocks.linear_backtest(based, keys=["area"], plan=plan, features=["x1", "x2"], carried=["baseline_24h", "baseline_7d"])
    for r in backtest.backtest_summary(out, keys=["area"]).collect():
        assert 0.7 < r.calibrated_coverage < 0.9 and r.mae < 1.1 and r.mae_improvement_vs_7d > 50
    report = backtest.backtest_report(out, keys=["area"]).filter("area = 'ES'").collect()
    by = {(r.section, r.slice): r for r in report}
    whole = by["overall", "model"]
    assert whole.n == sum(r.n for r in report if r.section == "fold") == sum(r.n for r in report if r.section == "hour")
    assert whole.mae * whole.n == pytest.approx(sum(r.mae * r.n for r in report if r.section == "day_type"))
    assert by["overall", "baseline_7d"].wape is not None and {r.slice for r in report if r.section == "regime"} == {"peak", "normal"}


def test_any_learner_can_be_backtested(spark):
    plan = BacktestPlan(train_days=20, test_days=8, step_days=8, steps_per_day=24, lead=24)
    _, df = series(spark)
    rows = backtest.indexed_rows(df, keys=["area"], plan=plan).withColumnRenamed("value", "target").withColumn("hour", F.hour("valid_time"))
    out = backtest.backtest_learner(rows, lambda: learners.RobustLinearForecaster(keys=["area"]), keys=["area"], plan=plan, features=["x1", "x2"]).toPandas()
    folds = rows.groupBy("area").agg(F.max("fold_count").alias("n")).collect()
    assert out.groupby("area").fold.nunique().to_dict() == {r.area: r.n for r in folds}
    assert (out.groupby(["area", "fold"]).size() == plan.test_rows).all()
    assert ((out.p10 <= out.p50) & (out.p50 <= out.p90)).all() and 0.6 < ((out.actual >= out.p10) & (out.actual <= out.p90)).mean() < 0.95
