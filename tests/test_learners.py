from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.operators import learners

NAMES = ["hour", "lag_1h", "lag_24h"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 24 * 30
    start = datetime(2025, 1, 1)
    parts = []
    for area, level in (("ES", 100.0), ("PT", 50.0)):
        hour = np.arange(n) % 24
        value = level + 10 * np.sin(hour / 24 * 2 * np.pi) + rng.normal(0, 2, n)
        parts.append(pd.DataFrame({
            "area": area, "valid_time": [start + timedelta(hours=i) for i in range(n)], "hour": hour.astype("int32"),
            "is_weekend": ((np.arange(n) // 24 + 2) % 7 >= 5).astype("int32"), "lag_1h": np.roll(value, 1),
            "lag_24h": np.roll(value, 24), "target": value, "horizon_step": np.where(np.arange(n) % 2, 1, 24).astype("int32"),
        }))
    return spark.createDataFrame(pd.concat(parts)).cache()


@pytest.mark.parametrize("kind", ["seasonal", "boosted_trees", "random_forest", "robust_linear"])
def test_quantiles_are_ordered_and_calibrated(spark, rows, kind):
    options = {"boosted_trees": {"iterations": 2, "depth": 3}, "random_forest": {"trees": 3, "depth": 3}}.get(kind, {})
    cut = datetime(2025, 1, 24)
    model = learners.create_forecaster(kind, keys=["area"], **options)
    model.fit(rows.filter(F.col("valid_time") < cut), feature_names=NAMES, calibration_fraction=0.2)
    held = rows.filter(F.col("valid_time") >= cut)
    got = model.predict(held).toPandas()
    assert len(got) == held.count()
    assert ((got.p10 <= got.p50) & (got.p50 <= got.p90)).all()
    assert 0.6 <= ((got.target >= got.p10) & (got.target <= got.p90)).mean() <= 0.97
    scored = model.score(held, "demand")
    assert scored.columns == ["area", "valid_time", "p10", "point_forecast", "p90", "unit"]


@pytest.mark.parametrize("kind", ["seasonal", "stacked", "dual_horizon"])
def test_saved_model_predicts_the_same(spark, rows, tmp_path, kind):
    small = {"iterations": 1, "depth": 2}
    names = NAMES
    members = {
        "stacked": {"members": [learners.BoostedTreesForecaster(["area"], **small), learners.RandomForestForecaster(["area"], trees=2, depth=2), learners.SeasonalQuantileForecaster(["area"])]},
        "dual_horizon": {"short": learners.BoostedTreesForecaster(["area"], **small), "long": learners.BoostedTreesForecaster(["area"], **small), "switch_steps": 6},
    }.get(kind, {})
    model = learners.create_forecaster(kind, keys=["area"], **members)
    model.fit(rows, feature_names=names, calibration_fraction=0.15)
    path = str(tmp_path / kind)
    model.save(spark, path)
    again = type(model).load(spark, path)
    assert again.feature_names == names
    order = ["area", "valid_time", "p10", "p50", "p90"]

    def table(m):
        return m.predict(rows).select(order).orderBy("area", "valid_time").toPandas()

    a, b = table(model), table(again)
    np.testing.assert_allclose(a[order[2:]].to_numpy(float), b[order[2:]].to_numpy(float), rtol=1e-9)


def test_period_split_is_strictly_later(spark, rows):
    split = learners.split_last_periods(rows.unionByName(rows), keys=["area"], fraction=0.15)
    bounds = split.groupBy("is_calibration").agg(F.min("valid_time").alias("lo"), F.max("valid_time").alias("hi"), F.countDistinct("valid_time").alias("n"))
    got = {r.is_calibration: r for r in bounds.collect()}
    assert got[False].hi < got[True].lo and got[True].n == int(24 * 30 * 0.15)


def test_importances_and_factory(spark, rows):
    model = learners.create_forecaster("boosted_trees", keys=["area"], iterations=2, depth=2).fit(rows, feature_names=NAMES)
    shown = {r.feature: r.importance for r in model.feature_importances(spark).collect()}
    assert set(shown) == set(NAMES) and sum(shown.values()) == pytest.approx(1.0)
    with pytest.raises(ValueError, match="unknown model_type"):
        learners.create_forecaster("nope")
    with pytest.raises(ValueError, match="horizon_step"):
        learners.create_forecaster("dual_horizon", keys=["area"]).fit(rows.drop("horizon_step"), feature_names=NAMES)


@pytest.fixture(scope="module")
def uneven(spark):
    """One series whose spread depends on the hour, so that residual quantiles of the whole would not fit."""
    rng = np.random.default_rng(12)
    n = 24 * 200
    hour = np.arange(n) % 24
    value = 100 + hour + rng.normal(0, 1, n) * (1 + hour / 2)
    pdf = pd.DataFrame({
        "area": "ES", "valid_time": [datetime(2025, 1, 1) + timedelta(hours=i) for i in range(n)], "hour": hour.astype("int32"),
        "is_weekend": 0, "lag_1h": rng.normal(0, 1, n), "lag_24h": np.roll(value, 24), "target": value,
    })
    return spark.createDataFrame(pdf).cache()


def test_leaf_quantiles_cover_without_calibration(spark, uneven):
    cut = datetime(2025, 1, 1) + timedelta(days=150)
    model = learners.create_forecaster("leaf_quantile", keys=["area"], trees=8, depth=5)
    model.fit(uneven.filter(F.col("valid_time") < cut), feature_names=NAMES)
    got = model.predict(uneven.filter(F.col("valid_time") >= cut)).toPandas()
    assert len(got) == 24 * 50 and ((got.p10 <= got.p50) & (got.p50 <= got.p90)).all()
    inside = (got.target >= got.p10) & (got.target <= got.p90)
    assert 0.75 <= inside.mean() <= 0.85
    assert inside[got.hour >= 16].mean() > 0.7 and inside[got.hour < 8].mean() < 0.95
    width = (got.p90 - got.p10).groupby(got.hour).mean()
    assert width[20] > 3 * width[2]


def test_leaf_quantiles_are_those_of_the_rows_in_the_leaf(spark, uneven, tmp_path):
    model = learners.LeafQuantileForecaster(["area"], trees=3, depth=3).fit(uneven, feature_names=NAMES)
    fallen = model._in_leaves(uneven.filter(F.pmod(F.xxhash64("valid_time"), F.lit(2)) != 0)).select("target", "_leaf").toPandas()
    table = {(r.tree, r.leaf): (r.p10, r.p50, r.p90, r.n) for r in model.leaves.collect()}
    leaves = np.stack(fallen._leaf)
    assert len(table) == sum(len(np.unique(leaves[:, t])) for t in range(3)) <= 3 * 2**3
    for (tree, leaf), (*q, n) in table.items():
        values = fallen.target[leaves[:, tree] == leaf]
        assert n == len(values) and np.allclose(q, np.quantile(values, [0.1, 0.5, 0.9]))
    some = uneven.limit(50)
    got = model.raw_quantiles(some).orderBy("valid_time").select("p10", "p50", "p90").collect()
    for r, own in zip(got, model._in_leaves(some).orderBy("valid_time").collect()):
        want = np.mean([table[t, leaf][:3] for t, leaf in enumerate(own._leaf)], axis=0)
        assert np.allclose(r, np.sort(want))
    model.save(spark, str(tmp_path / "leaf"))
    again = learners.QuantileForecaster.load(spark, str(tmp_path / "leaf"))
    assert type(again) is learners.LeafQuantileForecaster
    assert again.raw_quantiles(some).orderBy("valid_time").select("p10", "p50", "p90").collect() == got


def test_members_of_any_kind_are_restored(spark, rows, tmp_path):
    members = [learners.SeasonalQuantileForecaster(["area"]), learners.RobustLinearForecaster(["area"]), learners.LeafQuantileForecaster(["area"], trees=2, depth=2)]
    model = learners.StackedForecaster(["area"], members=members).fit(rows, feature_names=NAMES)
    model.save(spark, str(tmp_path / "s"))
    again = learners.StackedForecaster.load(spark, str(tmp_path / "s"))
    assert [type(m) for m in again.members] == [type(m) for m in members]
    want = model.predict(rows).orderBy("area", "valid_time").select("p10", "p90").limit(20).collect()
    assert again.predict(rows).orderBy("area", "valid_time").select("p10", "p90").limit(20).collect() == want
    with pytest.raises(ValueError, match="holds a StackedForecaster"):
        learners.SeasonalQuantileForecaster.load(spark, str(tmp_path / "s"))
    with pytest.raises(ValueError, match="members"):
        learners.StackedForecaster(["area"], members=members[:2])
