from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.functions.timegrid import calendar_features
from voltframe.operators import features

START = pd.Timestamp("2025-01-01")


def make_series(spark, values, step="15min", key="a"):
    times = pd.date_range(START, periods=len(values), freq=step)
    pdf = pd.DataFrame({"area": key, "valid_time": times, "value": np.asarray(values, dtype=float)})
    return spark.createDataFrame(pdf).withColumn("valid_time", F.col("valid_time").cast("timestamp"))


def collect(df):
    return df.toPandas().sort_values(["area", "valid_time"]).reset_index(drop=True)


def by_definition(v: pd.Series, spd: int, lead: int) -> pd.DataFrame:
    """The feature definitions applied to one in-memory series."""
    hour, out, known = spd // 24, pd.DataFrame(index=v.index), v.shift(1)
    for name, k in {"lag_1h": hour, "lag_4h": 4 * hour, "lag_24h": spd, "lag_14d": 14 * spd}.items():
        out[name] = v.shift(k)
    out["diff_1h"] = v.shift(hour) - v.shift(2 * hour)
    out["acceleration_1h"] = out["diff_1h"] - (v.shift(2 * hour) - v.shift(3 * hour))
    out["ema_4step"] = known.ewm(span=4).mean()
    out["ema_12step"] = known.ewm(span=12).mean()
    out["rolling_std_4step"] = known.rolling(hour).std().fillna(0)
    for days, label in ((1, "24h"), (7, "7d")):
        out[f"rolling_mean_{label}"] = known.rolling(days * spd).mean()
        out[f"rolling_std_{label}"] = known.rolling(days * spd).std()
    out["rolling_min_24h"] = known.rolling(spd).min()
    out["rolling_max_24h"] = known.rolling(spd).max()
    out["volatility_24h"] = (out.rolling_max_24h - out.rolling_min_24h) / (out.rolling_mean_24h + 1e-3)
    return out.shift(lead - 1)


@pytest.mark.parametrize(("lead", "chunk"), [(1, None), (7, 500), (96, 1700)])
def test_history_matches_definition_for_any_chunking(spark, lead, chunk):
    rng = np.random.default_rng(3)
    values = 1000 + rng.normal(size=96 * 20).cumsum()
    df = make_series(spark, values).unionByName(make_series(spark, values[::-1], key="b"))
    got = collect(
        features.history_features(df, keys=["area"], steps_per_day=96, lead=lead, rows_per_chunk=chunk)
    )
    for key, series in (("a", values), ("b", values[::-1])):
        rows = got[got.area == key].reset_index(drop=True)
        want = by_definition(pd.Series(series), 96, lead)
        for name in want:
            np.testing.assert_allclose(
                rows[name].to_numpy(float), want[name].to_numpy(), rtol=1e-9, atol=1e-7, err_msg=name
            )


@pytest.mark.parametrize("lead", [4, 96, 192])
def test_values_after_the_origin_do_not_matter(spark, lead):
    values = np.sin(np.arange(2500) / 50.0)
    cut = 2200
    disturbed = values.copy()
    disturbed[cut - lead + 1 :] += 1e6
    columns = list(features.HISTORY_FEATURES)

    def at_cut(series):
        out = features.history_features(make_series(spark, series), keys=["area"], steps_per_day=96, lead=lead)
        return collect(out).loc[cut, columns].to_numpy(float)

    assert at_cut(values).tolist() == at_cut(disturbed).tolist()


def test_rolling_frames_exclude_the_current_step(spark):
    values = np.zeros(200)
    values[100] = 100.0
    got = collect(features.history_features(make_series(spark, values), keys=["area"], steps_per_day=96))
    assert got.loc[100, "rolling_max_24h"] == 0.0
    assert got.loc[101, "rolling_max_24h"] == 100.0
    assert got.loc[100, "ema_4step"] == 0.0 and got.loc[101, "ema_4step"] > 0


def test_multiscale_is_complete_and_joins_exogenous(spark):
    df = make_series(spark, np.arange(1500.0))
    exog = make_series(spark, np.arange(1500.0) * 2)
    out = features.multiscale_features(df, keys=["area"], steps_per_day=96, exogenous=exog)
    got = collect(out)
    assert len(got) == 1500 - 14 * 96
    assert not got.isna().any().any()
    assert (got["exog_lag_24h"] == (got["target"] - 96) * 2).all()
    assert set(features.SHORT_HORIZON_FEATURES) <= set(got.columns)
    short = features.short_horizon_features(out, ["area"])
    assert len(features.SHORT_HORIZON_FEATURES) == 18 and "ema_12step" in short.columns
    assert len(features.LONG_HORIZON_FEATURES) == 27


def test_irregular_series_is_refused(spark):
    df = make_series(spark, np.arange(300.0))
    features.require_regular(df, keys=["area"], steps_per_day=96)
    broken = df.filter(F.col("value") != 150)
    with pytest.raises(ValueError, match="regular"):
        features.require_regular(broken, keys=["area"], steps_per_day=96)
    gaps = features.series_gaps(broken, keys=["area"], steps_per_day=96).collect()
    assert [(g.violation, g.missing_steps) for g in gaps] == [("gap", 1)]
    doubled = df.unionByName(df.filter("value = 7"))
    assert [g.violation for g in features.series_gaps(doubled, keys=["area"], steps_per_day=96).collect()] == ["duplicate"]


def test_lead_and_grid_arguments_are_checked(spark):
    df = make_series(spark, np.arange(10.0))
    with pytest.raises(ValueError):
        features.horizon_features(df, keys=["area"], lead=0)
    with pytest.raises(ValueError):
        features.horizon_features(df, keys=["area"], lead=1, steps_per_day=50)


def test_calendar_uses_the_market_clock(spark):
    stamps = ["2025-01-06T00:00:00", "2025-03-30T00:30:00", "2025-03-30T01:30:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.to_timestamp("s").alias("valid_time"))
    spain = calendar_features(df).orderBy("valid_time").collect()
    portugal = calendar_features(df, country_code="PT").orderBy("valid_time").collect()
    assert [r.hour for r in spain] == [1, 1, 3]
    assert (spain[0].is_holiday, portugal[0].hour, portugal[0].is_holiday) == (1, 0, 0)
    with pytest.raises(ValueError, match="unsupported country_code"):
        calendar_features(df, country_code="US")


def test_one_shuffle_serves_all_windows(spark):
    df = make_series(spark, np.arange(100.0))
    plan = features.history_features(df, keys=["area"], steps_per_day=96)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 2


@pytest.mark.parametrize("steps_per_day", [288, 1440])
def test_moving_averages_have_no_limit_of_steps_per_day(spark, steps_per_day):
    values = 1000 + np.random.default_rng(5).normal(size=steps_per_day * 2 + 37).cumsum()
    df = make_series(spark, values, step=f"{86400 // steps_per_day}s")
    got = collect(features.history_features(df, keys=["area"], steps_per_day=steps_per_day, groups=("ema",), rows_per_chunk=900))
    known = pd.Series(values).shift(1)
    for name, span in features.EMA_SPANS.items():
        np.testing.assert_allclose(got[name].to_numpy(float), known.ewm(span=span).mean().to_numpy(), rtol=1e-9)
