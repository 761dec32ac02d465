from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.operators.asof import asof_features, asof_values
from voltframe.plans.asof import asof_join
from voltframe.plans.prefix_median import running_median
from voltframe.plans.skew import (
    carry_forward,
    order_statistics,
    quantile_rank,
    time_bucket,
    with_row_index,
)

BASE = pd.Timestamp("2025-01-01")


def stamped(spark, pdf, *columns):
    df = spark.createDataFrame(pdf)
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


@pytest.fixture(scope="module")
def skewed():
    """4000 rows of which four fifths share one key; many equal values and repeated times."""
    rng = np.random.default_rng(11)
    n = 4000
    return pd.DataFrame(
        {
            "k": rng.choice(["hot", "b", "c"], n, p=[0.8, 0.15, 0.05]),
            "ts": BASE + pd.to_timedelta(rng.integers(0, 200_000, n), unit="s"),
            "v": np.where(rng.random(n) < 0.3, 5.0, np.round(rng.normal(0, 50, n), 2)),
            "id": np.arange(n),
        }
    )


def test_row_index_is_exact(spark, skewed):
    df = stamped(spark, skewed, "ts")
    got = with_row_index(
        df, keys=["k"], bucket=time_bucket("ts", 3_600_000_000), order=[F.col("ts"), F.col("id")], name="i", total="n"
    ).toPandas()
    for k, part in got.groupby("k"):
        part = part.sort_values(["ts", "id"])
        assert part.i.tolist() == list(range(len(part))), k
        assert set(part.n) == {len(part)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_carry_forward_crosses_buckets(spark, skewed, inclusive):
    df = stamped(spark, skewed, "ts")
    value = F.when(F.col("v") > 60, F.col("v"))
    got = carry_forward(
        df, keys=["k"], bucket=time_bucket("ts", 60_000_000), order=[F.col("ts"), F.col("id")], value=value,
        name="last_big", inclusive=inclusive,
    ).toPandas()
    for _, part in got.groupby("k"):
        part = part.sort_values(["ts", "id"])
        want = part.v.where(part.v > 60).ffill()
        want = want if inclusive else want.shift(1)
        np.testing.assert_array_equal(part.last_big.to_numpy(float), want.to_numpy())


def test_order_statistics_equal_numpy(spark, skewed):
    df = stamped(spark, skewed, "ts")
    probabilities = {"q05": 0.05, "q50": 0.5, "q95": 0.95, "top": 1.0, "low": 0.0}
    got = order_statistics(
        df, keys=["k"], value="v", ranks={n: quantile_rank(p) for n, p in probabilities.items()}
    ).toPandas().set_index("k")
    for k, part in skewed.groupby("k"):
        for name, p in probabilities.items():
            assert got.loc[k, name] == pytest.approx(np.quantile(part.v, p), abs=1e-12)
        assert got.loc[k, "n"] == len(part)


def test_running_median_matches_brute_force_under_skew(spark, skewed):
    pdf = skewed.sort_values(["k", "ts", "id"]).assign(seq=lambda d: d.groupby("k").cumcount())
    numbered = stamped(spark, pdf, "ts")
    wanted = pdf.sample(300, random_state=1)[["k", "seq"]]
    got = running_median(
        numbered, spark.createDataFrame(wanted), keys=["k"], value="v", rows_per_chunk=100
    ).toPandas()
    assert len(got) == len(wanted)
    series = {k: d.v.to_numpy() for k, d in pdf.groupby("k")}
    for row in got.itertuples():
        assert row.running_median == np.median(series[row.k][: row.seq + 1])


def asof_inputs(spark, skewed):
    rng = np.random.default_rng(5)
    m = skewed.rename(columns={"ts": "published_at", "v": "value", "id": "event_id"})
    m = m.assign(interval_start=m.published_at, value=m.value.where(rng.random(len(m)) > 0.3))
    o = pd.DataFrame(
        {
            "k": rng.choice(["hot", "b", "none"], 500),
            "forecast_origin": BASE + pd.to_timedelta(rng.integers(-9000, 210_000, 500), unit="s"),
            "origin_id": np.arange(500),
        }
    )
    o["valid_time"] = o.forecast_origin
    left = stamped(spark, o, "forecast_origin", "valid_time")
    right = stamped(spark, m, "published_at", "interval_start")
    return m, o, left, right.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


@pytest.mark.parametrize("by", [["k"], []])
def test_asof_with_imputation_matches_brute_force(spark, skewed, by):
    m, o, left, right = asof_inputs(spark, skewed)
    if not by:
        left, right = left.drop("k"), right.drop("k")
    got = asof_features(right, left, by=by, rows_per_chunk=128).toPandas().set_index("origin_id")
    for row in o.itertuples():
        prior = m[m.published_at <= row.forecast_origin]
        prior = prior[prior.k == row.k] if by else prior
        prior = prior.sort_values(["published_at", "event_id"])
        matched = prior.value.iloc[-1] if len(prior) else np.nan
        median = prior.value.median()
        value, method = got.loc[row.origin_id, ["value", "imputation_method"]]
        if not np.isnan(matched):
            assert (value, method) == (matched, "none")
        elif not np.isnan(median):
            assert (value, method) == (median, "prior_median")
        else:
            assert pd.isna(value) and method == "unavailable"


def one_case(spark, published, origin):
    right = stamped(
        spark,
        pd.DataFrame({"published_at": published, "interval_start": published, "value": [25000.0, 26000.0][: len(published)]}),
        "published_at", "interval_start",
    )
    left = stamped(
        spark, pd.DataFrame({"forecast_origin": [origin], "valid_time": [origin]}), "forecast_origin", "valid_time"
    )
    return asof_features(right, left).collect()[0]


def test_origin_sees_only_earlier_publications(spark):
    published = [pd.Timestamp("2025-01-01 11:45"), pd.Timestamp("2025-01-01 12:30")]
    assert one_case(spark, published, pd.Timestamp("2025-01-01 12:00")).value == 25000
    assert one_case(spark, published, pd.Timestamp("2025-01-01 13:00")).value == 26000
    assert one_case(spark, published, pd.Timestamp("2025-01-01 12:30")).value == 26000


def test_no_fallback_from_the_future(spark):
    row = one_case(spark, [pd.Timestamp("2025-01-01 13:00")], pd.Timestamp("2025-01-01 12:00"))
    assert row.value is None and row.imputation_method == "unavailable" and row.is_missing


def test_missing_columns_are_named(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="measurements missing columns"):
        asof_values(df, df)
    with pytest.raises(ValueError, match="share columns"):
        asof_join(df, df, left_on="id", right_on="id")


def test_plans_hold_no_pair_joins(spark, skewed):
    _, _, left, right = asof_inputs(spark, skewed)
    for df in (asof_values(right, left, by=["k"]), asof_features(right, left, by=["k"]), asof_values(right.drop("k"), left.drop("k"))):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in physical and "CartesianProduct" not in physical
        assert "Join Cross" not in plan


def test_row_index_keeps_rows_with_null_keys(spark):
    rows = [(k, f"2024-01-0{d}") for k in ("a", None) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "k string, d string").withColumn("ts", F.to_timestamp("d"))
    got = with_row_index(df, keys=["k"], bucket=time_bucket("ts"), order=[F.col("ts")], total="n").collect()
    assert sorted((r.k or "", r.d, r.row_index, r.n) for r in got) == sorted((k or "", d, int(d[-1]) - 1, 3) for k, d in rows)
