"""Pieces of equal size, as-of joins over crowded hours and null keys, and running medians that ship a bounded number of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.operators.asof import asof_features, asof_values
from voltframe.operators.governance import release_ledger
from voltframe.plans.prefix_median import running_median
from voltframe.plans.skew import carry_forward, in_pieces, order_statistics, quantile_rank, running, with_row_index

BASE = pd.Timestamp("2025-01-01")


@pytest.fixture(scope="module")
def crowded():
    """3000 rows of two keys and a null key; nine tenths of all rows lie within one hour of one key."""
    rng = np.random.default_rng(21)
    n = 3000
    hot = rng.random(n) < 0.9
    seconds = np.where(hot, rng.integers(36_000, 39_600, n), rng.integers(0, 864_000, n))
    k = np.where(hot, "a", rng.choice(["a", "b", "-"], n))
    return pd.DataFrame({"k": k, "ts": BASE + pd.to_timedelta(seconds, unit="s"), "v": np.round(rng.normal(0, 9, n), 1), "id": np.arange(n)})


def frame(spark, pdf):
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withColumn("k", F.when(F.col("k") != "-", F.col("k")))


def test_one_crowded_hour_is_split(spark, crowded):
    sizes = [r["n"] for r in in_pieces(frame(spark, crowded), ["k"], [F.col("ts")], 10).groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * len(crowded) / 10


def test_rows_that_are_all_equal_are_split(spark):
    same = spark.range(0, 1000, 1, 4).select(F.lit("a").alias("k"), F.lit(1).alias("ts"))
    sizes = [r["n"] for r in in_pieces(same, ["k"], [F.col("ts")], 5).groupBy("_piece").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 400
    assert sorted(r.row_index for r in with_row_index(same, keys=["k"], order=[F.col("ts")], pieces=5).collect()) == list(range(1000))


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_running_values_in_pieces_equal_pandas(spark, crowded, pieces):
    value = F.when(F.col("v") > 12, F.col("v"))
    got = running(
        frame(spark, crowded), keys=["k"], order=[F.col("ts"), F.col("id")], pieces=pieces,
        values={"big": ("last", value), "low": ("min", F.col("v")), "count": ("sum", F.lit(1))},
    )
    indexed = with_row_index(got, keys=["k"], order=[F.col("ts"), F.col("id")], name="i", total="n", pieces=pieces).toPandas()
    assert len(indexed) == len(crowded) and set(indexed.columns) == {"k", "ts", "v", "id", "big", "low", "count", "i", "n"}
    for _, part in indexed.fillna({"k": "-"}).groupby("k"):
        part = part.sort_values(["ts", "id"])
        np.testing.assert_array_equal(part.big.to_numpy(float), part.v.where(part.v > 12).ffill().to_numpy())
        np.testing.assert_array_equal(part.low, part.v.cummin())
        assert part["count"].tolist() == list(range(1, len(part) + 1)) == (part.i + 1).tolist() and set(part.n) == {len(part)}


@pytest.mark.parametrize("bucket", [True, False])
def test_null_keys_carry_like_others(spark, bucket):
    rows = [(k, i, 1.0 if i == 0 else None) for k in ("a", None) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = carry_forward(df, keys=["k"], order=[F.col("i")], value=F.col("v"), name="c", bucket=F.col("i") if bucket else None).collect()
    assert len(got) == 8 and {r.c for r in got} == {1.0}


def test_asof_features_with_null_keys_and_any_number_of_pieces(spark, crowded):
    rng = np.random.default_rng(3)
    m = crowded.assign(v=crowded.v.where(rng.random(len(crowded)) > 0.4))
    o = pd.DataFrame({"k": rng.choice(["a", "b", "-", "none"], 300), "ts": BASE + pd.to_timedelta(rng.integers(30_000, 50_000, 300), unit="s"), "oid": np.arange(300)})
    right = frame(spark, m).select("k", F.col("ts").alias("published_at"), F.col("ts").alias("interval_start"), F.when(~F.isnan("v"), F.col("v")).alias("value"), F.col("id").cast("string").alias("event_id"))
    left = frame(spark, o).select("k", F.col("ts").alias("forecast_origin"), F.col("ts").alias("valid_time"), "oid")
    results = [asof_features(right, left, by=["k"], pieces=p, rows_per_chunk=c).toPandas().set_index("oid").sort_index() for p, c in ((3, 64), (20, 4096))]
    pd.testing.assert_frame_equal(*results)
    m = m.assign(event_id=m.id.astype(str)).sort_values(["ts", "event_id"])
    for row in o.itertuples():
        prior = m[(m.ts <= row.ts) & (m.k == row.k)]
        last = prior.v.iloc[-1] if len(prior) else np.nan
        want = prior.v.median() if np.isnan(last) else last
        got = results[0].loc[row.oid]
        assert (got.value == want) or (np.isnan(want) and pd.isna(got.value)), row
        assert got.is_missing == bool(np.isnan(last))
    assert asof_values(right, left.limit(0), by=["k"]).count() == 0
    empty = asof_features(right.limit(0), left, by=["k"]).toPandas()
    assert len(empty) == 300 and set(empty.imputation_method) == {"unavailable"}


def median_inputs(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 1, n) * rng.choice([1e-7, 1, 1e6], n), 9)
    return v, spark.createDataFrame(pd.DataFrame({"k": "x", "seq": np.arange(n), "v": v}))


@pytest.mark.parametrize(("chunk", "bits"), [(64, 4), (300, 8), (4096, 3)])
def test_all_running_medians_equal_numpy(spark, chunk, bits):
    v, numbered = median_inputs(spark, 1500)
    got = running_median(numbered, numbered.select("k", "seq"), keys=["k"], value="v", rows_per_chunk=chunk, bits=bits).toPandas()
    got = got.set_index("seq").running_median
    assert len(got) == 1500 and all(got[i] == np.median(v[: i + 1]) for i in range(1500))


def test_equal_values_and_tiny_series(spark):
    pdf = pd.DataFrame({"k": ["a"] * 500 + ["b"] + ["-"] * 2, "seq": [*range(500), 0, 0, 1], "v": [7.0] * 500 + [1.0, 2.0, 5.0]})
    numbered = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "-", F.col("k")))
    got = running_median(numbered, numbered.select("k", "seq"), keys=["k"], value="v", rows_per_chunk=50, bits=3).collect()
    assert {(r.k, r.seq): r.running_median for r in got} == {("a", i): 7.0 for i in range(500)} | {("b", 0): 1.0, (None, 0): 2.0, (None, 1): 3.5}


def shuffled_records(spark, job):
    """Records that the stages of a job wrote to shuffles."""
    context = spark.sparkContext
    store, bus, gateway = context._jsc.sc().statusStore(), context._jsc.sc().listenerBus(), context._gateway

    def written():
        bus.waitUntilEmpty()
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    job().count()
    return sum(n for stage, n in written().items() if stage not in before)


def test_rows_shipped_per_row_do_not_grow_with_the_series(spark):
    shares = []
    for n in (4_200, 8_000):  # both take two levels of eight bits
        numbered = median_inputs(spark, n)[1]
        wanted = numbered.filter("seq % 4 = 0").select("k", "seq")
        shares.append(shuffled_records(spark, lambda: running_median(numbered, wanted, keys=["k"], value="v", rows_per_chunk=512)) / n)
    assert shares[1] < shares[0] * 1.1, shares


def test_ledger_keeps_products_with_null_names(spark):
    rows = [(area, day, f"v{day}", mae, 100.0) for area in ("ES", None) for day, mae in ((1, 80.0), (2, 85.0), (3, 70.0))]
    df = spark.createDataFrame(rows, "area string, at int, version string, mae double, baseline_mae double")
    got = release_ledger(df, keys=["area"], order="at").collect()
    assert sorted((r.area or "", r.at, r.promoted, r.champion_version) for r in got) == sorted(
        (area, at, promoted, champion) for area in ("ES", "") for at, promoted, champion in ((1, True, "v1"), (2, False, "v1"), (3, True, "v3"))
    )


def test_crowded_values_are_split_until_they_fit(spark):
    rng = np.random.default_rng(8)
    v = np.where(rng.random(4000) < 0.9, rng.normal(0, 1e-7, 4000), rng.normal(0, 50, 4000))
    pdf = pd.DataFrame({"k": rng.choice(["a", "-"], 4000, p=[0.9, 0.1]), "v": v})
    df = spark.createDataFrame(pdf).withColumn("k", F.when(F.col("k") != "-", F.col("k")))
    probabilities = {"q05": 0.05, "q50": 0.5, "q951": 0.951, "low": 0.0, "top": 1.0}
    ranks = {n: quantile_rank(p) for n, p in probabilities.items()}
    for bound in (1 << 18, 30):
        got = {r.k or "-": r for r in order_statistics(df, keys=["k"], value="v", ranks=ranks, sorted_cells=bound).collect()}
        for k, part in pdf.groupby("k"):
            assert got[k].n == len(part)
            for name, p in probabilities.items():
                assert got[k][name] == pytest.approx(np.quantile(part.v, p), rel=1e-12, abs=1e-18)


def test_order_statistics_place_nan_and_infinity_last(spark):
    values = [float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e308, -1e308, 5e-324, None, float("nan"), 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = {f"r{i}": (lambda n, i=i: F.lit(i)) for i in range(10)}
    for bound in (1 << 18, 1):
        row = order_statistics(df, keys=[], value="v", ranks=ranks, sorted_cells=bound).collect()[0]
        got = [row[f"r{i}"] for i in range(10)]
        assert got[:8] == [float("-inf"), -1e308, 0.0, 0.0, 5e-324, 1.0, 1e308, float("inf")] and all(np.isnan(got[8:])) and row.n == 10


def test_one_value_repeated_and_no_values(spark):
    df = spark.range(1000).select(F.lit(3.5).alias("v"), F.lit("a").alias("k"))
    row = order_statistics(df, keys=["k"], value="v", ranks={"q": quantile_rank(0.3)}, sorted_cells=1).collect()[0]
    assert (row.q, row.n) == (3.5, 1000)
    assert order_statistics(df.limit(0), keys=["k"], value="v", ranks={"q": quantile_rank(0.3)}).count() == 0
