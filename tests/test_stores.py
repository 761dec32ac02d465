"""Artifacts that appear whole, the stored forecast table, and breach windows counted in event time."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltframe.operators import artifacts, governance, learners, state
from voltframe.schemas import BRONZE_SCHEMA, FORECAST_SCHEMA
from voltframe.sources import payloads
from voltframe.sources.connectors import bronze_columns
from voltframe.streaming.breaches import stream_ordered_breaches
from voltframe.streaming.lake import Lake, read_forecasts, store_forecasts

START = datetime(2025, 1, 1)


def model(spark):
    rows = [("ES", START + timedelta(hours=i), i % 24, 0, float(i % 24)) for i in range(24 * 20)]
    df = spark.createDataFrame(rows, "area string, valid_time timestamp, hour int, is_weekend int, target double")
    made = learners.SeasonalQuantileForecaster(keys=["area"], model_version="v1").fit(df, feature_names=[])
    return made, df


@pytest.mark.parametrize("value", ["", ".", "..", "a/b", "a\\b", ".hidden", "a b", None])
def test_no_value_leads_out_of_its_folder(value):
    with pytest.raises(ValueError, match="area cannot name a folder"):
        artifacts.artifact_folder("/models", area=value, target="demand", product="operational", version="v1")
    assert artifacts.artifact_folder("/m/", area="10YES-REE------0", target="demand", product="p", version="v1.2") == "/m/10YES-REE------0/demand/p/v1.2"


def test_artifacts_appear_whole_once_and_are_checked(spark, tmp_path):
    made, df = model(spark)
    place = {"area": "ES", "target": "demand", "product": "operational"}
    folder = artifacts.save_model(spark, made, str(tmp_path), **place)
    again = artifacts.load_model(spark, folder)
    assert again.predict(df).agg(F.sum("p50")).first() == made.predict(df).agg(F.sum("p50")).first()
    with pytest.raises(FileExistsError):
        artifacts.save_model(spark, made, str(tmp_path), **place)
    assert [p.name for p in (tmp_path / "ES" / "demand" / "operational").iterdir()] == ["v1"]

    def dies(hidden):
        made.save(spark, hidden)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError, match="killed"):
        artifacts.publish(spark, folder.replace("v1", "v2"), dies)
    assert [p.name for p in (tmp_path / "ES" / "demand" / "operational").iterdir()] == ["v1"]
    meta = next((tmp_path / "ES" / "demand" / "operational" / "v1" / "metadata").glob("part-*"))
    meta.write_text(meta.read_text().replace("v1", "v9"))
    (meta.parent / ".part-x.crc").unlink(missing_ok=True)
    for crc in meta.parent.glob(f".{meta.name}.crc"):
        crc.unlink()
    assert [r.problem for r in artifacts.damaged_files(spark, folder).collect()] == ["changed"]
    with pytest.raises(ValueError, match="is changed"):
        artifacts.load_model(spark, folder)
    with pytest.raises(FileNotFoundError):
        artifacts.load_model(spark, folder.replace("v1", "v3"))


def forecast(spark, *rows):
    """Rows from (id, target, issue day, interval, point, shadow)."""
    data = []
    for i, target, day, k, point, shadow in rows:
        issue = START + timedelta(days=day)
        start = issue + timedelta(minutes=15 * k)
        data.append((i, target, "ES", issue, start, start + timedelta(minutes=15), point, point - 1, point, point + 1, "MW", "m", "v1", "s", ["f"], shadow))
    return spark.createDataFrame(data, FORECAST_SCHEMA)


def test_stored_forecasts_are_merged_folder_by_folder(spark, tmp_path):
    lake = Lake(str(tmp_path))
    assert read_forecasts(spark, lake).count() == 0
    store_forecasts(forecast(spark, ("a", "demand", 0, 1, 1.0, False), ("b", "demand", 1, 1, 2.0, False), ("c", "price", 0, 1, 3.0, False)), lake)
    untouched = next((tmp_path / "gold" / "forecasts" / "target=price" / "issue_day=2025-01-01").glob("*.parquet"))
    stamp = untouched.stat().st_mtime_ns
    store_forecasts(forecast(spark, ("z", "demand", 0, 1, 9.0, False), ("d", "demand", 0, 2, 4.0, False), ("e", "demand", 0, 1, 5.0, True)), lake)
    got = {r.forecast_id: (r.target, r.point, r.is_shadow) for r in read_forecasts(spark, lake).collect()}
    assert got == {"a": ("demand", 9.0, False), "b": ("demand", 2.0, False), "c": ("price", 3.0, False), "d": ("demand", 4.0, False), "e": ("demand", 5.0, True)}
    assert untouched.stat().st_mtime_ns == stamp
    plan = read_forecasts(spark, lake).filter((F.col("target") == "price") & (F.col("issue_day") == START.date()))._jdf.queryExecution().executedPlan().toString()
    assert "target" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_windows_that_arrive_late_across_batches_count_in_order(spark, tmp_path):
    schema = "area string, target string, window_start timestamp, champion_error double, reference_error double"
    folder = tmp_path / "windows"
    folder.mkdir()
    errors = [125.0, 125.0, 90.0, 130.0, 130.0, 125.0, 130.0, 90.0, 125.0, 125.0]
    order = [[0, 2, 4], [1, 3, 7], [6, 5], [9, 8], [60]]
    rows = {i: {"area": "ES", "target": "demand", "window_start": (START + timedelta(hours=i)).isoformat() + "Z", "champion_error": e, "reference_error": 100.0}
            for i, e in [*enumerate(errors), (60, 90.0)]}
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, batch in enumerate(order):
            (folder / f"{n}.json").write_text("\n".join(json.dumps(rows[i]) for i in batch))
            stream = stream_ordered_breaches(spark.readStream.schema(schema).json(str(folder)), "6 hours")
            query = (
                stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
            )
            assert query.awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("window_start") < START + timedelta(hours=20)).orderBy("window_start").collect()
    twin = governance.breach_streaks(spark.createDataFrame([(r["area"], r["target"], START + timedelta(hours=i), r["champion_error"], r["reference_error"]) for i, r in rows.items() if i < 20], schema), keys=["area", "target"], order="window_start")
    want = twin.orderBy("window_start").collect()
    assert [(r.window_start, r.degraded, r.consecutive_breaches, r.rollback) for r in got] == [(r.window_start, r.degraded, r.consecutive_breaches, r.rollback) for r in want]


def test_provenance_and_bronze_layout(spark):
    xml = (
        "<M><TimeSeries><Period><timeInterval><start>2025-01-01T00:00Z</start></timeInterval><resolution>PT15M</resolution>"
        "<Point><position>1</position><quantity>5</quantity></Point></Period></TimeSeries></M>"
    )
    docs = spark.createDataFrame([(xml,)], "payload string")
    known = payloads.market_events(docs, "demand", area="ES", retrieved_at=F.lit(START), source_url="https://example.org/api", request_params={"b": "2", "a": "1"}).head()
    assert (known.source_url, known.request_params) == ("https://example.org/api", {"a": "1", "b": "2"})
    bare = payloads.market_events(docs, "demand", area="ES", retrieved_at=F.lit(START)).head()
    assert bare.source_url is None and bare.request_params == {}
    raw = spark.createDataFrame([("t", 0, 1, START, bytearray(b"k"), bytearray(b"v"))], "topic string, partition int, offset long, timestamp timestamp, key binary, value binary")
    bronze = bronze_columns(raw)
    assert [(f.name, f.dataType) for f in bronze.schema] == [(f.name, f.dataType) for f in BRONZE_SCHEMA] and bronze.head()["raw_payload"] == "v"


def test_state_tables_lose_no_update(spark, tmp_path):
    folder = str(tmp_path / "deployments")
    assert state.read_state(spark, folder) is None
    rows = lambda *r: spark.createDataFrame(list(r), "deployment_key string, champion_version string, status string")
    assert state.update_state(rows(("a", "v1", "champion"), ("b", "v1", "champion")), folder, key="deployment_key") == 0
    with ThreadPoolExecutor(3) as pool:
        keys = ["a", "b", "c"]
        numbers = [f.result(120) for f in [pool.submit(state.update_state, rows((k, "v2", "champion")), folder, key="deployment_key") for k in keys]]
    assert sorted(numbers) == [1, 2, 3]
    partial = spark.createDataFrame([("a", "rolled_back")], "deployment_key string, status string")
    state.update_state(partial, folder, key="deployment_key")
    got = {r.deployment_key: (r.champion_version, r.status) for r in state.read_state(spark, folder).collect()}
    assert got == {"a": ("v2", "rolled_back"), "b": ("v2", "champion"), "c": ("v2", "champion")}
    assert state.read_state(spark, folder, 0).count() == 2
    assert state.drop_versions(spark, folder, keep=2) == [0, 1, 2] and state.read_state(spark, folder).count() == 3
