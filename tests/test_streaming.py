from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltframe.operators import curate
from voltframe.sources.connectors import bronze_columns, read_landed
from voltframe.streaming import lake as lake_module
from voltframe.streaming.breaches import stream_breaches
from voltframe.streaming.ingest import curator, start_bronze, start_curation
from voltframe.streaming.lake import Lake, compact, read_silver, read_table, run_backfill

DAY = datetime(2025, 1, 1)


def event(n, minute, value, *, revision=1, late=False, **changes):
    start = DAY + timedelta(minutes=minute)
    end = start + timedelta(minutes=15)
    arrived = end + (timedelta(hours=2, minutes=45) if late else timedelta(minutes=1))
    body = {
        "schema_version": "1.0", "event_id": f"e{n}", "source": "fixture", "event_type": "demand", "area": "ES",
        "interval_start": start, "interval_end": end, "published_at": end, "ingested_at": arrived,
        "value": value, "unit": "MW", "revision": revision, "quality_status": "valid",
    } | changes
    return {k: v.isoformat() + "+00:00" if isinstance(v, datetime) else v for k, v in body.items()}


def batches():
    first = [
        event(1, 0, 24800.0), event(2, 15, 24550.0), event(2, 15, 24550.0),
        event(3, 30, 7200.0, event_type="generation", dimension="wind"),
        event(4, 45, 62.3, event_type="price", unit="EUR/MWh"),
        event(5, 60, 1.0, unit="kW"),
        event(6, 75, 1.0, quality_status=None),
        event(7, 90, None),
    ]
    second = [
        event(8, 15, 24610.0, revision=2, late=True, quality_status="estimated"),
        event(9, 0, 24900.0, revision=2),
        event(10, 30, 7300.0, event_type="generation", dimension="wind"),
    ]
    return [[json.dumps(e) for e in first] + ['{"schema_version":"broken"'], [json.dumps(e) for e in second]]


def land(folder, number, payloads):
    os.makedirs(folder, exist_ok=True)
    lines = [
        json.dumps({"topic": "grid.demand.v1", "partition": 0, "offset": 100 * number + i,
                    "timestamp": f"2025-01-01T0{number}:00:00Z", "key": str(i), "value": p})
        for i, p in enumerate(payloads)
    ]
    with open(f"{folder}/part{number}.json", "w") as out:
        out.write("\n".join(lines))


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


def curated(spark, tmp_path, lake):
    """Two landed files curated one after the other."""
    for number, payloads in enumerate(batches()):
        land(str(tmp_path / "landing"), number, payloads)
        start_curation(read_landed(spark, str(tmp_path / "landing")), lake, once=True).awaitTermination(120)


def values(df):
    return {(r.event_type, r.interval_start.minute): (r.value, r.revision) for r in df.collect()}


def test_stream_routes_and_merges(spark, tmp_path, lake):
    curated(spark, tmp_path, lake)
    silver = values(read_silver(spark, lake))
    assert silver == {
        ("demand", 0): (24900.0, 2), ("demand", 15): (24550.0, 1),
        ("generation", 30): (7200.0, 1), ("price", 45): (62.3, 1),
    }
    dead = read_table(spark, lake.dead_letters)
    assert dead.count() == 4 and {r.reason for r in dead.collect()} == {"schema_validation"}
    assert [r.event_id for r in read_table(spark, lake.late).collect()] == ["e8"]

    raw = spark.read.schema("topic string, partition int, offset long, timestamp timestamp, key string, value string").json(str(tmp_path / "landing"))
    valid = curate.valid_events(curate.parse_bronze(bronze_columns(raw)))
    twin = curate.fold_batches(curate.on_time_events(valid).withColumn("batch_id", F.col("revision") - 1))
    assert values(twin)["demand", 0] == (24900.0, 2) and len(values(twin)) == 4


def test_retried_batch_changes_nothing(spark, tmp_path, lake):
    curated(spark, tmp_path, lake)
    before = [read_table(spark, p).count() for p in (lake.silver_log, lake.late, lake.dead_letters)]
    raw = spark.read.schema("topic string, partition int, offset long, timestamp timestamp, key string, value string").json(str(tmp_path / "landing" / "part1.json"))
    curator(lake)(bronze_columns(raw), 1)
    assert [read_table(spark, p).count() for p in (lake.silver_log, lake.late, lake.dead_letters)] == before


def test_backfill_is_bounded_and_runs_once(spark, tmp_path, lake):
    curated(spark, tmp_path, lake)
    args = ("fixture", "2025-01-01T00:00:00+00:00", "2025-01-02T00:00:00+00:00")
    run_id = run_backfill(spark, lake, *args)
    assert values(read_silver(spark, lake))["demand", 15] == (24610.0, 2)
    manifest = read_table(spark, lake.manifests).collect()
    assert [(m.run_id, m.record_count, m.before_snapshot_id) for m in manifest] == [(run_id, 1, "1")]
    assert run_backfill(spark, lake, *args) == run_id
    assert read_table(spark, lake.manifests).count() == 1
    outside = run_backfill(spark, lake, "fixture", "2025-01-01T00:30:00+00:00", "2025-01-02T00:00:00+00:00")
    assert read_table(spark, lake.manifests).filter(F.col("run_id") == outside).collect()[0].record_count == 0


def test_compaction_keeps_the_view(spark, tmp_path, lake):
    curated(spark, tmp_path, lake)
    before = values(read_silver(spark, lake))
    assert compact(spark, lake) == 1
    assert values(read_silver(spark, lake)) == before
    land(str(tmp_path / "landing"), 2, [json.dumps(event(11, 0, 25000.0, revision=3)), json.dumps(event(12, 45, 1.0, event_type="price", unit="EUR/MWh"))])
    start_curation(read_landed(spark, str(tmp_path / "landing")), lake, once=True).awaitTermination(120)
    after = values(read_silver(spark, lake))
    assert after["demand", 0] == (25000.0, 3) and after["price", 45] == (62.3, 1)


def test_bronze_keeps_every_message(spark, tmp_path, lake):
    for number, payloads in enumerate(batches()):
        land(str(tmp_path / "landing"), number, payloads)
    start_bronze(read_landed(spark, str(tmp_path / "landing")), lake, once=True).awaitTermination(120)
    assert spark.read.parquet(lake.bronze).count() == sum(len(b) for b in batches())


def test_replayed_messages_are_dropped_within_the_delay(spark, tmp_path, lake):
    payloads = [json.dumps(event(1, 0, 1.0, unit="kW"))]
    folder = tmp_path / "landing"
    land(str(folder), 0, payloads)
    land(str(folder), 1, payloads)
    raw = read_landed(spark, str(folder), files_per_batch=1)
    start_curation(raw, lake, once=True, deduplicate_within="4 hours").awaitTermination(120)
    assert read_table(spark, lake.dead_letters).count() == 1


def test_backfills_at_the_same_time_keep_their_folders(spark, tmp_path, monkeypatch):
    late = spark.range(1).selectExpr("'a' AS source", "timestamp'2025-01-01 00:00:00' AS interval_start", "0L AS batch_id")
    written = []
    monkeypatch.setattr(lake_module, "read_table", lambda spark, path: late)
    monkeypatch.setattr(lake_module.curate, "backfill_candidates", lambda rows, *_: rows)
    monkeypatch.setattr(lake_module, "write_silver", lambda rows, lake, batch_id: written.append(batch_id))
    # Two runs that both see no finished manifest.
    for source, root in (("a", "one"), ("b", "two")):
        lake_module.run_backfill(spark, Lake(str(tmp_path / root)), source, "2025-01-01", "2025-02-01")
    assert len(set(written)) == 2 and min(written) >= lake_module.BACKFILL_BASE


def test_breach_state_survives_batches(spark, tmp_path):
    folder = tmp_path / "windows"
    os.makedirs(folder)
    schema = "area string, target string, window_start timestamp, champion_error double, reference_error double"

    def add(name, errors, first):
        rows = [
            json.dumps({"area": "ES", "target": "demand", "window_start": (DAY + timedelta(hours=first + i)).isoformat() + "Z",
                        "champion_error": e, "reference_error": 100.0})
            for i, e in enumerate(errors)
        ]
        (folder / name).write_text("\n".join(rows))

    def run():
        query = (
            stream_breaches(spark.readStream.schema(schema).json(str(folder)))
            .writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)

    add("a.json", [125.0, 125.0], 0)
    run()
    add("b.json", [125.0, 90.0, 130.0], 2)
    run()
    got = [(r.consecutive_breaches, r.rollback) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()]
    assert got == [(1, False), (2, False), (3, True), (0, False), (1, False)]


def test_silver_filters_prune_folders(spark, tmp_path, lake):
    curated(spark, tmp_path, lake)
    view = read_silver(spark, lake).filter((F.col("event_type") == "demand") & (F.col("day") == DAY.date()))
    assert view.count() == 2
    plan = view._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "event_type" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0]


def test_a_batch_in_flight_is_neither_read_nor_compacted(spark, tmp_path):
    from voltframe.streaming import lake as lakes

    lake = Lake(str(tmp_path / "lake"))
    row = "business_key string, revision int, ingested_at timestamp, event_id string, event_type string, interval_start timestamp"
    for n in (0, 1):
        df = spark.sql(
            f"SELECT 'k{n}' business_key, 1 revision, timestamp'2025-01-01' ingested_at, 'e{n}' event_id, 'demand' event_type, timestamp'2025-01-01' interval_start"
        )
        assert df.schema.names == [c.split()[0] for c in row.split(", ")]
        lakes.write_silver(df, lake, n)
    marker = tmp_path / "lake" / "silver" / "log" / "batch_id=1" / "_SUCCESS"
    marker.rename(tmp_path / "waiting")
    assert read_silver(spark, lake).count() == 1
    assert compact(spark, lake) == 0
    (tmp_path / "waiting").rename(marker)
    assert sorted(r.business_key for r in read_silver(spark, lake).collect()) == ["k0", "k1"]
