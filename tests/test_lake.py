"""The commit log of silver: order of commits, empty batches, compaction beside a commit, backfills, vacuum."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltframe.operators import curate
from voltframe.streaming import lake as lakes
from voltframe.streaming.lake import Lake, compact, read_log, read_silver, run_backfill, vacuum, write_silver

DAY = datetime(2025, 1, 1)
COLUMNS = "event_id string, source string, event_type string, interval_start timestamp, ingested_at timestamp, value double, revision int, business_key string"


def rows(spark, *events):
    """Winners of a batch from (key, day offset, value, revision)."""
    data = [(f"e-{k}-{v}", "fixture", "demand", DAY + timedelta(days=d), DAY, v, r, k) for k, d, v, r in events]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture
def lake(tmp_path):
    return Lake(str(tmp_path / "lake"))


def view(spark, lake):
    return {r.business_key: (r.value, r.revision) for r in read_silver(spark, lake).collect()}


def late_rows(spark, lake, *events):
    rows(spark, *events).write.mode("overwrite").parquet(f"{lake.late}/batch_id=0")


ARGS = ("fixture", "2025-01-01T00:00:00+00:00", "2025-01-09T00:00:00+00:00")


def test_of_equal_revisions_the_first_commit_stays_also_after_a_backfill(spark, lake):
    write_silver(rows(spark, ("a", 0, 1.0, 1)), lake, 0)
    late_rows(spark, lake, ("k", 0, 22.0, 2), ("a", 0, 9.0, 1))
    run_backfill(spark, lake, *ARGS)
    write_silver(rows(spark, ("k", 0, 33.0, 2), ("a", 0, 5.0, 2)), lake, 1)
    assert view(spark, lake) == {"a": (5.0, 2), "k": (22.0, 2)}
    compact(spark, lake)
    write_silver(rows(spark, ("k", 0, 44.0, 2), ("a", 0, 6.0, 2)), lake, 2)
    assert view(spark, lake) == {"a": (5.0, 2), "k": (22.0, 2)}


def test_a_batch_without_rows_after_a_compaction(spark, lake):
    write_silver(rows(spark, ("a", 0, 1.0, 1)), lake, 0)
    write_silver(rows(spark, ("a", 0, 2.0, 2)), lake, 1)
    assert compact(spark, lake) == 1
    write_silver(rows(spark).limit(0), lake, 2)
    assert view(spark, lake) == {"a": (2.0, 2)}
    assert read_log(spark, lake).has(2) and compact(spark, lake) == 3


def test_a_lake_of_empty_batches(spark, lake):
    assert read_silver(spark, lake) is None and compact(spark, lake) is None
    write_silver(rows(spark).limit(0), lake, 0)
    assert view(spark, lake) == {} and read_silver(spark, lake).columns


def test_a_commit_during_a_compaction_is_kept(spark, lake, monkeypatch):
    for n in (0, 1):
        write_silver(rows(spark, ("a", 0, float(n), n + 1), (f"b{n}", 1, 1.0, 1)), lake, n)
    real = lakes.write_batch

    def slow(df, path, batch_id, partitions):
        real(df, path, batch_id, partitions)
        monkeypatch.setattr(lakes, "write_batch", real)
        write_silver(rows(spark, ("a", 0, 7.0, 2), ("c", 0, 3.0, 1), ("b0", 1, 8.0, 2)), lake, 2)

    monkeypatch.setattr(lakes, "write_batch", slow)
    assert compact(spark, lake) == 1
    assert view(spark, lake) == {"a": (1.0, 2), "b0": (8.0, 2), "b1": (1.0, 1), "c": (3.0, 1)}
    assert compact(spark, lake) == 3
    assert view(spark, lake) == {"a": (1.0, 2), "b0": (8.0, 2), "b1": (1.0, 1), "c": (3.0, 1)}


def test_compaction_rewrites_only_folders_of_several_parts(spark, lake):
    write_silver(rows(spark, ("a", 0, 1.0, 1), ("b", 1, 1.0, 1), ("c", 2, 1.0, 1)), lake, 0)
    write_silver(rows(spark, ("a", 0, 2.0, 2)), lake, 1)
    compact(spark, lake)
    live = read_log(spark, lake).live
    assert [w < 0 for w, _ in live["event_type=demand/day=2025-01-01"]] == [True]
    assert all(live[f"event_type=demand/day=2025-01-0{d}"] == [[0, 0]] for d in (2, 3))
    assert view(spark, lake) == {"a": (2.0, 2), "b": (1.0, 1), "c": (1.0, 1)}


def test_two_backfills_at_once_both_count_and_one_twice_counts_once(spark, lake):
    write_silver(rows(spark, ("a", 0, 1.0, 1)), lake, 0)
    late_rows(spark, lake, ("x", 0, 1.0, 1), ("y", 3, 2.0, 1))
    first = ("fixture", "2025-01-01T00:00:00+00:00", "2025-01-02T00:00:00+00:00")
    second = ("fixture", "2025-01-02T00:00:00+00:00", "2025-01-09T00:00:00+00:00")
    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(run_backfill, spark, lake, *a) for a in (first, second, first)]
        ids = [r.result(120) for r in runs]
    assert ids[0] == ids[2] != ids[1]
    assert view(spark, lake) == {"a": (1.0, 1), "x": (1.0, 1), "y": (2.0, 1)}
    log = read_log(spark, lake)
    assert log.number == 2 and len(log.written) == 2


def test_a_taken_number_makes_the_record_anew(spark, lake):
    seen = []

    def record(log):
        seen.append(log.number)
        if len(seen) == 1:
            lakes.commit(spark, lake, lambda _: {"writer": 5, "schema": rows(spark).schema.json(), "folders": []})
        return {"writer": 6, "schema": rows(spark).schema.json(), "folders": []}

    assert lakes.commit(spark, lake, record) == 1 and seen == [-1, 0]
    assert lakes.commit(spark, lake, lambda log: None) is None
    assert read_log(spark, lake).stream == 6


def test_columns_may_be_added_but_not_change_their_type(spark, lake):
    write_silver(rows(spark, ("a", 0, 1.0, 1)), lake, 0)
    write_silver(rows(spark, ("b", 0, 1.0, 1)).withColumn("note", F.lit("n")), lake, 1)
    assert {r.business_key: r.note for r in read_silver(spark, lake).collect()} == {"a": None, "b": "n"}
    with pytest.raises(ValueError, match="value is stored as double"):
        write_silver(rows(spark, ("c", 0, 1.0, 1)).withColumn("value", F.lit("text")), lake, 2)


def test_vacuum_deletes_what_no_recent_state_reads(spark, lake):
    for n in range(3):
        write_silver(rows(spark, ("a", 0, float(n), n + 1)), lake, n)
    compact(spark, lake)
    assert vacuum(spark, lake, keep=10) == []
    assert vacuum(spark, lake, keep=1) == [0, 1, 2]
    assert view(spark, lake) == {"a": (2.0, 3)}
    rows(spark, ("z", 0, 1.0, 1)).write.parquet(f"{lake.silver_log}/batch_id=77")  # written, not committed
    assert vacuum(spark, lake, keep=0) == [] and view(spark, lake) == {"a": (2.0, 3)}


def test_random_histories_equal_a_sequence_of_merges(spark, lake):
    import random

    rng = random.Random(4)
    state = {}
    for n in range(6):
        batch = [(f"k{i}", i % 2, float(10 * n + i), rng.randint(1, 3)) for i in rng.sample(range(5), rng.randint(0, 4))]
        write_silver(rows(spark, *batch) if batch else rows(spark).limit(0), lake, n)
        for k, _, v, r in batch:
            if k not in state or r > state[k][1]:
                state[k] = (v, r)
        if rng.random() < 0.5:
            compact(spark, lake)
        assert view(spark, lake) == state
    assert json.loads(read_log(spark, lake).schema)["fields"]
    assert curate.silver_view(lakes.silver_log(spark, lake)).count() == len(state)
