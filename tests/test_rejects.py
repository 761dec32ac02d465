"""Documents and lines that are refused with a reason, segments between holes, and the digest tree of a snapshot."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltframe.operators import features, monitoring
from voltframe.sources import payloads

EVENT = {
    "schema_version": "1.0", "event_id": "e", "source": "s", "event_type": "demand", "area": "ES", "interval_start": "2025-01-01T00:00:00+00:00",
    "interval_end": "2025-01-01T00:15:00+00:00", "published_at": "2025-01-01T00:15:00+00:00", "ingested_at": "2025-01-01T00:16:00+00:00",
    "value": 1.0, "unit": "MW", "revision": 1, "quality_status": "valid",
}


def test_bad_lines_are_named_by_file_and_number_however_files_are_split(spark, tmp_path):
    want = {}
    for f in range(2):
        lines = []
        for i in range(1, 401):
            event = EVENT | {"event_id": f"{f}-{i}"}
            if i % 97 == 0:
                event["unit"] = "kW"
                want[f"f{f}.jsonl", i] = ["unit"]
            if i % 131 == 0:
                event["extra"] = 1
                want[f"f{f}.jsonl", i] = ["unknown_field"]
            lines.append("" if i % 50 == 0 else "{broken" if i % 211 == 0 else json.dumps(event))
            if i % 211 == 0:
                want[f"f{f}.jsonl", i] = ["malformed"]
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("4096", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            numbered = payloads.numbered_lines(spark, str(tmp_path)).groupBy("file").agg(F.collect_set("line").alias("l")).collect()
            assert [sorted(r.l) for r in numbered] == [list(range(1, 401))] * 2
            bad = {(r.file.rsplit("/", 1)[1], r.line): r.violations for r in payloads.rejected_event_lines(spark, str(tmp_path)).collect()}
            assert bad == want
            with pytest.raises(ValueError, match=r"f0.jsonl, line 97: unit"):
                payloads.strict_event_lines(spark, str(tmp_path))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    good = tmp_path / "good"
    good.mkdir()
    (good / "a.jsonl").write_text("\n" + json.dumps(EVENT) + "\n\n" + json.dumps(EVENT | {"event_id": "z"}))
    assert [r.event_id for r in payloads.strict_event_lines(spark, str(good)).orderBy("event_id").collect()] == ["e", "z"]


XML = (
    "<GL_MarketDocument><TimeSeries><Period><timeInterval><start>2025-01-01T00:00Z</start><end>2025-01-01T01:00Z</end></timeInterval>"
    "<resolution>{0}</resolution><Point><position>1</position><quantity>{1}</quantity></Point></Period></TimeSeries></GL_MarketDocument>"
)


def test_documents_without_points_are_reported(spark):
    docs = [("ok", XML.format("PT15M", 5)), ("cut", XML.format("PT15M", 5)[:-30]), ("none", None), ("blank", " "), ("ack", "<Acknowledgement><reason>x</reason></Acknowledgement>"),
            ("res", XML.format("P1Y", 5)), ("value", XML.format("PT15M", ""))]
    df = spark.createDataFrame(docs, "name string, payload string")
    got = {r.name: r.reason for r in payloads.market_rejects(df).collect()}
    assert got == {"cut": "malformed", "none": "empty", "blank": "empty", "ack": "without_series", "res": "no_usable_point", "value": "no_usable_point"}
    used = {r.name for r in payloads.market_points(df).collect()}
    assert used == {"ok"} and not used & got.keys()


def test_station_documents_that_add_nothing_are_reported(spark):
    good = json.dumps({"hourly": {"time": ["2025-01-01T00:00"], "temperature_2m": [1.0]}})
    rows = [("madrid", good), ("oslo", good), ("bilbao", "{"), ("seville", None), ("valencia", json.dumps({"hourly": {"time": []}})), ("barcelona", "{}")]
    got = {r.station: r.reason for r in payloads.station_rejects(spark.createDataFrame(rows, "station string, payload string")).collect()}
    assert got == {"oslo": "unknown_station", "bilbao": "malformed", "seville": "malformed", "valencia": "without_hours", "barcelona": "without_hours"}


def holed(spark):
    """60 days of hours with a hole of 30 hours after 35 days; the part after the hole alone."""
    rng = np.random.default_rng(1)
    n = 24 * 60
    pdf = pd.DataFrame({"area": "ES", "valid_time": [datetime(2025, 1, 1) + timedelta(hours=i) for i in range(n)], "value": rng.normal(100, 5, n)})
    kept = pdf[(pdf.index < 24 * 35) | (pdf.index >= 24 * 35 + 30)]
    return spark.createDataFrame(kept), spark.createDataFrame(kept[kept.index >= 24 * 35])


def test_features_never_reach_over_a_hole(spark):
    whole, after = holed(spark)
    make = lambda df, rows: features.history_features(df, keys=["area"], steps_per_day=24, lead=24, rows_per_chunk=rows, segments=True).orderBy("valid_time").toPandas()
    results = [make(whole, rows) for rows in (None, 500, 3000)]
    for other in results[1:]:
        pd.testing.assert_frame_equal(results[0], other, rtol=1e-9)
    alone = make(after, None)
    pd.testing.assert_frame_equal(results[0].tail(len(alone)).reset_index(drop=True), alone, rtol=1e-9)
    rows = features.horizon_features(whole, keys=["area"], lead=24, steps_per_day=24)
    late = rows.filter(F.col("valid_time") >= datetime(2025, 1, 1) + timedelta(days=35)).agg(F.min("valid_time")).first()[0]
    assert late >= datetime(2025, 1, 1) + timedelta(days=35, hours=30) + timedelta(days=14)


def test_irregular_series_can_be_refused(spark):
    whole, after = holed(spark)
    with pytest.raises(ValueError, match="regular"):
        features.horizon_features(whole, keys=["area"], lead=24, steps_per_day=24, refuse_irregular=True)
    assert features.horizon_features(after, keys=["area"], lead=24, steps_per_day=24, refuse_irregular=True).count() > 0
    with pytest.raises(Exception, match="two rows of a series at one time"):
        features.horizon_features(after.unionByName(after.limit(1)), keys=["area"], lead=24, steps_per_day=24).count()


def test_digest_tree_follows_the_set_of_checksums_and_can_be_updated(spark):
    sums = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    rows = [(k, s) for k, n in (("a", 300), ("b", 20)) for s in sums[:n]]
    df = spark.createDataFrame([*rows, ("a", sums[3]), ("a", None), ("a", "")], "k string, payload_checksum string")
    for prefix in (1, 2, 3, 4):
        leaves = monitoring.snapshot_leaves(df, keys=["k"], prefix=prefix)
        root = {r.k: (r.snapshot_id, r.checksums) for r in monitoring.snapshot_root(leaves, keys=["k"], prefix=prefix).collect()}
        for key, n in (("a", 300), ("b", 20)):
            nodes = {}
            for s in sorted(sums[:n]):
                nodes.setdefault(s[:prefix], []).append(s)
            nodes = {name: hashlib.sha256("|".join(own).encode()).hexdigest() for name, own in nodes.items()}
            for length in range((prefix - 1) // 2 * 2, -1, -2):
                up = {}
                for name in sorted(nodes):
                    up.setdefault(name[:length], []).append(f"{name}:{nodes[name]}")
                nodes = {name: hashlib.sha256("|".join(own).encode()).hexdigest() for name, own in up.items()}
            assert root[key] == ("tree-" + nodes[""][:20], n)
    old, new = df.filter(F.col("payload_checksum") != sums[7]), spark.createDataFrame([("a", sums[7]), ("c", sums[1])], df.schema)
    updated = monitoring.update_leaves(monitoring.snapshot_leaves(old, keys=["k"]), old, new, keys=["k"])
    want = monitoring.snapshot_leaves(old.unionByName(new), keys=["k"])
    assert sorted(map(tuple, updated.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in want._jdf.queryExecution().executedPlan().toString()
