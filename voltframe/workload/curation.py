"""Queries over event curation, publishing, backfills and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltframe.operators import curate, monitoring
from voltframe.workload.registry import register
from voltframe.workload.tables import ACCEPTED, NOW, TYPED, VALID

EVENT_OUT = """business_key, event_id, source, event_type, area, interval_start, interval_end, published_at,
  ingested_at, value, unit, revision, quality_status, dimension, payload_checksum"""
LATE = "ingested_at > interval_end + INTERVAL 2 HOUR"
BACKFILL = ("src1", "2024-01-08T00:00:00+00:00", "2024-01-22T00:00:00+00:00")


def valid(t) -> DataFrame:
    return curate.valid_events(curate.parse_bronze(t.bronze))


def out(df: DataFrame) -> DataFrame:
    return df.select(*[c.strip() for c in EVENT_OUT.replace("\n", " ").split(",")])


@register("valid_events", f"WITH {VALID} SELECT {EVENT_OUT} FROM valid")
def valid_events(t):
    """JSON parse, acceptance rules and business key."""
    return out(valid(t))


@register(
    "dead_letter",
    f"""WITH {TYPED} SELECT topic, CAST(eid % 4 AS INTEGER) AS partition, eid AS "offset",
      'schema_validation' AS reason, CAST('{NOW}' AS TIMESTAMP) AS rejected_at
    FROM typed WHERE NOT coalesce({ACCEPTED}, FALSE)""",
)
def dead_letter(t):
    """Everything the acceptance rules do not take, including rows with null type or quality."""
    return curate.dead_letters(curate.parse_bronze(t.bronze), t.now).drop("raw_payload")


@register("late_events", f"WITH {VALID} SELECT {EVENT_OUT} FROM valid WHERE {LATE}")
def late_events(t):
    return out(curate.late_events(valid(t)))


@register("on_time_events", f"WITH {VALID} SELECT DISTINCT {EVENT_OUT} FROM valid WHERE NOT ({LATE})")
def on_time_events(t):
    return out(curate.on_time_events(valid(t)))


CONTRACT_SQL = f"""WITH {TYPED},
judged AS (SELECT eid, list_filter([
  CASE WHEN event_type NOT IN ('demand', 'generation', 'price', 'weather') THEN 'event_type' END,
  CASE WHEN (event_type IN ('demand', 'generation') AND unit <> 'MW') OR (event_type = 'price' AND unit <> 'EUR/MWh')
    OR (event_type = 'weather' AND unit NOT IN ('degC', 'm/s', '%', 'W/m2')) THEN 'unit' END,
  CASE WHEN revision < 1 THEN 'revision' END,
  CASE WHEN event_id IS NULL THEN 'null_event_id' END,
  CASE WHEN quality_status IS NULL THEN 'null_quality_status' END,
  CASE WHEN eid % 53 = 9 THEN 'unknown_field' END,
  CASE WHEN eid % 59 = 4 THEN 'naive_published_at' END], lambda x : x IS NOT NULL) AS v
  FROM typed WHERE eid % 101 <> 11
  UNION ALL SELECT eid, ['null_event_id', 'null_source', 'null_area', 'null_interval_start', 'null_interval_end',
    'null_published_at', 'null_ingested_at', 'null_unit', 'null_revision', 'null_event_type', 'null_quality_status']
  FROM typed WHERE eid % 101 = 11)
SELECT eid AS "offset", array_to_string(v, ',') AS violations FROM judged"""


@register("contract_violations", CONTRACT_SQL)
def contract_violations(t):
    """Strict contract: every violated rule per message."""
    parsed = curate.parse_bronze(t.bronze).select("offset", "raw_payload", "event.*")
    judged = curate.contract_violations(parsed, raw="raw_payload")
    return judged.select("offset", F.array_join("violations", ",").alias("violations"))


FOLDED = f"""{VALID},
on_time AS (SELECT *, CAST(date_diff('day', TIMESTAMP '1970-01-01', date_trunc('day', ingested_at)) AS INTEGER) AS batch_id
  FROM valid WHERE NOT ({LATE})),
winners AS (SELECT * FROM on_time QUALIFY row_number() OVER (PARTITION BY business_key, batch_id
  ORDER BY revision DESC, ingested_at DESC, event_id DESC) = 1)"""


def daily_batches(t) -> DataFrame:
    """On-time rows numbered by arrival day. Exact copies need no removal: one winner remains."""
    day = F.unix_date(F.to_date("ingested_at"))
    return valid(t).withColumn("batch_id", F.when(~curate.is_late(), day))


@register(
    "merge_latest",
    f"""WITH {FOLDED} SELECT {EVENT_OUT}, batch_id FROM winners QUALIFY row_number() OVER (PARTITION BY business_key
      ORDER BY revision DESC, batch_id, ingested_at DESC, event_id DESC) = 1""",
)
def merge_latest(t):
    """Silver state after daily batches: newer revisions replace, ties keep the stored row."""
    merged = curate.fold_batches(daily_batches(t).filter(F.col("batch_id").isNotNull()))
    return merged.select(*out(merged).columns, "batch_id")


@register(
    "backfill_merge",
    f"""WITH {FOLDED},
    late AS (SELECT * FROM valid WHERE {LATE} AND source = '{BACKFILL[0]}'
      AND interval_start >= TIMESTAMP '2024-01-08' AND interval_start < TIMESTAMP '2024-01-22'),
    log AS (SELECT {EVENT_OUT}, batch_id FROM winners UNION ALL
      SELECT {EVENT_OUT}, 1000000 AS batch_id FROM late QUALIFY row_number() OVER (PARTITION BY business_key
        ORDER BY revision DESC, ingested_at DESC, event_id DESC) = 1)
    SELECT {EVENT_OUT} FROM log QUALIFY row_number() OVER (PARTITION BY business_key
      ORDER BY revision DESC, batch_id, ingested_at DESC, event_id DESC) = 1""",
)
def backfill_merge(t):
    """Silver state after a bounded backfill of late rows is appended as one more batch."""
    source, start, end = BACKFILL
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    chosen = curate.is_late() & curate.in_backfill(source, lo, hi)
    batched = daily_batches(t).withColumn("batch_id", F.when(chosen, 1_000_000).otherwise(F.col("batch_id")))
    return out(curate.fold_batches(batched.filter(F.col("batch_id").isNotNull())))


@register(
    "backfill_manifest",
    f"""WITH {VALID} SELECT substr(sha256('{"|".join(BACKFILL)}'), 1, 16) AS run_id, '{BACKFILL[0]}' AS source,
      TIMESTAMP '2024-01-08' AS start_time, TIMESTAMP '2024-01-22' AS end_time,
      sha256('{"|".join(BACKFILL)}') AS input_checksum, count(*) AS record_count,
      CAST('{NOW}' AS TIMESTAMP) AS completed_at
    FROM valid WHERE {LATE} AND source = '{BACKFILL[0]}' AND interval_start >= TIMESTAMP '2024-01-08'
      AND interval_start < TIMESTAMP '2024-01-22'""",
)
def backfill_manifest(t):
    return curate.backfill_manifest(curate.late_events(valid(t)), None, *BACKFILL, t.now)


@register(
    "file_backfill_identity",
    f"""WITH {VALID}, covered AS (SELECT min(interval_start) AS start_time, max(interval_end) AS end_time,
      count(*) AS record_count FROM valid)
    SELECT start_time, end_time, record_count, substr(sha256('file-checksum|' ||
      strftime(start_time, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || strftime(end_time, '%Y-%m-%dT%H:%M:%S') || '+00:00'),
      1, 16) AS run_id FROM covered""",
)
def file_backfill_identity(t):
    return curate.file_backfill_identity(valid(t), F.lit("file-checksum"))


@register("topic_route", f"WITH {VALID} SELECT topic, business_key AS key, event_id, value, revision FROM valid")
def topic_route(t):
    """Keyed messages per topic, encoded to JSON and decoded again."""
    messages = curate.to_messages(valid(t))
    decoded = messages.select("topic", "key", F.from_json("value", "event_id string, value double, revision int").alias("e"))
    return decoded.select("topic", "key", "e.event_id", "e.value", "e.revision")


@register(
    "ops_counters",
    f"""WITH {VALID}
    SELECT 'events_published' AS metric, topic AS label, count(*) AS n FROM valid GROUP BY ALL
    UNION ALL SELECT 'late_events', source, count(*) FROM valid WHERE {LATE} GROUP BY ALL
    UNION ALL SELECT 'dead_letter_events', 'schema_validation', count(*) FROM typed WHERE NOT coalesce({ACCEPTED}, FALSE)""",
)
def ops_counters(t):
    return monitoring.ops_counters(curate.parse_bronze(t.bronze))


@register(
    "source_freshness",
    f"""WITH {VALID}, newest AS (SELECT source, max(ingested_at) AS newest FROM valid GROUP BY 1)
    SELECT source, newest, CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(newest)) AS BIGINT) AS age_seconds,
      epoch(TIMESTAMP '{NOW}') - floor(epoch(newest)) > 1800 AS is_stale FROM newest""",
)
def source_freshness(t):
    return monitoring.source_freshness(valid(t), t.now)


@register(
    "snapshot_id",
    f"""WITH {VALID}, sums AS (SELECT DISTINCT area, event_type, payload_checksum FROM valid)
    SELECT area, event_type, 'live-' || substr(sha256(string_agg(payload_checksum, '|' ORDER BY payload_checksum)), 1, 20)
      AS snapshot_id, count(*) AS checksums FROM sums GROUP BY 1, 2""",
)
def snapshot_id(t):
    return monitoring.snapshot_id(valid(t), keys=["area", "event_type"])


@register(
    "snapshot_tree",
    f"""WITH {VALID}, sums AS (SELECT DISTINCT area, event_type, payload_checksum AS s FROM valid),
    leaves AS (SELECT area, event_type, substr(s, 1, 2) AS leaf, sha256(string_agg(s, '|' ORDER BY s)) AS digest, count(*) AS n FROM sums GROUP BY 1, 2, 3)
    SELECT area, event_type, 'tree-' || substr(sha256(string_agg(leaf || ':' || digest, '|' ORDER BY leaf)), 1, 20) AS snapshot_id,
      CAST(sum(n) AS BIGINT) AS checksums FROM leaves GROUP BY 1, 2""",
)
def snapshot_tree(t):
    """Snapshot identity as the root of a digest tree, of which a new payload renews one leaf."""
    keys = ["area", "event_type"]
    return monitoring.snapshot_root(monitoring.snapshot_leaves(valid(t), keys=keys, prefix=2), keys=keys, prefix=2)
