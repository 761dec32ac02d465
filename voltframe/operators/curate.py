"""Event curation: parse, validate, route, deduplicate and merge versioned measurements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.functions.hashing import business_key, iso_utc, run_identity
from voltframe.operators.series import latest_by
from voltframe.schemas import (
    DEAD_LETTER_TOPIC,
    EVENT_COLUMNS,
    EVENT_SCHEMA,
    EVENT_TYPES,
    QUALITY_STATUSES,
    SCHEMA_VERSION,
    SILVER_COLUMNS,
    TOPICS,
    UNITS,
)

LATE_AFTER = "INTERVAL 2 HOURS"
REQUIRED = (
    "event_id", "source", "area", "interval_start", "interval_end", "published_at",
    "ingested_at", "unit", "revision", "event_type", "quality_status",
)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def unit_matches(event_type: Column, unit: Column) -> Column:
    choice = F.when(F.lit(False), F.lit(False))
    for name, units in UNITS.items():
        choice = choice.when(event_type == name, unit.isin(*units))
    return choice


def accepted(event: str | None = None) -> Column:
    """True for rows the stream accepts; never null, so its negation is exactly the reject set."""

    def c(name: str) -> Column:
        return F.col(f"{event}.{name}" if event else name)

    ok = _all([c(name).isNotNull() for name in REQUIRED])
    ok &= c("interval_end") > c("interval_start")
    ok &= c("event_type").isin(*EVENT_TYPES) & c("quality_status").isin(*QUALITY_STATUSES)
    ok &= (c("quality_status") != "valid") | c("value").isNotNull()
    ok &= (c("quality_status") != "missing") | c("value").isNull()
    ok &= unit_matches(c("event_type"), c("unit"))
    return F.coalesce(ok, F.lit(False))


def parse_bronze(bronze: DataFrame) -> DataFrame:
    """Add the typed ``event`` struct; unreadable text becomes a struct of nulls and is rejected.

    The one-element explode keeps the optimizer from copying the JSON parser into every condition
    that looks at a field: each message is parsed once.
    """
    return bronze.withColumn("event", F.explode(F.array(F.from_json("raw_payload", EVENT_SCHEMA))))


def dead_letters(parsed: DataFrame, rejected_at: Column | None = None) -> DataFrame:
    return parsed.filter(~accepted("event")).select(
        "topic",
        "partition",
        "offset",
        "raw_payload",
        F.lit("schema_validation").alias("reason"),
        (F.current_timestamp() if rejected_at is None else rejected_at).alias("rejected_at"),
    )


def valid_events(parsed: DataFrame) -> DataFrame:
    events = parsed.filter(accepted("event")).select(
        *[F.col(f"event.{c}").alias(c) for c in SILVER_COLUMNS]
    )
    return events.select(business_key().alias("business_key"), "*")


def is_late(after: str = LATE_AFTER) -> Column:
    """Arrival-lag rule: ingested more than two hours after the interval ended."""
    return F.col("ingested_at") > F.col("interval_end") + F.expr(after)


def late_events(valid: DataFrame, after: str = LATE_AFTER) -> DataFrame:
    return valid.filter(is_late(after))


def on_time_events(valid: DataFrame, after: str = LATE_AFTER) -> DataFrame:
    """Distinct on-time rows: one filter and one aggregation instead of a set difference."""
    return valid.filter(~is_late(after)).distinct()


def batch_winners(valid: DataFrame, keys: Sequence[str] = ("business_key",)) -> DataFrame:
    """One row per business key: highest revision, then latest arrival, then greatest id."""
    return latest_by(valid, keys, [F.col("revision"), F.col("ingested_at"), F.col("event_id")])


def silver_view(log: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Current state of an append-only log of batch winners.

    Same answer as "update only when strictly newer": the highest revision wins, and among equal
    revisions the batch stored first. Event type and day follow from the key; grouping by them too
    lets a filter on either prune the stored folders.
    """
    folders = [c for c in ("event_type", "day") if c in log.columns]
    order = [F.col("revision"), -F.col(batch), F.col("ingested_at"), F.col("event_id")]
    return latest_by(log, ["business_key", *folders], order)


def fold_batches(valid: DataFrame, batch: str = "batch_id") -> DataFrame:
    """State after a sequence of batches, in one aggregation: it orders rows as batch winners and silver view would in turn."""
    return silver_view(valid, batch)


def merge_latest(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored rows merged with one incoming batch: update if strictly newer, insert if absent."""
    log = stored.withColumn("batch_id", F.lit(0)).unionByName(
        batch_winners(incoming).withColumn("batch_id", F.lit(1))
    )
    return silver_view(log).drop("batch_id")


def in_backfill(source: str, start: Column, end: Column) -> Column:
    """Rows of one source whose interval starts in ``[start, end)``."""
    at = F.col("interval_start")
    return (F.col("source") == source) & (at >= start) & (at < end)


def backfill_candidates(late: DataFrame, source: str, start: Column, end: Column) -> DataFrame:
    """Late rows of a backfill request, deduplicated before they are merged."""
    return batch_winners(late.filter(in_backfill(source, start, end)))


def backfill_run_id(source: str, start: str, end: str) -> tuple[Column, Column]:
    """(run id, input checksum) of a backfill request."""
    checksum = run_identity(F.lit(source), F.lit(start), F.lit(end))
    return F.substring(checksum, 1, 16), checksum


def backfill_manifest(
    late: DataFrame, manifests: DataFrame | None, source: str, start: str, end: str, completed_at: Column
) -> DataFrame:
    """Manifest row of a backfill; empty when the same run is already recorded."""
    run_id, checksum = backfill_run_id(source, start, end)
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    chosen = late.filter(in_backfill(source, lo, hi))
    row = chosen.agg(F.count(F.lit(1)).alias("record_count")).select(
        run_id.alias("run_id"),
        F.lit(source).alias("source"),
        lo.alias("start_time"),
        hi.alias("end_time"),
        checksum.alias("input_checksum"),
        "record_count",
        completed_at.alias("completed_at"),
    )
    return row if manifests is None else row.join(manifests, "run_id", "left_anti")


def file_backfill_identity(events: DataFrame, payload_checksum: Column) -> DataFrame:
    """Identity of a file backfill: checksum plus covered time range."""
    covered = events.agg(
        F.min("interval_start").alias("start_time"),
        F.max("interval_end").alias("end_time"),
        F.count(F.lit(1)).alias("record_count"),
    )
    identity = run_identity(payload_checksum, iso_utc(F.col("start_time")), iso_utc(F.col("end_time")))
    return covered.withColumn("run_id", F.substring(identity, 1, 16))


def contract_violations(df: DataFrame, raw: str | None = None) -> DataFrame:
    """Strict contract: every violated rule by name (empty array = conforming).

    ``raw`` names the JSON text column when unknown top-level fields must be rejected too.
    """
    c = F.col
    rules = {
        "schema_version": c("schema_version") != SCHEMA_VERSION,
        "event_type": ~c("event_type").isin(*EVENT_TYPES),
        "quality_status": ~c("quality_status").isin(*QUALITY_STATUSES),
        "interval_order": c("interval_end") <= c("interval_start"),
        "unit": ~unit_matches(c("event_type"), c("unit")),
        "missing_with_value": (c("quality_status") == "missing") & c("value").isNotNull(),
        "valid_without_value": (c("quality_status") == "valid") & c("value").isNull(),
        "revision": c("revision") < 1,
    }
    checks = [F.when(rule, F.lit(name)) for name, rule in rules.items()]
    checks += [F.when(c(name).isNull(), F.lit(f"null_{name}")) for name in REQUIRED]
    if raw:
        known = F.array(*[F.lit(name) for name in EVENT_COLUMNS])
        extra = F.array_except(F.json_object_keys(raw), known)
        checks.append(F.when(F.size(extra) > 0, F.lit("unknown_field")))
        for name in ("interval_start", "interval_end", "published_at", "ingested_at"):
            text = F.get_json_object(raw, f"$.{name}")
            checks.append(F.when(~text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.lit(f"naive_{name}")))
    return df.withColumn("violations", F.array_compact(F.array(*checks)))


def to_messages(events: DataFrame) -> DataFrame:
    """Keyed messages for publishing: topic by event type, key = business key, JSON value."""
    topics = F.create_map(*[F.lit(x) for item in TOPICS.items() for x in item])
    columns = [c for c in EVENT_COLUMNS if c in events.columns]
    return events.select(
        F.coalesce(F.try_element_at(topics, "event_type"), F.lit(DEAD_LETTER_TOPIC)).alias("topic"),
        business_key().alias("key"),
        F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"}).alias("value"),
    )


def from_messages(messages: DataFrame) -> DataFrame:
    return messages.select(F.from_json("value", EVENT_SCHEMA).alias("event")).select("event.*")
