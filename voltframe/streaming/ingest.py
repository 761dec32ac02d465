"""Streaming ingest: raw envelopes to bronze, and curation of each micro-batch into silver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltframe.operators import curate
from voltframe.sources.connectors import bronze_columns
from voltframe.streaming.lake import Lake, by_day, merge_statement, write_batch, write_silver


def start_bronze(raw: DataFrame, lake: Lake, *, once: bool = False) -> StreamingQuery:
    """Append every message as received, partitioned by day; the file sink commits exactly once."""
    bronze = by_day(bronze_columns(raw), "kafka_timestamp", "day")
    writer = (
        bronze.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("day")
        .option("path", lake.bronze)
        .option("checkpointLocation", lake.checkpoint("bronze"))
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def curator(lake: Lake, merge_into: str | None = None) -> Callable[[DataFrame, int], None]:
    """Micro-batch function: rejects, late rows and on-time winners from one cached parse."""

    def curate_batch(batch: DataFrame, batch_id: int) -> None:
        parsed = curate.parse_bronze(batch).persist()
        try:
            rejected_at = F.col("ingested_at")
            dead = curate.dead_letters(parsed, rejected_at)
            write_batch(by_day(dead, "rejected_at", "day"), lake.dead_letters, batch_id, ["day"])
            valid = curate.valid_events(parsed)
            write_batch(curate.late_events(valid), lake.late, batch_id, [])
            winners = curate.batch_winners(valid.filter(~curate.is_late()))
            if merge_into:
                winners.createOrReplaceTempView("incoming_winners")
                batch.sparkSession.sql(merge_statement(merge_into, "incoming_winners"))
            else:
                write_silver(winners, lake, batch_id)
        finally:
            parsed.unpersist()

    return curate_batch


def start_curation(
    raw: DataFrame, lake: Lake, *, merge_into: str | None = None, once: bool = False,
    deduplicate_within: str | None = None,
) -> StreamingQuery:
    """Curate a raw stream. Lateness is an arrival rule on the data, not a stream watermark.

    ``deduplicate_within`` drops replays of the same message seen within that delay; the state it
    keeps is bounded by the delay and holds a digest per message, whatever its length.
    """
    bronze = bronze_columns(raw)
    if deduplicate_within:
        message = F.to_json(F.struct("topic", "key", "raw_payload"))
        digested = bronze.withColumn("_message", F.sha2(message, 256)).withWatermark("kafka_timestamp", deduplicate_within)
        bronze = digested.dropDuplicatesWithinWatermark(["_message"]).drop("_message")
    writer = bronze.writeStream.foreachBatch(curator(lake, merge_into)).option(
        "checkpointLocation", lake.checkpoint("silver")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
