"""Lake folders written by the streaming jobs, and how they are read.

Without a table format there is no MERGE. Silver is a set of folders of batch winners, a log of numbered commit records that says
which folders count and in which order they were stored, and a view that picks the winning revision per business key. A writer first
writes its folder, named after its own number, and then commits it; whoever has committed once is skipped when retried. Stream
batches, backfills and compactions share one sequence of commit numbers, so of equal revisions the one committed first stays.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltframe.operators import curate
from voltframe.operators.forecasts import upsert_by_natural_key
from voltframe.schemas import FORECAST_SCHEMA, MANIFEST_SCHEMA
from voltframe.session import durable
from voltframe.storage import delete, matching, read_text, rename_new, write_text

# Writer numbers: stream batches count from 0, backfills have a number from their run id above this base, compactions negative ones.
BACKFILL_BASE = 10**12
FOLDERS = ("event_type", "day")


@dataclass(frozen=True)
class Lake:
    root: str

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    @property
    def bronze(self) -> str:
        return self.path("bronze", "events")

    @property
    def silver_log(self) -> str:
        return self.path("silver", "log")

    @property
    def commits(self) -> str:
        return self.path("silver", "commits")

    @property
    def late(self) -> str:
        return self.path("silver", "late_events")

    @property
    def dead_letters(self) -> str:
        return self.path("silver", "dead_letter_events")

    @property
    def manifests(self) -> str:
        return self.path("gold", "backfill_manifests")

    @property
    def forecasts(self) -> str:
        return self.path("gold", "forecasts")

    def checkpoint(self, name: str) -> str:
        return self.path("_checkpoints", name)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A partitioned Parquet folder, or ``None`` while no rows have been written."""
    if not matching(spark, f"{path}/*"):
        return None
    try:
        return spark.read.option("mergeSchema", "false").parquet(path)
    except AnalysisException as empty:
        if empty.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def write_batch(df: DataFrame, path: str, batch_id: int, partitions: list[str]) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(f"{path}/batch_id={batch_id}")


def by_day(df: DataFrame, ts: str, name: str) -> DataFrame:
    return df.withColumn(name, F.to_date(ts))


@dataclass
class Log:
    """What the commit records add up to.

    ``live`` maps a folder ``event_type=.../day=...`` to the (part, rank) pairs that hold its rows; the rank is the number of the
    commit, for a compacted part that of the last commit it contains. ``written`` are the writers seen, of stream batches all up to
    ``stream``.
    """

    number: int = -1
    live: dict[str, list[list[int]]] = field(default_factory=dict)
    schema: str | None = None
    stream: int = -1
    written: set[int] = field(default_factory=set)

    def has(self, writer: int) -> bool:
        return writer in self.written or 0 <= writer <= self.stream

    def add(self, record: dict[str, Any]) -> None:
        """Apply the next record."""
        if "state" in record:
            state = record["state"]
            self.live, self.schema, self.stream = state["live"], state["schema"], state["stream"]
            self.written = set(state["written"])
        else:
            self.schema = _merged(self.schema, record["schema"])
            writer, part, rank = record["writer"], record.get("part", record["writer"]), record["number"]
            if 0 <= writer < BACKFILL_BASE:
                self.stream = max(self.stream, writer)
            else:
                self.written.add(writer)
            for folder in record["folders"]:
                self.live.setdefault(folder, []).append([part, rank])
        self.number = record["number"]

    def replaced(self, writer: int, upto: int, folders: list[str]) -> dict[str, Any]:
        """The state once the parts up to a commit in these folders give way to one compacted part."""
        live = dict(self.live)
        for folder in folders:
            live[folder] = [[writer, upto], *(part for part in live[folder] if part[1] > upto)]
        return {"live": live, "schema": self.schema, "stream": self.stream, "written": sorted(self.written)}


def _merged(old: str | None, new: str) -> str:
    """Stored schema after a commit: columns may be added, not change their type."""
    if old is None or old == new:
        return new
    fields = {f.name: f for f in T.StructType.fromJson(json.loads(old))}
    for f in T.StructType.fromJson(json.loads(new)):
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"column {f.name} is stored as {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    return T.StructType(list(fields.values())).json()


def read_log(spark: SparkSession, lake: Lake) -> Log:
    """All commits, read from the newest record that holds a whole state."""
    names = sorted(matching(spark, f"{lake.commits}/*.json"))
    records: list[dict[str, Any]] = []
    for name in reversed(names):
        records.append(json.loads(read_text(spark, name)))
        if "state" in records[-1]:
            break
    log = Log()
    for record in reversed(records):
        log.add(record)
    return log


def commit(spark: SparkSession, lake: Lake, record: Callable[[Log], dict[str, Any] | None]) -> int | None:
    """Store the next commit record; its number, or ``None`` if ``record`` (given the log so far) declines.

    A record is written aside and renamed to its number. The rename fails if somebody else has taken that number; then the
    record is made anew from the longer log.
    """
    while True:
        log = read_log(spark, lake)
        body = record(log)
        if body is None:
            return None
        number, aside = log.number + 1, f"{lake.commits}/.{uuid.uuid4().hex}"
        write_text(spark, aside, json.dumps(body | {"number": number}))
        if rename_new(spark, aside, f"{lake.commits}/{number:020d}.json"):
            return number
        delete(spark, aside)


def _folders(spark: SparkSession, lake: Lake, writer: int) -> list[str]:
    base = f"{lake.silver_log}/batch_id={writer}"
    return sorted(p.split(f"batch_id={writer}/")[1] for p in matching(spark, f"{base}/event_type=*/day=*"))


def write_silver(winners: DataFrame, lake: Lake, batch_id: int) -> None:
    """Winners land in (event_type, day) folders and are committed; a business key never leaves its folder.

    Rebalancing gathers each folder into few files and still splits a hot one. A writer that has committed before is skipped. There is
    one stream, so its batch numbers name their parts; a backfill may run twice at once, so each attempt has a part of its own and
    the one that commits first counts.
    """
    spark = winners.sparkSession
    if read_log(spark, lake).has(batch_id):
        return
    part = batch_id if batch_id < BACKFILL_BASE else BACKFILL_BASE + (uuid.uuid4().int >> 66)
    rows = by_day(winners, "interval_start", "day").hint("rebalance", *FOLDERS)
    write_batch(rows, lake.silver_log, part, list(FOLDERS))
    schema = T.StructType([f for f in rows.schema if f.name not in FOLDERS]).json()
    folders = _folders(spark, lake, part)

    def record(log: Log) -> dict[str, Any] | None:
        _merged(log.schema, schema)  # refuses a column of another type before anything counts
        return None if log.has(batch_id) else {"writer": batch_id, "part": part, "schema": schema, "folders": folders}

    if commit(spark, lake, record) is None and part != batch_id:
        delete(spark, f"{lake.silver_log}/batch_id={part}")


def _complete(spark: SparkSession, lake: Lake) -> set[int]:
    """Parts whose folder carries its success marker."""
    marked = matching(spark, f"{lake.silver_log}/batch_id=*/_SUCCESS")
    return {int(p.split("batch_id=")[1].split("/")[0]) for p in marked}


def _read_parts(spark: SparkSession, lake: Lake, log: Log, live: dict[str, list[list[int]]]) -> DataFrame:
    """Rows of the live parts by the stored schema; ``batch_id`` is the rank of their commit."""
    fields = [*T.StructType.fromJson(json.loads(log.schema)), T.StructField("batch_id", T.LongType())]
    schema = T.StructType([*fields, T.StructField("event_type", T.StringType()), T.StructField("day", T.DateType())])
    paths = sorted({f"{lake.silver_log}/batch_id={writer}/{folder}" for folder, parts in live.items() for writer, _ in parts})
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", lake.silver_log).parquet(*paths)
    ranks = sorted({(writer, rank) for parts in live.values() for writer, rank in parts})
    order = spark.createDataFrame(ranks, "batch_id long, _rank long")
    # One row per commit since the folders were compacted, read from the log by the driver.
    ranked = rows.join(F.broadcast(order), "batch_id")
    return ranked.withColumn("batch_id", F.col("_rank")).drop("_rank").select(*schema.names)


def silver_log(spark: SparkSession, lake: Lake) -> DataFrame | None:
    """All stored winners in their committed parts; ``None`` before the first commit."""
    log = read_log(spark, lake)
    if log.number < 0:
        return None
    done = _complete(spark, lake)
    live = {folder: [p for p in parts if p[0] in done] for folder, parts in log.live.items()}
    return _read_parts(spark, lake, log, live)


def read_silver(spark: SparkSession, lake: Lake) -> DataFrame | None:
    log = silver_log(spark, lake)
    return None if log is None else curate.silver_view(log)


def compact(spark: SparkSession, lake: Lake) -> int | None:
    """Rewrite the folders that several commits have touched into one part each; the last commit it covers.

    Other folders stay as they are. Commits that land meanwhile have higher numbers and stay beside the compacted parts. The record
    also holds the whole state, so that readers need no older ones.
    """
    log = read_log(spark, lake)
    done = _complete(spark, lake)
    waiting = [rank for parts in log.live.values() for writer, rank in parts if writer not in done]
    upto = min([*(rank - 1 for rank in waiting), log.number])
    if upto < 0:
        return None
    covered = {folder: [p for p in parts if p[1] <= upto] for folder, parts in log.live.items()}
    crowded = {folder: parts for folder, parts in covered.items() if len(parts) > 1}
    if crowded:
        writer = -(uuid.uuid4().int >> 66) - 1
        state = curate.silver_view(_read_parts(spark, lake, log, crowded)).drop("batch_id")
        write_batch(state.hint("rebalance", *FOLDERS), lake.silver_log, writer, list(FOLDERS))
        commit(spark, lake, lambda now: {"writer": writer, "state": now.replaced(writer, upto, sorted(crowded))})
    return upto


def vacuum(spark: SparkSession, lake: Lake, *, keep: int = 10) -> list[int]:
    """Delete committed parts that no state since the last ``keep`` commits reads; their numbers.

    Readers that began before those commits must have ended. Parts that were never committed are left to their writers.
    """
    log = read_log(spark, lake)
    names = sorted(matching(spark, f"{lake.commits}/*.json"))
    records = [json.loads(row.value) for row in spark.read.text(names, wholetext=True).collect()] if names else []
    records.sort(key=lambda record: record["number"])
    committed = {record.get("part", record["writer"]) for record in records}
    used = {part for parts in log.live.values() for part, _ in parts}
    for record in records[max(0, len(records) - keep) :] if keep else []:
        used.add(record.get("part", record["writer"]))
        used |= {part for parts in record.get("state", {}).get("live", {}).values() for part, _ in parts}
    gone = sorted((_complete(spark, lake) & committed) - used)
    for part in gone:
        delete(spark, f"{lake.silver_log}/batch_id={part}")
    return gone


def run_backfill(spark: SparkSession, lake: Lake, source: str, start: str, end: str) -> str:
    """Merge late rows of ``[start, end)`` into silver once per request; returns the run id."""
    run, _ = curate.backfill_run_id(source, start, end)
    run_id = spark.range(1).select(run.alias("r")).head()[0]
    if matching(spark, f"{lake.manifests}/run={run_id}/_SUCCESS"):
        return run_id
    late = read_table(spark, lake.late)
    if late is None:
        return run_id
    before = read_log(spark, lake).number
    writer = BACKFILL_BASE + int(run_id[:15], 16)
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    write_silver(curate.backfill_candidates(late.drop("batch_id"), source, lo, hi), lake, writer)
    manifest = curate.backfill_manifest(late, None, source, start, end, F.current_timestamp())
    # Written aside and renamed: of two runs of one request at once, the first one's manifest stays.
    aside = f"{lake.manifests}/.{uuid.uuid4().hex}"
    manifest.withColumns(
        {
            "before_snapshot_id": F.lit(str(before) if before >= 0 else None).cast("string"),
            "after_snapshot_id": F.lit(str(read_log(spark, lake).number)),
        }
    ).select(*MANIFEST_SCHEMA.names).coalesce(1).write.parquet(aside)
    if not rename_new(spark, aside, f"{lake.manifests}/run={run_id}"):
        delete(spark, aside)
    return run_id


def read_forecasts(spark: SparkSession, lake: Lake) -> DataFrame:
    """The stored forecasts; empty before the first write. A filter on target or issue day prunes folders."""
    schema = T.StructType([*FORECAST_SCHEMA, T.StructField("issue_day", T.DateType())])
    if not matching(spark, f"{lake.forecasts}/target=*"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", lake.forecasts).parquet(lake.forecasts)


def store_forecasts(rows: DataFrame, lake: Lake) -> None:
    """Upsert forecast rows by natural key: the first id of a key survives, later values replace the rest.

    Only the (target, issue day) folders that the rows touch are read and written again, each replaced when the job commits.
    """
    spark = rows.sparkSession
    new = by_day(rows.select(*FORECAST_SCHEMA.names), "issue_time", "issue_day").withColumn("_turn", F.lit(1))
    new = durable(new)
    touched = new.select("target", "issue_day").distinct()
    old = read_forecasts(spark, lake).join(F.broadcast(touched), ["target", "issue_day"], "left_semi").withColumn("_turn", F.lit(0))
    # Rows written twice in one call settle by their id, so that a repeated run ends alike.
    merged = upsert_by_natural_key(old.unionByName(new), order=["_turn", "forecast_id"])
    stored = durable(merged.select(*FORECAST_SCHEMA.names, F.to_date("issue_time").alias("issue_day")))
    spaced = stored.hint("rebalance", "target", "issue_day")
    writer = spaced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target", "issue_day")
    writer.parquet(lake.forecasts)


def merge_statement(target: str, source: str) -> str:
    """The same upsert for a catalog whose table format supports MERGE."""
    return f"""
        MERGE INTO {target} t USING {source} s ON t.business_key = s.business_key
        WHEN MATCHED AND s.revision > t.revision THEN UPDATE SET *
        WHEN NOT MATCHED THEN INSERT *
    """
