"""Small keyed state tables (deployments, model status, runs): numbered versions, each published whole by rename."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from voltframe.operators.governance import apply_updates
from voltframe.storage import delete, matching, rename_new


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(p.rsplit("version=", 1)[1]) for p in matching(spark, f"{folder}/version=*"))


def read_state(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame | None:
    """The newest (or a given) version of a state table; ``None`` before the first write."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    return spark.read.parquet(f"{folder}/version={versions[-1] if version is None else version}")


def update_state(updates: DataFrame, folder: str, *, key: str) -> int:
    """Upsert rows by key and publish the next version; its number.

    Columns that the updates lack keep their value. If somebody else publishes that version first, the updates are applied anew to
    theirs, so that no update is lost. A writer that dies leaves a hidden folder that nobody reads.
    """
    spark = updates.sparkSession
    while True:
        versions = _versions(spark, folder)
        number = versions[-1] + 1 if versions else 0
        current = read_state(spark, folder, versions[-1]) if versions else None
        merged = updates if current is None else apply_updates(current, updates, key=key)
        aside = f"{folder}/.{uuid.uuid4().hex}"
        merged.write.parquet(aside)
        if rename_new(spark, aside, f"{folder}/version={number}"):
            return number
        delete(spark, aside)


def drop_versions(spark: SparkSession, folder: str, *, keep: int = 20) -> list[int]:
    """Delete all but the newest ``keep`` versions (at least one stays); their numbers."""
    gone = _versions(spark, folder)[: -max(1, keep)]
    for number in gone:
        delete(spark, f"{folder}/version={number}")
    return gone
