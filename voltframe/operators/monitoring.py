"""Operational counters, freshness, error ratio, drift and data-snapshot identity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.operators.curate import LATE_AFTER, accepted
from voltframe.plans.skew import gather, order_statistics, quantile_rank
from voltframe.schemas import TOPICS

STALE_SOURCE_SECONDS = 1800
ERROR_RATIO_LIMIT = 1.2


def ops_counters(parsed: DataFrame) -> DataFrame:
    """Published by topic, late by source, rejected by reason as ``(metric, label, n)``.

    Each parsed message yields the counters it belongs to, so all of them come from one pass.
    """
    ok = accepted("event")
    topics = F.create_map(*[F.lit(x) for item in TOPICS.items() for x in item])
    late = F.col("event.ingested_at") > F.col("event.interval_end") + F.expr(LATE_AFTER)

    def counter(metric: str, label: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"))

    counters = F.array_compact(
        F.array(
            F.when(ok, counter("events_published", F.try_element_at(topics, "event.event_type"))),
            F.when(ok & late, counter("late_events", F.col("event.source"))),
            F.when(~ok, counter("dead_letter_events", F.lit("schema_validation"))),
        )
    )
    return (
        parsed.select(F.explode(counters).alias("_c"))
        .groupBy("_c.metric", "_c.label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def source_freshness(events: DataFrame, now: Column, stale_after: int = STALE_SOURCE_SECONDS) -> DataFrame:
    newest = events.groupBy("source").agg(F.max("ingested_at").alias("newest"))
    age = F.unix_seconds(now) - F.unix_seconds("newest")
    return newest.withColumns({"age_seconds": age, "is_stale": age > stale_after})


def error_ratio(status: DataFrame, limit: float = ERROR_RATIO_LIMIT) -> DataFrame:
    """Rolling error over baseline error and a breach flag; null without a positive baseline."""
    ratio = F.when(F.col("baseline_error") > 0, F.col("rolling_error") / F.col("baseline_error"))
    return status.withColumns({"error_ratio": ratio, "is_breach": F.coalesce(ratio > limit, F.lit(False))})


def population_stability(
    reference: DataFrame, current: DataFrame, *, keys: Sequence[str], value: str, bins: int = 10, floor: float = 1e-4
) -> DataFrame:
    """Population stability index over quantile bins of the reference sample."""
    names = [f"e{i}" for i in range(1, bins)]
    edges = order_statistics(
        reference, keys=keys, value=value,
        ranks={n: quantile_rank(i / bins) for i, n in enumerate(names, start=1)},
    ).select(*keys, F.array(*names).alias("_edges"))

    def binned(df: DataFrame, name: str) -> DataFrame:
        slot = F.size(F.filter(F.col("_edges"), lambda e: e < F.col(value)))
        return df.select(*keys, value).join(edges, list(keys)).groupBy(*keys, slot.alias("_bin")).agg(
            F.count(F.lit(1)).alias(name)
        )

    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    counts = grid.join(binned(reference, "_a"), [*keys, "_bin"], "left").join(
        binned(current, "_b"), [*keys, "_bin"], "left"
    ).fillna(0, subset=["_a", "_b"])
    totals = counts.groupBy(*keys).agg(F.sum("_a").alias("_ta"), F.sum("_b").alias("_tb"))
    share_a = F.greatest(F.try_divide(F.col("_a"), F.col("_ta")), F.lit(floor))
    share_b = F.greatest(F.try_divide(F.col("_b"), F.col("_tb")), F.lit(floor))
    return (
        counts.join(totals, list(keys))
        .groupBy(*keys)
        .agg(F.sum((share_a - share_b) * F.log(share_a / share_b)).alias("psi"))
    )


def _digest(keys: list[str], column: str):
    """Hash each key's ordered checksums while they stream by; memory stays constant."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest, count = None, None, 0
        for pdf in batches:
            done = []
            for row in pdf[[*keys, column]].itertuples(index=False, name=None):
                key, checksum = row[:-1], row[-1]
                if key != current:
                    if digest is not None:
                        done.append((*current, digest.hexdigest(), count))
                    current, digest, count = key, hashlib.sha256(), 0
                digest.update(checksum.encode() if count == 0 else b"|" + checksum.encode())
                count += 1
            if done:
                yield pd.DataFrame(done, columns=[*keys, "digest", "checksums"])
        if digest is not None:
            yield pd.DataFrame([(*current, digest.hexdigest(), count)], columns=[*keys, "digest", "checksums"])

    return run


def snapshot_id(events: DataFrame, *, keys: Sequence[str], column: str = "payload_checksum") -> DataFrame:
    """Identity of the source payloads behind each key: hash of the sorted distinct checksums.

    The value is defined as one hash over one ordered list, so the last step streams the distinct
    checksums (one per source document) of a key in order; sorting spills, nothing is collected.
    """
    keys = list(keys)
    distinct = events.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(*keys, column).distinct()
    fields = [f"`{k}` {distinct.schema[k].dataType.simpleString()}" for k in keys]
    return (
        gather(distinct, keys)
        .sortWithinPartitions(*keys, column)
        .mapInPandas(_digest(keys, column), schema=", ".join([*fields, "digest string", "checksums long"]))
        .select(
            *keys, F.concat(F.lit("live-"), F.substring("digest", 1, 20)).alias("snapshot_id"), "checksums"
        )
    )


def snapshot_leaves(events: DataFrame, *, keys: Sequence[str], column: str = "payload_checksum", prefix: int = 4) -> DataFrame:
    """Leaves of a digest tree: per key and checksum prefix the digest of the sorted distinct checksums, and their number.

    Checksums are hash values, so the leaves of a key are of about equal size; ``prefix`` hexadecimal digits give ``16 ** prefix`` of
    them. Any source payload touches one leaf only.
    """
    text = F.col(column)
    distinct = events.filter(text.isNotNull() & (text != "")).select(*keys, text.alias("_sum")).distinct()
    leaves = distinct.groupBy(*keys, F.substring("_sum", 1, prefix).alias("leaf"))
    return leaves.agg(F.array_sort(F.collect_list("_sum")).alias("_sums")).select(
        *keys, "leaf", F.sha2(F.array_join("_sums", "|"), 256).alias("digest"), F.size("_sums").cast("long").alias("checksums")
    )


def snapshot_root(leaves: DataFrame, *, keys: Sequence[str], prefix: int = 4) -> DataFrame:
    """Root of the tree: two digits at a time, a node is the digest of its children's names and digests in order."""
    nodes = leaves
    for length in range((prefix - 1) // 2 * 2, -1, -2):
        children = F.array_sort(F.collect_list(F.struct("leaf", "digest")))
        nodes = nodes.groupBy(*keys, F.substring("leaf", 1, length).alias("leaf")).agg(children.alias("_c"), F.sum("checksums").alias("checksums"))
        named = F.transform("_c", lambda c: F.concat(c["leaf"], F.lit(":"), c["digest"]))
        nodes = nodes.select(*keys, "leaf", F.sha2(F.array_join(named, "|"), 256).alias("digest"), "checksums")
    return nodes.select(*keys, F.concat(F.lit("tree-"), F.substring("digest", 1, 20)).alias("snapshot_id"), "checksums")


def update_leaves(
    leaves: DataFrame, stored: DataFrame, added: DataFrame, *, keys: Sequence[str], column: str = "payload_checksum", prefix: int = 4
) -> DataFrame:
    """Leaves after more events arrived: only those whose prefix the new checksums touch are made anew from the stored events."""
    leaf = F.substring(column, 1, prefix)
    at = F.struct(*keys, F.col("leaf"))
    touched = added.filter(F.col(column) != "").withColumn("leaf", leaf).select(at.alias("_at")).distinct()
    both = stored.select(*keys, column).unionByName(added.select(*keys, column)).withColumn("leaf", leaf).withColumn("_at", at)
    renewed = snapshot_leaves(both.join(touched, "_at", "left_semi"), keys=keys, column=column, prefix=prefix)
    return leaves.withColumn("_at", at).join(touched, "_at", "left_anti").drop("_at").unionByName(renewed)
