"""Model release rules as table operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.plans.skew import carry_forward, gather, running, with_row_index

MIN_IMPROVEMENT = 0.02
MAX_SLICE_REGRESSION = 0.10
BREACH_THRESHOLD = 0.20
REQUIRED_BREACHES = 3


def improvement(champion: Column, challenger: Column) -> Column:
    return F.try_divide(champion - challenger, champion)


# What the gate says, an output value of release records.
REASONS = {
    "champion": "champion error must be positive",
    "improvement": "challenger does not improve primary error by {:g}%",
    "slice": "challenger regresses a critical slice by more than {:g}%",
    "promote": "promotion criteria satisfied",
}


def promotion_gate(
    champion: Column,
    challenger: Column,
    slice_regressions: Column | None = None,
    *,
    minimum_improvement: float = MIN_IMPROVEMENT,
    maximum_slice_regression: float = MAX_SLICE_REGRESSION,
) -> dict[str, Column]:
    """``promote`` and ``reason`` columns of the release gate."""
    regresses = (
        F.lit(False)
        if slice_regressions is None
        else F.coalesce(
            F.exists(slice_regressions, lambda r: r > F.lit(maximum_slice_regression)), F.lit(False)
        )
    )
    reason = (
        F.when(champion <= 0, REASONS["champion"])
        .when(improvement(champion, challenger) < minimum_improvement, REASONS["improvement"].format(100 * minimum_improvement))
        .when(regresses, REASONS["slice"].format(100 * maximum_slice_regression))
        .otherwise(REASONS["promote"])
    )
    return {"promote": reason == REASONS["promote"], "reason": reason}


def _promotions(keys: list[str], order: str, minimum_improvement: float):
    """Stream record-low candidates in order and keep those that beat the champion by enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, champion = None, None
        for pdf in batches:
            keep = []
            identities = list(zip(*[pdf[k] for k in keys], strict=True)) if keys else [()] * len(pdf)
            for identity, mae in zip(identities, pdf["mae"].tolist(), strict=True):
                if identity != current:
                    # The first row of a key is its first promotion.
                    current, champion, promoted = identity, mae, True
                else:
                    promoted = champion > 0 and not (champion - mae) / champion < minimum_improvement
                    champion = mae if promoted else champion
                keep.append(promoted)
            yield pdf.loc[keep, [*keys, order]]

    return run


def release_ledger(
    candidates: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    bucket: Column | None = None,
    minimum_improvement: float = MIN_IMPROVEMENT,
) -> DataFrame:
    """Outcome of every candidate ``(keys..., order, version, mae, baseline_mae)`` in sequence.

    Each candidate is compared with the champion at that time, or with its own baseline when there
    is none; a promotion becomes the champion. Which candidates get promoted depends on the ones
    before, but a promoted one always undercuts every earlier error since the first promotion. So
    only running record lows are replayed in order, as a stream with constant state; the champion
    each candidate met is then carried forward to it in parallel.
    """
    keys = list(keys)
    at = F.col(order)
    gate = promotion_gate(F.col("baseline_mae"), F.col("mae"), minimum_improvement=minimum_improvement)
    # Keys travel as one text, so that a null key is a product of its own.
    named = candidates.withColumn("_product", F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("_"))))
    first = named.filter(gate["promote"]).groupBy("_product").agg(F.min(at).alias("_first"))
    since = named.join(first, "_product").filter(at >= F.col("_first")).select("_product", order, "mae")
    floors = running(since, keys=["_product"], bucket=bucket, order=[at], values={"_floor": ("min", F.col("mae"))}, inclusive=False)
    records = floors.filter(F.col("_floor").isNull() | (F.col("mae") <= F.col("_floor")))
    promoted = (
        gather(records.select("_product", order, "mae"), ["_product"])
        .sortWithinPartitions("_product", order)
        .mapInPandas(_promotions(["_product"], order, minimum_improvement), schema=named.select("_product", order).schema)
        .withColumn("promoted", F.lit(True))
    )
    marked = named.join(promoted, ["_product", order], "left").withColumn("promoted", F.coalesce("promoted", F.lit(False))).drop("_product")
    champion = F.when(F.col("promoted"), F.struct("version", "mae"))
    judged = carry_forward(
        marked, keys=keys, bucket=bucket, order=[at], value=champion, name="_met", inclusive=False
    )
    met, promote = F.col("_met"), F.col("promoted")
    reference = F.coalesce(met["mae"], F.col("baseline_mae"))
    return judged.withColumns(
        {
            "reference_error": reference,
            "reason": promotion_gate(reference, F.col("mae"), minimum_improvement=minimum_improvement)["reason"],
            "champion_version": F.when(promote, F.col("version")).otherwise(met["version"]),
            "champion_error": F.when(promote, F.col("mae")).otherwise(met["mae"]),
            "previous_version": F.when(promote, met["version"]),
            "previous_error": F.when(promote, met["mae"]),
            "status": F.when(promote, "champion").otherwise("candidate_rejected"),
            "is_shadow": ~promote,
        }
    ).drop("_met")


def deployments(ledger: DataFrame, *, keys: Sequence[str], order: str) -> DataFrame:
    """Current release state per product: the last ledger row, keyed ``area:target:product``."""
    fields = [
        "champion_version", "champion_error", "previous_version", "previous_error",
        F.col("version").alias("candidate_version"), F.col("mae").alias("candidate_error"),
        F.col("baseline_mae").alias("baseline_error"), "status",
        F.col(order).alias("last_evaluated_at"),
    ]
    last = ledger.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_row"))
    return last.select(
        F.concat_ws(":", *keys).alias("deployment_key"), *keys, "_row.*"
    )


def rollback(state: DataFrame, *, strict: bool = True, at: Column | None = None) -> DataFrame:
    """Swap champion and previous model with their errors; without a previous model raise or skip."""
    possible = F.col("previous_version").isNotNull()
    if strict:
        message = F.concat(F.lit("no previous model for "), F.col("deployment_key"))
        chosen = state.filter(F.when(possible, True).otherwise(F.raise_error(message).cast("boolean")))
    else:
        chosen = state.filter(possible)
    swapped = {
        "champion_version": F.col("previous_version"),
        "champion_error": F.col("previous_error"),
        "previous_version": F.col("champion_version"),
        "previous_error": F.col("champion_error"),
        "status": F.lit("rolled_back"),
    }
    if "previous_artifact_uri" in state.columns:
        swapped |= {"champion_artifact_uri": F.col("previous_artifact_uri"), "previous_artifact_uri": F.col("champion_artifact_uri")}
    if at is not None:
        swapped["last_evaluated_at"] = at
    return chosen.withColumns(swapped)


def apply_updates(state: DataFrame, updates: DataFrame, *, key: str) -> DataFrame:
    """Keyed upsert of a state table: columns present in ``updates`` replace, others are kept."""
    marked = updates.withColumn("_updated", F.lit(True))
    joined = state.alias("s").join(marked.alias("u"), key, "full_outer")
    columns = [key]
    for c in [c for c in dict.fromkeys([*state.columns, *updates.columns]) if c != key]:
        if c not in updates.columns:
            columns.append(F.col(f"s.{c}").alias(c))
        elif c not in state.columns:
            columns.append(F.col(f"u.{c}").alias(c))
        else:
            columns.append(
                F.when(F.col("_updated"), F.col(f"u.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
            )
    return joined.select(*columns)


def breach_streaks(
    windows: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    bucket: Column | None = None,
    threshold: float = BREACH_THRESHOLD,
    required: int = REQUIRED_BREACHES,
) -> DataFrame:
    """Consecutive degraded windows so far and whether they call for a rollback.

    The streak is the distance to the last healthy window, so it needs no sequential scan.
    """
    at, reference = F.col(order), F.col("reference_error")
    positive = F.when(reference > 0, reference).otherwise(
        F.raise_error(F.lit("reference error must be positive")).cast("double")
    )
    degraded = F.col("champion_error") > positive * F.lit(1 + threshold)
    indexed = with_row_index(
        windows.withColumn("degraded", degraded), keys=keys, bucket=bucket, order=[at], name="_i"
    )
    healthy = carry_forward(
        indexed, keys=keys, bucket=bucket, order=[at],
        value=F.when(~F.col("degraded"), F.col("_i")), name="_healthy",
    )
    streak = F.when(F.col("degraded"), F.col("_i") - F.coalesce("_healthy", F.lit(-1))).otherwise(0)
    return healthy.withColumn("consecutive_breaches", streak.cast("long")).withColumn(
        "rollback", F.col("consecutive_breaches") >= required
    ).drop("_i", "_healthy")
