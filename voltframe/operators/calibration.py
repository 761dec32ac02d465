"""Quantile repair, split-conformal calibration and forecast blending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltframe.plans.skew import order_statistics

WIDTH_FLOOR = 1e-4
TARGET_COVERAGE = 0.80
# Blend weights of the three stacked learners.
STACK_WEIGHTS = (0.45, 0.35, 0.20)


def monotone(df: DataFrame) -> DataFrame:
    """Sort the three quantiles of each row."""
    ordered = F.array_sort(F.array("p10", "p50", "p90"))
    return df.withColumn("_q", ordered).withColumns(
        {name: F.col("_q")[i] for i, name in enumerate(("p10", "p50", "p90"))}
    ).drop("_q")


def conformity_score(actual: Column, p10: Column, p90: Column, adaptive: bool = True) -> Column:
    miss = F.greatest(p10 - actual, actual - p90)
    return miss / ((p90 - p10) + F.lit(WIDTH_FLOOR)) if adaptive else miss


def correction_rank(n: Column, target_coverage: float = TARGET_COVERAGE) -> Column:
    """0-based rank of the correction among ``n`` ascending scores."""
    level = F.ceil((n + F.lit(1)).cast("double") * F.lit(target_coverage))
    return F.least(n - F.lit(1), level)


def conformal_fit(
    df: DataFrame,
    *,
    keys: Sequence[str],
    actual: str = "actual",
    target_coverage: float = TARGET_COVERAGE,
    adaptive: bool = True,
) -> DataFrame:
    """Correction per key as an exact order statistic: ``(keys..., q_correction, n)``."""
    scored = df.select(
        *keys, conformity_score(F.col(actual), F.col("p10"), F.col("p90"), adaptive).alias("_score")
    )
    return order_statistics(
        scored, keys=keys, value="_score",
        ranks={"q_correction": lambda n: correction_rank(n, target_coverage)},
    )


def conformal_fit_small(
    df: DataFrame, *, keys: Sequence[str], actual: str = "actual", target_coverage: float = TARGET_COVERAGE
) -> DataFrame:
    """Same correction in one aggregation, for calibration sets of a known small size (one fold)."""
    score = conformity_score(F.col(actual), F.col("p10"), F.col("p90"))
    collected = df.select(*keys, score.alias("_score")).groupBy(*keys).agg(
        F.array_sort(F.collect_list("_score")).alias("_scores")
    )
    rank = correction_rank(F.size("_scores").cast("long"), target_coverage)
    return collected.select(
        *keys,
        F.element_at("_scores", (rank + 1).cast("int")).alias("q_correction"),
        F.size("_scores").cast("long").alias("n"),
    )


def conformal_apply(df: DataFrame, correction: Column, adaptive: bool = True) -> DataFrame:
    """Widen (or narrow) the interval by the correction and repair the order; null leaves it as is."""
    q = F.coalesce(correction, F.lit(0.0))
    amount = q * ((F.col("p90") - F.col("p10")) + F.lit(WIDTH_FLOOR)) if adaptive else q
    widened = df.withColumn("_by", amount).withColumns(
        {"p10": F.col("p10") - F.col("_by"), "p90": F.col("p90") + F.col("_by")}
    )
    return monotone(widened.drop("_by"))


def stacked_blend(df: DataFrame, weights: Sequence[float] = STACK_WEIGHTS) -> DataFrame:
    """Weighted sum of learner quantiles in columns ``p10_1 .. p90_3``, then order repair."""

    def blend(q: str) -> Column:
        total = F.lit(0.0)
        for i, w in enumerate(weights, start=1):
            total = total + F.lit(float(w)) * F.col(f"{q}_{i}")
        return total

    return monotone(df.withColumns({q: blend(q) for q in ("p10", "p50", "p90")}))


def horizon_weight(step: Column, switch_steps: int) -> Column:
    """Weight of the short-lead model: 1 at the first step, 0 from the switch horizon on."""
    raw = F.lit(1.0) - (step.cast("double") - 1.0) / F.lit(float(switch_steps))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def dual_horizon_blend(df: DataFrame, switch_steps: int, step: str = "horizon_step") -> DataFrame:
    """Blend of short (``*_s``) and long (``*_l``) quantiles by each row's own lead."""
    a = horizon_weight(F.col(step), switch_steps)
    blended = {
        q: a * F.col(f"{q}_s") + (F.lit(1.0) - a) * F.col(f"{q}_l") for q in ("p10", "p50", "p90")
    }
    return monotone(df.withColumns(blended))
