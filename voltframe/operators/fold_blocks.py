"""Backtest folds as sums of mergeable block statistics.

Fold windows start and end at few offsets within a step, so cutting every step at those offsets gives blocks of which each window is
an exact run. One aggregation turns the rows into one small table per block (a Gram matrix for least squares, value counts for
quantiles by hour); a fold adds up its blocks. However many folds there are, a row is read once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltframe.operators.backtest import BacktestPlan, assign_folds, indexed_rows
from voltframe.operators.calibration import conformal_apply, conformal_fit_small
from voltframe.session import durable


class FoldBlocks:
    """Where the blocks of a plan begin and which of them a fold's training window holds."""

    def __init__(self, plan: BacktestPlan):
        self.step = plan.step_rows
        fit_end = plan.train_rows - plan.lead_steps - plan.calibration_rows
        if fit_end <= 0:
            raise ValueError("the calibration rows leave nothing to fit on")
        edges = (0, fit_end, plan.train_rows - plan.lead_steps, plan.train_rows, plan.train_rows + plan.test_rows)
        self.offsets = sorted({e % self.step for e in edges})
        self.fit_blocks = self.number(fit_end)

    def number(self, row: int) -> int:
        """Block of a row index."""
        return row // self.step * len(self.offsets) + sum(o <= row % self.step for o in self.offsets) - 1

    def column(self, row: Column) -> Column:
        """``number`` as a column expression."""
        inside = F.pmod(row, F.lit(self.step))
        passed = sum((F.when(inside >= o, 1).otherwise(0) for o in self.offsets), F.lit(0))
        return (F.floor(row / F.lit(self.step)) * len(self.offsets) + passed - 1).cast("long")

    def first(self, fold: Column) -> Column:
        """First block of the training window of a 1-based fold."""
        return (fold - 1) * len(self.offsets)


def folds_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per series and fold."""
    counts = rows.groupBy(*keys).agg(F.max("fold_count").alias("_folds")).filter(F.col("_folds") > 0)
    return counts.select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_folds"))).alias("fold"))


def gram_blocks(rows: DataFrame, *, keys: Sequence[str], plan: BacktestPlan, features: Sequence[str], target: str = "target") -> DataFrame:
    """``keys, _block, _g0.._gN``: sums of all products of (1, features, target) per block; rows with a null do not count."""
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)]]
    sums = [F.sum(a * b).alias(f"_g{i}") for i, (a, b) in enumerate(combinations_with_replacement(values, 2))]
    complete = rows.dropna(subset=[*features, target])
    return complete.groupBy(*keys, FoldBlocks(plan).column(F.col("row_idx")).alias("_block")).agg(*sums)


def fold_sums(blocks: DataFrame, folds: DataFrame, *, keys: Sequence[str], plan: BacktestPlan) -> DataFrame:
    """``keys, fold`` and the sums of all other columns of ``blocks`` over the blocks of the fold's training window."""
    shape = FoldBlocks(plan)
    summed = [c for c in blocks.columns if c not in (*keys, "_block")]
    starts = folds.select(*keys, "fold", shape.first(F.col("fold")).alias("_block"), *[F.lit(0.0).alias(c) for c in summed])
    stacked = blocks.withColumn("fold", F.lit(None).cast("long")).unionByName(starts)
    window = Window.partitionBy(*keys).orderBy("_block").rangeBetween(0, shape.fit_blocks - 1)
    added = stacked.select(*keys, "fold", *[F.sum(c).over(window).alias(c) for c in summed])
    return added.filter(F.col("fold").isNotNull())


def _solving(size: int):
    """Least squares from a packed Gram matrix: the coefficients of all but the last column, of least norm where several fit."""
    upper = np.triu_indices(size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gram = np.zeros((len(pdf), size, size))
            packed = pdf[[f"_g{i}" for i in range(len(upper[0]))]].to_numpy(float)
            gram[:, upper[0], upper[1]] = packed
            gram[:, upper[1], upper[0]] = packed
            inner, right = gram[:, :-1, :-1], gram[:, :-1, -1:]
            # Scaling to a unit diagonal keeps features of different size apart in the tolerance.
            scale = np.sqrt(np.maximum(np.diagonal(inner, axis1=1, axis2=2), 1e-300))
            inverse = np.linalg.pinv(inner / scale[:, :, None] / scale[:, None, :], rcond=1e-13, hermitian=True)
            solved = (inverse @ (right / scale[:, :, None]))[:, :, 0] / scale
            out = pdf.drop(columns=[c for c in pdf.columns if c.startswith("_g")])
            yield out.assign(rows=gram[:, 0, 0].astype(np.int64), coefficients=list(solved))

    return run


def linear_folds(rows: DataFrame, *, keys: Sequence[str], plan: BacktestPlan, features: Sequence[str]) -> DataFrame:
    """``keys, fold, rows, coefficients`` (intercept first) of the least-squares fit of every fold of every series.

    ``rows`` are ``indexed_rows`` with a ``target``. A fold without complete rows has coefficients of zero.
    """
    blocks = gram_blocks(rows, keys=keys, plan=plan, features=features)
    sums = fold_sums(blocks, folds_of(rows, keys), keys=keys, plan=plan)
    fields = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return sums.mapInPandas(_solving(len(features) + 2), schema=", ".join([*fields, "fold long", "rows long", "coefficients array<double>"]))


def linear_backtest(
    df: DataFrame, *, keys: Sequence[str], plan: BacktestPlan, features: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """Out-of-sample predictions of a linear learner in every fold, in the columns of ``backtest_predictions``.

    ``df`` has ``value`` and the features at every valid time. The interval is the conformal one around the point of each fold's
    calibration rows, so the raw interval is the point itself. Rows with a missing feature get no prediction.
    """
    by = [*keys, "fold"]
    # Fitting, calibration and testing read the indexed rows, which are stored once.
    rows = durable(indexed_rows(df, keys=keys, plan=plan).withColumnRenamed("value", "target"))
    fitted = durable(linear_folds(rows, keys=keys, plan=plan, features=features))
    members = assign_folds(rows.dropna(subset=[*features, "target"]), plan).filter("role <> 'fit'").join(fitted, by)
    point = F.col("coefficients")[0]
    for i, name in enumerate(features, start=1):
        point = point + F.col("coefficients")[i] * F.col(name)
    scored = members.withColumn("p50", point).withColumns({"p10": F.col("p50"), "p90": F.col("p50"), "actual": F.col("target")})
    correction = conformal_fit_small(scored.filter("role = 'calibrate'"), keys=by).select(*by, "q_correction")
    test = scored.filter("role = 'test'").join(correction, by, "left").withColumns({"raw_p10": F.col("p10"), "raw_p90": F.col("p90")})
    return conformal_apply(test, F.col("q_correction")).select(
        *by, "valid_time", "actual", "p10", "p50", "p90", "raw_p10", "raw_p90", "q_correction", *carried, F.col("p50").alias("predicted")
    )


def count_blocks(rows: DataFrame, *, keys: Sequence[str], plan: BacktestPlan, by: Sequence[str], target: str = "target") -> DataFrame:
    """``keys, by, _block, _v, _c``: how often each value occurs per block and group."""
    block = FoldBlocks(plan).column(F.col("row_idx")).alias("_block")
    return rows.filter(F.col(target).isNotNull()).groupBy(*keys, *by, block, F.col(target).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def fold_quantiles(
    counts: DataFrame, folds: DataFrame, *, keys: Sequence[str], plan: BacktestPlan, by: Sequence[str], quantiles: Sequence[float]
) -> DataFrame:
    """``keys, fold, by, q``: exact quantiles of the values that the blocks of each fold's training window count together."""
    shape = FoldBlocks(plan)
    per_step = len(shape.offsets)
    last = folds.groupBy(*keys).agg(F.max("fold").alias("_last"))
    lowest = F.greatest(F.ceil((F.col("_block") - shape.fit_blocks + 1) / F.lit(per_step)) + 1, F.lit(1)).cast("long")
    highest = F.least(F.floor(F.col("_block") / F.lit(per_step)) + 1, F.col("_last")).cast("long")
    numbers = F.when(lowest <= highest, F.sequence(lowest, highest)).otherwise(F.array().cast("array<bigint>"))
    placed = counts.join(last, list(keys)).select(*keys, *by, "_v", "_c", F.explode(numbers).alias("fold"))
    # A group holds one value per day of a training window at most, so its state is bounded by that window.
    merged = placed.groupBy(*keys, "fold", *by)
    return merged.agg(F.percentile("_v", F.array(*[F.lit(float(q)) for q in quantiles]), F.col("_c")).alias("q"))
