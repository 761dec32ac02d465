"""Forecast accuracy as aggregate expressions (all mergeable before the shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pinball_loss(actual: Column, predicted: Column, quantile: float) -> Column:
    error = actual - predicted
    return F.avg(F.greatest(error * F.lit(quantile), error * F.lit(quantile - 1)))


def winkler_score(actual: Column, lower: Column, upper: Column, alpha: float = 0.2) -> Column:
    penalty = F.lit(2.0 / alpha)
    below = F.when(actual < lower, (lower - actual) * penalty).otherwise(0.0)
    above = F.when(actual > upper, (actual - upper) * penalty).otherwise(0.0)
    return F.avg(upper - lower + below + above)


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    return F.avg(actual.between(lower, upper).cast("double"))


def improvement_pct(baseline: Column, model: Column) -> Column:
    return F.try_divide(baseline - model, baseline) * 100.0


def evaluate(
    actual: Column,
    point: Column,
    p10: Column,
    p90: Column,
    *,
    allow_wape: Column | bool = True,
    alpha: float = 0.2,
    prefix: str = "",
) -> list[Column]:
    """MAE, RMSE, WAPE, MAPE, pinball, coverage and Winkler score of one forecast."""
    error = actual - point
    share = F.try_divide(F.sum(F.abs(error)), F.sum(F.abs(actual)))
    allowed = F.lit(allow_wape) if isinstance(allow_wape, bool) else F.bool_and(allow_wape)
    relative = F.when(F.abs(actual) > 1e-3, F.abs(error) / F.abs(actual))
    metrics = {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "wape": F.when(allowed, share),
        "mape": F.avg(relative) * 100.0,
        "pinball_p10": pinball_loss(actual, p10, 0.1),
        "pinball_p90": pinball_loss(actual, p90, 0.9),
        "interval_coverage": coverage(actual, p10, p90),
        "winkler_score": winkler_score(actual, p10, p90, alpha),
    }
    return [c.alias(prefix + name) for name, c in metrics.items()]
