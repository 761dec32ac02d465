"""Quantile forecasters whose fitting runs as Spark jobs.

``SeasonalQuantileForecaster`` is one grouped aggregation. The MLlib learners fit one pooled model
over all series (series identity enters as a feature through its lags) and take P10/P90 from
residual quantiles by series and hour. All share ``fit`` / ``predict`` / ``save`` / ``load``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.operators.calibration import (
    STACK_WEIGHTS,
    conformal_apply,
    conformal_fit,
    dual_horizon_blend,
    monotone,
    stacked_blend,
)
from voltframe.operators.features import LONG_HORIZON_FEATURES, SHORT_HORIZON_FEATURES
from voltframe.plans.skew import order_statistics, quantile_rank, time_bucket, with_row_index
from voltframe.schemas import unit_for_target
from voltframe.session import durable

QUANTILES = (0.1, 0.5, 0.9)
QUANTILE_COLUMNS = ("p10", "p50", "p90")
MIN_CALIBRATION_ROWS = 96


def seasonal_quantiles(rows: DataFrame, *, keys: Sequence[str], target: str = "target") -> DataFrame:
    """Quantiles by (hour, weekend) and, with a null weekend flag, by hour alone.

    A group holds one value per day of the training window, so its state is bounded by that window.
    """
    levels = F.array(F.col("is_weekend"), F.lit(None).cast("int"))
    return (
        rows.select(*keys, "hour", F.explode(levels).alias("is_weekend"), target)
        .groupBy(*keys, "hour", "is_weekend")
        .agg(F.percentile(target, F.array(*[F.lit(q) for q in QUANTILES])).alias("_q"))
        .select(
            *keys, "hour", "is_weekend",
            *[F.col("_q")[i].alias(name) for i, name in enumerate(QUANTILE_COLUMNS)],
        )
    )


def hour_tables(table: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Seasonal quantiles as one row per hour: quantile maps keyed by weekend flag (-1 = any day)."""
    flag = F.coalesce("is_weekend", F.lit(-1))
    return table.groupBy(*keys, "hour").agg(
        *[F.map_from_entries(F.collect_list(F.struct(flag, F.col(q)))).alias(f"_{q}") for q in QUANTILE_COLUMNS]
    )


def predict_from_hours(rows: DataFrame, hours: DataFrame, *, keys: Sequence[str]) -> DataFrame:
    """Quantiles of the row's (hour, weekend) group, or of its hour where that group is unseen."""
    joined = rows.join(hours, [*keys, "hour"], "left")
    picked = {
        q: F.coalesce(
            F.try_element_at(f"_{q}", F.col("is_weekend")), F.try_element_at(f"_{q}", F.lit(-1))
        )
        for q in QUANTILE_COLUMNS
    }
    return monotone(joined.withColumns(picked).drop(*[f"_{q}" for q in QUANTILE_COLUMNS]))


def split_last_rows(rows: DataFrame, *, keys: Sequence[str], fraction: float) -> DataFrame:
    """Flag each series' last ``max(96, n * fraction)`` rows as ``is_calibration``."""
    ts = F.col("valid_time")
    indexed = with_row_index(rows, keys=keys, bucket=time_bucket(ts), order=[ts], name="_i", total="_n")
    size = F.greatest(F.lit(MIN_CALIBRATION_ROWS), F.floor(F.col("_n") * F.lit(fraction)))
    return indexed.withColumn("is_calibration", F.col("_i") >= F.col("_n") - size).drop("_i", "_n")


def split_last_periods(rows: DataFrame, *, keys: Sequence[str], fraction: float) -> DataFrame:
    """Flag the last ``max(1, periods * fraction)`` distinct valid times as ``is_calibration``."""
    ts = F.col("valid_time")
    periods = with_row_index(
        rows.select(*keys, "valid_time").distinct(),
        keys=keys, bucket=time_bucket(ts), order=[ts], name="_i", total="_n",
    )
    size = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(fraction)))
    start = periods.filter(F.col("_i") == F.col("_n") - size).select(
        *keys, F.col("valid_time").alias("_start")
    )
    return rows.join(start, list(keys)).withColumn(
        "is_calibration", F.col("valid_time") >= F.col("_start")
    ).drop("_start")


class QuantileForecaster:
    """Shared calibration, prediction and persistence; subclasses provide raw quantiles."""

    model_name = "quantile"
    splitter = staticmethod(split_last_rows)

    def __init__(self, keys: Sequence[str] = ("area",), model_version: str = "untrained") -> None:
        self.keys = list(keys)
        self.model_version = model_version
        self.feature_names: list[str] = []
        self.corrections: DataFrame | None = None

    def _fit_raw(self, rows: DataFrame) -> None:
        raise NotImplementedError

    def raw_quantiles(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError

    def fit(
        self, rows: DataFrame, *, feature_names: Sequence[str], calibration_fraction: float = 0.0
    ) -> QuantileForecaster:
        if not 0 <= calibration_fraction < 1:
            raise ValueError("calibration_fraction must be in [0, 1)")
        self.feature_names = list(feature_names)
        if calibration_fraction:
            split = self.splitter(rows, keys=self.keys, fraction=calibration_fraction)
            self._fit_raw(split.filter(~F.col("is_calibration")).drop("is_calibration"))
            held = self.raw_quantiles(split.filter("is_calibration").drop("is_calibration"))
            fitted = conformal_fit(held, keys=self.keys, actual="target")
            # One row per series; stored, so predicting does not repeat the fit.
            self.corrections = durable(fitted.select(*self.keys, "q_correction"))
        else:
            self._fit_raw(rows)
        return self

    def predict(self, rows: DataFrame, *, apply_calibration: bool = True) -> DataFrame:
        raw = self.raw_quantiles(rows)
        return self.calibrated(raw) if apply_calibration else raw

    def calibrated(self, raw: DataFrame) -> DataFrame:
        """Raw quantiles after the correction of their series; as they are if the model was fitted without calibration."""
        if self.corrections is None:
            return raw
        corrected = raw.join(self.corrections, self.keys, "left")
        return conformal_apply(corrected, F.col("q_correction")).drop("q_correction")

    def score(self, rows: DataFrame, target: str, *, apply_calibration: bool = True) -> DataFrame:
        """The serving columns: p10, point_forecast, p90 and unit."""
        return self.predict(rows, apply_calibration=apply_calibration).select(
            *self.keys, "valid_time", "p10", F.col("p50").alias("point_forecast"), "p90",
            F.lit(unit_for_target(target)).alias("unit"),
        )

    def feature_importances(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], "feature string, importance double")

    # Persistence: one folder with the raw model, the corrections and a small metadata file.
    def _save_raw(self, path: str) -> None:
        raise NotImplementedError

    def _load_raw(self, spark: SparkSession, path: str) -> None:
        raise NotImplementedError

    def _settings(self) -> dict[str, Any]:
        return {}

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {
            "keys": self.keys, "model_version": self.model_version, "feature_names": self.feature_names,
            "calibrated": self.corrections is not None, "type": type(self).__name__, **self._settings(),
        }
        self._save_raw(path)
        if self.corrections is not None:
            self.corrections.write.mode("errorifexists").parquet(f"{path}/corrections")
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> QuantileForecaster:
        meta = json.loads(spark.read.text(f"{path}/metadata").head()[0])
        names, calibrated, kind = meta.pop("feature_names"), meta.pop("calibrated"), meta.pop("type", cls.__name__)
        found = next((c for c in _kinds(QuantileForecaster) if c.__name__ == kind), cls)
        if not issubclass(found, cls):
            raise ValueError(f"{path} holds a {kind}, not a {cls.__name__}")
        model = found(**meta)
        model.feature_names = names
        model._load_raw(spark, path)
        if calibrated:
            model.corrections = spark.read.parquet(f"{path}/corrections")
        return model


def _kinds(base: type[QuantileForecaster]) -> list[type[QuantileForecaster]]:
    """A forecaster class and all classes derived from it."""
    return [base, *(c for sub in base.__subclasses__() for c in _kinds(sub))]


class SeasonalQuantileForecaster(QuantileForecaster):
    """Empirical quantiles by local hour and weekend flag."""

    model_name = "seasonal-quantile"
    table: DataFrame

    def _fit_raw(self, rows: DataFrame) -> None:
        self.table = durable(hour_tables(seasonal_quantiles(rows, keys=self.keys), keys=self.keys))

    def raw_quantiles(self, rows: DataFrame) -> DataFrame:
        return predict_from_hours(rows, self.table, keys=self.keys)

    def _save_raw(self, path: str) -> None:
        self.table.write.mode("errorifexists").parquet(f"{path}/raw")

    def _load_raw(self, spark: SparkSession, path: str) -> None:
        self.table = spark.read.parquet(f"{path}/raw")


class PooledRegressionForecaster(QuantileForecaster):
    """One MLlib regression over all series for the median, residual quantiles for the interval."""

    model_name = "pooled-regression"
    model: PipelineModel
    residuals: DataFrame

    def _estimator(self):
        raise NotImplementedError

    def _point(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows).drop("features")

    def _fit_raw(self, rows: DataFrame) -> None:
        from pyspark.ml import Pipeline

        assembler = VectorAssembler(inputCols=self.feature_names, outputCol="features")
        self.model = Pipeline(stages=[assembler, self._estimator()]).fit(rows)
        fitted = self._point(rows).withColumn("target", F.col("target") - F.col("prediction"))
        by_hour = seasonal_quantiles(
            fitted.select(*self.keys, "hour", F.lit(0).alias("is_weekend"), "target"), keys=self.keys
        ).filter(F.col("is_weekend").isNull())
        self.residuals = durable(
            by_hour.select(*self.keys, "hour", F.col("p10").alias("_r10"), F.col("p90").alias("_r90"))
        )

    def raw_quantiles(self, rows: DataFrame) -> DataFrame:
        joined = self._point(rows).join(self.residuals, [*self.keys, "hour"], "left")
        return monotone(
            joined.withColumns(
                {
                    "p10": F.col("prediction") + F.coalesce("_r10", F.lit(0.0)),
                    "p50": F.col("prediction"),
                    "p90": F.col("prediction") + F.coalesce("_r90", F.lit(0.0)),
                }
            ).drop("prediction", "_r10", "_r90")
        )

    def feature_importances(self, spark: SparkSession) -> DataFrame:
        """Importance per feature; that of a linear model is the size of its coefficient, whatever the sign."""
        fitted = self.model.stages[-1]
        weights = fitted.featureImportances if hasattr(fitted, "featureImportances") else fitted.coefficients
        rows = [(n, abs(float(w))) for n, w in zip(self.feature_names, weights.toArray(), strict=True)]
        return spark.createDataFrame(rows, "feature string, importance double")

    def _save_raw(self, path: str) -> None:
        self.model.save(f"{path}/raw")
        self.residuals.write.parquet(f"{path}/residuals")

    def _load_raw(self, spark: SparkSession, path: str) -> None:
        self.model = PipelineModel.load(f"{path}/raw")
        self.residuals = spark.read.parquet(f"{path}/residuals")


class BoostedTreesForecaster(PooledRegressionForecaster):
    model_name = "boosted-trees-quantile"

    def __init__(self, *args: Any, iterations: int = 20, depth: int = 5, **kwargs: Any) -> None:
        super().__init__(*args, **kwargs)
        self.iterations, self.depth = iterations, depth

    def _estimator(self):
        return GBTRegressor(
            labelCol="target", lossType="absolute", maxIter=self.iterations, maxDepth=self.depth, seed=42
        )

    def _settings(self) -> dict[str, Any]:
        return {"iterations": self.iterations, "depth": self.depth}


class RandomForestForecaster(PooledRegressionForecaster):
    model_name = "random-forest-quantile"

    def __init__(self, *args: Any, trees: int = 20, depth: int = 6, **kwargs: Any) -> None:
        super().__init__(*args, **kwargs)
        self.trees, self.depth = trees, depth

    def _estimator(self):
        return RandomForestRegressor(labelCol="target", numTrees=self.trees, maxDepth=self.depth, seed=42)

    def _settings(self) -> dict[str, Any]:
        return {"trees": self.trees, "depth": self.depth}


class LeafQuantileForecaster(PooledRegressionForecaster):
    """A forest whose leaves are filled again: all three quantiles come from values the trees were not grown on.

    Half of the valid times (by hash) grow the trees. The other half falls through them, and every (tree, leaf) gets the exact
    quantiles of its values. A prediction averages the quantiles of its leaves over the trees. The leaf table has at most
    ``trees * 2 ** depth`` rows, whatever the number of training rows.
    """

    model_name = "leaf-quantile"
    leaves: DataFrame

    def __init__(self, *args: Any, trees: int = 10, depth: int = 6, **kwargs: Any) -> None:
        super().__init__(*args, **kwargs)
        self.trees, self.depth = trees, depth

    def _estimator(self):
        return RandomForestRegressor(labelCol="target", numTrees=self.trees, maxDepth=self.depth, seed=42, leafCol="leaf")

    def _settings(self) -> dict[str, Any]:
        return {"trees": self.trees, "depth": self.depth}

    def _in_leaves(self, rows: DataFrame) -> DataFrame:
        leaf = F.transform(vector_to_array("leaf"), lambda x: x.cast("int"))
        return self.model.transform(rows).withColumn("_leaf", leaf).drop("features", "prediction", "leaf")

    def _fit_raw(self, rows: DataFrame) -> None:
        from pyspark.ml import Pipeline

        grows = F.pmod(F.xxhash64("valid_time"), F.lit(2)) == 0
        assembler = VectorAssembler(inputCols=self.feature_names, outputCol="features")
        self.model = Pipeline(stages=[assembler, self._estimator()]).fit(rows.filter(grows))
        fallen = self._in_leaves(rows.filter(~grows)).select("target", F.posexplode("_leaf").alias("tree", "leaf"))
        ranks = {q: quantile_rank(p) for q, p in zip(QUANTILE_COLUMNS, QUANTILES, strict=True)}
        self.leaves = durable(order_statistics(fallen, keys=["tree", "leaf"], value="target", ranks=ranks))

    def _table(self) -> DataFrame:
        """All leaves in one row: per tree an array by leaf number, so that a prediction is a lookup by position."""
        numbered = self.leaves.groupBy("tree").agg(
            F.map_from_entries(F.collect_list(F.struct("leaf", F.struct(*QUANTILE_COLUMNS)))).alias("_m"), F.max("leaf").alias("_last")
        )
        placed = numbered.select("tree", F.transform(F.sequence(F.lit(0), "_last"), lambda i: F.try_element_at("_m", i)).alias("_q"))
        row = placed.agg(F.map_from_entries(F.collect_list(F.struct("tree", "_q"))).alias("_t"))
        return row.select(F.transform(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: F.try_element_at("_t", t)).alias("_leaves"))

    def raw_quantiles(self, rows: DataFrame) -> DataFrame:
        """Leaves that no estimation row fell into are left out of the mean."""
        table = F.broadcast(self._table())
        found = F.filter(F.zip_with("_leaves", "_leaf", lambda leaves, i: F.get(leaves, i)), lambda q: q.isNotNull())
        joined = self._in_leaves(rows).crossJoin(table).withColumn("_found", found)

        def mean(name: str) -> Column:
            total = F.aggregate("_found", F.lit(0.0), lambda total, leaf: total + leaf[name])
            return F.try_divide(total, F.size("_found"))

        return monotone(joined.withColumns({q: mean(q) for q in QUANTILE_COLUMNS}).drop("_leaf", "_leaves", "_found"))

    def _save_raw(self, path: str) -> None:
        self.model.save(f"{path}/raw")
        self.leaves.write.parquet(f"{path}/leaves")

    def _load_raw(self, spark: SparkSession, path: str) -> None:
        self.model = PipelineModel.load(f"{path}/raw")
        self.leaves = spark.read.parquet(f"{path}/leaves")


class RobustLinearForecaster(PooledRegressionForecaster):
    model_name = "robust-linear-quantile"

    def _estimator(self):
        return LinearRegression(labelCol="target", loss="huber", maxIter=30, regParam=1e-3)


class StackedForecaster(QuantileForecaster):
    """Weighted blend of three learners; calibration happens on the blended output."""

    model_name = "stacked-quantile"
    splitter = staticmethod(split_last_periods)

    def __init__(self, *args: Any, members: Sequence[QuantileForecaster] | None = None, **kwargs: Any) -> None:
        super().__init__(*args, **kwargs)
        self.members = list(members) if members else [
            BoostedTreesForecaster(self.keys),
            RandomForestForecaster(self.keys),
            SeasonalQuantileForecaster(self.keys),
        ]
        if len(self.members) != len(STACK_WEIGHTS):
            raise ValueError(f"a stacked forecaster has {len(STACK_WEIGHTS)} members")

    def _fit_raw(self, rows: DataFrame) -> None:
        for member in self.members:
            member.fit(rows, feature_names=self.feature_names)

    def raw_quantiles(self, rows: DataFrame) -> DataFrame:
        out = rows
        for i, member in enumerate(self.members, start=1):
            out = member.raw_quantiles(out).withColumnsRenamed({q: f"{q}_{i}" for q in QUANTILE_COLUMNS})
        blended = stacked_blend(out, STACK_WEIGHTS)
        return blended.drop(*[f"{q}_{i}" for q in QUANTILE_COLUMNS for i in (1, 2, 3)])

    def feature_importances(self, spark: SparkSession) -> DataFrame:
        """First and second member's importances, weighted 0.6 and 0.4."""
        parts = [
            m.feature_importances(spark).withColumn("importance", F.col("importance") * w)
            for m, w in zip(self.members, (0.6, 0.4), strict=False)
        ]
        stacked = reduce(DataFrame.unionByName, parts)
        return stacked.groupBy("feature").agg(F.sum("importance").alias("importance"))

    def _save_raw(self, path: str) -> None:
        spark = SparkSession.active()
        for i, member in enumerate(self.members):
            member.save(spark, f"{path}/member{i}")

    def _load_raw(self, spark: SparkSession, path: str) -> None:
        self.members = [QuantileForecaster.load(spark, f"{path}/member{i}") for i in range(len(STACK_WEIGHTS))]


class DualHorizonForecaster(QuantileForecaster):
    """A short-lead and a long-lead model, blended by each row's own lead."""

    model_name = "dual-horizon-quantile"
    splitter = staticmethod(split_last_periods)

    def __init__(
        self,
        *args: Any,
        switch_steps: int = 24,
        short: QuantileForecaster | None = None,
        long: QuantileForecaster | None = None,
        **kwargs: Any,
    ) -> None:
        super().__init__(*args, **kwargs)
        self.switch_steps = switch_steps
        self.short = short or BoostedTreesForecaster(self.keys)
        self.long = long or BoostedTreesForecaster(self.keys)

    def _parts(self, rows: DataFrame) -> list[tuple[QuantileForecaster, list[str], DataFrame]]:
        """Each model with its features and its rows: leads up to the switch, and from it on."""
        if "horizon_step" not in rows.columns:
            raise ValueError("rows need the lead of each forecast in horizon_step")
        lead = F.col("horizon_step")
        parts = []
        for model, wanted, own in (
            (self.short, SHORT_HORIZON_FEATURES, lead <= self.switch_steps),
            (self.long, LONG_HORIZON_FEATURES, lead >= self.switch_steps),
        ):
            names = [n for n in wanted if n in self.feature_names]
            if not names:
                raise ValueError(f"none of the features of the {'short' if model is self.short else 'long'} model is given")
            chosen = rows.filter(own)
            parts.append((model, names, rows if chosen.isEmpty() else chosen))
        return parts

    def _fit_raw(self, rows: DataFrame) -> None:
        for model, names, own in self._parts(rows):
            model.fit(own, feature_names=names)

    def raw_quantiles(self, rows: DataFrame) -> DataFrame:
        short = self.short.raw_quantiles(rows).withColumnsRenamed({q: f"{q}_s" for q in QUANTILE_COLUMNS})
        both = self.long.raw_quantiles(short).withColumnsRenamed({q: f"{q}_l" for q in QUANTILE_COLUMNS})
        blended = dual_horizon_blend(both, self.switch_steps)
        return blended.drop(*[f"{q}_{s}" for q in QUANTILE_COLUMNS for s in "sl"])

    def feature_importances(self, spark: SparkSession) -> DataFrame:
        return self.short.feature_importances(spark)

    def _settings(self) -> dict[str, Any]:
        return {"switch_steps": self.switch_steps}

    def _save_raw(self, path: str) -> None:
        spark = SparkSession.active()
        self.short.save(spark, f"{path}/short")
        self.long.save(spark, f"{path}/long")

    def _load_raw(self, spark: SparkSession, path: str) -> None:
        self.short = QuantileForecaster.load(spark, f"{path}/short")
        self.long = QuantileForecaster.load(spark, f"{path}/long")


MODELS = {
    "seasonal": SeasonalQuantileForecaster,
    "boosted_trees": BoostedTreesForecaster,
    "random_forest": RandomForestForecaster,
    "robust_linear": RobustLinearForecaster,
    "leaf_quantile": LeafQuantileForecaster,
    "stacked": StackedForecaster,
    "dual_horizon": DualHorizonForecaster,
}


def create_forecaster(model_type: str = "seasonal", **kwargs: Any) -> QuantileForecaster:
    try:
        return MODELS[model_type](**kwargs)
    except KeyError:
        raise ValueError(f"unknown model_type: {model_type}") from None
