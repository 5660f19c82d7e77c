"""Remaining-useful-life models on Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaflow import fixed_values as V
from rotaflow.functions import rules
from rotaflow.operators.features import TrainingBatches
from rotaflow.operators.machine_models import merged
from rotaflow.schemas import feature_names
from rotaflow.session import cut_lineage, free_shuffles

MODEL_TYPES = ("random_forest", "gradient_boosting", "linear")


@dataclass(frozen=True)
class Trained:
    model: PipelineModel
    features: list[str]
    metrics: DataFrame
    importance: DataFrame


def _regressor(model_type: str, label: str, seed: int, trees: int):
    common = {"featuresCol": "scaled", "labelCol": label, "predictionCol": "prediction"}
    if model_type == "random_forest":
        return RandomForestRegressor(
            numTrees=trees,
            maxDepth=10,
            minInstancesPerNode=2,
            featureSubsetStrategy="all",
            # for the histograms of each task that runs, so a multiple of it in an executor; the trees do not depend on it
            maxMemoryInMB=256,
            seed=seed,
            **common,
        )
    if model_type == "gradient_boosting":
        return GBTRegressor(maxIter=trees, maxDepth=5, stepSize=0.1, seed=seed, **common)
    if model_type == "linear":
        # a tiny ridge keeps collinear features from blowing up; scaling is done before
        return LinearRegression(standardization=False, regParam=1e-6, **common)
    raise ValueError(f"unknown model type {model_type}; one of {MODEL_TYPES}")


def stored(split: DataFrame) -> DataFrame:
    """The table, kept in the shared folder: every pass of a fit reads it again, and so may what predicts."""
    return cut_lineage(split)


_MOMENTS = "n long, wrong long, mean array<double>, scatter array<double>"


def _values(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])


def _task_moments(columns: list[str]):
    """Count, means and scatter matrix of a task's rows that are no test rows, and how many hold a value that is no finite number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wrong = None, 0
        for batch in batches:
            values = _values(batch, columns)[~batch.column("is_test").to_numpy(zero_copy_only=False).astype(bool)]
            fine = np.isfinite(values).all(axis=1)
            wrong += int((~fine).sum())
            values = values[fine]
            if len(values):
                mean = values.mean(axis=0)
                own = (len(values), mean, (values - mean).T @ (values - mean))
                total = own if total is None else merged(total, own)
        n, mean, scatter = total or (0, np.zeros(0), np.zeros(0))
        lists = [pa.array([x.ravel().tolist()], pa.list_(pa.float64())) for x in (mean, scatter)]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([wrong], pa.int64()), *lists], ["n", "wrong", "mean", "scatter"])

    return run


def _gathered(made: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of all tasks together: a row per task, as large as the square of the number of features."""
    total = None
    for row in made.collect():
        if row["wrong"]:
            raise ValueError(f"{row['wrong']} rows of a task have a feature or label that is missing or no finite number")
        if row["n"]:
            own = (row["n"], np.array(row["mean"]), np.array(row["scatter"]).reshape(len(row["mean"]), -1))
            total = own if total is None else merged(total, own)
    if total is None:
        raise ValueError("there are no rows to train on")
    return total


def _like(n: int, mean: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    """A few rows, two per direction, with the means and the (population) covariances of all ``n``."""
    scale = np.sqrt(np.diag(scatter))
    moving = np.flatnonzero(scale > 0)
    if not len(moving):
        return mean[None]
    values, directions = np.linalg.eigh(scatter[np.ix_(moving, moving)] / np.outer(scale[moving], scale[moving]))
    steps = np.zeros((len(moving), len(mean)))
    steps[:, moving] = (directions * np.sqrt(np.maximum(values, 0.0) * len(moving) / n)).T * scale[moving]
    return np.concatenate([mean + steps, mean - steps])


def _spread(table: DataFrame) -> DataFrame:
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def train_rul(
    split: DataFrame,
    label: str = "rul_days",
    model_type: str = "random_forest",
    features: Sequence[str] | None = None,
    seed: int = 42,
    trees: int = 100,
    is_stored: bool = False,
) -> Trained:
    """Fits scaler and regressor on the rows with ``is_test`` false.

    ``split`` carries the features, the label and ``is_test`` (the last share of
    each machine's history). One model serves the fleet; filter ``split`` on a
    machine for a model of its own. Metrics cover both parts. The fit reads the
    table several times and stores it before, unless it is a stored one (``is_stored``).

    A linear model is fitted to moments, see ``_line_stages``.
    """
    names = list(features or feature_names())
    regressor = _regressor(model_type, label, seed, trees)
    split = split.select(*names, F.col(label).cast("double").alias(label), "is_test")
    split = _spread(split if is_stored else stored(split))
    if model_type == "linear":
        doubles = split.select(*[F.col(c).cast("double").alias(c) for c in (*names, label)], "is_test")
        moments = _gathered(doubles.mapInArrow(_task_moments([*names, label]), _MOMENTS))
        model = PipelineModel(_line_stages(split.sparkSession, names, label, moments))
    else:
        scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)
        stages = [VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="error"), scaler, regressor]
        model = Pipeline(stages=stages).fit(split.where(~F.col("is_test")).select(*names, label))
    scored = model.transform(split).select("is_test", label, "prediction")
    spark = split.sparkSession
    return Trained(
        model, names, regression_metrics(scored, label), feature_importance(spark, model, names)
    )


def _line_stages(spark: SparkSession, names: list[str], label: str, moments: tuple) -> list:
    """Assembler, scaler and linear model.

    They are fitted to a few rows that have the moments of all, so the data is read once; a summary of the model itself would be of those rows.
    """
    n, mean, scatter = moments
    assembler = VectorAssembler(inputCols=names, outputCol="raw", handleInvalid="error")
    few = lambda rows: assembler.transform(spark.createDataFrame(rows.tolist(), [*names, label]).coalesce(1))
    apart = np.sqrt(np.diag(scatter) / max(n - 1, 1) / 2)  # two rows whose sample deviations are those of all
    scaler = StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True).fit(few(np.stack([mean + apart, mean - apart])))
    return [assembler, scaler, _regressor("linear", label, 0, 0).fit(scaler.transform(few(_like(n, mean, scatter))))]


def train_line(spark: SparkSession, batches: TrainingBatches, label: str = "rul_days") -> Trained:
    """``train_rul`` with a linear model over all features, in two passes over batches; no wide table is written or read."""
    names = feature_names()
    moments = _gathered(batches.through(_task_moments([*names, label]), _MOMENTS))
    free_shuffles(spark)
    stages = _line_stages(spark, names, label, moments)
    _, scaler, line = stages
    scales, centre = np.array(scaler.std.toArray()), np.array(scaler.mean.toArray())
    weights = np.divide(line.coefficients.toArray(), scales, out=np.zeros(len(names)), where=scales > 0)
    intercept = line.intercept

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = _values(batch, names)
            if not np.isfinite(x).all():
                raise ValueError("a feature is missing or no finite number")
            prediction = pa.array((x - centre) @ weights + intercept)
            yield pa.RecordBatch.from_arrays([batch.column("is_test"), batch.column(label), prediction], ["is_test", label, "prediction"])

    scored = batches.through(run, f"is_test boolean, {label} double, prediction double")
    model = PipelineModel(stages)
    return Trained(model, names, regression_metrics(scored, label), feature_importance(spark, model, names))


def regression_metrics(scored: DataFrame, label: str = "rul_days") -> DataFrame:
    """MAE, RMSE and R² for the training and the test part, in one pass."""
    error = F.col("prediction") - F.col(label)
    return (
        scored.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("part"))
        .agg(
            F.count("*").alias("readings"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (1 - F.try_divide(F.avg(error * error), F.var_pop(label))).alias("r2"),
        )
    )


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str]) -> DataFrame:
    """Importance per feature; empty for models without importances."""
    fitted = model.stages[-1]
    values = getattr(fitted, "featureImportances", None)
    rows = [] if values is None else list(zip(names, [float(x) for x in values.toArray()]))
    return spark.createDataFrame(rows, "feature string, importance double")


def feature_importance_topk(importance: DataFrame, k: int = 10) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


def predict_rul(
    model: PipelineModel,
    features: DataFrame,
    names: Sequence[str] | None = None,
    level: float = 0.95,
) -> DataFrame:
    """Prediction, interval, probability and the five strongest factors per row.

    For a forest the interval is the spread of its trees, computed by one column
    per tree; other models get the plain -20 % / +20 % range.
    """
    names = list(names or feature_names())
    scored = model.transform(features)
    fitted = model.stages[-1]
    rul = F.col("prediction")
    if hasattr(fitted, "trees") and "RandomForest" in type(fitted).__name__:
        columns = []
        for number, tree in enumerate(fitted.trees):
            tree.setFeaturesCol("scaled").setPredictionCol(f"_tree_{number}")
            scored = tree.transform(scored)
            columns.append(f"_tree_{number}")
        z = round(NormalDist().inv_cdf(0.5 + level / 2), 2)
        trees = F.array(*columns)
        mean = F.aggregate(trees, F.lit(0.0), lambda a, x: a + x) / len(columns)
        square = F.aggregate(trees, F.lit(0.0), lambda a, x: a + x * x) / len(columns)
        margin = F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)) * z
        lower, upper = rul - margin, rul + margin
    else:
        lower, upper = rul * 0.8, rul * 1.2
    importances = getattr(fitted, "featureImportances", None)
    weights = [1.0] * len(names) if importances is None else importances.toArray().tolist()
    return scored.select(
        "well_id",
        "ts",
        rul.alias("rul_days"),
        F.greatest(F.lit(0.0), lower).alias("rul_lower"),
        upper.alias("rul_upper"),
        rules.failure_probability(rul).alias("failure_probability"),
        contributing_factors(names, weights).alias("contributing_factors"),
        rules.edge_prediction(rul).alias("prediction"),
    )


def contributing_factors(names: Sequence[str], weights: Sequence[float], k: int = 5):
    """Names of the ``k`` features with the largest weighted absolute value."""
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(
                    (-F.abs(F.col(n)) * float(w)).alias("w"), F.lit(n).alias("name")
                )
                for n, w in zip(names, weights)
            ]
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda e: e["name"])


def save_model(trained: Trained, path: str, model_type: str, name: str) -> None:
    """Pipeline, ordered feature names, metrics, importances and metadata under ``path``."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    spark = trained.metrics.sparkSession
    ordered = spark.createDataFrame(list(enumerate(trained.features)), "position int, feature string")
    ordered.write.mode("overwrite").parquet(f"{path}/features")
    trained.metrics.write.mode("overwrite").parquet(f"{path}/metrics")
    trained.importance.write.mode("overwrite").parquet(f"{path}/importance")
    model_metadata(spark, name, model_type).write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    """Saved pipeline and its feature names in training order (a few dozen)."""
    rows = spark.read.parquet(f"{path}/features").orderBy("position").collect()
    return PipelineModel.load(f"{path}/pipeline"), [r["feature"] for r in rows]


def model_metadata(
    spark: SparkSession, name: str, model_type: str, version: str = V.MODEL_VERSION
) -> DataFrame:
    """One row describing a saved model."""
    return spark.createDataFrame(
        [(version, name, datetime.now(timezone.utc).replace(tzinfo=None), model_type, V.FRAMEWORK)],
        "version string, pump_name string, created_at timestamp_ntz, model_type string, "
        "framework string",
    )
