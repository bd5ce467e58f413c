"""Boosted trees: fit, scores, storage, and held-out scores of folds that are trained side by side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import settled

#: The usual trees of the model.
DEFAULTS = {"maxIter": 300, "maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8, "seed": 42}
_X, _W, _Y = "__features", "__weight", "__label"


def _finite(c: str) -> Column:
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def class_weights(labels: DataFrame, label: str) -> tuple[float, float]:
    """Weights that give both classes half of the whole: one aggregate. A missing class is an error."""
    n = labels.agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b")).first()
    if not n.a or not n.b:
        raise ValueError(f"labels of both classes are needed, got {n.a} of 0 and {n.b} of 1")
    return (n.a + n.b) / (2 * n.a), (n.a + n.b) / (2 * n.b)


def fit(rows: DataFrame, features: Sequence[str], label: str = "label", balanced: bool = True, **trees) -> PipelineModel:
    """A pipeline of medians for missing values, the features in the given order and boosted trees, from the rows whose label is 0 or 1.

    ``trees`` overrides ``DEFAULTS``. Values that are null or not finite count as missing; a feature without any value is an error."""
    x = rows.where(F.col(label).isin(0, 1)).select(*[_finite(f).alias(f"__{f}") for f in features], F.col(label).cast("double").alias(_Y))
    x = settled(x, "training")
    low, high = class_weights(x, _Y) if balanced else (1.0, 1.0)
    x = x.withColumn(_W, F.when(F.col(_Y) == 1, high).otherwise(low))
    inputs = [f"__{f}" for f in features]
    filled = [f"__filled_{f}" for f in features]
    boosted = GBTClassifier(featuresCol=_X, labelCol=_Y, weightCol=_W, predictionCol="__predicted", **(DEFAULTS | trees))
    for param, column in ((boosted.rawPredictionCol, "__raw"), (boosted.probabilityCol, "__probability")):
        boosted.set(param, column)
    stages = [Imputer(inputCols=inputs, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol=_X), boosted]
    return Pipeline(stages=stages).fit(x)


def feature_names(model: PipelineModel) -> list[str]:
    """The features that the model was fitted on, in its order: they are part of what is saved."""
    return [c[2:] for c in model.stages[0].getInputCols()]


def score(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    """``rows`` with ``name``, the probability of class 1. Features are found by name in any order; a missing one is an error, further columns stay."""
    names = feature_names(model)
    missing = [f for f in names if f not in rows.columns]
    if missing:
        raise ValueError(f"features {missing} are missing")
    x = model.transform(rows.withColumns({f"__{f}": _finite(f) for f in names}))
    return x.withColumn(name, vector_to_array("__probability")[1]).select(*[F.col(f"`{c}`") for c in rows.columns if c != name], name)


def importances(model: PipelineModel) -> dict[str, float]:
    return dict(zip(feature_names(model), map(float, model.stages[-1].featureImportances.toArray()), strict=True))


def save(model: PipelineModel, path: str) -> None:
    """Overwrites ``path`` with the whole pipeline: medians, the features' order, trees."""
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.read().session(spark).load(path)


def held_out(rows: DataFrame, features: Sequence[str], label: str = "label", parallel: int = 4, **trees) -> DataFrame:
    """The test rows of each fold (columns ``fold, role``) with ``p``, from a model of its train rows. Up to ``parallel`` models are trained at once;
    each is a job of its own on the cluster. A fold whose train rows lack a class has no scores."""
    rows = settled(rows.where(F.col("role").isin("train", "test")), "folds")
    counts = rows.where("role = 'train'").groupBy("fold").agg(F.count_if(F.col(label) == 0).alias("a"), F.count_if(F.col(label) == 1).alias("b"))
    folds = sorted(r.fold for r in counts.where("a > 0 and b > 0").collect())  # one row a fold

    def one(fold: int) -> DataFrame:
        part = rows.where(F.col("fold") == fold)
        return score(fit(part.where("role = 'train'"), features, label, **trees), part.where("role = 'test'"))

    with ThreadPool(max(1, min(parallel, len(folds)))) as pool:
        scored = pool.map(one, folds)
    return reduce(DataFrame.unionByName, scored) if scored else rows.where("false").withColumn("p", F.lit(0.0))
