"""Two-stage scoring with gradient-boosted trees: out-of-fold stacking and self-training, and interfaces for outside models."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Scorer(Protocol):
    """A pair scorer from outside: adds ``out`` to rows with the columns q_text and p_text."""

    def __call__(self, pairs: DataFrame, out: str) -> DataFrame: ...


def lexical_scorer(pairs: DataFrame, out: str = "score") -> DataFrame:
    """The default pair scorer: token-sort similarity of the two texts."""
    from kinweave.functions.kernels import token_sort_ratio_udf

    return pairs.withColumn(out, token_sort_ratio_udf("q_text", "p_text"))


def split_digit(id_column: str = "q", modulus: int = 10):
    """The group split: the id modulo ``modulus``, never negative."""
    return F.pmod(F.col(id_column), F.lit(modulus)).cast("long")


def fit(train: DataFrame, features: list[str], label: str = "y", trees: int = 30, depth: int = 5, rate: float = 0.1, min_leaf: int = 1, validation: str | None = None, seed: int = 1) -> PipelineModel:
    """A GBT pipeline; ``validation`` names a boolean column of rows for early stopping."""
    gbt = GBTClassifier(
        featuresCol="features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, minInstancesPerNode=min_leaf, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(train)


def predict(model: PipelineModel, rows: DataFrame, out: str = "s") -> DataFrame:
    scored = model.transform(rows).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("features", "rawPrediction", "probability", "prediction")


def importances(model: PipelineModel, features: list[str], n: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])[:n]


def out_of_fold(rows: DataFrame, features: list[str], group: str = "q", folds: int = 5, out: str = "s", **options) -> DataFrame:
    """Each row scored by a model that saw none of its group."""
    parts = None
    fold = split_digit(group, folds)
    for i in range(folds):
        part = predict(fit(rows.filter(fold != i), features, **options), rows.filter(fold == i), out)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def pseudo_labels(scored: DataFrame, low: float = 0.05, high: float = 0.95, score: str = "s", label: str = "y") -> DataFrame:
    """The confident rows, labelled by their score."""
    return scored.filter((F.col(score) >= high) | (F.col(score) <= low)).withColumn(label, (F.col(score) >= high).cast("double"))


def self_train(labelled: DataFrame, target: DataFrame, features: list[str], rounds: int = 3, **options) -> DataFrame:
    """The target rows with a score; after every fit but the last, its confident target rows join the labelled ones anew."""
    names = [*features, options.get("label", "y")]
    train = labelled
    for i in range(rounds):
        scored = predict(fit(train, features, **options), target)
        if i + 1 < rounds:
            train = labelled.select(*names).unionByName(pseudo_labels(scored).select(*names))
    return scored


def two_stage(train: DataFrame, test: DataFrame, features: list[str], context: Callable[[DataFrame], DataFrame], context_names: list[str],
              first: dict | None = None, second: dict | None = None, stop: tuple[int, int] | None = None, **options) -> DataFrame:
    """Stage 1 scored out of fold on the training rows, context features of its scores, stage 2 over both.

    ``first`` and ``second`` are options of one stage; ``stop`` names the last
    digits of the queries on which stage 1 and stage 2 stop early; a stage does
    not train on its own.
    """
    one, two = options | (first or {}), options | (second or {})
    held = lambda rows, i: rows.withColumn("_stop", split_digit() == stop[i])
    scored = out_of_fold(train, features, **one)
    if stop is None:
        stage1, stage2 = fit(train, features, **one), fit(context(scored), [*features, *context_names], **two)
    else:
        stage1 = fit(held(train, 0), features, validation="_stop", **one)
        stage2 = fit(held(context(scored), 1), [*features, *context_names], validation="_stop", **two)
    return predict(stage2, context(predict(stage1, test)).withColumnRenamed("s", "s1"), "s")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_or_load(path: str, make: Callable[[], PipelineModel]) -> PipelineModel:
    """The model of that path, made and saved if it is not there (a run that was broken off goes on behind its last model)."""
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    try:
        return load(path)
    except (PySparkException, Py4JJavaError):
        save(make(), path)
        return load(path)
