"""Classifier factories on MLlib, by name."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.sql import DataFrame

from salience.functions.expressions import whole_vector

# Hidden layer widths of the perceptron.
HIDDEN_LAYERS = [64, 32, 32, 16]
COLUMNS = {"featuresCol": "_features", "labelCol": "output"}


def logistic(input_dim: int, seed: int = 0, max_iter: int = 100) -> LogisticRegression:
    return LogisticRegression(maxIter=max_iter, **COLUMNS)


def perceptron(
    input_dim: int, seed: int = 0, max_iter: int = 100
) -> MultilayerPerceptronClassifier:
    """Sigmoid hidden units and no dropout (what MLlib offers)."""
    return MultilayerPerceptronClassifier(
        layers=[input_dim, *HIDDEN_LAYERS, 2], seed=seed, maxIter=max_iter, **COLUMNS
    )


def boosted_trees(input_dim: int, seed: int = 0, max_iter: int = 20) -> GBTClassifier:
    """Third, non-linear member of the consensus."""
    return GBTClassifier(maxIter=max_iter, maxDepth=3, seed=seed, **COLUMNS)


FACTORIES = {"log": logistic, "mlp": perceptron, "gbt": boosted_trees}


def create_model(name: str, input_dim: int, seed: int = 0, **options):
    if name not in FACTORIES:
        raise ValueError(f"unknown model {name!r}; choose from {sorted(FACTORIES)}")
    return FACTORIES[name](input_dim, seed, **options)


def vectorised(samples: DataFrame, features: str = "features") -> DataFrame:
    return samples.withColumn("_features", whole_vector(samples, features))


def fit_model(
    name: str, samples: DataFrame, input_dim: int, seed: int = 0, features: str = "features",
    **options,
) -> PipelineModel:
    """Fit on ``(output, features)``; the result scores ``_features``."""
    estimator = create_model(name, input_dim, seed, **options)
    return Pipeline(stages=[estimator]).fit(vectorised(samples, features))
