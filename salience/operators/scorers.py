"""Scorers: turn a sample's features into P(output = 1).

A linear scorer is a one-row table ``(w ARRAY<DOUBLE>, bias DOUBLE)``; its
length is one sample row, so it travels as a scalar subquery.  Any fitted
MLlib classifier can be used through :func:`score_with_model`.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.functions.expressions import dot, sigmoid, whole_vector
from salience.session import cut_lineage


def class_means(samples: DataFrame) -> DataFrame:
    """One row with the feature-mean arrays ``m0`` and ``m1`` of both classes.

    ``Summarizer`` adds up whole vectors on the map side, so one vector per
    class and task is shuffled rather than one row per value.
    """
    per_class = (
        samples.select("output", whole_vector(samples).alias("_v"))
        .groupBy("output")
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("mu"))
    )
    return per_class.agg(
        F.max(F.when(F.col("output") == 0, F.col("mu"))).alias("m0"),
        F.max(F.when(F.col("output") == 1, F.col("mu"))).alias("m1"),
    )


def fit_centroid(samples: DataFrame) -> DataFrame:
    """Linear scorer through the class centroids: w = m1 - m0, midpoint bias.

    Fitting is an action, as in MLlib: the one-row model is written out, so
    that scoring it several times does not fit it again.
    """
    means = class_means(samples).withColumn(
        "w", F.zip_with("m1", "m0", lambda a, b: a - b)
    )
    middle = F.zip_with("m1", "m0", lambda a, b: (a + b) / 2.0)
    return cut_lineage(means.select("w", (-dot(F.col("w"), middle)).alias("bias")))


def linear_scorer(spark: SparkSession, weights: list[float], bias: float) -> DataFrame:
    """Linear scorer from fitted coefficients."""
    return spark.createDataFrame(
        [([float(v) for v in weights], float(bias))], "w array<double>, bias double"
    )


def attach_scorer(df: DataFrame, scorer: DataFrame) -> DataFrame:
    """Add columns ``w`` and ``bias`` from a one-row scorer."""
    packed = scorer.select(F.struct("w", "bias").alias("_s")).scalar()
    return (
        df.withColumn("_s", packed)
        .withColumn("w", F.col("_s.w"))
        .withColumn("bias", F.col("_s.bias"))
        .drop("_s")
    )


def score_linear(samples: DataFrame, scorer: DataFrame) -> DataFrame:
    """Add ``margin`` and ``probability``; no shuffle."""
    return (
        attach_scorer(samples, scorer)
        .withColumn("margin", dot(F.col("features"), F.col("w")) + F.col("bias"))
        .withColumn("probability", sigmoid(F.col("margin")))
        .drop("w", "bias")
    )


def score_with_model(rows: DataFrame, model, features: str = "features") -> DataFrame:
    """Add ``probability`` from a fitted MLlib classifier or pipeline."""
    vectors = rows.withColumn("_features", whole_vector(rows, features))
    scored = model.transform(vectors)
    return scored.withColumn(
        "probability", F.get(vector_to_array("probability"), 1)
    ).select(*rows.columns, "probability")
