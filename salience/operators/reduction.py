"""Linear reducers: PCA (and linear kernel PCA), truncated SVD, NMF.

A reducer is a driver-side ``Reducer`` of d x K loadings and a mean vector, the
size of a fitted MLlib model.  Loadings come from a randomised range finder over the
rows, so no d x d matrix is formed; each one's largest entry is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.functions.expressions import complete, whole_vector
from salience.operators import rangefinder
from salience.operators.matrix import feature_count, to_long


@dataclass
class Reducer:
    mean: np.ndarray
    loadings: np.ndarray

    def transform(self, samples: DataFrame, name: str = "z") -> DataFrame:
        """Add the reduced vector; Arrow batches times the loading matrix."""
        mean, loadings = self.mean, self.loadings

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if len(batch) == 0:
                    yield pd.Series([], dtype=object)
                    continue
                z = (np.stack(batch.to_numpy()) - mean) @ loadings
                yield pd.Series(list(z), index=batch.index)

        return samples.withColumn(name, project(F.col("features")))

    def loading_table(self, spark: SparkSession) -> DataFrame:
        rows = [(j, [float(v) for v in row]) for j, row in enumerate(self.loadings)]
        return spark.createDataFrame(rows, "feature_id int, weights array<double>")

    def effective_weights(self, beta: np.ndarray, intercept: float) -> tuple[np.ndarray, float]:
        """Collapse reducer and a linear model on z to one weight per feature."""
        w = self.loadings @ np.asarray(beta)
        return w, float(intercept - self.mean @ w)


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    if batch.num_rows:
        yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _loadings(samples: DataFrame, k: int, mean: np.ndarray) -> np.ndarray:
    cells = samples.select(complete(F.col("features"), F.col("sample_id")).alias("features"))
    return rangefinder.singular_vectors(cells, _rows, len(mean), k, mean)[1]


def fit_pca(samples: DataFrame, k: int) -> Reducer:
    """Centred PCA as an SVD of centred rows; kernel PCA with a linear kernel up to sign.

    A matrix of a rank below ``k`` gives as many components as it has.
    """
    vectors = samples.select(whole_vector(samples).alias("v"))
    mean = vectors.agg(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    return Reducer(mean, _loadings(samples, k, mean))


def fit_svd(samples: DataFrame, k: int) -> Reducer:
    """Truncated SVD of the uncentred rows."""
    none = np.zeros(feature_count(samples))
    return Reducer(none, _loadings(samples, k, none))


REDUCERS = {"PCA": fit_pca, "KernelPCA": fit_pca, "SVD": fit_svd}


def reduce_dimensions(
    train: DataFrame, test: DataFrame, method: str, k: int
) -> tuple[DataFrame, DataFrame, Reducer]:
    """Fit on train, transform both."""
    if method not in REDUCERS:
        raise ValueError(f"unknown reducer {method!r}; choose from {sorted(REDUCERS)}")
    reducer = REDUCERS[method](train, k)
    return reducer.transform(train), reducer.transform(test), reducer


def nmf(samples: DataFrame, k: int, iterations: int = 10, seed: int = 0):
    """Non-negative factors by alternating least squares on long triplets.

    Needs integer sample ids and values >= 0.  Returns (sample factors,
    feature factors) as ``(id, factors)``.
    """
    triplets = to_long(samples).select(
        F.col("sample_id").cast("int").alias("user"),
        F.col("feature_id").alias("item"),
        F.col("value").cast("float").alias("rating"),
    )
    model = ALS(
        rank=k, maxIter=iterations, nonnegative=True, regParam=0.01, seed=seed,
        userCol="user", itemCol="item", ratingCol="rating",
    ).fit(triplets)
    return (
        model.userFactors.withColumnRenamed("features", "factors"),
        model.itemFactors.withColumnRenamed("features", "factors"),
    )


def projection_2d(samples: DataFrame) -> DataFrame:
    """Two-component projection with labels."""
    z = fit_pca(samples, 2).transform(samples)
    return z.select(
        "sample_id", "output", F.get("z", F.lit(0)).alias("pc1"), F.get("z", F.lit(1)).alias("pc2")
    )
