"""Rival importance methods: surrogates, Shapley values and local models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.functions.expressions import binarise, whole_vector
from salience.operators.reduction import Reducer
from salience.operators.scan import dense_position
from salience.operators.scorers import attach_scorer, score_with_model

Predict = Callable[[np.ndarray], np.ndarray]


def fit_surrogate(scored: DataFrame):
    """L2 logistic model of the binarised predictions on the original features.

    ``regParam = 1/n`` corresponds to unit inverse regularisation on the
    summed loss.
    """
    rows = scored.select(
        whole_vector(scored).alias("_features"),
        binarise(F.col("probability")).alias("target"),
    )
    n = rows.count()
    return LogisticRegression(
        maxIter=1000, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False,
        featuresCol="_features", labelCol="target",
    ).fit(rows)


def coefficient_table(spark: SparkSession, weights) -> DataFrame:
    """``(feature_id, importance)`` from a fitted coefficient vector."""
    rows = [(j, float(w)) for j, w in enumerate(weights)]
    return spark.createDataFrame(rows, "feature_id int, importance double")


def surrogate_importance(scored: DataFrame) -> DataFrame:
    model = fit_surrogate(scored)
    return coefficient_table(scored.sparkSession, model.coefficients.toArray())


def linear_shap(
    explained: DataFrame, background: DataFrame, scorer: DataFrame, agg: str = "mean"
) -> DataFrame:
    """Shapley values of a linear model: ``w_j * (x_j - mean background_j)``.

    ``agg`` is ``mean`` (signed) or ``mean_abs``; the signed mean over its own
    background is zero.
    """
    if agg not in ("mean", "mean_abs"):
        raise ValueError("agg must be 'mean' or 'mean_abs'")
    centre = background.select(whole_vector(background).alias("v")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mu")
    )
    ready = attach_scorer(explained, scorer).withColumn("mu", centre.scalar())
    gaps = F.zip_with("features", "mu", lambda x, m: x - m)
    rows = ready.select(
        F.posexplode(F.zip_with(gaps, F.col("w"), lambda g, w: g * w)).alias("feature_id", "shap")
    )
    value = F.col("shap") if agg == "mean" else F.abs("shap")
    return rows.groupBy("feature_id").agg(F.avg(value).alias("importance"))


def surrogate_shap(scored: DataFrame, agg: str = "mean") -> DataFrame:
    """Linear Shapley values of the surrogate over its own data."""
    from salience.operators.scorers import linear_scorer

    model = fit_surrogate(scored)
    scorer = linear_scorer(scored.sparkSession, model.coefficients, model.intercept)
    return linear_shap(scored, scored, scorer, agg)


def map_to_features(component_shap: np.ndarray, reducer: Reducer, spark: SparkSession) -> DataFrame:
    """Mean component values times loadings: one value per original feature."""
    loadings = reducer.loading_table(spark)
    weights = F.array(*[F.lit(float(v)) for v in component_shap])
    mapped = F.aggregate(
        F.zip_with("weights", weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    return loadings.select("feature_id", mapped.alias("importance"))


def inverse_shap_linear(
    reduced: DataFrame, background: DataFrame, beta: np.ndarray, reducer: Reducer
) -> DataFrame:
    """Shapley values of a linear model on ``z``, mapped back through the loadings."""
    mean = lambda df: df.agg(
        Summarizer.mean(array_to_vector("z")).alias("m")
    ).first()["m"].toArray()
    gaps = mean(reduced) - mean(background)
    return map_to_features(np.asarray(beta) * gaps, reducer, reduced.sparkSession)


def component_shap_sampled(
    reduced: DataFrame, background: DataFrame, model, orders: int = 10, seed: int = 0
) -> DataFrame:
    """Sampled Shapley values on ``z`` for any fitted classifier: (component, shap).

    Each sample meets ``orders`` rows drawn from the whole background by a seeded
    hash.  In a seeded order the components of the background row are exchanged for
    the sample's, one by one; a score after the t-th exchange counts for the t-th
    component and against the next one, so no scores need to meet again.
    """
    placed = dense_position(
        background.select(F.col("z").alias("base"), F.struct(
            F.xxhash64("sample_id", F.lit(seed)), F.col("sample_id")).alias("_by")),
        [], "_by", "_at", size="_rows",
    )
    total = placed.agg(F.max("_rows")).scalar()
    draws = reduced.select(
        "sample_id", "z", F.explode(F.sequence(F.lit(1), F.lit(orders))).alias("draw")
    ).withColumn(
        "_at", F.pmod(F.xxhash64("sample_id", "draw", F.lit(seed + 1)), total) + 1
    )
    places = F.sequence(F.lit(0), F.size("z") - 1)
    order = F.transform(
        F.array_sort(F.transform(places, lambda c: F.struct(
            F.xxhash64(F.col("sample_id"), F.col("draw"), c, F.lit(seed + 2)).alias("by"),
            c.alias("c")))),
        lambda s: s["c"],
    )
    steps = draws.join(placed, "_at").withColumn("order", order).select(
        "z", "base", "order", F.explode(F.sequence(F.lit(0), F.size("z"))).alias("t")
    )
    mixed = F.transform("z", lambda v, c: F.when(
        F.array_position("order", c) <= F.col("t"), v).otherwise(F.get("base", c)))
    scored = score_with_model(steps.select("order", "t", mixed.alias("mixed")), model, "mixed")
    moves = F.array(
        F.struct(F.get("order", F.col("t") - 1).alias("component"), F.col("probability").alias("v")),
        F.struct(F.get("order", F.col("t")).alias("component"), (-F.col("probability")).alias("v")),
    )
    rows = reduced.agg(F.count(F.lit(1))).scalar()
    return (
        scored.select(F.inline(moves)).where("component IS NOT NULL")
        .groupBy("component").agg(F.sum("v").alias("v"))
        .select("component", (F.col("v") / (rows * orders)).alias("shap"))
    )


def inverse_shap_sampled(
    reduced: DataFrame, background: DataFrame, model, reducer: Reducer, orders: int = 10,
    seed: int = 0,
) -> DataFrame:
    """Sampled Shapley values of a classifier on ``z``, mapped back through the loadings."""
    # One number per component, as wide as one row of z.
    found = component_shap_sampled(reduced, background, model, orders, seed).orderBy("component")
    return map_to_features(
        np.array([r["shap"] for r in found.collect()]), reducer, reduced.sparkSession
    )


def linear_predict(weights, bias: float) -> Predict:
    w = np.asarray(weights, dtype=float)
    return lambda x: 1.0 / (1.0 + np.exp(-(x @ w + bias)))


def _ridge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, alpha: float) -> np.ndarray:
    """Weighted ridge coefficients with an unpenalised intercept."""
    share = weight / weight.sum()
    xc, yc = x - share @ x, y - share @ y
    gram = (xc * weight[:, None]).T @ xc + alpha * np.eye(x.shape[1])
    return np.linalg.solve(gram, (xc * weight[:, None]).T @ yc)


def local_surrogate(
    explained: DataFrame,
    train: DataFrame,
    predict: Predict,
    num_samples: int = 5000,
    num_features: int = 10,
    seed: int = 0,
) -> DataFrame:
    """Mean local-surrogate coefficient per feature.

    For each instance: seeded normal draws around the training mean with the
    training spread, an exponential kernel of width 0.75*sqrt(d), the
    ``num_features`` strongest features by a light ridge, and a weighted ridge
    on those.  Other features count as zero in the mean.  Explains class 1.
    """
    stats = train.select(whole_vector(train).alias("v")).agg(
        Summarizer.mean(F.col("v")).alias("m"), Summarizer.std(F.col("v")).alias("s")
    ).first()
    mean, scale = stats["m"].toArray(), stats["s"].toArray()
    scale = np.where(scale > 0, scale, 1.0)
    kind = explained.schema["sample_id"].dataType.simpleString()
    keyed = explained.select(
        (F.xxhash64("sample_id") if kind == "string" else F.col("sample_id")).alias("key"),
        "features",
    )

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(mean)
        width = 0.75 * np.sqrt(d)
        total, n = np.zeros(d), 0
        for batch in batches:
            for key, row in zip(batch["key"], batch["features"]):
                rng = np.random.default_rng([seed, int(key) & 0xFFFFFFFF])
                own = (np.asarray(row) - mean) / scale
                z = rng.standard_normal((num_samples, d))
                z[0] = own
                y = predict(z * scale + mean)
                gap = ((z - own) ** 2).sum(axis=1)
                weight = np.sqrt(np.exp(-gap / width**2))
                chosen = np.arange(d)
                if d > num_features:
                    first = _ridge(z, y, weight, 0.01)
                    chosen = np.argsort(-np.abs(first * own), kind="stable")[:num_features]
                total[chosen] += _ridge(z[:, chosen], y, weight, 1.0)
                n += 1
        if n:
            yield pd.DataFrame({"feature_id": range(d), "total": total, "n": n})

    # Instances are CPU-heavy and small, so they are spread by number of cores.
    from salience.session import parallelism

    spread = keyed.repartition(parallelism(explained.sparkSession), "key")
    return (
        spread.mapInPandas(explain, "feature_id int, total double, n bigint")
        .groupBy("feature_id")
        .agg((F.sum("total") / F.sum("n")).alias("importance"))
    )
