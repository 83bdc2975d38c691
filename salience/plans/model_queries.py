"""Queries on fitted models: scores, attributions, sweeps and clusterings.

Fits have no SQL twin; tests check their invariants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.operators import (
    attribution, clustering, importance, manyfits, matrix, models, ranking, reduction, scorers, sweep,
)
from salience.operators.rescoring import Linear
from salience.plans import fixtures
from salience.plans.network_queries import SIMULATIONS, _correlation, _feature_ids
from salience.plans.ranking_queries import REPEATS, SEED, run_rankings, single_ranking
from salience.session import cut_lineage

COMPONENTS = 8


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = matrix.stratified_split(fixtures.samples(spark, sf))
    return (
        cut_lineage(parts.where("is_train").drop("is_train")),
        cut_lineage(parts.where("not is_train").drop("is_train")),
    )


def _width(samples: DataFrame) -> int:
    return matrix.feature_count(samples)


def _scores(spark: SparkSession, sf: str, name: str, **options) -> DataFrame:
    train, test = _parts(spark, sf)
    model = models.fit_model(name, train, _width(train), 1, **options)
    return scorers.score_with_model(test, model).select("sample_id", "output", "probability")


def logistic_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "log", max_iter=50)


def perceptron_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "mlp", max_iter=30)


def boosted_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf, "gbt", max_iter=5)


def pca_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Two-component projection with labels."""
    return reduction.projection_2d(fixtures.samples(spark, sf))


def pca_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    return reduction.reduce_dimensions(train, test, "KernelPCA", COMPONENTS)[1].select(
        "sample_id", "output", "z"
    )


def svd_scores(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    return reduction.reduce_dimensions(train, test, "SVD", COMPONENTS)[1].select(
        "sample_id", "output", "z"
    )


def _components(reducer: reduction.Reducer, samples: DataFrame) -> DataFrame:
    """Loadings of each component, and the sum of squares of the samples along it."""
    along = reducer.transform(samples).select(F.posexplode("z").alias("component", "x"))
    variance = along.groupBy("component").agg(F.round(F.sum(F.col("x") * F.col("x")), 6).alias("variance"))
    loadings = reducer.loading_table(samples.sparkSession).select(
        "feature_id", F.posexplode("weights").alias("component", "loading"))
    return loadings.join(variance, "component").select(
        "component", "feature_id", F.round("loading", 6).alias("loading"), "variance")


def pca_components(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.samples(spark, sf)
    return _components(reduction.fit_pca(samples, 2), samples)


def svd_components(spark: SparkSession, sf: str) -> DataFrame:
    samples = fixtures.samples(spark, sf)
    return _components(reduction.fit_svd(samples, 3), samples)


def nmf_factors(spark: SparkSession, sf: str) -> DataFrame:
    """Non-negative sample factors of the shifted matrix."""
    shifted = fixtures.samples(spark, sf).withColumn(
        "features", F.transform("features", lambda v: v + 1.0)
    )
    return reduction.nmf(shifted, COMPONENTS, iterations=5)[0]


def _reduced_logistic(spark: SparkSession, sf: str):
    train, test = _parts(spark, sf)
    ztrain, ztest, reducer = reduction.reduce_dimensions(train, test, "PCA", COMPONENTS)
    model = models.fit_model("log", ztrain, COMPONENTS, features="z", max_iter=50)
    return train, test, ztrain, ztest, reducer, model


def logistic_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Reducer and logistic model collapse to one weight per feature."""
    _, test, _, _, reducer, model = _reduced_logistic(spark, sf)
    stage = model.stages[-1]
    weights, bias = reducer.effective_weights(stage.coefficients.toArray(), stage.intercept)
    scorer = scorers.linear_scorer(spark, weights, bias)
    return importance.permutation_importance(test, scorer, 5, 2, model="log")


def perceptron_importance(spark: SparkSession, sf: str) -> DataFrame:
    """A perceptron on reduced features: shuffled values move z by a loading row."""
    train, test = _parts(spark, sf)
    ztrain, ztest, reducer = reduction.reduce_dimensions(train, test, "PCA", COMPONENTS)
    model = models.fit_model("mlp", ztrain, COMPONENTS, 1, features="z", max_iter=30)
    return importance.permutation_importance_model(
        ztest, model, REPEATS, model="mlp", loadings=reducer.loading_table(spark)
    )


def boosted_importance(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    model = models.fit_model("gbt", train, _width(train), 1)
    return importance.permutation_importance_model(test, model, REPEATS, model="gbt")


def _centroid(spark: SparkSession, sf: str) -> tuple[DataFrame, Linear]:
    data = fixtures.samples(spark, sf)
    return data, Linear.of_scorer(scorers.fit_centroid(data))


def general_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importance through the interface of any model, of the centroid scorer."""
    data, model = _centroid(spark, sf)
    diffs = importance.permutation_importance_model(data, model, 5, 3, SEED, chunk=24)
    return diffs.select("run_id", "metric", "feature_id", F.round("diff", 8).alias("diff"))


def general_change(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction change through the interface of any model, of the centroid scorer."""
    data, model = _centroid(spark, sf)
    table = importance.prediction_change_model(data, model, _feature_ids(spark, sf), SIMULATIONS, SEED)
    return table.select("sample_id", "feature_id", F.round("avg_change", 9).alias("avg_change"))


def general_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity through the interface of any model, of the centroid scorer."""
    data, model = _centroid(spark, sf)
    table = importance.sensitivity_model(data, model)
    return table.select("feature_id", F.round(F.col("sensitivity") * 1e9, 3).alias("sensitivity_e9"))


def perceptron_change(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction change of a perceptron behind a reducer."""
    train, test = _parts(spark, sf)
    ztrain, ztest, reducer = reduction.reduce_dimensions(train, test, "PCA", COMPONENTS)
    model = models.fit_model("mlp", ztrain, COMPONENTS, 1, features="z", max_iter=30)
    return importance.prediction_change_model(
        ztest, model, _feature_ids(spark, sf), SIMULATIONS, SEED, reducer.loadings)


def boosted_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity of boosted trees."""
    train, test = _parts(spark, sf)
    return importance.sensitivity_model(test, models.fit_model("gbt", train, _width(train), 1))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    model = models.fit_model("log", train, _width(train), max_iter=50)
    return cut_lineage(scorers.score_with_model(test, model))


def surrogate_importance(spark: SparkSession, sf: str) -> DataFrame:
    table = attribution.surrogate_importance(_scored(spark, sf))
    return ranking.magnitude_ranking(table, "importance")


def surrogate_shap(spark: SparkSession, sf: str) -> DataFrame:
    table = attribution.surrogate_shap(_scored(spark, sf), "mean_abs")
    return ranking.magnitude_ranking(table, "importance")


def inverse_mapped_shap(spark: SparkSession, sf: str) -> DataFrame:
    _, _, ztrain, ztest, reducer, model = _reduced_logistic(spark, sf)
    beta = model.stages[-1].coefficients.toArray()
    table = attribution.inverse_shap_linear(ztest, ztrain, beta, reducer)
    return ranking.magnitude_ranking(table, "importance")


def inverse_mapped_shap_sampled(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    ztrain, ztest, reducer = reduction.reduce_dimensions(train, test, "PCA", COMPONENTS)
    model = models.fit_model("mlp", ztrain, COMPONENTS, 1, features="z", max_iter=30)
    table = attribution.inverse_shap_sampled(ztest, ztrain, model, reducer)
    return ranking.magnitude_ranking(table, "importance")


def local_surrogate(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _parts(spark, sf)
    model = models.fit_model("log", train, _width(train), max_iter=50).stages[-1]
    predict = attribution.linear_predict(model.coefficients.toArray(), model.intercept)
    table = attribution.local_surrogate(test, train, predict, num_samples=5000)
    return ranking.magnitude_ranking(table, "importance")


def _round_metrics(table: DataFrame) -> DataFrame:
    return table.select("part", "fold", *[F.round(m, 6).alias(m) for m in manyfits.METRICS])


def fold_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of a logistic model on each of five folds, their mean and spread."""
    return _round_metrics(manyfits.cross_validate(fixtures.samples(spark, sf), 5, "log"))


def fold_evaluation_centroid(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the centroid scorer."""
    return _round_metrics(manyfits.cross_validate(fixtures.samples(spark, sf), 5, "centroid"))


def fold_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Mean ROC curve of the folds' logistic models."""
    roc, _ = manyfits.mean_curves(manyfits.fold_scores(fixtures.samples(spark, sf), 5, "log"))
    return roc.select("grid", F.round("mean_value", 6).alias("mean_value"), F.round("mean_area", 6).alias("mean_area"))


def fold_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """For each left-out fold, the rows fitted on and the largest part of the loss's slope, rounded."""
    folded = cut_lineage(matrix.stratified_folds(fixtures.samples(spark, sf), 5))
    fits = [manyfits.Fit(tuple(range(_width(folded))), fold) for fold in range(1, 6)]
    slopes = manyfits.slopes(folded, fits, manyfits.fit_logistic(folded, fits))
    return spark.createDataFrame(
        [(f.fold, n, round(s, 4)) for f, (n, s) in zip(fits, slopes)], "fold int, n long, slope double")


def model_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Logistic models on the top k features for every k, fifty simulations each."""
    train, test = _parts(spark, sf)
    best = sweep.ordered_features(single_ranking(spark, sf), _width(train))
    curves = manyfits.sweep_many(train, test, best, list(range(1, len(best) + 1)), 50)
    return sweep.mean_over_simulations(curves)


def method_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Feature sets of three rankings compared on two data sets, fifty simulations each."""
    train, test = _parts(spark, sf)
    ranks = run_rankings(spark, sf)
    chosen = {m: sweep.ordered_features(ranks.where(F.col("model") == m), 10) for m in ("m1", "m2", "m3")}
    return sweep.performance_cells(manyfits.compare_many(train, {"train": train, "test": test}, chosen, 50))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.clustered_points(spark, sf).drop("cluster")


def kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.kmeans(_points(spark, sf), 6, seed=1).select("point_id", "cluster")


def gaussian_mixture(spark: SparkSession, sf: str) -> DataFrame:
    reduced = reduction.fit_pca(fixtures.samples(spark, sf), 4).transform(
        fixtures.samples(spark, sf), "features"
    )
    points = reduced.select(F.col("sample_id").alias("point_id"), "features")
    return clustering.gmm(points, 3, max_iter=20, seed=1).select("point_id", "cluster")


def bisecting(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.bisecting(_points(spark, sf), 6, seed=1).select("point_id", "cluster")


def power_iteration(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral clusters of the features on their similarity edges."""
    edges = _correlation(spark, sf).withColumn("weight", F.abs("weight"))
    rows = spark.createDataFrame([(i,) for i in _feature_ids(spark, sf)], "point_id int")
    nodes = rows.withColumn("features", F.array().cast("array<double>"))
    return clustering.power_iteration(nodes, edges, 4).select("point_id", "cluster")


def cluster_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Grid over two methods, best configuration per method."""
    results = clustering.grid_search(
        _points(spark, sf),
        {
            "kmeans": clustering.parameter_grid({"n_clusters": [5, 7], "max_iter": [10]}),
            "bisecting": clustering.parameter_grid({"n_clusters": [5, 7], "max_iter": [10]}),
        },
        "calinski",
    )
    return clustering.best_per_method(results, "calinski")


def best_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of the best of several seeded repeats."""
    labels, _ = clustering.rerun_best(
        _points(spark, sf), "kmeans", {"n_clusters": 5, "max_iter": 10}, "calinski", 10
    )
    return labels.select("point_id", "cluster")


def roundtrip_models(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a saved and reloaded pipeline."""
    from salience.session import scratch_path
    from salience.sources.models import load_model, save_model

    train, test = _parts(spark, sf)
    path = scratch_path(spark, "model")
    save_model(models.fit_model("log", train, _width(train), max_iter=30), path)
    return scorers.score_with_model(test, load_model(path)).select(
        "sample_id", "output", "probability"
    )


def roundtrip_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How far the scores of a reloaded pipeline are from those of the fitted one."""
    from salience.session import scratch_path
    from salience.sources.models import load_model, save_model

    train, test = _parts(spark, sf)
    model, path = models.fit_model("log", train, _width(train), max_iter=30), scratch_path(spark, "model")
    save_model(model, path)
    first = scorers.score_with_model(test, model).withColumnRenamed("probability", "first")
    again = scorers.score_with_model(first, load_model(path))
    return again.select(
        "sample_id", "output", F.round(F.abs(F.col("probability") - F.col("first")), 9).alias("moved"))


QUERIES = {
    f.__name__: f
    for f in (
        logistic_scores, perceptron_scores, boosted_scores, pca_projection, pca_scores,
        svd_scores, pca_components, svd_components, nmf_factors, logistic_importance, perceptron_importance, boosted_importance,
        general_importance, general_change, general_sensitivity, perceptron_change,
        boosted_sensitivity, surrogate_importance, surrogate_shap, inverse_mapped_shap, inverse_mapped_shap_sampled,
        local_surrogate, fold_evaluation, fold_evaluation_centroid, fold_curve, fold_optimum, model_sweep, method_comparison, kmeans,
        gaussian_mixture, bisecting, power_iteration, cluster_grid, best_cluster,
        roundtrip_models, roundtrip_scores,
    )
}
