"""Prediction-change similarity, influence network and cluster queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.operators import cells, clustering, graph, importance, indices, matrix, scorers, similarity
from salience.operators.spectral import residuals, spectral_embedding
from salience.plans import fixtures
from salience.plans.ranking_queries import SEED, single_ranking
from salience.session import cut_lineage

SIMULATIONS = 3


def _feature_ids(spark: SparkSession, sf: str) -> list[int]:
    names = fixtures.feature_names(fixtures.samples(spark, sf))
    return [r[0] for r in names.select("feature_id").orderBy("feature_id").collect()]


def prediction_change(spark: SparkSession, sf: str) -> DataFrame:
    """Mean prediction change per sample and feature."""
    data = fixtures.samples(spark, sf)
    ids = _feature_ids(spark, sf)
    scorer = scorers.fit_centroid(data)
    return importance.prediction_change(data, scorer, ids, SIMULATIONS, SEED).select(
        "sample_id", "feature_id", F.round("avg_change", 9).alias("avg_change")
    )


def _correlation(spark: SparkSession, sf: str, data: DataFrame | None = None) -> DataFrame:
    samples = fixtures.samples(spark, sf) if data is None else data
    ids = _feature_ids(spark, sf)
    scorer = scorers.fit_centroid(samples)
    rows = importance.prediction_changes(samples, scorer, ids, SIMULATIONS, SEED)
    return cut_lineage(similarity.correlation_edges(rows, ids))


def feature_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of the features' effects on predictions."""
    return _correlation(spark, sf).select("src", "dst", F.round("weight", 6).alias("weight"))


def value_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of the feature values, in panels of 24 features."""
    ids = _feature_ids(spark, sf)
    rows = fixtures.samples(spark, sf).select("sample_id", "features")
    table = similarity.correlation_edges(rows, ids, panel=24)
    return table.select("src", "dst", F.round("weight", 6).alias("weight"))


def combined_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """Sample-weighted mean of the correlations of two data sets."""
    parts = matrix.stratified_split(fixtures.samples(spark, sf), 0.4)
    sets = [cut_lineage(parts.where("is_train")), cut_lineage(parts.where("not is_train"))]
    tables = [_correlation(spark, sf, s.drop("is_train")) for s in sets]
    sizes = [s.count() for s in sets]
    mean = similarity.combine_correlations(*tables, *sizes)
    return mean.select("src", "dst", F.round("weight", 6).alias("weight"))


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Four given feature clusters."""
    names = fixtures.feature_names(fixtures.samples(spark, sf))
    return names.select("feature_id", (F.col("feature_id") % 4).alias("cluster"))


def edge_list(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.edge_list(similarity.symmetric(_correlation(spark, sf)))
    return edges.select("src", "dst", F.round("weight", 6).alias("weight"), "colour")


def cluster_similarity(spark: SparkSession, sf: str) -> DataFrame:
    table = graph.cluster_similarity(_correlation(spark, sf), _clusters(spark, sf))
    return table.select("cluster", "size", F.round("similarity", 6).alias("similarity"))


def pruned_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Per cluster, the edges left when the next removal would disconnect it."""
    kept = graph.pruned_edges(_correlation(spark, sf), _clusters(spark, sf))
    return kept.select("cluster", "src", "dst", F.round("weight", 6).alias("weight"), "colour")


def pruned_small_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Pruning that keeps two edges per node, for clusters under 20 nodes."""
    kept = graph.pruned_edges(_correlation(spark, sf), _clusters(spark, sf), 20)
    return kept.select("cluster", "src", "dst", F.round("weight", 6).alias("weight"), "colour")


def node_table(spark: SparkSession, sf: str) -> DataFrame:
    ranks = single_ranking(spark, sf)
    names = fixtures.feature_names(fixtures.samples(spark, sf))
    table = graph.node_table(_clusters(spark, sf), ranks, names, critical=12, top=40)
    return table.select(
        "feature_id", "cluster", F.round("node_size", 4).alias("node_size"),
        F.col("is_critical").cast("int").alias("is_critical"), "colour", "label",
    )


def ordered_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity matrix with rows and columns in cluster order."""
    whole = similarity.symmetric(_correlation(spark, sf))
    table = similarity.ordered_matrix(whole, _clusters(spark, sf))
    return table.select(
        "src", "dst", F.round("weight", 6).alias("weight"), "row_position", "col_position"
    )


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of customers linked within nation and segment."""
    rows = fixtures.load(spark, sf, "customer")
    groups = rows.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("src"))
    edges = (
        rows.join(groups, ["c_nationkey", "c_mktsegment"])
        .select("src", F.col("c_custkey").alias("dst"))
        .where(F.col("src") < F.col("dst"))
    )
    return graph.components(rows.select(F.col("c_custkey").alias("node")), edges)


def spanning_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Minimum spanning tree of the points; its edge count and total length."""
    points = fixtures.clustered_points(spark, sf)
    return clustering.minimum_spanning_tree(points).select(
        "src", "dst", F.round("cost", 5).alias("cost")
    )


def _score(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = indices.index(name)(fixtures.clustered_points(spark, sf))
    return table.select(F.round("score", 6).alias("score"))


def cluster_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf, "silhouette")


def cluster_dunn(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf, "dunn")


def cluster_davies(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf, "davies")


def cluster_calinski(spark: SparkSession, sf: str) -> DataFrame:
    return _score(spark, sf, "calinski")


def silhouette_widths(spark: SparkSession, sf: str) -> DataFrame:
    table = indices.silhouette_samples(fixtures.clustered_points(spark, sf))
    return table.select("point_id", "cluster", F.round("width", 6).alias("width"))


def small_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters below 60 members."""
    return indices.small_clusters(fixtures.clustered_points(spark, sf), 60)


def linkage_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage cut at a distance."""
    points = fixtures.clustered_points(spark, sf).drop("cluster")
    return clustering.linkage_threshold(points, 1.1).select("point_id", "cluster")


def single_linkage(spark: SparkSession, sf: str) -> DataFrame:
    points = fixtures.clustered_points(spark, sf).drop("cluster")
    return clustering.single_linkage(points, 12).select("point_id", "cluster")


def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    points = fixtures.clustered_points(spark, sf).drop("cluster")
    return clustering.dbscan(points, 1.15, 4).select("point_id", "cluster")


def _flat_points(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.clustered_points(spark, sf).drop("cluster")


def dbscan_l1(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters by the sum of absolute differences."""
    return clustering.dbscan(_flat_points(spark, sf), 7.2, 4, metric="l1").select("point_id", "cluster")


def dbscan_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Density clusters by cosine distance."""
    return clustering.dbscan(_flat_points(spark, sf), 0.66, 4, metric="cosine").select("point_id", "cluster")


def linkage_l1(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage cut at a sum of absolute differences."""
    return clustering.linkage_threshold(_flat_points(spark, sf), 7.0, metric="l1").select("point_id", "cluster")


def linkage_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Single linkage cut at a cosine distance."""
    return clustering.linkage_threshold(_flat_points(spark, sf), 0.62, metric="cosine").select("point_id", "cluster")


def nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest other points of every point."""
    table = cells.neighbours(_flat_points(spark, sf), 5)
    return table.select("point_id", "rank", "other", F.round("distance", 6).alias("distance"))


def similarity_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges between points that are among each other's seven nearest by angle."""
    return clustering.similarity_graph(_flat_points(spark, sf), 7, "cosine")


def spectral_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors found, their rows, and how far they are from orthonormal eigenvectors, rounded."""
    edges = cut_lineage(clustering.similarity_graph(_flat_points(spark, sf), 7, "cosine"))
    placed, values = spectral_embedding(edges, 4)
    checked = residuals(edges, placed, values)
    return checked.select(
        "component", "nodes", F.round("norm", 6).alias("norm"), F.round("residual", 3).alias("residual"))


def spectral(spark: SparkSession, sf: str) -> DataFrame:
    """Spectral clusters of the points on the graph of their ten nearest neighbours."""
    return clustering.spectral(_flat_points(spark, sf), 4).select("point_id", "cluster")


QUERIES = {
    f.__name__: f
    for f in (
        prediction_change, feature_correlation, value_correlation, combined_correlation,
        edge_list, cluster_similarity, pruned_edges, pruned_small_clusters, node_table,
        ordered_matrix, components, spanning_tree, cluster_silhouette, cluster_dunn,
        cluster_davies, cluster_calinski, silhouette_widths, small_clusters,
        linkage_threshold, single_linkage, dbscan, dbscan_l1, dbscan_cosine, linkage_l1,
        linkage_cosine, nearest_neighbours, similarity_graph, spectral,
        spectral_residuals,
    )
}
