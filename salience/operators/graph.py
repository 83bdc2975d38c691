"""Influence network: edges, components, spanning forests, pruning, nodes.

Edges are ``(src, dst, weight)`` with src < dst.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from salience.functions.expressions import clean_name, edge_colour, node_colour
from salience.operators import lookup
from salience.operators.lookup import look_up
from salience.session import cut_lineage


def edge_list(similarity: DataFrame) -> DataFrame:
    """Similarity table to edges: one per unordered pair, zero weight is none."""
    return similarity.where((F.col("src") < F.col("dst")) & (F.col("weight") != 0)).withColumn(
        "colour", edge_colour(F.col("weight"))
    )


def spanning_forest(nodes: DataFrame, edges: DataFrame, cost: str) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest and component label of every node.

    Boruvka rounds: every component picks its cheapest leaving edge
    (``min`` of a struct, combined map-side), picks are merged by pointer
    jumping, and parallel edges between components shrink to the cheapest.  Ties
    break on (src, dst), which makes the order total.  Components at least halve
    each round, and every round is written out.  Joins on a component split a giant
    one's rows (:func:`look_up`).

    Returns ``(tree(src, dst, cost), labels(node, component))``; a component
    is named after its smallest node.
    """
    key = F.struct(F.col(cost).alias("cost"), F.col("src").alias("src"), F.col("dst").alias("dst"))
    live = cut_lineage(
        edges.where(F.col("src") != F.col("dst")).select(
            F.col("src").alias("a"), F.col("dst").alias("b"), key.alias("key")
        )
    )
    trees: list[DataFrame] = [live.select("key").limit(0)]
    merges: list[DataFrame] = []
    while True:
        if live.isEmpty():
            break
        ends = F.array(
            F.struct(F.col("a").alias("c"), F.col("b").alias("parent")),
            F.struct(F.col("b").alias("c"), F.col("a").alias("parent")),
        )
        picks = cut_lineage(
            live.select("key", F.inline(ends))
            .groupBy("c")
            .agg(F.min(F.struct("key", "parent")).alias("pick"))
            .select("c", F.col("pick.parent").alias("parent"), F.col("pick.key").alias("key"))
        )
        trees.append(picks.select("key").distinct())
        pointers = roots(picks.select("c", "parent"))
        merges.append(pointers)
        live = contracted(live, pointers)
    labels = cut_lineage(nodes.select(F.col("node"), F.col("node").alias("component")))
    for merge in merges:
        moved = look_up(labels, merge.withColumnRenamed("c", "component"), "component", "left")
        labels = cut_lineage(moved.select("node", F.coalesce("root", "component").alias("component")))
    names = labels.groupBy("component").agg(F.min("node").alias("name"))
    named = look_up(labels, names, "component").select("node", F.col("name").alias("component"))
    tree = reduce(DataFrame.unionByName, trees)
    return tree.select("key.src", "key.dst", "key.cost"), named


def contracted(live: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(a, b, key)`` between the roots of ``(c, root)``: of parallel edges the least key is left."""
    near = pointers.select(F.col("c").alias("a"), F.col("root").alias("ra"))
    far = pointers.select(F.col("c").alias("b"), F.col("root").alias("rb"))
    return cut_lineage(
        _twice(live, near, "a", far, "b")
        .where(F.col("ra") != F.col("rb"))
        .groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        .agg(F.min("key").alias("key"))
    )


def _twice(rows: DataFrame, one: DataFrame, key: str, two: DataFrame, other: str) -> DataFrame:
    """Two look-ups in a row; the first adds no rows, so a small table needs no count between."""
    if rows.count() <= lookup.HOT_ROWS:
        return rows.join(one, key).join(two, other)
    return look_up(cut_lineage(look_up(rows, one, key)), two, other)


def roots(picks: DataFrame) -> DataFrame:
    """Follow picks to a common root; two components picking each other end at the smaller."""
    back = picks.select(F.col("c").alias("parent"), F.col("parent").alias("grand"))
    pointers = cut_lineage(
        look_up(picks, back, "parent", "left").select(
            "c",
            F.when((F.col("grand") == F.col("c")) & (F.col("c") < F.col("parent")), F.col("c"))
            .otherwise(F.col("parent"))
            .alias("root"),
        )
    )
    while True:
        ahead = pointers.select(F.col("c").alias("root"), F.col("root").alias("next"))
        beyond = pointers.select(F.col("c").alias("next"), F.col("root").alias("far"))
        stepped = cut_lineage(
            _twice(pointers, ahead, "root", beyond, "next").select(
                "c", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")
            )
        )
        pointers = stepped.select("c", "root")
        if stepped.where("moved").isEmpty():
            return pointers


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``; a component is named after its smallest node."""
    return spanning_forest(nodes, edges.withColumn("_one", F.lit(1)), "_one")[1]


def within_clusters(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges whose ends share a cluster, with that cluster."""
    ends = clusters.select("feature_id", "cluster")
    left = ends.select(F.col("feature_id").alias("src"), "cluster")
    right = ends.select(F.col("feature_id").alias("dst"), F.col("cluster").alias("_other"))
    return (
        edges.join(left, "src")
        .join(right, "dst")
        .where(F.col("cluster") == F.col("_other"))
        .drop("_other")
    )


def cluster_similarity(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean |weight| over the pairs of each cluster; null for a singleton.

    Pairs without an edge weigh 0, so the divisor is the number of pairs.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = within_clusters(edges, clusters).groupBy("cluster").agg(
        F.sum(F.abs("weight")).alias("_sum")
    )
    pairs = F.col("size") * (F.col("size") - 1) / F.lit(2.0)
    return sizes.join(sums, "cluster", "left").select(
        "cluster",
        "size",
        (F.coalesce("_sum", F.lit(0.0)) / F.nullif(pairs, F.lit(0.0))).alias("similarity"),
    )


def pruned_edges(
    edges: DataFrame, clusters: DataFrame, min_node_count: int | None = None
) -> DataFrame:
    """Per cluster, drop the weakest edges until the next would break it.

    A connected cluster falls apart exactly when the weakest edge of its
    maximum spanning tree goes, so that edge is the threshold.  Clusters below
    ``min_node_count`` stop instead when a node would keep fewer than two
    edges: the threshold is the smallest second-strongest edge of any node.  A
    cluster already past its limit loses nothing.
    """
    inner = cut_lineage(within_clusters(edges, clusters).withColumn("cost", -F.abs("weight")))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    order = F.struct("cost", "src", "dst")
    tree, _ = spanning_forest(clusters.select(F.col("feature_id").alias("node")), inner, "cost")
    spans = within_clusters(tree, clusters).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("links"), F.max(order).alias("last")
    )
    limits = sizes.join(spans, "cluster", "left").select(
        "cluster",
        "size",
        F.when(F.col("links") == F.col("size") - 1, F.col("last")).alias("limit"),
    )
    if min_node_count is not None:
        ends = inner.select(
            "cluster", order.alias("key"), F.explode(F.array("src", "dst")).alias("feature_id")
        )
        first = ends.groupBy("cluster", "feature_id").agg(F.min("key").alias("first"))
        second = (
            ends.join(first, ["cluster", "feature_id"])
            .groupBy("cluster", "feature_id")
            .agg(F.min(F.when(F.col("key") > F.col("first"), F.col("key"))).alias("second"))
        )
        degrees = (
            clusters.select("cluster", "feature_id")
            .join(second, ["cluster", "feature_id"], "left")
            .groupBy("cluster")
            .agg(
                F.count_if(F.col("second").isNull()).alias("thin"),
                F.max("second").alias("edge"),
            )
            .select("cluster", F.when(F.col("thin") == 0, F.col("edge")).alias("degree_limit"))
        )
        limits = limits.join(degrees, "cluster").select(
            "cluster",
            F.when(F.col("size") < min_node_count, F.col("degree_limit"))
            .otherwise(F.col("limit"))
            .alias("limit"),
        )
    kept = inner.join(limits.select("cluster", "limit"), "cluster").where(
        F.col("limit").isNull() | (order <= F.col("limit"))
    )
    return kept.select("cluster", "src", "dst", "weight", edge_colour(F.col("weight")).alias("colour"))


def node_table(
    clusters: DataFrame, ranking: DataFrame, names: DataFrame, critical: int, top: int = 100
) -> DataFrame:
    """Cluster, drawn size, critical flag, colour and label of every node.

    The ``top`` ranked features scale to 1000..3000, others are 100; all are
    multiplied by 5.
    """
    best = ranking.where(F.col("position") <= top)
    bounds = best.agg(
        F.struct(F.min("rank_fin").alias("low"), F.max("rank_fin").alias("high"))
    ).scalar()
    sized = ranking.withColumn("_b", bounds).select(
        "feature_id",
        "position",
        F.when(
            F.col("position") <= top,
            2000.0
            * (F.col("rank_fin") - F.col("_b.low"))
            / F.nullif(F.col("_b.high") - F.col("_b.low"), F.lit(0.0))
            + 1000.0,
        ).alias("scaled"),
    )
    flagged = F.coalesce(F.col("position") <= critical, F.lit(False))
    return (
        clusters.select("feature_id", "cluster")
        .join(sized, "feature_id", "left")
        .join(names, "feature_id", "left")
        .select(
            "feature_id",
            "cluster",
            (F.coalesce("scaled", F.lit(100.0)) * 5).alias("node_size"),
            flagged.alias("is_critical"),
            node_colour(flagged).alias("colour"),
            clean_name(F.col("feature_name")).alias("label"),
        )
    )
