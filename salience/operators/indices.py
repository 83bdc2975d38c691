"""Cluster quality: silhouette, Davies-Bouldin, Calinski-Harabasz, Dunn.

Input: ``(point_id, cluster, features ARRAY<DOUBLE>)``.  Each index is a
one-row table with column ``score``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from salience.functions.expressions import squared_distance, whole_vector
from salience.operators.cells import SLACK, Block, Cells, beyond, gaps, make_cells, meet, pack, positions, taken, within
from salience.operators.scan import dense_position
from salience.operators.tiles import BLOCK_ROWS, distances, matrix_of, tiled
from salience.session import cut_lineage


def _sums_to(groups):
    """Distance sums from every visitor to the members of the clusters it meets; a cell is a cluster."""
    for x, ys in groups:
        sums, sizes, names = {}, {}, {}
        for y, rows in ys:
            if not len(rows):
                continue
            if y.cell not in sums:
                sums[y.cell], sizes[y.cell] = np.zeros(len(x)), np.zeros(len(x), np.int64)
                names[y.cell] = y["cluster"][:1]
            sums[y.cell][rows] += distances(taken(x, rows), y.vectors).sum(axis=1)
            sizes[y.cell][rows] += len(y)
        for cell, n in sizes.items():
            met = n > 0
            yield {"point_id": x["point_id"][met], "cluster": x["cluster"][met],
                   "other": np.repeat(names[cell], met.sum()), "gap": sums[cell][met], "n": n[met]}


def _own_or_nearest(found: np.ndarray, own: np.ndarray, scatter: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Own cluster, and the others whose mean distance can be the smallest.

    A mean distance to a cluster is at least the distance to its centre and at most
    that plus the mean distance of its members from the centre.
    """
    is_own = np.arange(found.shape[1])[None, :] == np.rint(mine)[:, None]
    most = np.where(is_own, np.inf, found + scatter[None, :]).min(axis=1, initial=np.inf)
    return is_own | (found <= most[:, None] * (1 + SLACK) + SLACK)


def silhouette_samples(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Silhouette width of every point; 0 in a cluster of one.

    Sums of distances are taken over the members of the own cluster and of those
    clusters that bounds by the centres leave in question.  Rows without a cluster
    are not judged; null or NaN cells raise an error.
    """
    judged = positions(points.where(F.col("cluster").isNotNull()), "euclidean")
    judged = judged.select("point_id", "cluster", "features")
    id_type = points.schema["point_id"].dataType.simpleString()
    kind = points.schema["cluster"].dataType.simpleString()
    centres, stats = _spread(judged)
    named = cut_lineage(dense_position(centres.join(stats, "cluster"), [], "cluster"))
    # As the centres of a fitted clustering, these are held whole by tasks.
    known = named.orderBy("position").collect()
    numbered = judged.join(named.select("cluster", (F.col("position") - 1).cast("int").alias("cell")), "cluster")
    width = len(known[0]["centre"]) if known else 0
    cells = pack(
        numbered, np.array([r["centre"] for r in known], float).reshape(len(known), width), "euclidean", block_rows,
        sum(r["size"] for r in known), width, [], radius=np.array([r["scatter"] for r in known], float))
    sums = (
        meet(cells, _sums_to, f"point_id {id_type}, cluster {kind}, other {kind}, gap double, n bigint",
             _own_or_nearest, radius="cell")
        .groupBy("point_id", "cluster", "other")
        .agg(F.sum("gap").alias("gap"), F.sum("n").alias("n"))
    )
    own = F.col("other") == F.col("cluster")
    near = sums.groupBy("point_id", "cluster").agg(
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.max(F.when(own, F.col("gap") / F.nullif(F.col("n") - 1, F.lit(0)))).alias("a"),
        F.min(F.when(~own, F.col("gap") / F.col("n"))).alias("b"),
    )
    width = (F.col("b") - F.col("a")) / F.greatest("a", "b")
    return near.select(
        "point_id", "cluster", F.when(F.col("size") == 1, F.lit(0.0)).otherwise(width).alias("width")
    )


def silhouette(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return silhouette_samples(points, block_rows).agg(F.avg("width").alias("score"))


def extremes(cells: Cells) -> tuple[float, float]:
    """A distance between clusters and one inside a cluster that bound the extreme ones.

    Every point is compared with all pivots; the farthest pair found is then swept
    once more from its far end.
    """
    metric, pivots = cells.metric, cells.pivots
    names = np.array([str(r["cluster"]) for r in cells.rows])
    spark = cells.points.sparkSession

    def scan_pivots(batches):
        for batch in batches:
            at = batch.schema.names.index
            values = batch.column(at("features")).flatten().to_numpy(zero_copy_only=False)
            found = gaps(values.reshape(batch.num_rows, pivots.shape[1]), pivots, metric)
            same = np.array(batch.column(at("cluster")).to_pylist(), object)[:, None] == names[None, :]
            if not batch.num_rows:
                continue
            inside = np.where(same, found, -1.0)
            row = int(inside.max(axis=1).argmax())
            yield pa.RecordBatch.from_pydict({
                "gap": [float(np.where(same, np.inf, found).min())], "width": [float(inside.max())],
                "name": [str(batch.column(at("cluster"))[row].as_py())],
                "place": [batch.column(at("features"))[row].as_py()],
            })

    slim = cells.points.select(F.col("cluster").cast("string").alias("cluster"), "features")
    best = slim.mapInArrow(
        scan_pivots, "gap double, width double, name string, place array<double>"
    ).agg(F.min("gap").alias("gap"), F.max(F.struct("width", "name", "place")).alias("far")).first()
    if best["gap"] is None:
        return math.inf, 0.0
    end = spark.createDataFrame([(best["far"]["place"],)], "place array<double>")
    swept = slim.where(F.col("cluster") == best["far"]["name"]).withColumn("_end", end.scalar()).agg(
        F.max(squared_distance(F.col("features"), F.col("_end"))).alias("w")).first()[0]
    return best["gap"], max(best["far"]["width"], math.sqrt(swept or 0.0), 0.0)


def dunn(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Smallest gap between clusters over the widest cluster; 0 if all single.

    Known distances bound both: only cells that can hold a closer pair of two
    clusters, or a farther pair of one, are opened.  Rows without a cluster are not
    judged; null or NaN cells raise an error.
    """
    judged = points.where(F.col("cluster").isNotNull()).select("point_id", "cluster", "features")
    cells = make_cells(judged, "euclidean", block_rows)
    gap, width = extremes(cells)
    slack = cells.slack

    def closest(groups):
        for x, ys in groups:
            least = math.inf
            for y, rows in ys:
                found = distances(taken(x, rows), y.vectors)
                least = min(least, np.where(_same(x, rows, y), np.inf, found).min(initial=np.inf))
            yield {"gap": np.array([least])}

    def widest(groups):
        for x, ys in groups:
            most = -math.inf
            for y, rows in ys:
                other = x["point_id"][rows][:, None] != y["point_id"][None, :]
                found = distances(taken(x, rows), y.vectors)
                most = max(most, np.where(_same(x, rows, y) & other, found, -np.inf).max(initial=-np.inf))
            yield {"width": np.array([most])}

    least = meet(cells, closest, "gap double", within(gap)).agg(F.min("gap").alias("gap"))
    most = meet(cells, widest, "width double", beyond(width * (1 - SLACK) - slack)).agg(F.max("width").alias("width"))
    # Infinite: no such pair.
    both = least.withColumn("width", most.scalar())
    real = F.when(F.col("gap") < math.inf, F.col("gap"))
    return both.select(
        F.when(F.coalesce(F.col("width"), F.lit(-math.inf)) == -math.inf, F.lit(0.0))
        .otherwise(real / F.col("width")).alias("score"))


def _same(x: Block, rows: np.ndarray, y: Block) -> np.ndarray:
    """Which pairs of visitors and homes share a cluster."""
    return x["cluster"][rows][:, None] == y["cluster"][None, :]


def centroids(points: DataFrame) -> DataFrame:
    """Mean vector and size per cluster; whole vectors combine map-side."""
    return (
        points.select("cluster", whole_vector(points).alias("_v"))
        .groupBy("cluster")
        .agg(
            vector_to_array(Summarizer.mean(F.col("_v"))).alias("centre"),
            F.count(F.lit(1)).alias("size"),
        )
    )


def _spread(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per cluster: centre, size, mean distance and squared distance to it."""
    centres = cut_lineage(centroids(points))
    near = points.join(centres, "cluster")
    square = squared_distance(F.col("features"), F.col("centre"))
    stats = near.groupBy("cluster").agg(
        F.avg(F.sqrt(square)).alias("scatter"), F.sum(square).alias("within")
    )
    return centres, stats


def davies_bouldin(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Mean over clusters of the worst (scatter_i + scatter_j) / centre gap."""
    centres, stats = _spread(points)
    table = centres.join(stats, "cluster").select(
        F.col("cluster").alias("point_id"), F.col("centre").alias("features"), "scatter"
    )

    def worst(a, b, gaps):
        both = a["scatter"].to_numpy()[:, None] + b["scatter"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gaps > 0, both / gaps, 0.0)
        return pd.DataFrame({"cluster": a["point_id"], "ratio": ratio.max(axis=1, initial=0.0)})

    def reduce_tile(a, b):
        if b is None:
            m = matrix_of(a)
            return worst(a, a, distances(m, m))
        gaps = distances(matrix_of(a), matrix_of(b))
        return pd.concat([worst(a, b, gaps), worst(b, a, gaps.T)])

    kind = table.schema["point_id"].dataType.simpleString()
    return (
        tiled(table, reduce_tile, f"cluster {kind}, ratio double", block_rows)
        .groupBy("cluster")
        .agg(F.max("ratio").alias("ratio"))
        .agg(F.avg("ratio").alias("score"))
    )


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Between-cluster over within-cluster variance, by degrees of freedom."""
    centres, stats = _spread(points)
    whole = points.select(whole_vector(points).alias("_v")).agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("mu")
    )
    parts = centres.join(stats, "cluster").withColumn("mu", whole.scalar())
    return parts.agg(
        F.sum(F.col("size") * squared_distance(F.col("centre"), F.col("mu"))).alias("between"),
        F.sum("within").alias("within"),
        F.count(F.lit(1)).alias("k"),
        F.sum("size").alias("n"),
    ).select(
        (
            (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n") - F.col("k")))
        ).alias("score")
    )


INDICES = {
    "silhouette": silhouette,
    "davies": davies_bouldin,
    "calinski": calinski_harabasz,
    "dunn": dunn,
}
HIGHER_IS_BETTER = {"silhouette": True, "davies": False, "calinski": True, "dunn": True}


def index(name: str):
    if name not in INDICES:
        raise ValueError(f"unknown index {name!r}; choose from {sorted(INDICES)}")
    return INDICES[name]


def cluster_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def small_clusters(points: DataFrame, least: int = 4) -> DataFrame:
    return cluster_sizes(points).where(F.col("size") < least)
