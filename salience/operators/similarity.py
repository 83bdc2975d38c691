"""Feature correlation from per-sample columns.

Values are standardised by a first pass, so a correlation is a plain sum of
products and large means cancel nothing.  Each task multiplies its own rows into
tiles of the Gram matrix; a tile travels as one array per feature and is summed as
such, and pairs appear once, at the end.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from salience.functions.expressions import complete, int_array
from salience.session import cut_lineage

# Features per panel: a task holds one panel pair, 32 MB of sums.
PANEL = 2048


def _tile(rows: DataFrame, mean: np.ndarray, unit: np.ndarray, a0: int, b0: int, panel: int) -> DataFrame:
    """(row, start, products): each task's sums of row feature times b0.. features."""
    a1, b1 = min(a0 + panel, len(mean)), min(b0 + panel, len(mean))
    slices = rows.select(
        F.slice("features", a0 + 1, a1 - a0).alias("xa"),
        F.slice("features", b0 + 1, b1 - b0).alias("xb"),
    )
    mean_a, unit_a, mean_b, unit_b = mean[a0:a1], unit[a0:a1], mean[b0:b1], unit[b0:b1]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross, met = np.zeros((a1 - a0, b1 - b0)), False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            met = True
            xa, xb = (
                batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for i in (0, 1)
            )
            cross += ((xa - mean_a) * unit_a).T @ ((xb - mean_b) * unit_b)
        if met:
            ends = np.arange(0, cross.size + 1, b1 - b0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(a0, a1), pa.int32()), pa.array([b0] * (a1 - a0), pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(cross.ravel()))],
                names=["row", "start", "products"],
            )

    return slices.mapInArrow(products, "row int, start int, products array<double>")


def correlation_edges(rows: DataFrame, feature_ids: list[int], panel: int = PANEL) -> DataFrame:
    """Pearson correlation of every feature pair: ``(src, dst, weight)``.

    ``rows`` has ``features`` in the order of ``feature_ids`` (ascending).
    Null for a constant feature; no rows give no pairs; a null or NaN cell raises an
    error that names its row.
    """
    name = F.col("sample_id") if "sample_id" in rows.columns else F.lit("a row")
    fixed = cut_lineage(rows.select(complete(F.col("features"), name).alias("features")))
    if fixed.isEmpty():
        return rows.sparkSession.createDataFrame([], "src int, dst int, weight double")
    names = ("mean", "variance", "min", "max")
    found = (
        fixed.select(array_to_vector("features").alias("v"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            Summarizer.metrics(*names).summary(F.col("v")).alias("m"),
        )
        .first()
    )
    shape = found["m"]
    mean, variance = shape["mean"].toArray(), shape["variance"].toArray()
    varies = (shape["max"].toArray() > shape["min"].toArray()) & (variance > 0)
    unit = np.zeros(len(mean))
    unit[varies] = 1 / np.sqrt(variance[varies] * (found["rows"] - 1))
    starts = range(0, len(mean), panel)
    tiles = [
        _tile(fixed, mean, unit, a, b, panel) for a in starts for b in starts if a <= b
    ]
    every = tiles[0]
    for tile in tiles[1:]:
        every = every.unionByName(tile)
    sums = every.groupBy("row", "start").agg(
        vector_to_array(Summarizer.sum(array_to_vector("products"))).alias("products")
    )
    pairs = sums.select("row", "start", F.posexplode("products").alias("at", "weight")).select(
        "row", (F.col("start") + F.col("at")).alias("column"), "weight"
    ).where(F.col("row") < F.col("column"))
    varying = F.from_json(F.lit(json.dumps(varies.tolist())), "array<boolean>")
    both = F.get(varying, F.col("row")) & F.get(varying, F.col("column"))
    ids = int_array(feature_ids)
    return pairs.select(
        F.get(ids, F.col("row")).alias("src"), F.get(ids, F.col("column")).alias("dst"),
        F.when(both, F.col("weight")).alias("weight"),
    )


def combine_correlations(
    first: DataFrame, second: DataFrame, n_first: int, n_second: int, check: bool = True
) -> DataFrame:
    """Sample-weighted mean of two correlation tables over the same pairs."""
    if check:
        for a, b in ((first, second), (second, first)):
            if not a.join(b, ["src", "dst"], "left_anti").isEmpty():
                raise ValueError("the two matrices do not share the same features")
    other = second.withColumnRenamed("weight", "_w")
    mean = (F.col("weight") * n_first + F.col("_w") * n_second) / float(n_first + n_second)
    return first.join(other, ["src", "dst"]).select("src", "dst", mean.alias("weight"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions plus the unit diagonal."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    diagonal = nodes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    return edges.unionByName(flipped).unionByName(diagonal)


def ordered_matrix(matrix: DataFrame, clusters: DataFrame) -> DataFrame:
    """Add row and column positions sorted by (cluster, feature)."""
    from salience.operators.ranking import positions

    placed = positions(
        clusters.select("feature_id", "cluster"), [], [F.col("cluster"), F.col("feature_id")]
    )
    rows = placed.select(F.col("feature_id").alias("src"), F.col("position").alias("row_position"))
    cols = placed.select(F.col("feature_id").alias("dst"), F.col("position").alias("col_position"))
    return matrix.join(rows, "src").join(cols, "dst")
