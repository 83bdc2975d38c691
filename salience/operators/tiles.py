"""All-pairs work on blocks of points, without ever emitting the pairs.

Points are dealt to K blocks of about ``block_rows`` by a hash of their id, and
every pair of blocks is one group ("tile").  A tile sees at most two blocks,
computes its distances with numpy and returns only what the operator reduces
them to (sums per cluster, a minimum, a spanning tree).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from salience.functions.shuffling import hash_id
from salience.session import parallelism

BLOCK_ROWS = 512


def tiled(
    points: DataFrame,
    reduce_tile: Callable[[pd.DataFrame, pd.DataFrame | None], pd.DataFrame],
    schema: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``reduce_tile(a, b)`` to every pair of blocks.

    ``points`` has ``point_id`` and ``features``.  ``b`` is None for the pairs
    inside one block.
    """
    blocks = max(1, math.ceil(points.count() / block_rows))
    kind = points.schema["point_id"].dataType.simpleString()
    own = (hash_id(F.col("point_id"), kind) % blocks).cast("int")
    placed = points.withColumn("_block", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    tiles = placed.withColumn("_low", F.least("_block", "_other")).withColumn(
        "_high", F.greatest("_block", "_other")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["_low"].iloc[0], pdf["_high"].iloc[0]
        first = pdf[pdf["_block"] == low].sort_values("point_id").reset_index(drop=True)
        if low == high:
            return reduce_tile(first, None)
        second = pdf[pdf["_block"] == high].sort_values("point_id").reset_index(drop=True)
        return reduce_tile(first, second)

    # An explicit count keeps AQE from merging CPU-heavy groups.
    spread = tiles.repartition(4 * parallelism(points.sparkSession), "_low", "_high")
    return spread.groupBy("_low", "_high").applyInPandas(run, schema)


def matrix_of(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["features"].to_numpy()) if len(frame) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    same, centre = a is b, a.mean(0)
    # Centred, so that far-off data do not cancel.
    a, b = a - centre, b - centre
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    out = np.sqrt(np.maximum(square, 0.0))
    if same:
        np.fill_diagonal(out, 0.0)
    return out
