"""Leading singular vectors of a tall table by a randomised block Krylov method.

A pass over the rows gives ``AᵀA Q`` for a block ``Q`` of a few columns; no pass forms
``AᵀA``.  Partial sums of the tasks meet in a tree, in chunks of about ``CHUNK_BYTES``,
so no task or group grows with the number of rows.  The driver holds matrices of the
width times the block's columns, the size of the result and a few like it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Bytes of one chunk of a partial sum, and partial sums that meet in one group.
CHUNK_BYTES, FAN_IN = 1 << 20, 32
#: Blocks that the Krylov space holds before it restarts from its best vectors.
BLOCKS = 6

Rows = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def gram_product(table: DataFrame, rows: Rows, block: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """``(A - centre)ᵀ (A - centre) block``, where ``rows`` makes rows of A from a batch."""
    spark = table.sparkSession
    told = spark.sparkContext.broadcast((block, 0.0 if centre is None else centre))
    step = max(1, CHUNK_BYTES // (8 * block.shape[1]))
    schema = "chunk int, part int, total binary"

    def add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, centre = told.value
        total = np.zeros(block.shape)
        for batch in batches:
            for part in rows(batch):
                part = part - centre
                total += part.T @ (part @ block)
        chunks = [total[k : k + step].tobytes() for k in range(0, len(total), step)]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(chunks), dtype=np.int32)),
             pa.array(np.full(len(chunks), task, np.int32)), pa.array(chunks, pa.binary())],
            names=["chunk", "part", "total"],
        )

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in group.column("total"))
        first = group.slice(0, 1)
        return pa.table([first.column("chunk"), first.column("part"), [total.tobytes()]], schema=group.schema)

    sums, parts = table.mapInArrow(add_rows, schema), table.rdd.getNumPartitions()
    while parts > FAN_IN:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        sums = sums.groupBy("chunk", "part").applyInArrow(add, schema)
        parts = -(-parts // FAN_IN)
    out = np.zeros(block.shape)
    for row in sums.groupBy("chunk").applyInArrow(add, schema).toLocalIterator():
        held = np.frombuffer(row.total).reshape(-1, block.shape[1])
        out[row.chunk * step : row.chunk * step + len(held)] = held
    told.destroy()
    return out


def _orthonormal(block: np.ndarray, basis: np.ndarray | None, least: float) -> np.ndarray:
    """An orthonormal basis of what ``block`` has beside ``basis``, but for norms below ``least``."""
    for _ in range(2):
        if basis is not None:
            block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > least]
        least = 0.5  # the second pass takes only rounding errors off unit vectors
    return block


def singular_vectors(
    table: DataFrame, rows: Rows, width: int, k: int, centre: np.ndarray | None = None,
    rounds: int = 40, oversample: int = 10, tolerance: float = 1e-11, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``k`` singular values and right vectors (columns) of the table's rows.

    The space starts from seeded Gaussian columns and grows by the residuals of its best
    vectors, one pass a round, until ``AᵀA v - s² v`` is below ``tolerance`` of the largest
    s² for each of them, or for ``rounds`` passes.  Fewer come back when the rank is
    lower (s above 1e-7 of the largest).  Each vector's largest entry is positive.  A
    table without rows, or rows without columns, give none.
    """
    size = min(width, k + oversample)
    fresh = _orthonormal(np.random.default_rng(seed).normal(size=(width, size)), None, 1e-12)
    basis, products = np.zeros((width, 0)), np.zeros((width, 0))
    vectors, squares = basis, np.zeros(0)
    for _ in range(rounds):
        if not fresh.shape[1]:
            break
        basis = np.hstack([basis, fresh])
        products = np.hstack([products, gram_product(table, rows, fresh, centre)])
        inner = basis.T @ products
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        turn = turn[:, ::-1][:, :size]
        squares, vectors, images = values[::-1][:size], basis @ turn, products @ turn
        top = squares[0] if len(squares) else 0.0
        residual = images - vectors * squares
        if top <= 0 or (np.linalg.norm(residual[:, :k], axis=0) <= tolerance * top).all():
            break
        if basis.shape[1] >= BLOCKS * size:
            basis, products = vectors, images
        fresh = _orthonormal(residual, basis, 1e-13 * top)
    kept = np.flatnonzero(squares[:k] > 1e-14 * squares[:1].sum())
    vectors = vectors[:, kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))]) if len(kept) else np.ones(0)
    return np.sqrt(squares[kept]), vectors * signs
