"""Shuffles: every sample next to the sample whose values it tries on.

A shuffle is one seeded permutation of the rows of the whole table, by the same
rule at every size.  Samples get dense positions in hashed order, and a shuffle
sends the values at position p to position ``(factor * p + shift) mod n``, so a
draw is arithmetic and no draw is sorted.  One row permutation serves all
features of a shuffle; each feature is still tried on alone, so its column keeps
exactly its values.  Senders and receivers meet in one equi-join on the position,
where no key is hot.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from salience.functions.expressions import int_array
from salience.functions.shuffling import affine_shuffle, hash_id
from salience.operators.matrix import feature_count
from salience.operators.scan import dense_position

# Features that travel in one row of the join.
CHUNK = 128


def draw_grid(runs: int, repeats: int, seed: int, rows: int) -> Column:
    """Array of (run_id, repeat, factor, shift) for ``runs`` x ``repeats`` shuffles."""
    draws = [
        (run, repeat, *affine_shuffle(rows, repeat, seed + run))
        for run in range(1, runs + 1)
        for repeat in range(1, repeats + 1)
    ]
    names = ("run_id", "repeat", "factor", "shift")
    return F.from_json(
        F.lit(json.dumps([dict(zip(names, d)) for d in draws])),
        "array<struct<run_id:int,repeat:int,factor:bigint,shift:bigint>>",
    )


def shuffled_pairs(
    samples: DataFrame,
    carry: list[str],
    runs: int,
    repeats: int,
    seed: int,
    feature_ids: list[int] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Rows (pos, chunk, carry..., x, run_id, repeat, x_new), one per shuffle and chunk.

    ``x`` holds the sample's own values of the features ``chunk * width ..`` of
    ``feature_ids`` (all when absent), ``x_new`` those it receives.
    """
    width = feature_count(samples) if feature_ids is None else len(feature_ids)
    values = F.col("features") if feature_ids is None else F.transform(
        int_array(feature_ids), lambda i: F.get(F.col("features"), i)
    )
    kind = samples.schema["sample_id"].dataType.simpleString()
    total = max(samples.count(), 1)
    placed = dense_position(
        samples.select(
            *carry, values.alias("x"),
            F.struct(hash_id(F.col("sample_id"), kind), F.col("sample_id")).alias("_order"),
        ),
        [], "_order", "_number",
    ).withColumn("pos", F.col("_number") - 1)
    slices = F.transform(
        F.sequence(F.lit(0), F.lit(max(0, (width - 1) // chunk))),
        lambda c: F.struct(
            c.alias("chunk"), F.slice("x", c * chunk + 1, F.lit(chunk)).alias("x")
        ),
    )
    pieces = placed.select("pos", *carry, F.inline(slices))
    sent = placed.select("pos", F.inline(slices)).select(
        "pos", "chunk", F.col("x").alias("x_new"), F.inline(draw_grid(runs, repeats, seed, total))
    )
    target = (F.col("pos") * F.col("factor") + F.col("shift")) % total
    sent = sent.select(target.alias("pos"), "chunk", "run_id", "repeat", "x_new")
    return pieces.join(sent, ["pos", "chunk"])
