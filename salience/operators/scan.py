"""Distributed running aggregates, dense positions and exact quantiles.

A plain window over a whole table (or over one hot key) runs in one task.
``scan`` range-partitions the rows by (key, order) instead, so a hot key is
spread over many tasks:

1. rows are range-partitioned and tagged with their partition number; the
   result is checkpointed, because range boundaries come from a sample and
   must not change between the two reads below;
2. a window runs inside each (key, partition);
3. the totals of earlier partitions (at most one row per key and partition)
   are added through an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from salience.session import cut_lineage

_COMBINE = {
    "sum": (F.sum, lambda a, b: a + b, lambda: F.lit(0)),
    "product": (F.product, lambda a, b: a * b, lambda: F.lit(1.0)),
}


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    outputs: dict[str, tuple[str, Column]],
    wholes: dict[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running aggregates along ``order`` inside each key.

    ``order`` must be unique within a key, and keys must not be null.
    ``outputs`` maps a new column to ``("sum" | "product", expression)``;
    ``wholes`` maps a new column to an expression summed over the whole key.
    Both arrive through the same join on (key, partition), so a hot key is
    never gathered again just to learn its size.
    """
    wholes = wholes or {}
    ranged = cut_lineage(
        df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    )
    place = [*keys, "_part"]
    inside = W.partitionBy(*place).orderBy(order)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    local = ranged.select(
        "*",
        *[_COMBINE[kind][0](e).over(running).alias(f"_in_{n}") for n, (kind, e) in outputs.items()],
    )
    totals = ranged.groupBy(*place).agg(
        *[_COMBINE[kind][0](e).alias(f"_all_{n}") for n, (kind, e) in outputs.items()],
        *[F.sum(e).alias(f"_part_{n}") for n, e in wholes.items()],
    )
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *place,
        *[
            _COMBINE[kind][0](f"_all_{n}").over(earlier).alias(f"_off_{n}")
            for n, (kind, _) in outputs.items()
        ],
        *[F.sum(f"_part_{n}").over(W.partitionBy(*keys)).alias(n) for n in wholes],
    )
    # Null keys are keys as others, so the join must find them.
    named = offsets.withColumnsRenamed({c: f"_at_{i}" for i, c in enumerate(place)})
    same = [F.col(c).eqNullSafe(F.col(f"_at_{i}")) for i, c in enumerate(place)]
    return local.join(named, same).select(
        *df.columns,
        *[
            _COMBINE[kind][1](
                F.col(f"_in_{n}"), F.coalesce(F.col(f"_off_{n}"), _COMBINE[kind][2]())
            ).alias(n)
            for n, (kind, _) in outputs.items()
        ],
        *wholes,
    )


def dense_position(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str = "position",
    size: str | None = None,
) -> DataFrame:
    """Number rows 1..n inside each key without a one-task window.

    ``size`` names a column for the number of rows of the key.
    """
    one = F.lit(1).cast("bigint")
    return scan(df, keys, order, {name: ("sum", one)}, {size: one} if size else None)


def tie_ranks(
    df: DataFrame, keys: list[str], value: str, extra: dict[str, Column]
) -> DataFrame:
    """One row per distinct value with its count and ascending average rank.

    ``extra`` adds aggregates computed in the same map-side-combined pass.
    Repeated values collapse before anything is ordered, so a hot value costs
    one row.
    """
    grouped = df.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n_tied"), *[e.alias(n) for n, e in extra.items()]
    )
    ranked = scan(grouped, keys, value, {"_upto": ("sum", F.col("n_tied"))})
    return ranked.withColumn(
        "avg_rank", F.col("_upto") - (F.col("n_tied") - 1) / F.lit(2.0)
    ).drop("_upto")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]
) -> DataFrame:
    """Exact quantiles with linear interpolation, per key; nulls and NaN are skipped.

    ``F.percentile`` keeps every distinct value of a group in one task; here
    the order statistics come from running counts of distinct values.
    """
    values = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    placed = scan(
        values, keys, value, {"_upto": ("sum", F.col("_n"))}, {"_total": F.col("_n")}
    )
    before = F.col("_upto") - F.col("_n")
    picks = []
    for name, p in probabilities.items():
        at = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        part = at - low
        # Values are picked, not multiplied by 0 or 1: infinity times 0 is NaN.
        weight = {"low": (low, 1 - part), "high": (high, part)}
        share = [
            F.when((before <= i) & (i < F.col("_upto")) & (w > 0), F.col(value) * w)
            for i, w in weight.values()
        ]
        picks.append(F.sum(F.when(share[0].isNull(), share[1]).when(
            share[1].isNull(), share[0]).otherwise(share[0] + share[1])).alias(name))
    return placed.groupBy(*keys).agg(*picks)
