"""Joins of many rows with the one row of their key, however often a key occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from salience.session import cut_lineage, parallelism

#: Rows of one key that a task takes at least before the key is split.
HOT_ROWS = 100_000


def look_up(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``table``, whose ``key`` is unique.

    A key of more rows than a fair share of a task is split by a hash of the whole
    row, and its one row of ``table`` is copied to each part.  Shares are a quarter of a
    task's, so at most four such keys for each task exist and the list of them may be
    broadcast.  ``rows`` should be a written table, as it is counted first; a table of no
    more than ``HOT_ROWS`` rows cannot hold such a key.
    """
    tasks = parallelism(rows.sparkSession)
    total = rows.count()
    if total <= HOT_ROWS:
        return rows.join(table, key, how)
    limit = max(HOT_ROWS, total // (4 * tasks))
    hot = cut_lineage(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(
        F.col(key).alias("_hot")))
    marked = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    is_hot = F.col("_hot").isNotNull()
    dealt = marked(rows).withColumn(
        "_part", F.when(is_hot, F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(4 * tasks))).otherwise(F.lit(0))
    ).drop("_hot")
    copied = marked(table).withColumn(
        "_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(4 * tasks - 1))).otherwise(F.array(F.lit(0))))
    ).drop("_hot").withColumn("_part", F.col("_part").cast("bigint"))
    return dealt.withColumn("_part", F.col("_part").cast("bigint")).join(copied, [key, "_part"], how).drop("_part")
