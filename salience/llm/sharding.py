"""Contiguous shards of nearly equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salience.session import cut_lineage

#: Bytes counted for each row besides its text.
ROW_BYTES = 16


def byte_shards(
    docs: DataFrame, shards: int = 40, order: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Cut all rows, in the order of a column, into shards of nearly equal bytes.

    Rows are range-partitioned by ``order``; each partition gives one total, the
    running sum of these totals gives each partition's start, and a running sum
    inside the partition gives each row's place in the whole.  A row belongs to
    the shard in which the middle of its bytes falls, so shards differ by less
    than one row from the target at each cut.  ``slot`` counts from 0 within a
    shard.

    A hot or repeated order value is split over partitions by a row number that
    is fixed by writing it out first.  Null order values come first; a null text
    has no bytes and checksum 0; an empty text counts its row bytes; no rows give
    no rows.  Columns besides ``order`` and ``text`` are not read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    sizes = docs.select(
        F.col(order).alias("doc_id"),
        (F.octet_length(content) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("seq"),
    )
    sizes = cut_lineage(sizes)
    ranged = sizes.repartitionByRange("doc_id", "seq").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("doc_id", "seq").rowsBetween(
        Window.unboundedPreceding, 0
    )
    runs = cut_lineage(ranged).withColumns(
        {"end": F.sum("size").over(within), "number": F.count("*").over(within)}
    )
    # One row for each partition: its number is the bound of these tables.
    totals = runs.groupBy("part").agg(
        F.max("end").alias("part_bytes"), F.max("number").alias("part_rows")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"),
    ))
    cut = F.expr(f"(2 * (bytes_before + end) - size) * {shards} div (2 * all_bytes)")
    placed = runs.join(F.broadcast(starts), "part").select(
        "doc_id", "size", "text_crc32",
        F.least(cut, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("number") - 1).alias("place"),
    )
    firsts = placed.groupBy("shard").agg(F.min("place").alias("shard_start"))  # a row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("shard_start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
