"""Merkle fixity audit of replicas of a web archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salience.session import cut_lineage

#: Bytes of an offset range that makes a leaf, and children of a node.
LEAF_BYTES, FAN_OUT = 1 << 18, 8
#: Numbers of surplus records that make a leaf.
LEAF_RECORDS = 1024


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of a page's WARC response record, as UTF-8 text."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    """Each record's number, offset, length and leaf in the archive of the pages.

    Records follow page_id; equal ids follow their digest, null ids come first.
    Offsets are running sums from totals of range partitions, so no task holds
    the whole order.
    """
    content = record(F.col("page_id"), F.col("url"), F.col("html"))
    slim = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.sha2(content.cast("binary"), 256).alias("digest"),
        F.octet_length(content).cast("long").alias("length"),
        F.monotonically_increasing_id().alias("seq"),
    )
    ranged = cut_lineage(slim).repartitionByRange("page_id", "digest", "seq").withColumn(
        "part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("page_id", "digest", "seq").rowsBetween(
        Window.unboundedPreceding, 0)
    runs = cut_lineage(ranged).withColumns(
        {"end": F.sum("length").over(within), "place": F.count("*").over(within)})
    totals = runs.groupBy("part").agg(F.max("end").alias("bytes"), F.max("place").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(  # a row for each partition
        "part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    return cut_lineage(runs.join(F.broadcast(starts), "part").select(
        "page_id", "digest", (F.col("rows_before") + F.col("place") - 1).alias("number"),
        (F.col("base") + F.col("end") - F.col("length")).alias("offset"), "length",
    ).withColumn("node", F.floor(F.col("offset") / LEAF_BYTES)))


def tree(records: DataFrame) -> DataFrame:
    """All levels of a replica's tree: level, node and digest.

    ``records`` has number, digest and node, the leaf of its offset range.  A leaf
    hashes its records' digests in order, a node its children's; a leaf has as
    many records as fit in its range, a node ``FAN_OUT`` children.
    """

    def fold(rows: DataFrame, level: int) -> DataFrame:
        parts = F.sort_array(F.collect_list(F.struct("number", "digest")))
        joined = F.array_join(F.transform(parts, lambda p: p.digest), "")
        return cut_lineage(rows.groupBy("node").agg(
            F.sha2(joined.cast("binary"), 256).alias("digest")
        ).select(F.lit(level).alias("level"), "node", "digest"))

    level = fold(records, 0)
    levels, number = level, 0
    while level.agg(F.coalesce(F.max("node"), F.lit(0)).alias("m")).first().m > 0:
        number += 1
        level = fold(level.select(
            F.col("node").alias("number"), "digest", F.floor(F.col("node") / FAN_OUT).alias("node")), number)
        levels = levels.unionByName(level)
    return levels


def mismatching_leaves(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Leaves of two trees that differ: roots first, then only children of differing nodes."""
    top = ours.agg(F.coalesce(F.max("level"), F.lit(0)).alias("m")).first().m
    open_nodes = None
    for level in range(top, -1, -1):
        mine, other = (
            t.where(F.col("level") == level).select("node", F.col("digest").alias(name))
            for t, name in ((ours, "mine"), (theirs, "other"))
        )
        both = mine.join(other, "node", "full")
        if open_nodes is not None:
            parents = open_nodes.select(F.col("node").alias("parent"))
            both = both.withColumn("parent", F.floor(F.col("node") / FAN_OUT)).join(parents, "parent", "left_semi")
        open_nodes = cut_lineage(both.where(~F.col("mine").eqNullSafe(F.col("other"))).select("node"))
    return open_nodes


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """Each record with the replica's state: intact, corrupt, moved, missing or surplus.

    ``records`` is a :func:`manifest`; ``replica`` has number and digest of what a
    replica holds and, if it tells them, its own ``offset`` of each record, which is
    then hashed with the digest.  Both are hashed into trees over the manifest's offset
    ranges, records that the manifest does not know into leaves behind its end; equal
    roots end the audit, otherwise records are compared only in leaves that differ.

    A record with the right digest at another offset is moved; one that only the
    replica holds is surplus and has no page_id.  A number told twice alike counts
    once; told with different digests it is corrupt.  Rows of the replica without a
    number are left out.  Null pages and empty bodies are records as others; an empty
    archive gives only surplus rows.
    """
    placed_by = "offset" in replica.columns
    at = F.col("offset").cast("long") if placed_by else F.lit(None).cast("long")
    told = replica.where("number IS NOT NULL").select(
        F.col("number").cast("long").alias("number"), F.struct("digest", at.alias("at")).alias("entry")
    ).groupBy("number").agg(F.min("entry").alias("low"), F.max("entry").alias("high")).select(
        "number", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low.digest")).otherwise("").alias("held"),
        F.col("low.at").alias("held_at"))
    last = records.agg(F.coalesce(F.max("node"), F.lit(-1)).alias("m")).first().m
    both = cut_lineage(records.select("number", "node", "digest", "offset").join(told, "number", "full").withColumn(
        "node", F.coalesce("node", last + 1 + F.floor(F.abs("number") / LEAF_RECORDS))))

    def leaves(digest: str, offset: str) -> DataFrame:
        entry = F.concat_ws(":", F.col(offset).cast("string"), digest) if placed_by else F.col(digest)
        return both.where(F.col(digest).isNotNull()).select("number", entry.alias("digest"), "node")

    bad = mismatching_leaves(tree(leaves("digest", "offset")), tree(leaves("held", "held_at")))
    suspect = both.join(bad, "node", "left_semi")
    moved = ~F.col("held_at").eqNullSafe(F.col("offset")) if placed_by else F.lit(False)
    state = (
        F.when(F.col("digest").isNull(), "surplus").when(F.col("held").isNull(), "missing")
        .when(F.col("held") != F.col("digest"), "corrupt").when(moved, "moved"))
    wrong = suspect.select("number", "node", "held", "held_at", state.alias("state")).where("state IS NOT NULL")
    known = records.join(wrong.where("state <> 'surplus'").select("number", "state"), "number", "left").select(
        "page_id", "number", "offset", "length", F.col("node").alias("leaf"), "digest",
        F.coalesce("state", F.lit("intact")).alias("state"))
    return known.unionByName(wrong.where("state = 'surplus'").select(
        F.lit(None).cast("long").alias("page_id"), "number", F.col("held_at").alias("offset"),
        F.lit(None).cast("long").alias("length"), F.col("node").alias("leaf"),
        F.col("held").alias("digest"), "state"))


def damaged_replica(pages: DataFrame, records: DataFrame) -> DataFrame:
    """A replica of the archive, with faults in records of given numbers, to audit.

    Every 1009th record has lost its last byte, every 2003rd is missing.
    """
    content = record(F.col("page_id"), F.col("url"), F.col("html"))
    own = pages.select(content.alias("content")).withColumn(
        "digest", F.sha2(F.col("content").cast("binary"), 256)).groupBy("digest").agg(
        F.first("content").alias("content"))
    hit = (F.col("number") % 1009 == 13)
    cut = F.col("content").substr(F.lit(1), F.char_length("content") - 1)
    held = records.select("number", "digest").where("number % 2003 <> 17").join(own, "digest")
    return held.select("number", F.sha2(F.when(hit, cut).otherwise(F.col("content")).cast("binary"), 256).alias("digest"))
