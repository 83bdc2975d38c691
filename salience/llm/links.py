"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for linked nodes.

    ``edges`` has columns a and b; self-links and repeats do no harm.  Large and
    small stars alternate until nothing changes: in a large star the larger
    neighbours of a node move to its smallest neighbour, in a small star the
    smaller ones and the node itself.  Minima are combined before the shuffle and
    each round ends in a written table, so a hub costs no more than its links.
    """
    links = cut_lineage(_tidy(edges.select("a", "b")))
    seen = None
    while True:
        state = links.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if state == seen:
            break
        seen = state
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(_tidy(large))
        down = large.groupBy("a").agg(F.min("b").alias("m"))  # each link points to its smaller end
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(down.select("a", F.col("m").alias("b")))
        links = cut_lineage(_tidy(small))
    return links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _tidy(links: DataFrame) -> DataFrame:
    """Larger end first, each link once, no self-links."""
    return links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
