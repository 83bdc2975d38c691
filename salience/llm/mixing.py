"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salience.operators.scan import dense_position, scan
from salience.session import cut_lineage

SPACE = "[\\x20\\x09-\\x0D]"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Times that a document may be taken.
MOST = 3
#: Words by which one symbol and one repeated line lower a document's quality.
SYMBOL_COST, LINE_COST = 4, 8
SEED = 11


def quality(size: Column, text: Column) -> Column:
    """A weight in (0, 1]: words over words plus the cost of symbols and repeated lines."""
    symbols = F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    repeated = F.size(lines) - F.size(F.array_distinct(lines))
    words = F.greatest(size, F.lit(1))
    return words / (words + SYMBOL_COST * symbols + LINE_COST * repeated)


def exponential(doc_id: Column, text: Column, seed: int) -> Column:
    """An exponential variate that only the seed, the id and the text decide."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), text)
    bits = F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long")
    return -F.ln((bits + F.lit(0.5)) / F.lit(float(2**52)))


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Words to take from each source: ``name``, ``source_size`` and ``target``.

    ``totals`` has a row for each source.  Names in code-point order get the
    weights in turn and share all words by them; no target exceeds ``most`` times
    its source, and the excess goes to the others by weight until none is above.
    That end is found at once: sources in the order of size over weight are full
    as long as filling them, and the rest at the same rate, asks for no more than
    all words.  Orders and sums over sources are range-partitioned scans, as
    sources have no bound.  Sources without words get 0; no sources give no rows.
    """
    placed = dense_position(totals.select("name", "source_size"), [], "name")
    step = F.element_at(F.array(*[F.lit(w) for w in weights]),
                        ((F.col("position") - 1) % len(weights) + 1).cast("int"))
    exact = "decimal(38,0)"
    ready = placed.withColumn("weight", step.cast("long")).select(
        "name", "source_size", "weight", (most * F.col("source_size")).alias("most"),
        F.struct((F.col("source_size") / F.col("weight")).alias("r"), "position").alias("turn"),
    )
    filled = cut_lineage(scan(
        ready, [], "turn",
        {"most_upto": ("sum", F.col("most")), "weight_upto": ("sum", F.col("weight"))},
        {"all_words": F.col("source_size"), "all_weights": F.col("weight")},
    ).withColumn("full", (
        F.col("most").cast(exact) * (F.col("all_weights") - F.col("weight_upto") + F.col("weight"))
        + F.col("weight").cast(exact) * (F.col("most_upto") - F.col("most"))
        <= F.col("weight").cast(exact) * F.col("all_words"))))
    rest = filled.agg(
        (F.max("all_words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0))).alias("words"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weights"))
    share = (rest.select(F.col("words").cast("double")).scalar() * F.col("weight")
             / rest.select(F.col("weights").cast("double")).scalar())
    return filled.select(
        "name", "source_size",
        F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED,
    text: str = "text",
) -> DataFrame:
    """How many words a mix takes from each document, so that sources meet their targets.

    A source whose target holds its size k times over is taken k times whole.  For
    the rest its documents are sorted by exponential keys divided by their quality
    weights (Efraimidis-Spirakis: a document comes early in proportion to its
    weight) and taken from the front while the middle of a document's words lies
    within the words still wanted.  So a source misses its target by at most half
    of one document, and none is taken more than ``most`` times.

    Rows are range-partitioned by (source, key), so a hot source is spread over
    many tasks; running sums stay inside a partition and totals of earlier
    partitions come through a join on (source, partition).  All is native.

    Gives doc_id, size (words), source_size, target, taken (words, repeats
    counted) and epochs (whole copies).  A null source is a source and comes last;
    null, empty and wordless texts have size 0 and are not taken; equal keys are
    ordered by id and size, so reruns agree and repeated rows are each counted;
    no rows give no rows; other columns are not read.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = F.col("source").cast("string")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), content.alias("content"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("name"),
        F.size(F.array_remove(F.split(content, f"{SPACE}+"), "")).cast("long").alias("size"),
    )
    keyed = cut_lineage(sized.select(
        "name", "doc_id", "size",
        (exponential(F.col("doc_id"), F.col("content"), seed)
         / quality(F.col("size"), F.col("content"))).alias("key"),
        F.monotonically_increasing_id().alias("seq"),
    ))
    order = ["key", "doc_id", "size", "seq"]
    ranged = cut_lineage(
        keyed.repartitionByRange("name", *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("name", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = ranged.withColumn("end", F.sum("size").over(inside))
    # A row for each source and partition; then one for each source.
    parts = cut_lineage(ranged.groupBy("name", "part").agg(F.sum("size").alias("part_size")))
    targets = source_targets(
        parts.groupBy("name").agg(F.sum("part_size").alias("source_size")), weights, most)
    before = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(parts.withColumn(
        "start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).join(targets, "name").select(
        "name", "part", "start", "source_size", "target",
        F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).alias("whole")))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    chosen = 2 * (F.col("start") + F.col("end")) - F.col("size") < 2 * rest
    epochs = F.col("whole") + chosen.cast("long")
    return runs.join(starts, ["name", "part"]).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * epochs).alias("taken"),
        F.when(F.col("size") > 0, epochs).otherwise(0).cast("long").alias("epochs"),
    )
