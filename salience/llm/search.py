"""Ranked lexical search of a set of items over classes of documents with equal bags of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salience.llm.words import LETTERS, LOWER, Words, blocks
from salience.operators.scan import scan
from salience.session import cut_lineage, scratch_path

#: Terms: runs of ASCII letters, digits and all code points outside ASCII.
TERM = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
#: Documents told for each item.
TOP = 50
#: Pairs of an item and a term that are searched at a time; one longer item makes a block alone.
BLOCK_PAIRS = 1 << 17
#: Classes scored at a time, in cells of (pair, class).
CELLS = 4_000_000
#: Stands for a missing id, which comes last.
LAST = 2**63 - 1


@dataclass
class Block:
    """Items with their terms, as numbers of a sorted list of words."""

    items: list
    terms: list[bytes]
    owner: np.ndarray  # of each pair: place of the item, ascending
    term: np.ndarray  # of each pair: number of the term


class Finder:
    """Finds the words of a block's list in texts, by hash and then by bytes."""

    def __init__(self, terms: list[bytes]):
        listed = Words(pa.array([t.decode() for t in terms], pa.string()), LETTERS)
        hashes = listed.hashes(lower=False)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.data, self.start = listed.data, listed.start
        self.size = listed.end - listed.start

    def __call__(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places of the texts' words that are listed, and their numbers in the list."""
        if not len(self.hashes) or not len(words.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = words.hashes(lower=True)
        near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[near] == hashes)
        number = self.order[near[at]]
        size = words.end[at] - words.start[at]
        equal = size == self.size[number]
        at, number, size = at[equal], number[equal], size[equal]
        # All bytes of all matches, side by side.
        ends = np.cumsum(size)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        mine = LOWER[words.data[np.repeat(words.start[at], size) + step]]
        same = mine == self.data[np.repeat(self.start[number], size) + step]
        equal = np.logical_and.reduceat(same, ends - size) if len(ends) else np.zeros(0, bool)
        return at[equal], number[equal]


def item_blocks(items: DataFrame, text: str = "text") -> Iterator[Block]:
    """Blocks of items, in their order, of about ``BLOCK_PAIRS`` pairs of an item and a term."""
    folded = F.translate(F.col(f"`{text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = items.select(
        "item_id", F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))).alias("term"))
    pairs = cut_lineage(split.distinct())
    sizes = pairs.groupBy("item_id").agg(F.count("*").alias("n_terms"))
    placed = cut_lineage(scan(sizes, [], "item_id", {"upto": ("sum", F.col("n_terms"))}).select(
        F.col("item_id").alias("item"), F.expr(f"(upto - n_terms) div {BLOCK_PAIRS}").alias("block")))
    last = placed.agg(F.max("block")).first()[0]
    for number in range(-1 if last is None else last + 1):
        own = pairs.join(placed.where(F.col("block") == number),
                         F.col("item_id").eqNullSafe(F.col("item"))).select("item_id", "term").collect()
        if not own:
            continue
        names = sorted({r[0] for r in own}, key=lambda x: (x is None, x))
        terms = sorted({r[1].encode() for r in own})
        place, code = ({x: i for i, x in enumerate(xs)} for xs in (names, terms))
        told = np.array(sorted((place[i], code[t.encode()]) for i, t in own), np.int64)
        yield Block(names, terms, told[:, 0], told[:, 1])


def bags(docs: DataFrame, terms: list[bytes], text: str = "text") -> DataFrame:
    """doc_id, n (terms of the text) and its listed terms with their numbers of occurrences.

    Texts without a term give no row.
    """
    told = docs.sparkSession.sparkContext.broadcast(terms)  # of a block: bounded
    schema = "doc_id long, n long, terms array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = None
        for batch in batches:
            find = find or Finder(told.value)
            for block in blocks(batch):
                words = Words(block.column(1), LETTERS)
                at, number = find(words)
                width = max(len(told.value), 1)
                cell, counts = np.unique(words.doc[at] * width + number, return_counts=True)
                ends = np.searchsorted(cell, np.arange(words.n + 1) * width).astype(np.int32)
                rows = pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(np.diff(words.first).astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array((cell % width).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int32)))],
                    names=["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(np.diff(words.first) > 0))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.where("text IS NOT NULL").mapInArrow(run, schema)


def scores(block: Block, weights: np.ndarray, m: np.ndarray, ends: np.ndarray,
           terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Scores of classes (columns) for the items (rows) of a block, in 64-bit integers."""
    rows = np.repeat(np.arange(len(m)), np.diff(ends))
    tf = counts.astype(np.int64)
    worth = np.zeros((len(block.terms), len(m)), np.int64)
    worth[terms, rows] = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[rows]))
    first = np.searchsorted(block.owner, np.arange(len(block.items)))
    return np.add.reduceat(worth[block.term], first, axis=0)


def _best(found: list[np.ndarray], keep: int) -> np.ndarray:
    """Of rows (item, score, least id, class), the first ``keep`` of each item."""
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
    first = np.searchsorted(rows[0], rows[0])
    return rows[:, np.arange(rows.shape[1]) - first < keep]


def top_classes(classes: DataFrame, block: Block, weights: np.ndarray, keep: int) -> DataFrame:
    """The best ``keep`` classes of each item in each task, by score and then least id."""
    told = classes.sparkSession.sparkContext.broadcast((block, weights))  # of a block: bounded
    schema = "item int, score long, least long, class_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights = told.value
        step = max(CELLS // max(len(block.owner), len(block.terms)), 1)
        best = np.zeros((4, 0), np.int64)
        floor = np.zeros(len(block.items), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                least, class_id, m = (part.column(k).to_numpy() for k in range(3))
                terms, counts = part.column(3), part.column(4)
                ends = terms.offsets.to_numpy().astype(np.int64)
                got = scores(block, weights, m, ends - ends[0],
                             terms.flatten().to_numpy(), counts.flatten().to_numpy())
                item, row = np.nonzero((got > 0) & (got >= floor[:, None]))
                best = _best([best, np.stack([item, got[item, row], least[row], class_id[row]])], keep)
                full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) == keep)
                floor[full] = best[1][np.searchsorted(best[0], full) + keep - 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best[0].astype(np.int32)), *[pa.array(best[k]) for k in (1, 2, 3)]],
            names=["item", "score", "least", "class_id"])

    return classes.select("least", "class_id", "m", "terms", "counts").mapInArrow(run, schema)


def _search_block(docs: DataFrame, block: Block, keep: int, kind: str) -> DataFrame | None:
    """Ranks, ids and scores for the items of one block; None if no document has a term."""
    spark = docs.sparkSession
    table = cut_lineage(bags(docs, block.terms))
    n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    bag = table.where("size(terms) > 0").select(
        F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "terms", "counts",
        F.expr(f"100 - 50 + ((50 * n * {n_docs}L) div {n_terms}L)").alias("m"),
    ).withColumn("bag", F.xxhash64("terms", "counts", "m"))
    # Rows of one hash are told apart by the vectors themselves.
    classes = cut_lineage(bag.groupBy("bag", "terms", "counts", "m").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("members")
    ).withColumn("class_id", F.monotonically_increasing_id()))
    held = np.zeros(len(block.terms), np.int64)
    for row in classes.select(F.explode("terms").alias("term"), "members").groupBy("term").agg(
            F.sum("members").alias("df")).collect():
        held[row.term] = row.df  # a row for each term of the block
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * held + 1))).astype(np.int64)
    by_item = Window.partitionBy("item")
    firsts = top_classes(classes, block, weights, keep).withColumn(
        "place", F.row_number().over(by_item.orderBy(F.desc("score"), "least", "class_id"))
    ).where(F.col("place") <= keep).select("item", "score", "class_id")
    firsts = cut_lineage(firsts)
    chosen = cut_lineage(classes.join(firsts.select("class_id").distinct(), "class_id").select(
        "class_id", "bag", *[F.col(c).alias(f"c_{c}") for c in ("terms", "counts", "m")]))
    members = bag.join(chosen, "bag").where(
        "terms = c_terms AND counts = c_counts AND m = c_m").select("class_id", "doc_id")
    # An item never tells more than its first members of a class.
    shown = members.withColumn(
        "nth", F.row_number().over(Window.partitionBy("class_id").orderBy("doc_id"))
    ).where(F.col("nth") <= keep).select("class_id", "doc_id")
    ranked = firsts.join(shown, "class_id").withColumn(
        "rank", F.row_number().over(by_item.orderBy(F.desc("score"), "doc_id"))
    ).where(F.col("rank") <= keep)
    names = spark.createDataFrame(list(enumerate(block.items)), f"item int, item_id {kind}")
    return ranked.join(F.broadcast(names), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, keep: int = TOP, text: str = "text") -> DataFrame:
    """The ``keep`` documents of highest score for each item, best first.

    Items are taken in blocks of bounded size, for each of which the documents are
    scanned once and restricted to the block's words.  Documents with the same
    counts of these words and the same length factor m form a class (grouped by
    hash and then by the vectors), so copies are scored once.  Each task keeps the
    best classes of each item; ``keep`` classes by score and least id suffice, and
    only the first ``keep`` members of these are fetched again.

    Gives item_id, rank (from 1), doc_id and score.  All document rows count, also
    repeated ones and those without an id, which rank last among equal scores and
    keep a null doc_id; null texts and texts without a term count as no document.
    Rows of one item_id are one item; an item without terms gives no rows, nor do
    empty tables.  Other columns are not read.
    """
    slim = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "found")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in item_blocks(items.select("item_id", F.col(f"`{text}`").alias("text"))):
        found = _search_block(slim, block, keep, kind)
        if found is not None:
            found.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
