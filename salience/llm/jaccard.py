"""Exact Jaccard join of shingle sets through token-combination prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.llm.links import components
from salience.llm.words import Words, blocks, mix, spare, windows
from salience.session import cut_lineage

#: Documents that share a token at most so often that the token alone is an index key.
RARE = 64
#: Nodes in a block of a large bucket; two blocks at a time meet in one task.
BLOCK = 512


class Bounds:
    """Sizes that follow from the threshold, for sets of n tokens (ints or columns).

    Linked sets share ``overlap(n)`` tokens at least.  The first ``kept(n)`` tokens
    by hash of two linked sets share ``shared(n)`` at least: a set's tokens beyond
    ``kept`` are too few to hold more of the overlap, and the partner has 85 % of
    the size at least.  ``spare`` widens the prefix so that it can be ordered anew,
    rarest token first.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, n):
        return (n * self.percent + 99) // 100

    def spare(self, n):
        return np.maximum(1, np.minimum(self.overlap(n), n // 20 + 2))

    def kept(self, n):
        return n - self.overlap(n) + self.spare(n)

    def shared(self, n):
        return self.spare(self.overlap(n))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of ``size`` words.

    A-Z count as a-z.  A text with fewer words has its whole sequence as its only
    shingle; one without words has none.
    """
    words = Words(texts)
    hashes = words.hashes(lower=True)
    grams, at = windows(hashes, words.doc, size)
    cuts = np.searchsorted(at, words.first)
    out = []
    for row in range(words.n):
        a, b = words.first[row], words.first[row + 1]
        if b - a >= size:
            out.append(np.unique(grams[cuts[row] : cuts[row + 1]]))
        elif b > a:
            whole, _ = windows(hashes[a:b], words.doc[a:b], int(b - a))
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """A signed 64-bit number for a set, the same in any order."""
    total = int(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
    return int(mix(np.array([(total + len(tokens)) % 2**64], np.uint64)).view(np.int64)[0])


def _marks(docs: DataFrame, size: int, bounds: Bounds) -> DataFrame:
    """doc_id, node (the set's key), n and the kept tokens of each row.

    Within a task the tokens of a set are given once; copies have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for block in blocks(batch):
                sets = shingle_sets(block.column(1), size)
                keys = [set_key(s) for s in sets]
                kept = []
                for key, tokens in zip(keys, sets, strict=True):
                    n = 0 if key in met else len(tokens)
                    met.add(key)
                    kept.append(tokens[: bounds.kept(n)] if n else tokens[:0])
                ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
                flat = np.concatenate(kept).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(keys, pa.int64()),
                     pa.array([len(s) for s in sets], pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "node", "n", "tokens"],
                )

    return docs.mapInArrow(run, "doc_id long, node long, n int, tokens array<long>")


def _index(marks: DataFrame, bounds: Bounds) -> DataFrame:
    """Index keys of each node that can have a partner, and the nodes of each key.

    A node's kept tokens are ordered by (frequency, hash).  Tokens of one document
    have no partner; if they fill the prefix, the node is done.  Otherwise the
    first token that two linked nodes share is in both prefixes.  If it is rare, it
    is an index key alone.  If it is frequent, all shared tokens are, and there are
    two of them in the prefix widened by one, so pairs of frequent tokens are the
    keys.  Tokens are first put in classes (a token takes the smallest first token
    among the nodes that have it), so that a group of near copies, which shares
    dozens of tokens, gives few keys.
    """
    kept = _sized(bounds, "n", "kept")
    prefix = kept - _sized(bounds, "n", "shared") + 1
    tokens = marks.select("node", "n", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(counts, "token").groupBy("node").agg(
        F.first("n").alias("n"),
        F.sort_array(F.collect_set(F.struct("df", "token"))).alias("order"),
    )
    single = prefix - (kept - F.size("order"))
    nodes = cut_lineage(
        shared.withColumn("single", single).where("single > 0").select(
            "node", "single", (_sized(bounds, "n", "shared") == 1).alias("short"),
            F.col("order")[0].alias("head"),
            F.slice("order", 1, F.least(F.col("single") + 1, F.size("order"))).alias("order"),
        )
    )
    entries = nodes.select(
        "node", "single", "short", "head", F.posexplode("order").alias("pos", "entry")
    ).select("node", "single", "short", "head", "pos", "entry.df", "entry.token")
    classes = entries.groupBy("token").agg(F.min("head").alias("class"))
    held = entries.join(classes, "token").select(
        "node", F.col("class.token").alias("class"),
        ((F.col("df") <= RARE) | F.col("short")).alias("alone"),
        (F.col("df") > RARE).alias("frequent"), (F.col("pos") < F.col("single")).alias("first"),
    )
    grouped = held.groupBy("node").agg(
        F.collect_set(F.when(F.col("alone") & F.col("first"), F.col("class"))).alias("ones"),
        F.sort_array(F.collect_set(F.when(F.col("frequent"), F.col("class")))).alias("many"),
    )
    keyed = grouped.select("node", F.explode(F.expr(
        """concat(transform(ones, t -> xxhash64('one', t)),
                  flatten(transform(many, (s, i) ->
                      transform(slice(many, i + 1, size(many)), t -> xxhash64('two', s, t)))))"""
    )).alias("key"))
    keyed = cut_lineage(keyed)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return keyed.join(sizes, "key")


def _sized(bounds: Bounds, n: str, what: str) -> Column:
    """A quantity of :class:`Bounds` as a column."""

    def overlap(x: str) -> str:
        return f"(({x} * {bounds.percent} + 99) div 100)"

    def spare(x: str) -> str:
        return f"greatest(1, least({overlap(x)}, {x} div 20 + 2))"

    return F.expr({"kept": f"{n} - {overlap(n)} + {spare(n)}", "shared": spare(overlap(n))}[what])


def _dealt(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """Sets of the wanted nodes, dealt to the pairs of blocks of each of their keys."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for block in blocks(batch):
                keys = [set_key(s) for s in shingle_sets(block.column(1), size)]
                fresh = [k not in met and not met.add(k) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), block.column(1)], names=["node", "text"]
                ).filter(pa.array(fresh))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                sets = [s.tobytes() for s in shingle_sets(block.column(1), size)]
                out: list[tuple] = []
                for row, node, places in zip(
                    sets, block.column(0).to_pylist(), block.column(2).to_pylist(), strict=True
                ):
                    for place in places:
                        count = -(-place["size"] // BLOCK)
                        own = node % count
                        for other in range(count):
                            pair = (min(own, other), max(own, other))
                            out.append((place["key"], *pair, own, node, row))
                    if len(out) >= 2000:
                        yield _rows(out, DEALT)
                        out = []
                yield _rows(out, DEALT)

    texts = docs.select("text").where("text is not null").select(
        F.lit(0).cast("long").alias("doc_id"), "text"
    ).mapInArrow(named, "node long, text string")
    places = wanted.groupBy("node").agg(F.collect_list(F.struct("key", "size")).alias("places"))
    # The same join at every size: neither side is bounded.
    joined = texts.join(places.hint("merge"), "node").select("node", "text", "places")
    return joined.mapInArrow(deal, DEALT)


DEALT = "key long, low int, high int, own int, node long, tokens binary"


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)],
        names=[name for name, _ in fields],
    )


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """A matrix of which sets on the left link with which on the right."""
    sizes = np.array([len(s) for s in left])[:, None], np.array([len(s) for s in right])[None, :]
    total = sizes[0] + sizes[1]
    if sizes[0].size * sizes[1].size <= 16:
        near = np.minimum(*sizes) * 100 >= np.maximum(*sizes) * percent
        both = np.zeros(total.shape, np.int64)
        for i, j in np.argwhere(near):
            both[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
    else:
        tokens, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        row = np.repeat(np.arange(len(left) + len(right)), np.concatenate([s.ravel() for s in sizes]))
        often = np.bincount(code, minlength=len(tokens)) > 1
        column = (np.cumsum(often) - 1)[code]
        row, column = row[often[code]], column[often[code]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        both = np.zeros(total.shape, np.float64)
        width = 2048
        cuts = np.searchsorted(column, np.arange(0, int(often.sum()) + width, width))
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            table = np.zeros((len(left) + len(right), width), np.float32)
            table[row[a:b], column[a:b] - k * width] = 1
            both += table[: len(left)] @ table[len(left) :].T
    return 100 * both >= percent * (total - both)


def _forest(nodes: list[int], sets: list[np.ndarray], sides: list[bool], percent: int) -> list[tuple]:
    """Links that join the nodes of a pair of blocks as all their links would.

    Left nodes meet right nodes; in a block with itself all nodes are both.
    """
    left = [i for i, s in enumerate(sides) if s]
    right = [i for i, s in enumerate(sides) if not s] or left
    links = linked_pairs([sets[i] for i in left], [sets[i] for i in right], percent)
    full = np.zeros((len(nodes), len(nodes)), bool)
    full[np.ix_(left, right)] = links
    full |= full.T
    fresh, out = np.ones(len(nodes), bool), []
    for start in range(len(nodes)):
        if not fresh[start]:
            continue
        fresh[start] = False
        stack = [start]
        while stack:
            i = stack.pop()
            found = np.flatnonzero(full[i] & fresh)
            fresh[found] = False
            stack += found.tolist()
            out += [(nodes[i], nodes[j]) for j in found.tolist()]
    return out


def _verify(dealt: DataFrame, percent: int) -> DataFrame:
    """Links between nodes that meet in a bucket, checked on their whole sets."""

    def solve(group: list[tuple[int, int, bytes]]) -> list[tuple]:
        """One pair of blocks; a node that came twice counts once."""
        once = {node: (own, raw) for own, node, raw in group}
        if len(once) < 2:
            return []
        nodes = list(once)
        first = min(own for own, _ in once.values())
        sides = [once[n][0] == first for n in nodes]
        sets = [np.frombuffer(once[n][1], np.uint64) for n in nodes]
        return _forest(nodes, sets, sides, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group, out = None, [], []
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            rest = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            for key, row in zip(keys, rest, strict=True):
                if key != current:
                    out += solve(group)
                    current, group = key, []
                group.append(row)
            if len(out) > 10_000:
                yield _rows(out, "a long, b long")
                out = []
        yield _rows(out + solve(group), "a long, b long")

    placed = dealt.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(run, "a long, b long")


def near_copies(
    docs: DataFrame, size: int = 4, percent: int = 85, text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, over all links.

    Two rows link when their shingle sets' intersection is ``percent`` % of their
    union at least; ``component_id`` is the smallest doc_id that links reach.
    Rows with equal sets are one node, so copies are never paired.  A bucket of the
    index is cut into blocks; two blocks meet in one bounded group that gives a
    spanning forest of its links, not its pairs.

    A null text or one without words has 0 shingles and its own doc_id as
    component.  A null doc_id never names a component unless it has no other.
    Repeated rows give repeated results; other columns are not read; no rows give
    no rows.
    """
    bounds = Bounds(percent)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    marks = cut_lineage(_marks(slim, size, bounds))
    wanted = cut_lineage(_index(marks, bounds))
    edges = _verify(_dealt(slim, size, wanted), percent)
    roots = components(edges)
    own = marks.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(named.join(least, "root").select("node", "component_id"))
    rows = marks.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return rows.join(classes, "node", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose doc_id is the smallest of their component.

    Rows without an id are kept, as nothing names them; rows that share a doc_id
    go or stay together.
    """
    (name,) = spare(docs.columns, "gone")
    found = near_copies(docs, size, percent, text).where("component_id <> doc_id").select(
        F.col("doc_id").alias(name)).distinct()
    gone = F.col("doc_id").cast("long") == F.col(name)
    return docs.join(found.hint("merge"), gone, "left_anti")
