"""Benchmark passages in documents: latent semantic search, then exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.passages import _common
from salience.llm.words import LETTERS, Words, blocks
from salience.operators.rangefinder import singular_vectors

#: Hashed terms.
TERMS = 1 << 14
SHIFT = np.uint64(64 - 14)
#: Words in a passage of the document counts, and in the windows of the search (each moves by half).
PASSAGE, WINDOWS = 32, (16, 32, 64)
#: Benchmark items that one pass over the documents looks for.
ITEMS = 4096
#: Dimensions of the latent space, passes of its fit, passages that are one dense block.
RANK, ROUNDS, DENSE = 384, 2, 256
#: Cosine inside the latent space that makes a window a candidate, the share of a
#: piece's latent length along it that does so at any cosine, and the share without
#: which none is.  A window moves by half of itself and an item has at most 1.5 times
#: its words, so one window holds two thirds of a copy.
COSINE, MASS, LEAST = 0.45, 0.5, 0.33
STEP = min(WINDOWS) // 2


def _terms(texts: pa.Array, step: int) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their hashes, and terms laid out so that each row starts a new step.

    The free places hold the empty term ``TERMS``; the last array has the step at
    which each row starts.
    """
    words = Words(texts, LETTERS)
    hashes = words.hashes(lower=True)
    counts = np.diff(words.first)
    steps = -(-counts // step)
    at = np.concatenate([[0], np.cumsum(steps)])
    laid = np.full(at[-1] * step, TERMS, np.int64)
    places = np.arange(len(hashes)) + np.repeat(at[:-1] * step - words.first[:-1], counts)
    laid[places] = (hashes >> SHIFT).astype(np.int64)
    return words, hashes, laid, at


def _document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many passages of all texts each term occurs, and the number of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(TERMS + 1, np.int64), 0
        for batch in batches:
            for block in blocks(batch):
                _, _, laid, _ = _terms(block.column(0), PASSAGE)
                rows = np.sort(laid.reshape(-1, PASSAGE), axis=1)
                new = np.ones(rows.shape, bool)
                new[:, 1:] = rows[:, 1:] != rows[:, :-1]
                total += np.bincount(rows[new], minlength=TERMS + 1)
                n += len(rows)
        total[TERMS] = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), pa.array(total[some])], names=["term", "n"]
        )

    rows = docs.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(TERMS + 1, np.int64)
    for row in rows.collect():  # TERMS + 1 rows at most
        counts[row.term] = row.n
    return counts[:TERMS], int(counts[TERMS])


@dataclass
class Space:
    """Latent space: the row of each hashed term in a basis that has the weights in it.

    The last row of the basis is empty, for terms that no item has.
    """

    row_of: np.ndarray
    basis: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        """Latent coordinates of a passage of these terms."""
        return self.basis[self.row_of[terms]].sum(axis=0)


def fit_space(docs: DataFrame, items: DataFrame, rank: int = RANK) -> Space:
    """A randomised SVD of the benchmark's TF-IDF passages, weighted by the whole corpus.

    Inverse document frequencies are over every passage of all documents and items.
    The rows of the SVD are the items' pieces at length one, made by tasks and never
    collected; its columns are the hashed terms that items have.
    """
    texts = items.select("text").where("text is not null")
    held, pieces = _document_counts(texts)
    counts, passages = _document_counts(docs.select("text").where("text is not null"))
    used = np.flatnonzero(held)
    row_of = np.full(TERMS + 1, len(used), np.int32)
    row_of[used] = np.arange(len(used))
    weights = np.log((1 + passages + pieces) / (1 + counts[used] + held[used]))

    def rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in blocks(batch):
            words = Words(block.column(0), LETTERS)
            terms = row_of[(words.hashes(lower=True) >> SHIFT).astype(np.int64)]
            ends = [(a + low, a + high) for a, b in zip(words.first[:-1], words.first[1:], strict=True) if b > a
                    for low, high in pieces_of(int(b - a))]
            for at in range(0, len(ends), DENSE):
                part = [np.bincount(terms[a:b], minlength=len(used)) for a, b in ends[at : at + DENSE]]
                dense = np.stack(part) * weights
                yield dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)

    vectors = singular_vectors(texts, rows, len(used), rank, rounds=ROUNDS)[1]
    basis = np.vstack([vectors * weights[:, None], np.zeros((1, vectors.shape[1]))])
    return Space(row_of, basis.astype(np.float32))


def window_of(length: int) -> int:
    """The window size nearest to a length."""
    return min(WINDOWS, key=lambda s: abs(np.log(s / length)))


def pieces_of(length: int) -> list[tuple[int, int]]:
    """Ends of the overlapping pieces, no longer than the largest window, of an item."""
    size = max(WINDOWS)
    first = [*range(0, max(length - size, 0), size // 2), max(length - size, 0)]
    return [(a, min(a + size, length)) for a in first]


def item_block(rows: list[tuple[int, str]], space: Space) -> dict:
    """Items in plain arrays, to broadcast: words, answers, latent vectors of their pieces."""
    words = Words(pa.array([t or "" for _, t in rows], pa.string()), LETTERS)
    hashes = words.hashes(lower=True)
    own = [hashes[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    pieces = [(k, w[a:b]) for k, w in enumerate(own) if len(w) for a, b in pieces_of(len(w))]
    nearest = np.array([window_of(len(w)) for _, w in pieces])
    latent = np.array([space.of((w >> SHIFT).astype(np.int64)) for _, w in pieces])
    latent = latent.reshape(len(pieces), space.basis.shape[1])
    size = np.linalg.norm(latent, axis=1)
    return {"ids": [i for i, _ in rows], "words": own, "size": size,
            "of_size": {s: np.flatnonzero(nearest == s) for s in WINDOWS if (nearest == s).any()},
            "item": np.array([k for k, _ in pieces]),
            "vectors": latent / np.maximum(size, 1e-9)[:, None],
            "kinds": [np.unique(w, return_counts=True) for w in own],
            "answers": [w[-max(3, len(w) // 5) :] for w in own]}


def _places(
    close: Iterator[tuple[int, int, int, float]], size: int
) -> Iterator[tuple[int, int, int, int, float]]:
    """Candidate windows (row, item, first word, cosine) joined where they touch."""
    current = None
    for row, item, first, cosine in sorted(close):
        if current and current[:2] == (row, item) and first <= current[3]:
            current = (row, item, current[2], first + size, max(current[4], cosine))
        else:
            if current:
                yield current
            current = (row, item, first, first + size, cosine)
    if current:
        yield current


def _close(
    space: Space, items: dict, laid: np.ndarray, at: np.ndarray, owner: np.ndarray, cosine: float
) -> Iterator[tuple[int, list[tuple[int, int, int, float]]]]:
    """By window size, the windows (row, item, first word, cosine) that are candidates."""
    places = space.row_of[laid].reshape(-1, STEP)
    total = space.basis[places[:, 0]]
    for k in range(1, STEP):
        total += space.basis[places[:, k]]
    for size, own in items["of_size"].items():
        width = size // STEP
        vectors, whole = items["vectors"][own].T, items["size"][own]
        starts = np.flatnonzero((np.arange(len(owner)) - at[owner]) % (width // 2) == 0)
        ends = np.minimum(starts + width, at[owner[starts] + 1])
        close = []
        for low in range(0, len(starts), 2048):
            s, e = starts[low : low + 2048], ends[low : low + 2048]
            latent = total[s]
            for k in range(1, width):
                inside = np.flatnonzero(s + k < e)
                latent[inside] += total[s[inside] + k]
            norm = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
            near = latent @ vectors
            wanted = np.minimum(np.maximum(cosine * norm[:, None], LEAST * whole), MASS * whole)
            i, j = np.nonzero((near >= wanted) & (near > 0))
            row = owner[s[i]]
            close += zip(row.tolist(), items["item"][own[j]].tolist(), ((s[i] - at[row]) * STEP).tolist(), (near[i, j] / norm[i]).tolist(), strict=True)
        yield size, close


def _find(
    texts: pa.Array, space: Space, items: dict, cosine: float, coverage: float
) -> list[tuple[int, int, float, float, int, int]]:
    """(row, item, cosine, coverage, start, end) of the best place of each leaked item."""
    words, hashes, laid, at = _terms(texts, STEP)
    if not len(laid):
        return []
    owner = np.repeat(np.arange(words.n), np.diff(at))
    best: dict[tuple[int, int], tuple[float, float, int, int]] = {}
    for size, close in _close(space, items, laid, at, owner, cosine):
        for row, item, first, last, likeness in _places(close, size):
            wanted = items["words"][item]
            n = int(words.first[row + 1] - words.first[row])
            wide = max(size, len(wanted))
            a, b = max(0, first - wide), min(n, last + wide)
            region = hashes[words.first[row] + a : words.first[row] + b]
            kinds, held = items["kinds"][item]
            kind = np.minimum(np.searchsorted(kinds, region), len(kinds) - 1)
            shared = kinds[kind] == region
            # No common subsequence has a word more often than both sides do.
            if np.minimum(np.bincount(kind[shared], minlength=len(kinds)), held).sum() < coverage * len(wanted):
                continue
            part, answer = _common(wanted, region) / len(wanted), items["answers"][item]
            if part < coverage or 2 * _common(answer, region) < len(answer):
                continue
            found = np.flatnonzero(shared)
            told = (part, likeness, a + int(found[0]), a + int(found[-1]) + 1)
            best[row, item] = max(best.get((row, item), told), told)
    return [(r, items["ids"][k], c, p, s, e) for (r, k), (p, c, s, e) in sorted(best.items())]


def _item_blocks(items: DataFrame, space: Space) -> Iterator[dict]:
    """The items in blocks of bounded size, in the order of their ids."""
    rows = items.select(F.col("item_id").cast("long"), "text").where("text is not null")
    block: list[tuple[int, str]] = []
    for row in rows.sort("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == ITEMS:
            yield item_block(block, space)
            block = []
    if block:
        yield item_block(block, space)


def leaks(
    docs: DataFrame, items: DataFrame, cosine: float = COSINE, coverage: float = 0.6, rank: int = RANK
) -> DataFrame:
    """doc_id, item_id, cosine, coverage, start_word and end_word of leaked items.

    Documents are searched in overlapping windows of about the length of an item, or
    of each of its overlapping pieces if it has over 64 words.  Both are compared in the
    latent space alone, so terms that no item has do not count: a window whose vector
    has a cosine of ``cosine`` with the piece's is a candidate, and so is one that holds
    half of the piece's length.  The words around it must hold a common subsequence
    of ``coverage``
    of the item's words, and half of the item's answer (its last fifth, three
    words at least) in order.  Words are runs of letters and digits, without case
    of A-Z.  Each document names an item once, at its best place.

    Null and wordless texts and items match nothing; repeated rows give repeated
    results; a null doc_id is given as null.  Without items or documents there are
    no rows.
    """
    space = fit_space(docs, items, rank)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(space)  # TERMS x RANK at most
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    schema = "doc_id long, item_id long, cosine double, coverage double, start_word int, end_word int"
    out = spark.createDataFrame([], schema)
    for block in _item_blocks(items, space):
        told = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            block = told.value
            for batch in batches:
                for part in blocks(batch):
                    rows = _find(part.column(1), shared.value, block, cosine, coverage)
                    ids = part.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                    columns = list(zip(*rows, strict=True)) or [()] * 6
                    kinds = [pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays(
                        [ids, *(pa.array(list(c), k) for c, k in zip(columns[1:], kinds, strict=True))],
                        names=["doc_id", "item_id", "cosine", "coverage", "start_word", "end_word"],
                    )

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out


def without_leaks(
    docs: DataFrame, items: DataFrame, cosine: float = COSINE, coverage: float = 0.6, rank: int = RANK
) -> DataFrame:
    """The rows, with all their columns, in which :func:`leaks` finds no item."""
    space = fit_space(docs, items, rank)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(space)  # TERMS x RANK at most
    at = docs.columns.index("text")
    for block in _item_blocks(items, space):
        told = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            block = told.value
            for batch in batches:
                for part in blocks(batch):
                    clean = np.ones(part.num_rows, bool)
                    clean[[r[0] for r in _find(part.column(at), shared.value, block, cosine, coverage)]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
