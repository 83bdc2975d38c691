"""Toxicity scores from a convolutional text classifier trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salience.llm.words import LETTERS, Words, blocks, mix
from salience.session import cut_lineage

#: Hash buckets of words and word beginnings, numbers in an embedding.
BUCKETS, DIM = 1 << 16, 16
#: Words that a filter sees, and filters of each width.
WIDTHS, FILTERS = (1, 2, 3), 12
#: Lengths in bytes of the word beginnings that get embeddings of their own.
STARTS = (3, 4, 5, 6)
#: Labelled rows that the classifier is fitted on at most, by label, and bytes in each.
SAMPLE, SAMPLE_BYTES = 1500, 16_000
EPOCHS, RATE, SEED = 6, 0.08, 5
#: Words that are scored at a time.
CHUNK = 40_000
#: Raw scores are counted in steps of a part of one, up to a bound, so counts are a bounded table.
STEPS, RAW_BOUND = 256, 64


@dataclass
class Model:
    """Weights of the network, words by language, and thresholds by language."""

    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * DIM, FILTERS)
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    base: float
    langs: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (the word, then its beginnings) and where each text starts.

    A beginning as long as the word has the empty bucket ``BUCKETS``.
    """
    words = Words(texts, LETTERS)
    sums = words.prefix_sums(lower=True)
    size = words.end - words.start
    columns = [words.span_hash(sums, words.start, words.end)]
    for length in STARTS:
        end = np.minimum(words.start + length, words.end)
        columns.append(mix(words.span_hash(sums, words.start, end) + np.uint64(length)))
    out = np.stack([(c >> np.uint64(48)).astype(np.int64) for c in columns], axis=1)
    for k, length in enumerate(STARTS):
        out[size <= length, k + 1] = BUCKETS
    return out, words.first


def _responses(model: Model, x: np.ndarray, width: int) -> np.ndarray:
    """Filter outputs at each place; x has a word a row, with width - 1 rows to spare."""
    n = len(x) - width + 1
    out = np.tile(model.bias[width], (n, 1))
    for k in range(width):
        out += x[k : k + n] @ model.filters[width][k * DIM : (k + 1) * DIM]
    return out


def _pad(x: np.ndarray) -> np.ndarray:
    return np.vstack([x, np.zeros((max(WIDTHS), x.shape[1]), x.dtype)])


def logits(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores, and the language group of each text by its words."""
    codes, first = features(texts)
    n = len(first) - 1
    pooled = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
    group = np.zeros((n, model.langs.shape[1]), np.float32)
    row = 0
    while row < n:
        to = max(row + 1, int(np.searchsorted(first, first[row] + CHUNK, "right")) - 1)
        part = codes[first[row] : first[to]]
        if len(part):
            x = model.embed[part[:, 0]]
            for k in range(1, part.shape[1]):
                x = x + model.embed[part[:, k]]
            lang = np.vstack([np.zeros((1, group.shape[1])), np.cumsum(model.langs[part[:, 0]], axis=0, dtype=np.float64)])
            offsets = first[row : to + 1] - first[row]
            group[row:to] = lang[offsets[1:]] - lang[offsets[:-1]]
            full = np.flatnonzero(np.diff(offsets) > 0)
            for w, width in enumerate(WIDTHS):
                out = np.maximum(_responses(model, _pad(x), width)[: len(x)], 0)
                # The last places of a text would see words of the next one.
                for back in range(1, width):
                    last = offsets[1:][full] - back
                    inside = last >= offsets[:-1][full]
                    place, end = last[inside], offsets[1:][full][inside]
                    out[place] = model.bias[width]
                    for k in range(width):
                        seen = place + k < end
                        out[place[seen]] += x[place[seen] + k] @ model.filters[width][k * DIM : (k + 1) * DIM]
                    out[place] = np.maximum(out[place], 0)
                top = np.maximum.reduceat(out, offsets[:-1][full], axis=0)
                pooled[row + full, w * FILTERS : (w + 1) * FILTERS] = top
        row = to
    return pooled @ model.dense + model.base, group.argmax(axis=1)


def score(model: Model, texts: pa.Array) -> np.ndarray:
    """Probabilities, 0.5 at the threshold of the text's language group."""
    raw, group = logits(model, texts)
    return 1 / (1 + np.exp(-np.clip(raw - model.thresholds[group], -30, 30)))


def train(texts: list[str], labels: np.ndarray, langs: list[str]) -> Model:
    """Fit the network by stochastic gradient steps, one text a step (Adagrad).

    A fifth of the rows is left out and sets first thresholds: for each language group
    the cut with the most right answers (:func:`calibrate` sets them by all rows).
    """
    rng = np.random.default_rng(SEED)
    model = Model(
        np.vstack([rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
        {w: rng.normal(0, 0.3 / w, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), 0.0,
    )
    if not len(texts):
        return model
    codes, first = features(pa.array(texts, pa.string()))
    labels = np.asarray(labels)
    _learn_languages(model, codes[:, 0], first, langs)
    held = np.arange(len(texts)) % 5 == 0
    steps = {k: np.full_like(v, 1e-6) for k, v in [("dense", model.dense), *(("f", w) and (f"f{w}", model.filters[w]) for w in WIDTHS), *((f"b{w}", model.bias[w]) for w in WIDTHS)]}
    embed_steps, base_step = np.full((BUCKETS + 1, 1), 1e-6, np.float32), 1e-6
    weight = {c: len(labels) / max(2 * (labels == c).sum(), 1) for c in (0, 1)}

    def move(name: str, target: np.ndarray, gradient: np.ndarray) -> None:
        steps[name] += gradient**2
        target -= RATE * gradient / np.sqrt(steps[name])

    for _ in range(EPOCHS):
        for row in rng.permutation(np.flatnonzero(~held)):
            part = codes[first[row] : first[row + 1]]
            if not len(part):
                continue
            x = _pad(model.embed[part].sum(axis=1))
            pooled, places = [], []
            for width in WIDTHS:
                out = _responses(model, x, width)[: len(part)]
                places.append(out.argmax(axis=0))
                pooled.append(np.maximum(out.max(axis=0), 0))
            pool = np.concatenate(pooled)
            raw = float(pool @ model.dense) + model.base
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[row]) * weight[int(labels[row])]
            back = error * model.dense * (pool > 0)
            move("dense", model.dense, error * pool)
            base_step += error**2
            model.base -= RATE * error / base_step**0.5
            at, change = [], []
            for k, width in enumerate(WIDTHS):
                mine = back[k * FILTERS : (k + 1) * FILTERS]
                seen = np.stack([x[places[k] + j] for j in range(width)], axis=1).reshape(FILTERS, -1)
                spread = (model.filters[width] * mine).T.reshape(FILTERS, width, DIM)
                for j in range(width):
                    at.append(places[k] + j)
                    change.append(spread[:, j])
                move(f"f{width}", model.filters[width], seen.T * mine)
                move(f"b{width}", model.bias[width], mine)
            at, change = np.concatenate(at), np.concatenate(change)
            real = (at < len(part)) & change.any(axis=1)
            buckets = part[at[real]]
            owner, change = buckets.ravel(), np.repeat(change[real], buckets.shape[1], axis=0)
            touched, code = np.unique(owner, return_inverse=True)
            gradient = np.zeros((len(touched), DIM), np.float32)
            np.add.at(gradient, code, change)
            embed_steps[touched] += (gradient**2).mean(axis=1, keepdims=True)
            model.embed[touched] -= RATE * gradient / np.sqrt(embed_steps[touched])
            model.embed[BUCKETS] = 0
    _calibrate(model, [t for t, h in zip(texts, held, strict=True) if h], labels[held])
    return model


def _learn_languages(model: Model, codes: np.ndarray, first: np.ndarray, langs: list[str]) -> None:
    """Log odds of words by language; a text's group is the one its words point to."""
    names = sorted({x for x in langs if x is not None}) or [""]
    counts = np.ones((BUCKETS, len(names)))
    for row, lang in enumerate(langs):
        if lang is not None:
            own = np.bincount(codes[first[row] : first[row + 1]], minlength=BUCKETS)[:BUCKETS]
            counts[:, names.index(lang)] += own
    share = np.log(counts / counts.sum(axis=0))
    model.langs = (share - share.mean(axis=1, keepdims=True)).astype(np.float32)
    model.thresholds = np.zeros(len(names))


def _calibrate(model: Model, texts: list[str], labels: np.ndarray) -> None:
    """Cuts by the given texts."""
    raw, group = logits(model, pa.array(texts, pa.string()))
    _set_cuts(model, group, raw, 1 - np.asarray(labels), np.asarray(labels))


def _set_cuts(model: Model, group: np.ndarray, raw: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> None:
    """Cuts with the most right answers by language group; a group of few rows takes the overall one.

    ``clean`` and ``toxic`` count the rows at a raw score.
    """

    def cut(own: np.ndarray) -> float:
        order = np.flatnonzero(own)[np.argsort(raw[own])]
        values = raw[order]
        ends = np.concatenate([[values[0] - 1], (values[1:] + values[:-1]) / 2, [values[-1] + 1]])
        wrong = np.concatenate([[0], np.cumsum(toxic[order])]) + np.concatenate([np.cumsum(clean[order][::-1])[::-1], [0]])
        return float(ends[wrong == wrong.min()].mean())

    if not len(raw):
        return
    everywhere = cut(np.ones(len(raw), bool))
    for g in range(len(model.thresholds)):
        own = group == g
        bad, rows = toxic[own].sum(), toxic[own].sum() + clean[own].sum()
        model.thresholds[g] = cut(own) if rows >= 20 and 0 < bad < rows else everywhere


def calibrate(docs: DataFrame, labels: DataFrame, model: Model, seen: list[int]) -> Model:
    """Set the cuts by the whole texts of all labelled rows outside the held-out fold, but those fitted on.

    ``seen`` are the ids that the fit has seen, at most 2 * ``SAMPLE``; without other
    rows the cuts stay.  Tasks score the texts; only ids, groups and scores meet the
    labels, and counts by group and step of the score, a bounded table, come to the driver.
    """
    spark = docs.sparkSession
    told = spark.sparkContext.broadcast(vars(model))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Model(**told.value)
            for block in blocks(batch):
                raw, group = logits(model, block.column(1))
                step = np.floor(np.clip(raw.astype(np.float64), -RAW_BOUND, RAW_BOUND) * STEPS)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(group.astype(np.int32)), pa.array(step.astype(np.int32))],
                    names=["doc_id", "group", "step"])

    learned = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = learned.mapInArrow(run, "doc_id long, group int, step int")
    used = spark.createDataFrame([(i,) for i in seen], "doc_id long")
    counted = scored.join(_marked(labels).hint("merge"), "doc_id").join(F.broadcast(used), "doc_id", "left_anti").groupBy(
        "group", "step").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic")).sort("group", "step")
    found = np.array([tuple(r) for r in counted.collect()], np.int64).reshape(-1, 4)
    _set_cuts(model, found[:, 0], (found[:, 1] + 0.5) / STEPS, found[:, 2], found[:, 3])
    return model


def _marked(labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``toxic`` of the labelled ids, once each."""
    return labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from the fit: crc32 of the id as text is a multiple of 5."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def draw(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` and ``toxic`` of the ``SAMPLE`` rows of each label with the smallest id hashes.

    Only ids and text lengths are joined, by a merge join at every size.  Counts of
    the hashes' first 12 bits, a bounded table, tell how far the sample reaches,
    so tasks hand over no more than the sample and one bin.
    """
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    usable = docs.where(
        ~held_out(F.col("doc_id")) & (F.octet_length("text") <= SAMPLE_BYTES)).select("doc_id").distinct()
    ids = cut_lineage(marked.join(usable.hint("merge"), "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"),
        F.xxhash64("doc_id").alias("hash")))
    first_bits = F.shiftright("hash", 52)
    reach: dict[int, list] = {0: [0, -(1 << 11) - 1], 1: [0, -(1 << 11) - 1]}
    for label, bits, n in ids.groupBy("toxic", first_bits).count().sort("toxic", first_bits).collect():
        if reach[label][0] < SAMPLE:
            reach[label] = [reach[label][0] + n, bits]
    near = ids.where(F.when(F.col("toxic") == 0, first_bits <= reach[0][1]).otherwise(first_bits <= reach[1][1]))
    place = F.row_number().over(Window.partitionBy("toxic").orderBy("hash", "doc_id"))
    return near.withColumn("place", place).where(F.col("place") <= SAMPLE).select("doc_id", "toxic", "hash")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on up to ``SAMPLE`` labelled rows of each label outside the held-out fold.

    Rows come in the order of a hash of the id, texts of up to ``SAMPLE_BYTES`` (the
    smallest text of a repeated id); these bounds are parameters of the fit only.
    The ids are drawn first and only their texts are fetched.  The cuts come from all
    other labelled rows, and scores use whole texts of all rows.
    """
    drawn = cut_lineage(draw(docs, labels).coalesce(1))
    texts = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = texts.join(F.broadcast(drawn), "doc_id").groupBy("hash", "doc_id", "toxic").agg(  # 2 * SAMPLE rows
        F.min(F.struct("text", "lang")).alias("own")).select("hash", "own.text", "own.lang", "toxic", "doc_id").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    model = train([r[1] for r in rows], np.array([r[3] for r in rows], np.int64), [r[2] for r in rows])
    return calibrate(docs, labels, model, [r[4] for at, r in enumerate(rows) if at % 5])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null and wordless texts get the score of no evidence.  Repeated rows give
    repeated results and null ids stay null; only doc_id and text are read, and
    doc_id is no input of the score.
    """
    told = docs.sparkSession.sparkContext.broadcast(vars(model))  # of fixed size
    schema = "doc_id long, held_out boolean, score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Model(**told.value)
            for block in blocks(batch):
                value = score(model, block.column(2)).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), block.column(1), pa.array(value),
                     pa.array((value >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       held_out(F.col("doc_id")).alias("held_out"), "text")
    return slim.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and score all rows."""
    return score_documents(docs, fit(docs, labels))
