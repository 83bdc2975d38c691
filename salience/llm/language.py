"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.toxicity import held_out
from salience.llm.words import LOWER, Words, blocks

#: Hash buckets of byte n-grams, and the n.
BUCKETS, GRAMS = 1 << 12, (1, 2, 3)
#: Centroids of a language; rows of a language that they are fitted on at most.
CLUSTERS, SAMPLE = 3, 800
#: A text less like its centroid than this share of the fitted rows were is rejected.
REJECT = 0.005
LETTER = r"\p{L}"
_ALPHA = np.array([chr(b).isalpha() or b >= 128 for b in range(128)] + [True] * 128)


def vectors(texts: pa.Array) -> np.ndarray:
    """Square roots of the counts of hashed byte n-grams of letters, a row for each text.

    A-Z count as a-z; every run of other bytes than letters counts as one space.
    """
    words = Words(texts, _ALPHA)
    out = np.zeros((words.n, BUCKETS), np.float32)
    if not len(words.start):
        return out
    size = words.end - words.start + 1  # a space before each word
    to = np.cumsum(size)
    data = np.full(int(to[-1]) + 1, 32, np.uint64)
    place = np.arange(int(to[-1]))
    word = np.repeat(np.arange(len(size)), size)
    source = words.start[word] + place - (to - size)[word] - 1
    inside = source >= words.start[word]
    data[:-1][inside] = LOWER[words.data[source[inside]]]
    row = words.doc[word]
    for n in GRAMS:
        code = np.full(len(place), n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x9E3779B1) + data[np.minimum(place + k, len(data) - 1)]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
        flat = row * BUCKETS + code.astype(np.int64)
        out += np.bincount(flat, minlength=words.n * BUCKETS).reshape(words.n, BUCKETS)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Unit centroids of unit rows, by cosine; starts are spread out."""
    centres = x[:1]
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
    for _ in range(20):
        own = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([
            x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))
        ]))
    return centres


def train(rows: list[tuple[str, np.ndarray]]) -> dict:
    """Inverse document frequencies, centroids, their languages and rejection cosines."""
    names = sorted({lang for lang, _ in rows})
    if not rows:
        return {"idf": np.zeros(BUCKETS, np.float32), "centres": np.zeros((0, BUCKETS)), "langs": [], "least": []}
    raw = np.stack([v for _, v in rows])
    idf = np.log((1 + len(raw)) / (1 + (raw > 0).sum(axis=0))).astype(np.float32) + 0.1
    centres, langs, least = [], [], []
    for name in names:
        x = _unit(raw[[k for k, (lang, _) in enumerate(rows) if lang == name]] * idf)
        made = _cluster(x, CLUSTERS)
        own = (x @ made.T).argmax(axis=1)
        for j, centre in enumerate(made):
            near = x[own == j] @ centre
            centres.append(centre)
            langs.append(name)
            least.append(float(np.quantile(near, REJECT)) if len(near) else 0.0)
    return {"idf": idf, "centres": np.stack(centres).astype(np.float32), "langs": langs, "least": least}


def predict(model: dict, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language of the nearest centroid, its cosine, and whether that is too far."""
    langs, score, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
    if len(model["langs"]) and len(texts):
        x = _unit(vectors(texts) * model["idf"])
        near = x @ model["centres"].T
        best = near.argmax(axis=1)
        score = np.clip(near.max(axis=1).astype(np.float64), 0, 1)
        langs = [model["langs"][k] for k in best]
        far = score < np.array(model["least"])[best]
    return langs, score, far


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.coalesce(F.col("text").rlike(LETTER), F.lit(False)).alias("lettered"), "text")


def _parts(block: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """At most 500 rows at a time, which bounds the table of counts."""
    for at in range(0, block.num_rows, 500):
        yield block.slice(at, 500)


def fit(docs: DataFrame) -> dict:
    """Centroids from about ``SAMPLE`` rows of each language outside the held-out fold.

    Rows are drawn by a hash of the id; the bound is a parameter of the fit only.
    Rows leave their tasks as count vectors of fixed size.
    """
    usable = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE / n))).otherwise(rate)
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                for part in _parts(block):
                    found = vectors(part.column(1)).astype(np.float16)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array([v.tobytes() for v in found], pa.binary())],
                        names=["lang", "vector"],
                    )

    drawn = usable.where(place < rate).select("lang", "text").mapInArrow(run, "lang string, vector binary")
    rows = [(r.lang, np.frombuffer(bytes(r.vector), np.float16).astype(np.float32)) for r in drawn.collect()]
    return train(sorted(rows, key=lambda r: (r[0], r[1].tobytes())))


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every whole text.

    Null texts and texts without a letter are ``und`` with score 0; so are all
    texts if no language was learned.  ``rejected`` tells texts farther from their
    centroid than fitted rows are.  Repeated rows give repeated results, null ids
    stay null, and columns other than doc_id and text are not read.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)  # a few rows of fixed size for each language
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                for part in _parts(block):
                    langs, score, far = predict(told.value, part.column(3))
                    lettered = part.column(2).to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1),
                         pa.array([x if y else "und" for x, y in zip(langs, lettered, strict=True)], pa.string()),
                         pa.array(np.where(lettered, score, 0.0)), pa.array(far | ~lettered)],
                        names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
                    )

    return _slim(docs).mapInArrow(run, schema)


def language(docs: DataFrame) -> DataFrame:
    """Fit on the rows with a language and predict all rows."""
    return identify(docs, fit(docs))
