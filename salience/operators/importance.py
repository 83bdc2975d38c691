"""Permutation importance, perturbation sensitivity and prediction change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F, types as T

from salience.functions.expressions import binarise, complete, int_array, sigmoid, whole_vector
from salience.operators.matrix import feature_count
from salience.operators.permutation import CHUNK, shuffled_pairs
from salience.operators.rescoring import Rescorer, rescorer
from salience.operators.scorers import attach_scorer, score_linear, score_with_model


def baseline_metrics(scored: DataFrame) -> DataFrame:
    """Accuracy and R^2 of ``probability`` against ``output``, one row."""
    error = F.col("output") - F.col("probability")
    hit = (binarise(F.col("probability")) == F.col("output")).cast("bigint")
    sums = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hit).alias("hits"),
        F.sum(error * error).alias("sse"),
        F.sum(F.col("output").cast("double")).alias("sy"),
    )
    # output is 0/1, so the sum of squares equals the sum
    spread = F.col("sy") - F.col("sy") * F.col("sy") / F.col("n")
    return sums.select(
        "n",
        (F.col("hits") / F.col("n")).alias("accuracy"),
        (1.0 - F.col("sse") / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def _drops(sums: DataFrame, samples: DataFrame, repeats: int, model: str) -> DataFrame:
    """Mean metric drops from the summed ``gain`` and ``loss`` of a run and feature."""
    totals = samples.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("output").cast("double")).alias("sy")
        ).alias("t")
    ).scalar()
    spread = F.col("t.sy") - F.col("t.sy") * F.col("t.sy") / F.col("t.n")
    wide = sums.withColumn("t", totals).select(
        "run_id",
        "feature_id",
        (F.col("gain") / (F.col("t.n") * repeats)).alias("accuracy"),
        (F.col("loss") / F.nullif(spread, F.lit(0.0)) / repeats).alias("r2"),
    )
    return wide.select(
        F.lit(model).alias("model"),
        "run_id",
        "feature_id",
        F.inline(
            F.array(
                F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("diff")),
                F.struct(F.lit("r2").alias("metric"), F.col("r2").alias("diff")),
            )
        ),
    ).select("model", "run_id", "metric", "feature_id", "diff")


def _weighted(samples: DataFrame, scorer: DataFrame) -> DataFrame:
    """Samples with their margin and each feature's share of it as ``features``."""
    return attach_scorer(score_linear(samples, scorer), scorer).withColumn(
        "features", F.zip_with("features", "w", lambda v, w: v * w)
    ).drop("w", "bias")


def permutation_importance(
    samples: DataFrame,
    scorer: DataFrame,
    repeats: int,
    runs: int = 1,
    seed: int = 0,
    model: str = "linear",
    chunk: int = CHUNK,
) -> DataFrame:
    """Importance table of a linear scorer.

    The scorer is linear, so a feature's new value moves the margin by the
    difference of two shares and nothing is projected again.  A task rescores
    whole Arrow batches and returns one sum per run and feature.
    """
    pairs = shuffled_pairs(
        _weighted(samples, scorer), ["output", "margin"], runs, repeats, seed, chunk=chunk
    )

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            run, part, y, margin = (batch.column(i).to_numpy() for i in range(4))
            for key in set(zip(run.tolist(), part.tolist())):
                at = np.flatnonzero((run == key[0]) & (part == key[1]))
                x, x_new = (
                    batch.column(i).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                    for i in (4, 5)
                )
                own, truth = margin[at, None], y[at, None]
                # Scored alike, so a shuffle that changes nothing drops exactly nothing.
                with np.errstate(over="ignore"):
                    p, p_new = (1 / (1 + np.exp(-m)) for m in (own, own + (x_new - x)))
                hits = ((p > 0.5) == truth).astype(float) - ((p_new > 0.5) == truth)
                loss = (truth - p_new) ** 2 - (truth - p) ** 2
                found = np.stack([hits.sum(0), loss.sum(0)])
                sums[key] = sums[key] + found if key in sums else found
        for (run, part), found in sums.items():
            width = found.shape[1]
            yield pa.RecordBatch.from_pydict({
                "run_id": pa.array([run] * width, pa.int32()),
                "feature_id": pa.array(range(part * chunk, part * chunk + width), pa.int32()),
                "gain": pa.array(found[0]), "loss": pa.array(found[1]),
            })

    sums = (
        pairs.select("run_id", "chunk", "output", "margin", "x", "x_new")
        .mapInArrow(rescore, "run_id int, feature_id int, gain double, loss double")
        .groupBy("run_id", "feature_id")
        .agg(F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))
    )
    return _drops(sums, samples, repeats, model)


def _states(samples: DataFrame, model: Rescorer, vectors: str, extra: list[str]) -> DataFrame:
    """Samples with ``state``, what the model keeps of them; ``vectors`` names its input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            state = model.state(x)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * state.shape[1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(state.ravel()))],
                names=[*batch.schema.names[1:], "state"])

    rest = samples.select(*extra)
    schema = T.StructType([*rest.schema.fields, T.StructField("state", T.ArrayType(T.DoubleType()))])
    name = next((c for c in extra if c == "sample_id"), None)
    told = F.col(name) if name else F.lit("a row")
    return samples.select(complete(F.col(vectors), told).alias("_x"), *extra).mapInArrow(run, schema)


def _block(batch: pa.RecordBatch, column: str, at: np.ndarray | None = None) -> np.ndarray:
    """An array column of equal lengths as a matrix."""
    values = batch.column(batch.schema.names.index(column))
    values = values if at is None else values.take(pa.array(at))
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def permutation_importance_model(
    samples: DataFrame,
    classifier,
    repeats: int,
    runs: int = 1,
    seed: int = 0,
    model: str = "model",
    loadings: DataFrame | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Importance table of any fitted classifier, or of a :class:`Rescorer`.

    ``samples`` carries ``z`` (reduced features) when ``loadings(feature_id,
    weights ARRAY<DOUBLE>)`` is given.  Models that a rescorer knows keep a short
    state of each sample, which travels with the shuffled values; a changed value
    re-evaluates only what depends on it, and a task returns one sum for each run
    and feature.  A model of another kind is scored on whole rows.
    """
    table = None
    if loadings is not None:  # as wide as the fitted reducer
        table = np.array([r["weights"] for r in loadings.orderBy("feature_id").collect()], float)
    known = rescorer(classifier, table)
    if known is None:
        return _importance_by_scoring(samples, classifier, repeats, runs, seed, model, loadings, chunk)
    ready = _states(samples, known, "features" if loadings is None else "z", ["sample_id", "output", "features"])
    pairs = shuffled_pairs(ready, ["output", "state"], runs, repeats, seed, chunk=chunk)

    def rescore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            run, part, y = (batch.column(i).to_numpy() for i in range(3))
            for key in set(zip(run.tolist(), part.tolist())):
                at = np.flatnonzero((run == key[0]) & (part == key[1]))
                state, x, x_new = (_block(batch, c, at) for c in ("state", "x", "x_new"))
                truth, p = y[at], known.probability(state)
                found = np.zeros((2, x.shape[1]))
                for k in range(x.shape[1]):
                    p_new = known.moved(state, key[1] * chunk + k, x[:, k], x_new[:, k])
                    hits = ((p > 0.5) == truth).astype(float) - ((p_new > 0.5) == truth)
                    # Each row gives its own difference: a shuffle that changes nothing sums to zero.
                    found[:, k] = hits.sum(), ((truth - p_new) ** 2 - (truth - p) ** 2).sum()
                sums[key] = sums[key] + found if key in sums else found
        for (run, part), found in sums.items():
            width = found.shape[1]
            yield pa.RecordBatch.from_pydict({
                "run_id": pa.array([run] * width, pa.int32()),
                "feature_id": pa.array(range(part * chunk, part * chunk + width), pa.int32()),
                "gain": pa.array(found[0]), "loss": pa.array(found[1]),
            })

    sums = (
        pairs.select("run_id", "chunk", "output", "state", "x", "x_new")
        .mapInArrow(rescore, "run_id int, feature_id int, gain double, loss double")
        .groupBy("run_id", "feature_id")
        .agg(F.sum("gain").alias("gain"), F.sum("loss").alias("loss"))
    )
    return _drops(sums, samples, repeats, model)


def _importance_by_scoring(
    samples: DataFrame, classifier, repeats: int, runs: int, seed: int, model: str,
    loadings: DataFrame | None, chunk: int,
) -> DataFrame:
    """Importance of a model that is only known by its scores of whole rows.

    With a reducer a shuffled value moves ``z`` by a multiple of one loading row.
    Loadings meet the pairs as one row per chunk, before features multiply the rows.
    Without one an element of the feature array is replaced; whole vectors arise in
    the task that scores them and are never shuffled.
    """
    reduced = loadings is not None
    width = chunk if reduced else max(1, feature_count(samples))
    base = samples if reduced else samples.withColumn("z", F.lit(None).cast("array<double>"))
    inputs = score_with_model(base, classifier, "z" if reduced else "features").select(
        "sample_id", "output", "features", "z", F.col("probability").alias("p")
    )
    pairs = shuffled_pairs(inputs, ["output", "z", "p"], runs, repeats, seed, chunk=width)
    if reduced:
        parts = loadings.groupBy((F.col("feature_id") / width).cast("int").alias("chunk")).agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("feature_id", "weights"))),
                lambda row: row["weights"],
            ).alias("weights")
        )
        pairs = pairs.join(parts, "chunk")
        cells = F.arrays_zip("x", "x_new", "weights")
    else:
        cells = F.arrays_zip("x", "x_new")
    at = F.col("at")
    rows = pairs.select(
        "run_id", "chunk", "output", "p", "z", "x", F.posexplode(cells).alias("at", "cell")
    )
    if reduced:
        step = F.col("cell.x_new") - F.col("cell.x")
        moved = F.zip_with("z", "cell.weights", lambda a, b: a + step * b)
    else:
        moved = F.transform(
            "x", lambda v, i: F.when(i == at, F.col("cell.x_new")).otherwise(v)
        )
    rescored = score_with_model(
        rows.select(
            "run_id", (F.col("chunk") * width + at).cast("int").alias("feature_id"), "output", "p",
            moved.alias("z_new"),
        ),
        classifier, "z_new",
    ).withColumnRenamed("probability", "p_new")
    y = F.col("output")
    hit = lambda p: (binarise(p) == y).cast("bigint")
    # Each row gives its own difference: a shuffle that changes nothing sums to zero.
    loss = (y - F.col("p_new")) * (y - F.col("p_new")) - (y - F.col("p")) * (y - F.col("p"))
    sums = rescored.groupBy("run_id", "feature_id").agg(
        F.sum(hit(F.col("p")) - hit(F.col("p_new"))).alias("gain"), F.sum(loss).alias("loss")
    )
    return _drops(sums, samples, repeats, model)


def sensitivity(samples: DataFrame, scorer: DataFrame) -> DataFrame:
    """Mean squared prediction change after adding 1 % of a feature's range."""
    vectors = samples.select(whole_vector(samples).alias("v"))
    steps = (
        vectors.agg(
            vector_to_array(Summarizer.max(F.col("v"))).alias("hi"),
            vector_to_array(Summarizer.min(F.col("v"))).alias("lo"),
        )
        .select(F.zip_with("hi", "lo", lambda a, b: 0.01 * (a - b)).alias("step"))
        .scalar()
    )
    scored = attach_scorer(score_linear(samples, scorer), scorer).withColumn("step", steps)
    rows = scored.select(
        "margin",
        "probability",
        F.posexplode(F.zip_with("w", "step", lambda a, b: a * b)).alias("feature_id", "move"),
    )
    change = F.col("probability") - sigmoid(F.col("margin") + F.col("move"))
    return rows.groupBy("feature_id").agg(F.avg(change * change).alias("sensitivity"))


def sensitivity_model(samples: DataFrame, classifier, loadings: np.ndarray | None = None) -> DataFrame:
    """:func:`sensitivity` of any model that a rescorer knows; ``z`` is its input with loadings."""
    known = _known(classifier, loadings)
    ready = _states(samples, known, "features" if loadings is None else "z", ["sample_id", "features"])
    steps = samples.select(whole_vector(samples).alias("v")).agg(
        vector_to_array(Summarizer.max(F.col("v"))).alias("hi"),
        vector_to_array(Summarizer.min(F.col("v"))).alias("lo"),
    ).select(F.zip_with("hi", "lo", lambda a, b: 0.01 * (a - b)).alias("step")).first()  # one row's width
    step = np.array(steps[0] or [], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(step)), 0
        for batch in batches:
            if batch.num_rows:
                x, state = _block(batch, "features"), _block(batch, "state")
                p = known.probability(state)
                for k in range(len(step)):
                    total[k] += ((p - known.moved(state, k, x[:, k], x[:, k] + step[k])) ** 2).sum()
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({
                "feature_id": pa.array(range(len(step)), pa.int32()), "total": total,
                "n": pa.array([n] * len(step), pa.int64())})

    sums = ready.mapInArrow(run, "feature_id int, total double, n bigint").groupBy("feature_id")
    return sums.agg((F.sum("total") / F.sum("n")).alias("sensitivity"))


def _known(classifier, loadings: np.ndarray | None) -> Rescorer:
    found = rescorer(classifier, loadings)
    if found is None:
        raise ValueError(f"no rescorer for {type(classifier).__name__}")
    return found


def prediction_changes_model(
    samples: DataFrame, classifier, feature_ids: list[int], simulations: int, seed: int = 0,
    loadings: np.ndarray | None = None,
) -> DataFrame:
    """:func:`prediction_changes` of any model that a rescorer knows."""
    known = _known(classifier, loadings)
    ready = _states(samples, known, "features" if loadings is None else "z", ["sample_id", "features"])
    pairs = shuffled_pairs(
        ready, ["sample_id", "state"], 1, simulations, seed, feature_ids, chunk=max(1, len(feature_ids)))
    kind = samples.schema["sample_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            state, x, x_new = (_block(batch, c) for c in ("state", "x", "x_new"))
            p = known.probability(state)
            change = np.stack([
                p - known.moved(state, j, x[:, k], x_new[:, k]) for k, j in enumerate(feature_ids)], axis=1)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(feature_ids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(change.ravel()))],
                names=["pos", "chunk", "sample_id", "change"])

    changes = pairs.select("pos", "chunk", "sample_id", "state", "x", "x_new").mapInArrow(
        run, f"pos bigint, chunk int, sample_id {kind}, change array<double>")
    return _mean_changes(changes, simulations)


def _mean_changes(changes: DataFrame, simulations: int) -> DataFrame:
    """``(sample_id, features)``: the mean of a sample's changes, which meet on its position."""
    drawn = changes.groupBy("pos", "chunk").agg(
        F.first("sample_id").alias("sample_id"), F.collect_list("change").alias("drawn"))
    total = F.reduce(
        F.slice("drawn", 2, F.lit(simulations)), F.get("drawn", F.lit(0)),
        lambda s, c: F.zip_with(s, c, lambda a, b: a + b),
    )
    return drawn.select(
        "sample_id", F.transform(total, lambda v: v / F.lit(float(simulations))).alias("features")
    )


def prediction_changes(
    samples: DataFrame, scorer: DataFrame, feature_ids: list[int], simulations: int, seed: int = 0
) -> DataFrame:
    """``(sample_id, features)``: mean of baseline minus shuffled probability, as arrays.

    A sample's shuffles meet on its position, where their join has put them, and
    are averaged there; ``features`` follows the order of ``feature_ids``.
    """
    pairs = shuffled_pairs(
        _weighted(samples, scorer), ["sample_id", "margin"], 1, simulations, seed, feature_ids,
        chunk=max(1, len(feature_ids)),
    )
    change = F.zip_with(
        "x", "x_new",
        lambda a, b: sigmoid(F.col("margin")) - sigmoid(F.col("margin") + (b - a)),
    )
    return _mean_changes(pairs.select("pos", "chunk", "sample_id", change.alias("change")), simulations)


def prediction_change_model(
    samples: DataFrame, classifier, feature_ids: list[int], simulations: int, seed: int = 0,
    loadings: np.ndarray | None = None,
) -> DataFrame:
    """:func:`prediction_change` of any model that a rescorer knows, through its reducer if it has one."""
    return _by_feature(
        prediction_changes_model(samples, classifier, feature_ids, simulations, seed, loadings), feature_ids)


def prediction_change(
    samples: DataFrame, scorer: DataFrame, feature_ids: list[int], simulations: int, seed: int = 0
) -> DataFrame:
    """Mean of (baseline - shuffled probability) per sample and feature, long."""
    return _by_feature(prediction_changes(samples, scorer, feature_ids, simulations, seed), feature_ids)


def _by_feature(arrays: DataFrame, feature_ids: list[int]) -> DataFrame:
    return arrays.select("sample_id", F.posexplode("features").alias("_at", "avg_change")).select(
        "sample_id", F.get(int_array(feature_ids), F.col("_at")).alias("feature_id"), "avg_change"
    )
