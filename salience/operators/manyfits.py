"""Many linear fits in one job: every pass over the rows serves all of them.

A fit is a set of features, a fold that it must not see and a seed of its sample.
A pass reads the training rows once, forms the margins of all fits by one matrix
product, and returns the loss and gradient of each, added up over tasks.  The
steps of all fits are then taken side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from salience.functions.expressions import complete
from salience.functions.shuffling import MODULUS, OFFSET, POSITION_FACTOR, SEED_FACTOR, hash_id
from salience.operators.matrix import feature_count, stratified_folds
from salience.operators.metrics import label_metrics, mean_and_std, mean_curve, pr_on_grid, ranking_metrics, roc_on_grid, score_counts
from salience.session import cut_lineage, parallelism

#: Bytes of the weights of fits that go through the rows together.
BLOCK_BYTES = 1 << 26
#: Passes over the rows at most, and the largest part of a gradient at which a fit ends.
PASSES, TOLERANCE = 200, 1e-7
#: Margins, of rows by fits, that a task holds at a time.
MARGINS = 1 << 19
#: Steps that a fit remembers.
MEMORY = 10
#: Chances of at most 0, 1, 2 ... copies of a row in a sample drawn with replacement.
COPIES = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(12), 1)))


@dataclass(frozen=True)
class Fit:
    """What one fit sees; ``fold`` and ``seed`` of None leave out no row and draw none."""

    features: tuple[int, ...]
    fold: int | None = None
    seed: int | None = None


def copies(hashes: np.ndarray, seeds: list[int | None]) -> np.ndarray:
    """How often each row (by the hash of its id) is in the sample of each seed."""
    out = np.ones((len(hashes), len(seeds)))
    for k, seed in enumerate(seeds):
        if seed is not None:
            x = (hashes * POSITION_FACTOR + (seed * SEED_FACTOR + OFFSET)) % MODULUS
            square = x * x % MODULUS
            drawn = square * square % MODULUS * x % MODULUS
            out[:, k] = np.searchsorted(COPIES, drawn / MODULUS, side="right")
    return out


def _slices(batches: Iterator[pa.RecordBatch], fits: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose margins are bounded, however many fits there are."""
    rows = max(1, MARGINS // max(1, fits))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def prepared(samples: DataFrame) -> DataFrame:
    """Training rows as the passes read them, written once."""
    kind = samples.schema["sample_id"].dataType.simpleString()
    fold = F.col("fold") if "fold" in samples.columns else F.lit(0)
    rows = samples.where(F.col("output").isin(0, 1)).select(
        complete(F.col("features"), F.col("sample_id")).alias("features"),
        F.col("output").cast("double").alias("y"), fold.cast("int").alias("fold"),
        hash_id(F.col("sample_id"), kind).alias("hash"))
    return cut_lineage(rows.repartition(parallelism(samples.sparkSession)))


def _pass(rows: DataFrame, weights: np.ndarray, fits: list[Fit]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and rows of each fit; the last weight is the intercept."""
    width = weights.shape[1] - 1
    folds = np.array([-1 if f.fold is None else f.fold for f in fits])
    seeds = [f.seed for f in fits]
    spread = sorted(set(seeds), key=lambda s: (s is not None, s))
    which = np.array([spread.index(s) for s in seeds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, count = np.zeros(len(fits)), np.zeros(len(fits))
        gradient = np.zeros((len(fits), width + 1))
        for batch in _slices(batches, len(fits)):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y, fold, hashes = (batch.column(i).to_numpy() for i in (1, 2, 3))
            seen = copies(hashes, spread)[:, which] * (fold[:, None] != folds[None, :])
            margin = x @ weights[:, :-1].T + weights[:, -1]
            loss += (seen * (np.logaddexp(0, margin) - y[:, None] * margin)).sum(0)
            off = seen * (1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y[:, None])
            gradient[:, :-1] += off.T @ x
            gradient[:, -1] += off.sum(0)
            count += seen.sum(0)
        told = np.column_stack([gradient, loss, count])
        ends = np.arange(len(fits) + 1, dtype=np.int32) * told.shape[1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(fits)), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(told.ravel()))],
            names=["fit", "sums"])

    sums = rows.mapInArrow(run, "fit int, sums array<double>").groupBy("fit").agg(
        vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    out = np.zeros((len(fits), width + 3))
    for fit, own in sums.collect():  # a row for each fit of the block
        out[fit] = own
    return out[:, -2], out[:, :-2], out[:, -1]


def fit_logistic(samples: DataFrame, fits: list[Fit], penalty: float = 1.0) -> np.ndarray:
    """Weights and intercept (last) of each fit, a row each; zero outside its features.

    Minimises the summed logistic loss plus ``penalty / 2`` times the squared weights
    (unit inverse regularisation; the intercept is free) by limited-memory
    quasi-Newton steps.  A fit whose trial point lowers its loss too little halves its
    step in the next pass; one that has converged leaves the pass.  Fits go in blocks
    of bounded bytes.  Rows whose output is neither 0 nor 1 are left out.
    """
    width = feature_count(samples)
    rows = prepared(samples)
    block = max(1, BLOCK_BYTES // (8 * (width + 3)))
    parts = [_fit_block(rows, fits[k : k + block], width, penalty) for k in range(0, len(fits), block)]
    return np.vstack(parts) if parts else np.zeros((0, width + 1))


def _fit_block(rows: DataFrame, fits: list[Fit], width: int, penalty: float) -> np.ndarray:
    n = len(fits)
    free = np.zeros((n, width + 1), bool)
    for k, fit in enumerate(fits):
        free[k, list(fit.features)] = True
    free[:, -1] = True
    held = np.append(np.full(width, penalty), 0.0)

    def evaluate(weights: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loss, gradient, count = _pass(rows, weights[who], [fits[k] for k in who])
        loss = loss + 0.5 * (held * weights[who] ** 2).sum(1)
        return loss, (gradient + held * weights[who]) * free[who], np.maximum(count, 1)

    best = np.zeros((n, width + 1))
    loss, slope, count = evaluate(best, np.arange(n))
    step = np.ones(n)
    moves: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
    direction = -slope / count[:, None]
    for _ in range(PASSES):
        who = np.flatnonzero(np.abs(slope).max(1) > TOLERANCE * count)
        who = who[step[who] > 1e-12]
        if not len(who):
            break
        trial = best.copy()
        trial[who] += step[who, None] * direction[who]
        new_loss, new_slope, _ = evaluate(trial, who)
        down = (direction[who] * slope[who]).sum(1)
        good = new_loss <= loss[who] + 1e-4 * step[who] * down + 1e-12 * np.abs(loss[who])
        step[who[~good]] /= 2
        for at in np.flatnonzero(good):
            k = who[at]
            moved, turned = trial[k] - best[k], new_slope[at] - slope[k]
            if moved @ turned > 1e-12 * np.sqrt((moved @ moved) * (turned @ turned)):
                moves[k] = [*moves[k][1 - MEMORY :], (moved, turned)]
            best[k], loss[k], slope[k], step[k] = trial[k], new_loss[at], new_slope[at], 1.0
            direction[k] = _descent(slope[k], moves[k])
    return best


def slopes(samples: DataFrame, fits: list[Fit], weights: np.ndarray, penalty: float = 1.0) -> list[tuple[int, float]]:
    """Rows of each fit and the largest part of its loss's slope at the weights, per row."""
    _, slope, count = _pass(prepared(samples), weights, fits)
    slope[:, :-1] += penalty * weights[:, :-1]
    out = []
    for k, fit in enumerate(fits):
        own = slope[k, [*fit.features, -1]]
        out.append((round(count[k]), float(np.abs(own).max() / max(count[k], 1))))
    return out


def _descent(slope: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The quasi-Newton direction of one fit from its last steps."""
    q, shares = slope.copy(), []
    for moved, turned in reversed(moves):
        share = (moved @ q) / (moved @ turned)
        shares.append(share)
        q = q - share * turned
    if moves:
        moved, turned = moves[-1]
        q = q * ((moved @ turned) / (turned @ turned))
    for (moved, turned), share in zip(moves, reversed(shares)):
        q = q + moved * (share - (turned @ q) / (moved @ turned))
    return -q


def score_all(test: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """Rows (fit, keep..., score): the margin of every fit on every row, in one pass."""
    schema = test.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(weights)):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            margin = x @ weights[:, :-1].T + weights[:, -1]
            row = np.repeat(np.arange(batch.num_rows), len(weights))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(len(weights), dtype=np.int32), batch.num_rows)),
                 *[c.take(pa.array(row)) for c in batch.columns[1:]], pa.array(margin.ravel())],
                names=["fit", *keep, "score"])

    slim = test.select(complete(F.col("features"), F.col("sample_id")).alias("_x"), *keep)
    return slim.mapInArrow(run, f"fit int, {kinds}, score double")


def fold_centroids(folded: DataFrame, folds: int) -> np.ndarray:
    """Weights and intercept of the class-mean scorer that leaves out each fold, in one pass."""
    sums = folded.where(F.col("output").isin(0, 1)).groupBy("fold", "output").agg(
        vector_to_array(Summarizer.sum(array_to_vector(complete(F.col("features"), F.col("sample_id"))))).alias("s"),
        F.count(F.lit(1)).alias("n")).collect()  # two rows for each fold
    width = len(sums[0]["s"]) if sums else 0
    total, size = np.zeros((folds, 2, width)), np.zeros((folds, 2, 1))
    for r in sums:
        total[r["fold"] - 1, r["output"]], size[r["fold"] - 1, r["output"]] = r["s"], r["n"]
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = (total.sum(0) - total) / (size.sum(0) - size)
    weights = mean[:, 1] - mean[:, 0]
    return np.column_stack([weights, -(weights * (mean[:, 1] + mean[:, 0]) / 2).sum(1)])


MODELS = ("centroid", "log")


def fold_scores(samples: DataFrame, folds: int = 5, model: str = "log") -> DataFrame:
    """``(fold, sample_id, output, probability)``: every sample scored by the fit that never saw it."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; choose from {MODELS}")
    folded = cut_lineage(stratified_folds(samples, folds))
    if model == "log":
        every = tuple(range(feature_count(samples)))
        weights = fit_logistic(folded, [Fit(every, fold) for fold in range(1, folds + 1)])
    else:
        weights = fold_centroids(folded, folds)
    scored = score_all(folded, weights, ["sample_id", "output", "fold"])
    own = scored.where((F.col("fit") + 1 == F.col("fold")) & F.col("output").isin(0, 1))
    return cut_lineage(own.select(
        "fold", "sample_id", "output", (1.0 / (1.0 + F.exp(-F.col("score")))).alias("probability")))


METRICS = ("accuracy", "f1", "auroc", "average_precision")


def cross_validate(samples: DataFrame, folds: int = 5, model: str = "log") -> DataFrame:
    """``(part, fold, metrics...)``: a row for each fold, then their mean and standard deviation.

    Folds are contiguous and balanced within the classes; samples without a label
    are in no score.  All fits of all folds are made together.
    """
    return fold_metrics(fold_scores(samples, folds, model))


def fold_metrics(scores: DataFrame) -> DataFrame:
    """Metrics of each fold's scores, their mean and their standard deviation."""
    hard = scores.withColumn("predicted", (F.col("probability") > 0.5).cast("int"))
    each = cut_lineage(label_metrics(hard, ["fold"], "output", "predicted").join(
        ranking_metrics(scores, ["fold"], "output", "probability"), "fold").select("fold", *METRICS))
    whole = mean_and_std(each.withColumn("_all", F.lit(1)), ["_all"], list(METRICS))
    rows = [F.struct(F.lit(part).alias("part"), *[F.col(f"{m}_{part}").alias(m) for m in METRICS])
            for part in ("mean", "std")]
    ends = whole.select(F.inline(F.array(*rows)))
    return each.select(F.lit("fold").alias("part"), "fold", *METRICS).unionByName(
        ends.select("part", F.lit(None).cast("int").alias("fold"), *METRICS))


def mean_curves(scores: DataFrame, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """Mean ROC and precision-recall curve of the folds, each with its area."""
    counts = cut_lineage(score_counts(scores, ["fold"], "output", "probability"))
    return (mean_curve(roc_on_grid(counts, ["fold"], points), [], "tpr", points),
            mean_curve(pr_on_grid(counts, ["fold"], points), [], "precision", points))


def sweep_many(
    train: DataFrame, test: DataFrame, features: list[int], counts: list[int], simulations: int,
) -> DataFrame:
    """AUROC and AUPRC of the best k features for every k and simulation, all fitted together.

    A simulation fits on a sample of the training rows drawn with replacement by its
    seed, as the optimum itself has no randomness.
    """
    jobs = [(k, sim) for k in counts for sim in range(simulations)]
    weights = fit_logistic(train, [Fit(tuple(features[:k]), None, sim) for k, sim in jobs])
    named = train.sparkSession.createDataFrame(
        [(i, k, sim) for i, (k, sim) in enumerate(jobs)], "fit int, num_features int, sim int")
    areas = ranking_metrics(score_all(test, weights, ["sample_id", "output"]), ["fit"], "output", "score")
    return areas.join(named, "fit").select(
        F.lit("log").alias("model"), "num_features", "sim", "auroc", F.col("average_precision").alias("auprc"))


def compare_many(
    train: DataFrame, tests: dict[str, DataFrame], chosen: dict[str, list[int]], simulations: int,
) -> DataFrame:
    """Mean and std of AUROC and AUPRC per data set and method, all fitted together."""
    jobs = [(name, sim) for name in chosen for sim in range(simulations)]
    weights = fit_logistic(train, [Fit(tuple(chosen[name]), None, sim) for name, sim in jobs])
    named = train.sparkSession.createDataFrame(
        [(i, name, sim) for i, (name, sim) in enumerate(jobs)], "fit int, method string, sim int")
    out = None
    for dataset, test in tests.items():
        areas = ranking_metrics(score_all(test, weights, ["sample_id", "output"]), ["fit"], "output", "score")
        part = areas.join(named, "fit").select(
            F.lit(dataset).alias("dataset"), F.lit("log").alias("model"), "method", "auroc",
            F.col("average_precision").alias("auprc"))
        out = part if out is None else out.unionByName(part)
    return mean_and_std(out, ["dataset", "model", "method"], ["auroc", "auprc"])
