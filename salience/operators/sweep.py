"""Feature-count sweeps, the cutoff rule and method comparison."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from salience.functions.expressions import format_pm, int_array
from salience.operators.matrix import take_features
from salience.operators.metrics import mean_and_std, ranking_metrics
from salience.operators.models import create_model, fit_model
from salience.operators.scorers import attach_scorer, score_with_model
from salience.session import cut_lineage

# Concurrent fits; each one is itself a distributed job.
FIT_THREADS = 4


def ordered_features(ranking: DataFrame, k: int) -> list[int]:
    """Ids of the k best features (at most one sample row's width)."""
    rows = ranking.where(F.col("position") <= k).orderBy("position").select("feature_id").collect()
    return [r[0] for r in rows]


def linear_sweep_scores(
    test: DataFrame, scorer: DataFrame, feature_ids: list[int], min_features: int = 1
) -> DataFrame:
    """Margins of a linear scorer on its top k features, for every k at once.

    Running sums of the per-feature terms in rank order give all sweep points
    of a sample in one pass over its array.  The bias moves no rank, so it is
    left out.
    """
    ids = int_array(feature_ids)
    terms = F.transform(
        ids, lambda j: F.get(F.col("features"), j) * F.get(F.col("w"), j)
    )
    running = F.aggregate(
        "_terms",
        F.struct(F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("sums")),
        lambda acc, t: F.struct(
            (acc["total"] + t).alias("total"),
            F.array_append(acc["sums"], acc["total"] + t).alias("sums"),
        ),
    )["sums"]
    return (
        attach_scorer(test, scorer)
        .withColumn("_terms", terms)
        .select("sample_id", "output", F.posexplode(running).alias("_at", "score"))
        .where(F.col("_at") + 1 >= min_features)
        .select("sample_id", "output", (F.col("_at") + 1).alias("num_features"), "score")
    )


def linear_sweep(scores: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC and average precision for every key, in one job."""
    return ranking_metrics(scores, keys, "output", "score").select(
        *keys, "auroc", F.col("average_precision").alias("auprc")
    )


def mean_over_simulations(sweep: DataFrame) -> DataFrame:
    return sweep.groupBy("model", "num_features").agg(
        F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc")
    )


def cutoff(sweep: DataFrame, value: str, band: float, min_features: int = 1) -> DataFrame:
    """First point within ``band`` of the best score, per model.

    ``num_features`` is the count to use; ``index`` is its 0-based place in
    the sweep.
    """
    best = sweep.groupBy("model").agg(F.max(value).alias("best"))
    inside = F.col(value).between(F.col("best") - band, F.col("best") + band)
    return (
        sweep.join(best, "model")
        .where(inside)
        .groupBy("model")
        .agg(F.min("num_features").alias("num_features"), F.max("best").alias("best"))
        .select("model", "num_features", (F.col("num_features") - min_features).alias("index"), "best")
    )


def fit_and_score(jobs: list[dict], train: DataFrame, test: DataFrame) -> DataFrame:
    """Fit one classifier per job and collect all test scores in one relation.

    A job is ``{"keys": {column: value}, "features": [ids], "model": name,
    "seed": int, "options": {}}``.  Fits run a few at a time; every fit is a
    distributed MLlib job over the cached training rows.
    """
    train = train.persist()
    test = test.persist()
    try:

        def run(job: dict) -> DataFrame:
            ids = job["features"]
            model = fit_model(
                job["model"], take_features(train, ids), len(ids), job["seed"],
                **job.get("options", {}),
            )
            scored = score_with_model(take_features(test, ids), model)
            return scored.select(
                *[F.lit(v).alias(c) for c, v in job["keys"].items()],
                "sample_id",
                "output",
                F.col("probability").alias("score"),
            )

        with ThreadPoolExecutor(FIT_THREADS) as pool:
            parts = list(pool.map(run, jobs))
        return cut_lineage(reduce(DataFrame.unionByName, parts))
    finally:
        train.unpersist()
        test.unpersist()


def model_sweep(
    train: DataFrame,
    test: DataFrame,
    model: str,
    ranking: DataFrame,
    counts: list[int],
    simulations: int = 10,
    **options,
) -> DataFrame:
    """Train on the top k features for every k and seed; AUROC/AUPRC of each."""
    create_model(model, 1)
    best = ordered_features(ranking, max(counts))
    jobs = [
        {
            "keys": {"model": model, "num_features": k, "sim": sim},
            "features": best[:k],
            "model": model,
            "seed": sim,
            "options": options,
        }
        for k in counts
        for sim in range(simulations)
    ]
    return linear_sweep(fit_and_score(jobs, train, test), ["model", "num_features", "sim"])


def compare_methods(
    train: DataFrame,
    tests: dict[str, DataFrame],
    model: str,
    rankings: list[DataFrame],
    count: int,
    simulations: int,
    labels: list[str] | None = None,
    **options,
) -> DataFrame:
    """Mean and std of AUROC/AUPRC per data set and ranking method, keyed by label."""
    labels = labels or [f"DataFrame {i + 1}" for i in range(len(rankings))]
    chosen = {n: ordered_features(r, count) for n, r in zip(labels, rankings)}
    results = []
    for dataset, test in tests.items():
        jobs = [
            {
                "keys": {"dataset": dataset, "model": model, "method": name, "sim": sim},
                "features": ids,
                "model": model,
                "seed": sim,
                "options": options,
            }
            for name, ids in chosen.items()
            for sim in range(simulations)
        ]
        results.append(
            linear_sweep(fit_and_score(jobs, train, test), ["dataset", "model", "method", "sim"])
        )
    return mean_and_std(
        reduce(DataFrame.unionByName, results), ["dataset", "model", "method"], ["auroc", "auprc"]
    )


def performance_cells(performance: DataFrame) -> DataFrame:
    """Presentation strings ``"mean ± std"``."""
    return performance.select(
        "dataset",
        "model",
        "method",
        format_pm(F.col("auroc_mean"), F.col("auroc_std")).alias("auroc"),
        format_pm(F.col("auprc_mean"), F.col("auprc_std")).alias("auprc"),
    )


def league(performance: DataFrame, metric: str, sort_by: str = "mean") -> DataFrame:
    """Mean of means and of stds per method and per (method, dataset).

    One rollup gives both levels; ``dataset`` is null on the overall rows.
    ``sort_by`` orders the methods by overall mean or std.
    """
    mean, std = f"{metric}_mean", f"{metric}_std"
    table = (
        performance.rollup("method", "dataset")
        .agg(
            F.avg(mean).alias("mean"),
            F.avg(std).alias("std"),
            F.grouping("method").alias("_gm"),
            F.grouping("dataset").alias("_gd"),
        )
        .where(F.col("_gm") == 0)
    )
    overall = table.where(F.col("_gd") == 1)
    # A league has one row per method.
    place = F.row_number().over(W.orderBy(F.col(sort_by).desc(), F.col("method")))
    order = overall.select("method", place.alias("place"))
    return table.join(order, "method").select("place", "method", "dataset", "mean", "std")
