"""Feature-ranking queries: importance, rankings, overlap, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.functions import combinatorics
from salience.functions.expressions import binarise, parse_pm
from salience.operators import attribution, importance, matrix, ranking, scan, scorers, sweep
from salience.plans import fixtures
from salience.session import cut_lineage
from salience.sources import tables

# The flagship workload: 4 runs of 25 shuffles.
RUNS, REPEATS, SEED = 4, 25, 100
SMALL_RUNS, SMALL_REPEATS = 3, 5
NARROW = 24


def long_explode(spark: SparkSession, sf: str) -> DataFrame:
    long = matrix.to_long(fixtures.samples(spark, sf))
    return long.select("sample_id", "output", "feature_id", F.round("value", 6).alias("value"))


def wide_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Long to arrays and back to one number per sample, order included."""
    data = matrix.to_arrays(matrix.to_long(fixtures.samples(spark, sf)))
    weighted = F.aggregate(
        F.transform("features", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )
    return matrix.features_only(data).select(
        "sample_id", F.size("features").alias("width"), F.round(weighted, 5).alias("checksum")
    )


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    parts = matrix.stratified_split(fixtures.samples(spark, sf))
    return parts.select("sample_id", "output", F.col("is_train").cast("int").alias("is_train"))


def folds_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    """Folds and a split of samples of which some have no label."""
    rows = fixtures.samples(spark, sf).withColumn(
        "output", F.when(F.col("sample_id") % 11 > 0, F.col("output")))
    parts = matrix.stratified_split(matrix.stratified_folds(rows, 7))
    return parts.select("sample_id", "output", "fold", F.col("is_train").cast("int").alias("is_train"))


def stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.stratified_folds(fixtures.samples(spark, sf), 7).select(
        "sample_id", "output", "fold"
    )


def centroid_scorer(spark: SparkSession, sf: str) -> DataFrame:
    data = fixtures.samples(spark, sf)
    scored = scorers.score_linear(data, scorers.fit_centroid(data))
    return scored.select(
        "sample_id",
        "output",
        F.round("margin", 6).alias("margin"),
        F.round("probability", 6).alias("probability"),
        binarise(F.col("probability")).alias("predicted"),
    )


def baseline_metrics(spark: SparkSession, sf: str) -> DataFrame:
    data = fixtures.samples(spark, sf)
    scored = scorers.score_linear(data, scorers.fit_centroid(data))
    return importance.baseline_metrics(scored).select(
        "n", F.round("accuracy", 6).alias("accuracy"), F.round("r2", 6).alias("r2")
    )


def _importance(
    spark: SparkSession, sf: str, runs: int, repeats: int, **options
) -> DataFrame:
    data = fixtures.samples(spark, sf)
    scorer = scorers.fit_centroid(data)
    diffs = importance.permutation_importance(data, scorer, repeats, runs, SEED, **options)
    return cut_lineage(diffs)


def importance_runs(spark: SparkSession, sf: str) -> DataFrame:
    return _importance(spark, sf, SMALL_RUNS, SMALL_REPEATS)


def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importance table, appended to a run store and read back."""
    from salience.session import scratch_path

    store = scratch_path(spark, "runs")
    tables.append_runs(_importance(spark, sf, SMALL_RUNS, SMALL_REPEATS), store)
    return tables.read_runs(spark, store).select(
        "run_id", "metric", "feature_id", F.round("diff", 8).alias("diff")
    )


def permutation_importance_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with features that travel in several chunks."""
    diffs = _importance(spark, sf, 1, SMALL_REPEATS, chunk=NARROW)
    return diffs.select("run_id", "metric", "feature_id", F.round("diff", 8).alias("diff"))


def feature_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Split, fit, permute, rank: the twenty most influential features."""
    data = fixtures.samples(spark, sf)
    parts = matrix.stratified_split(data)
    train, test = parts.where("is_train"), parts.where("not is_train")
    scorer = scorers.fit_centroid(train)
    diffs = importance.permutation_importance(test, scorer, REPEATS, RUNS, SEED)
    # The importance runs are stored before they are ranked.
    ranks = ranking.aggregate_ranking(cut_lineage(diffs))
    top = ranking.top_features(ranks, fixtures.feature_names(data), 20)
    return top.select(
        "feature_id", "feature_name", "rank_total", F.round("rank_fin", 6).alias("rank_fin"),
        "position",
    )


def aggregate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    ranks = ranking.aggregate_ranking(_importance(spark, sf, SMALL_RUNS, SMALL_REPEATS))
    return ranks.select(
        "feature_id", "rank_total", F.round("rank_fin", 6).alias("rank_fin"), "position"
    )


def accuracy_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking restricted to the accuracy runs."""
    ranks = ranking.aggregate_ranking(
        _importance(spark, sf, SMALL_RUNS, SMALL_REPEATS), ["accuracy"]
    )
    return ranks.select(
        "feature_id", "rank_total", F.round("rank_fin", 6).alias("rank_fin"), "position"
    )


def run_rankings(spark: SparkSession, sf: str) -> DataFrame:
    """One ranking per run; the runs stand for three models."""
    diffs = _importance(spark, sf, SMALL_RUNS, SMALL_REPEATS)
    named = diffs.withColumn("model", F.concat(F.lit("m"), F.col("run_id")))
    return cut_lineage(ranking.aggregate_ranking(named))


MODELS = ["m1", "m2", "m3"]
TOP = 15


def single_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return cut_lineage(
        ranking.aggregate_ranking(_importance(spark, sf, SMALL_RUNS, SMALL_REPEATS))
    )


def top_feature_projection(spark: SparkSession, sf: str) -> DataFrame:
    long = matrix.to_long(fixtures.samples(spark, sf))
    return matrix.select_top(long, single_ranking(spark, sf), 5).select(
        "sample_id", "output", "feature_id", F.round("value", 6).alias("value")
    )


def sensitivity_importance(spark: SparkSession, sf: str) -> DataFrame:
    data = fixtures.samples(spark, sf)
    table = importance.sensitivity(data, scorers.fit_centroid(data))
    return ranking.magnitude_ranking(table, "sensitivity").select(
        "feature_id", F.round(F.col("sensitivity") * 1e9, 3).alias("sensitivity_e9"), "position"
    )


def _shap(spark: SparkSession, sf: str, agg: str) -> DataFrame:
    parts = matrix.stratified_split(fixtures.samples(spark, sf))
    train, test = parts.where("is_train"), parts.where("not is_train")
    table = attribution.linear_shap(test, train, scorers.fit_centroid(train), agg)
    return ranking.magnitude_ranking(table, "importance").select(
        "feature_id", F.round("importance", 9).alias("importance"), "position"
    )


def linear_shap(spark: SparkSession, sf: str) -> DataFrame:
    return _shap(spark, sf, "mean")


def linear_shap_abs(spark: SparkSession, sf: str) -> DataFrame:
    return _shap(spark, sf, "mean_abs")


def venn_regions(spark: SparkSession, sf: str) -> DataFrame:
    masks = ranking.membership_masks(run_rankings(spark, sf), MODELS, TOP)
    return ranking.venn_regions(masks)


def venn_members(spark: SparkSession, sf: str) -> DataFrame:
    """Features shared by all three or by exactly two top lists."""
    masks = ranking.membership_masks(run_rankings(spark, sf), MODELS, TOP)
    every = ranking.shared_by_all(masks, 3).select(F.lit(7).alias("mask"), "feature_id")
    return every.unionByName(ranking.pairwise_only(masks))


def overlap_summary(spark: SparkSession, sf: str) -> DataFrame:
    masks = ranking.membership_masks(run_rankings(spark, sf), MODELS, TOP)
    width = fixtures.feature_names(fixtures.samples(spark, sf)).count()
    return ranking.overlap_summary(masks, TOP, width).select(
        "total_overlap", F.round("expected_overlap", 6).alias("expected_overlap")
    )


def log_factorial(spark: SparkSession, sf: str) -> DataFrame:
    """ln(n!) for n = 1 .. number of customers."""
    rows = fixtures.load(spark, sf, "customer").select("c_custkey")
    numbers = scan.dense_position(rows, [], "c_custkey", "n")
    return combinatorics.log_factorials(numbers).select(
        "n", F.round("log_factorial", 4).alias("log_factorial")
    )


def _supplier_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """1 .. 4 * number of suppliers."""
    rows = fixtures.load(spark, sf, "supplier").select("s_suppkey")
    placed = scan.dense_position(rows, [], "s_suppkey", "n")
    return placed.select(
        F.explode(F.sequence((F.col("n") - 1) * 4 + 1, F.col("n") * 4)).alias("n")
    )


def overlap_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Chance of at least k overlaps when suppliers are the features."""
    total = fixtures.load(spark, sf, "supplier").count()
    table = cut_lineage(combinatorics.log_factorials(_supplier_numbers(spark, sf)))
    share = ((total // 10) / total) ** 2
    return combinatorics.overlap_tail(table, total, share).select(
        "k", F.round("probability", 9).alias("probability")
    )


def overlap_two_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Log probability that two lists share exactly k features."""
    total = fixtures.load(spark, sf, "supplier").count()
    table = cut_lineage(combinatorics.log_factorials(_supplier_numbers(spark, sf)))
    left = table.where(F.col("n") < total).select(F.col("n").alias("k"), "log_factorial")
    right = table.where(F.col("n") < total).select(
        (F.lit(total) - F.col("n")).alias("k"), F.col("log_factorial").alias("rest")
    )
    top = table.where(F.col("n") == total).agg(F.max("log_factorial")).scalar()
    choose = F.col("top") - F.col("log_factorial") - F.col("rest")
    return (
        left.join(right, "k")
        .withColumn("top", top)
        .select(
            "k",
            F.round(choose, 4).alias("log_choose"),
            F.round(
                combinatorics.overlap_log_probability(choose, F.col("k"), total // 10, total), 4
            ).alias("log_probability"),
        )
    )


def average_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.average_rank(run_rankings(spark, sf), "m1").select(
        "feature_id", F.round("mean_rank", 6).alias("mean_rank"), "position"
    )


def rank_columns(spark: SparkSession, sf: str) -> DataFrame:
    table = ranking.rank_columns(run_rankings(spark, sf), MODELS)
    return table.select("feature_id", *[F.round(m, 6).alias(m) for m in MODELS])


SPLIT_SEEDS = [1, 2]


def _linear_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC/AUPRC for every feature count, two split seeds as simulations."""
    data = fixtures.samples(spark, sf)
    best = sweep.ordered_features(single_ranking(spark, sf), 64)
    curves = None
    for seed in SPLIT_SEEDS:
        parts = matrix.stratified_split(data, seed=seed)
        scorer = scorers.fit_centroid(parts.where("is_train"))
        scores = sweep.linear_sweep_scores(parts.where("not is_train"), scorer, best).select(
            "*", F.lit("centroid").alias("model"), F.lit(seed).alias("sim")
        )
        curves = scores if curves is None else curves.unionByName(scores)
    # Sums in different order differ in the last bits; equal scores must tie.
    tied = curves.withColumn("score", F.round("score", 9))
    return sweep.linear_sweep(tied, ["model", "num_features", "sim"])


def feature_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return sweep.mean_over_simulations(_linear_sweep(spark, sf)).select(
        "num_features", F.round("auroc", 6).alias("auroc"), F.round("auprc", 6).alias("auprc")
    )


def sweep_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    mean = cut_lineage(sweep.mean_over_simulations(_linear_sweep(spark, sf)))
    return sweep.cutoff(mean, "auroc", 0.025).select(
        "model", "num_features", "index", F.round("best", 6).alias("best")
    )


def _performance(spark: SparkSession, sf: str) -> DataFrame:
    """Performance table stand-in: order prices by status, priority and year."""
    orders = fixtures.load(spark, sf, "orders")
    return orders.groupBy(
        F.col("o_orderstatus").alias("dataset"),
        F.date_format("o_orderdate", "yyyy").alias("model"),
        F.col("o_orderpriority").alias("method"),
    ).agg(
        (F.avg("o_totalprice") / 1e6).alias("auroc_mean"),
        (F.stddev_pop("o_totalprice") / 1e6).alias("auroc_std"),
        (F.avg("o_totalprice") / 2e6).alias("auprc_mean"),
        (F.stddev_pop("o_totalprice") / 2e6).alias("auprc_std"),
    )


def _league(spark: SparkSession, sf: str, sort_by: str) -> DataFrame:
    return sweep.league(cut_lineage(_performance(spark, sf)), "auroc", sort_by).select(
        F.col("place").cast("int").alias("place"),
        "method",
        F.coalesce("dataset", F.lit("all")).alias("dataset"),
        F.round("mean", 6).alias("mean"),
        F.round("std", 6).alias("std"),
    )


def method_league(spark: SparkSession, sf: str) -> DataFrame:
    return _league(spark, sf, "mean")


def method_league_std(spark: SparkSession, sf: str) -> DataFrame:
    return _league(spark, sf, "std")


def format_parse_pm(spark: SparkSession, sf: str) -> DataFrame:
    cells = sweep.performance_cells(_performance(spark, sf))
    return cells.select(
        "dataset", "model", "method", "auroc",
        parse_pm(F.col("auroc"))["mean"].alias("mean"),
        parse_pm(F.col("auroc"))["std"].alias("std"),
    )


def square_pad(spark: SparkSession, sf: str) -> DataFrame:
    """All 64 values and the label, padded to 81."""
    data = fixtures.samples(spark, sf).withColumn(
        "features", F.array_append("features", F.col("output").cast("double"))
    )
    total = F.aggregate("features", F.lit(0.0), lambda s, v: s + v)
    return matrix.square_padded(data).select(
        "sample_id", F.size("features").alias("width"), F.round(total, 6).alias("total")
    )


def drop_null_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with at least one returned line, through nulls of an outer join."""
    orders = fixtures.load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    returned = (
        fixtures.load(spark, sf, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("returned"))
    )
    joined = orders.join(returned, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return matrix.drop_nulls(joined, ["returned"]).select("o_orderkey", "o_totalprice", "returned")


def label_index(spark: SparkSession, sf: str) -> DataFrame:
    customers = fixtures.load(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return matrix.encode_labels(customers, "c_mktsegment")


QUERIES = {
    f.__name__: f
    for f in (
        long_explode, wide_arrays, stratified_split, stratified_folds, folds_unlabelled, centroid_scorer,
        baseline_metrics, permutation_importance, permutation_importance_blocks,
        feature_ranking, aggregate_ranking, accuracy_ranking, top_feature_projection,
        sensitivity_importance, linear_shap, linear_shap_abs, venn_regions, venn_members,
        overlap_summary, log_factorial, overlap_probability, overlap_two_groups,
        average_rank, rank_columns, feature_sweep, sweep_cutoff, method_league,
        method_league_std, format_parse_pm, square_pad, drop_null_subset, label_index,
    )
}
