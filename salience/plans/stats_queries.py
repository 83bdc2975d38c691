"""Metric, two-group and survival queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.operators import matrix, metrics, scorers, stats, survival
from salience.plans import fixtures
from salience.plans.ranking_queries import run_rankings
from salience.session import cut_lineage

SIGNIFICANCE = 0.05


def label_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and F1 per language of a fixed length rule."""
    rows = fixtures.scored_documents(spark, sf).withColumn(
        "predicted", (F.col("score") > 400).cast("int")
    )
    return metrics.label_metrics(rows, ["lang"], "y", "predicted").select(
        "lang", F.round("accuracy", 6).alias("accuracy"), F.round("f1", 6).alias("f1")
    )


def _areas(rows: DataFrame, keys: list[str]) -> DataFrame:
    table = metrics.ranking_metrics(rows, keys, "y", "score")
    return table.select(
        *keys, *[F.round(c, 6).alias(c) for c in ("auroc", "average_precision", "pr_area")]
    )


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC, average precision and PR area per language."""
    return _areas(fixtures.scored_documents(spark, sf), ["lang"])


def ranking_metrics_all(spark: SparkSession, sf: str) -> DataFrame:
    return _areas(fixtures.scored_documents(spark, sf), [])


def line_ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The same metrics on every order line: how price predicts a return."""
    rows = fixtures.load(spark, sf, "lineitem").select(
        "l_linestatus",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_extendedprice").alias("score"),
    )
    return _areas(rows, ["l_linestatus"])


def _duo(spark: SparkSession, sf: str) -> DataFrame:
    """Two data sets: English documents and the rest."""
    return fixtures.scored_documents(spark, sf).withColumn(
        "dataset", F.when(F.col("lang") == "en", F.lit("en")).otherwise(F.lit("other"))
    )


def curves_duo(spark: SparkSession, sf: str) -> DataFrame:
    """ROC and PR points of both data sets."""
    counts = metrics.score_counts(_duo(spark, sf), ["dataset"], "y", "score")
    points = metrics.curve_points(counts, ["dataset"])
    return points.select(
        "dataset", "threshold",
        *[F.round(c, 6).alias(c) for c in ("fpr", "tpr", "precision", "recall", "baseline")],
    )


def _fold_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.scored_documents(spark, sf).select(
        F.col("doc_id").alias("sample_id"), F.col("y").alias("output"), "score"
    )
    folded = matrix.stratified_folds(rows, 5)
    return metrics.score_counts(folded, ["fold"], "output", "score")


def mean_roc_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Mean ROC of five folds on a 100-point grid, with its area."""
    grid = metrics.roc_on_grid(_fold_counts(spark, sf), ["fold"])
    return metrics.mean_curve(grid, [], "tpr").select(
        "grid", F.round("mean_value", 6).alias("mean_value"), F.round("mean_area", 6).alias("mean_area")
    )


def mean_pr_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = metrics.pr_on_grid(_fold_counts(spark, sf), ["fold"])
    return metrics.mean_curve(grid, [], "precision").select(
        "grid", F.round("mean_value", 6).alias("mean_value"), F.round("mean_area", 6).alias("mean_area")
    )


def feature_density(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class density of order-line prices in 20 bins."""
    rows = fixtures.load(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    table = stats.density(rows, "l_extendedprice", "l_returnflag", 20)
    return table.select(
        "l_returnflag", "bin", F.round("bin_start", 4).alias("bin_start"), "n",
        F.round(F.col("density") * 1e6, 6).alias("density_e6"),
    )


def mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    """Rank test of four order-line columns between two groups."""
    table = stats.mann_whitney(fixtures.two_groups(spark, sf), ["feature"], "value", "output")
    return table.select(
        "feature", "n0", "n1", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"),
        F.round("mean_0", 4).alias("mean_0"), F.round("mean_1", 4).alias("mean_1"),
    )


def _with_gaps(df: DataFrame, value: str, key: str, every: int) -> DataFrame:
    """Null in each ``every``-th row by a key, NaN in the row after it."""
    left = F.pmod(F.col(key), F.lit(every))
    return df.withColumn(
        value, F.when(left == 0, None).when(left == 1, float("nan")).otherwise(F.col(value)))


def mann_whitney_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rank test of prices of which some are null or NaN."""
    rows = _with_gaps(fixtures.load(spark, sf, "lineitem"), "l_extendedprice", "l_partkey", 5).select(
        "l_linestatus", (F.col("l_returnflag") == "N").cast("int").alias("output"), "l_extendedprice")
    table = stats.mann_whitney(rows, ["l_linestatus"], "l_extendedprice", "output")
    return table.select(
        "l_linestatus", "n0", "n1", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"),
        F.round("mean_0", 4).alias("mean_0"), F.round("mean_1", 4).alias("mean_1"))


def feature_density_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Density of prices of which some are null or NaN."""
    rows = _with_gaps(fixtures.load(spark, sf, "lineitem"), "l_extendedprice", "l_partkey", 5)
    table = stats.density(rows, "l_extendedprice", "l_returnflag", 12)
    return table.select(
        "l_returnflag", "bin", F.round("bin_start", 4).alias("bin_start"), "n",
        F.round(F.col("density") * 1e6, 6).alias("density_e6"))


def kaplan_meier_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Survival table of customers of whom some have no time."""
    rows = _with_gaps(fixtures.survival(spark, sf), "survival_day", "sample_id", 6)
    table = survival.kaplan_meier(rows, ["c_mktsegment"], "survival_day", "survival_event")
    return table.select(
        "c_mktsegment", "survival_day", "deaths", "leaving", "at_risk",
        F.round("survival", 6).alias("survival"))


def log_rank_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Log-rank test of customers of whom some have no time."""
    split = survival.median_groups(fixtures.survival(spark, sf), [], "c_acctbal")
    rows = _with_gaps(split, "survival_day", "sample_id", 6)
    table = survival.log_rank(rows, [], "grp", "survival_day", "survival_event")
    return table.select("n0", "n1", F.round("chi2", 6).alias("chi2"))


def mann_whitney_p(spark: SparkSession, sf: str) -> DataFrame:
    """The p-values of the same tests."""
    from salience.functions.tails import normal_two_sided

    table = stats.mann_whitney(fixtures.two_groups(spark, sf), ["feature"], "value", "output")
    return table.select("feature", F.round(normal_two_sided(F.col("z")), 9).alias("p"))


def feature_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Rank test and sign of every matrix column."""
    table = stats.feature_tests(fixtures.samples(spark, sf), SIGNIFICANCE)
    return table.select(
        "feature_id", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"), "sign"
    )


def group_quartiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.two_groups(spark, sf)
    table = stats.two_group_summary(rows, ["feature"], "value", "output")
    return table.select(
        "feature", "output",
        *[F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")],
        F.round("z", 6).alias("z"),
    )


def biomarker(spark: SparkSession, sf: str) -> DataFrame:
    table = stats.biomarker(fixtures.samples(spark, sf), SIGNIFICANCE)
    return table.select("sample_id", "output", F.round("biomarker", 6).alias("biomarker"))


def biomarker_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.significance_counts(
        stats.feature_tests(fixtures.samples(spark, sf), SIGNIFICANCE)
    )


def kaplan_meier(spark: SparkSession, sf: str) -> DataFrame:
    """Survival table per market segment."""
    rows = fixtures.survival(spark, sf)
    table = survival.kaplan_meier(rows, ["c_mktsegment"], "survival_day", "survival_event")
    return table.select(
        "c_mktsegment", "survival_day", "deaths", "leaving", "at_risk",
        F.round("survival", 6).alias("survival"),
    )


def log_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Log-rank test across the median account balance."""
    rows = survival.median_groups(fixtures.survival(spark, sf), [], "c_acctbal")
    table = survival.log_rank(rows, [], "grp", "survival_day", "survival_event")
    return table.select("n0", "n1", F.round("chi2", 6).alias("chi2"))


def log_rank_p(spark: SparkSession, sf: str) -> DataFrame:
    from salience.functions.tails import chi_square_1

    rows = survival.median_groups(fixtures.survival(spark, sf), [], "c_acctbal")
    table = survival.log_rank(rows, [], "grp", "survival_day", "survival_event")
    return table.select(F.round(chi_square_1(F.col("chi2")), 9).alias("p"))


def log_rank_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Log-rank test inside every market segment, split at the segment median."""
    rows = survival.median_groups(fixtures.survival(spark, sf), ["c_mktsegment"], "c_acctbal")
    table = survival.log_rank(rows, ["c_mktsegment"], "grp", "survival_day", "survival_event")
    return table.select("c_mktsegment", "n0", "n1", F.round("chi2", 6).alias("chi2"))


def fixed_cut_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Group sizes and log-rank test around a fixed cut of a 0/1 marker."""
    rows = fixtures.survival(spark, sf).withColumn(
        "marker", (F.col("c_acctbal") < 0).cast("int")
    )
    split = survival.cut_groups(rows, "marker", 0.5)
    table = survival.log_rank(split, [], "grp", "survival_day", "survival_event")
    return table.select("n0", "n1", F.round("chi2", 6).alias("chi2"))


def biomarker_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Biomarker rows with survival data attached by id."""
    marked = stats.biomarker(fixtures.samples(spark, sf), SIGNIFICANCE)
    table = survival.attach_survival(
        marked, fixtures.survival(spark, sf).drop("c_acctbal", "c_mktsegment")
    )
    return table.select(
        "sample_id", "output", F.round("biomarker", 6).alias("biomarker"),
        "survival_day", "survival_event",
    )


def survival_inner(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.survival(spark, sf).select("sample_id", "survival_day", "survival_event")
    return matrix.labels_only(fixtures.samples(spark, sf)).join(rows, "sample_id")


TOP_COUNTS = {"m1": 10, "m2": 20, "m3": 30}


def combined_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Per model: biomarker on its top features, group test, survival test."""
    data = fixtures.samples(spark, sf)
    ranks = run_rankings(spark, sf)
    signs = cut_lineage(stats.feature_tests(data, SIGNIFICANCE))
    marked = None
    for model, count in TOP_COUNTS.items():
        top = ranks.where((F.col("model") == model) & (F.col("position") <= count))
        kept = signs.join(top.select("feature_id"), "feature_id", "left_semi")
        rows = stats.signed_sum(data, kept).withColumn("model", F.lit(model))
        marked = rows if marked is None else marked.unionByName(rows)
    # Equal sums must tie, whatever order they were added in.
    rounded = marked.withColumn("biomarker", F.round("biomarker", 9))
    table = survival.combined_analysis(
        rounded, fixtures.survival(spark, sf).drop("c_acctbal", "c_mktsegment")
    )
    return table.select(
        "model", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"),
        "n0", "n1", F.round("chi2", 6).alias("chi2"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        label_metrics, ranking_metrics, ranking_metrics_all, line_ranking_metrics, curves_duo,
        mean_roc_grid, mean_pr_grid, feature_density, mann_whitney, mann_whitney_p,
        mann_whitney_gaps, feature_density_gaps, kaplan_meier_gaps, log_rank_gaps,
        feature_tests, group_quartiles, biomarker, biomarker_counts, kaplan_meier, log_rank,
        log_rank_p, log_rank_segments, fixed_cut_survival, biomarker_survival, survival_inner,
        combined_analysis,
    )
}
