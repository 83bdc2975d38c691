"""Rankings over features and the overlap of top-feature sets.

A window here orders the features of one run or model.  There are only as many
features as one sample row is wide, so these groups stay small however many
samples there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from salience.functions.expressions import clean_name


def average_ranks(importance: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Add ``rank``: descending, ties share the mean of their positions."""
    ordered = W.partitionBy(*keys).orderBy(F.col(value).desc())
    upto = F.count(F.lit(1)).over(ordered.rangeBetween(W.unboundedPreceding, W.currentRow))
    return importance.withColumn("rank", (F.rank().over(ordered) + upto) / F.lit(2.0))


def positions(ranking: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return ranking.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def aggregate_ranking(importance: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Rank every run and metric, add the ranks up and normalise.

    ``metrics`` restricts which runs count; by default accuracy and R^2 runs
    are mixed.
    """
    runs = importance if metrics is None else importance.where(F.col("metric").isin(metrics))
    totals = (
        average_ranks(runs, ["model", "run_id", "metric"], "diff")
        .groupBy("model", "feature_id")
        .agg(F.sum("rank").alias("rank_total"))
    )
    whole = W.partitionBy("model")
    low, high = F.min("rank_total").over(whole), F.max("rank_total").over(whole)
    place = F.row_number().over(whole.orderBy("rank_total", "feature_id"))
    return totals.select(
        "model",
        "feature_id",
        "rank_total",
        (1.0 - (F.col("rank_total") - low) / F.nullif(high - low, F.lit(0.0))).alias("rank_fin"),
        place.alias("position"),
    )


def magnitude_ranking(table: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Order by absolute value, largest first, keeping the sign."""
    return positions(table, keys or [], [F.abs(value).desc(), F.col("feature_id")])


def top_features(ranking: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """First n features of each model with cleaned names."""
    return (
        ranking.where(F.col("position") <= n)
        .join(names, "feature_id")
        .withColumn("feature_name", clean_name(F.col("feature_name")))
    )


def average_rank(rankings: DataFrame, first_model: str) -> DataFrame:
    """Mean normalised rank over models, aligned on the first model's features."""
    base = rankings.where(F.col("model") == first_model).select("feature_id")
    mean = (
        rankings.join(base, "feature_id", "left_semi")
        .groupBy("feature_id")
        .agg(F.avg("rank_fin").alias("mean_rank"))
    )
    return positions(mean, [], [F.col("mean_rank").desc(), F.col("feature_id")])


def rank_columns(rankings: DataFrame, models: list[str]) -> DataFrame:
    """One ``rank_fin`` column per model, aligned on the first model."""
    base = rankings.where(F.col("model") == models[0]).select("feature_id")
    return (
        rankings.join(base, "feature_id", "left_semi")
        .groupBy("feature_id")
        .pivot("model", models)
        .agg(F.max("rank_fin"))
    )


def membership_masks(rankings: DataFrame, models: list[str], n: int) -> DataFrame:
    """Bit mask per feature: bit i is set when model i has it in its top n."""
    bit = F.lit(0)
    for i, model in enumerate(models):
        bit = F.when(F.col("model") == model, F.lit(1 << i)).otherwise(bit)
    return (
        rankings.where((F.col("position") <= n) & F.col("model").isin(models))
        .groupBy("feature_id")
        .agg(F.bit_or(bit).alias("mask"))
    )


def venn_regions(masks: DataFrame) -> DataFrame:
    return masks.groupBy("mask").agg(F.count(F.lit(1)).alias("n_features"))


def shared_by_all(masks: DataFrame, models: int) -> DataFrame:
    return masks.where(F.col("mask") == (1 << models) - 1).select("feature_id")


def pairwise_only(masks: DataFrame) -> DataFrame:
    """Features in exactly two of the top lists, with the pair's mask."""
    return masks.where(F.bit_count("mask") == 2).select("mask", "feature_id")


def overlap_summary(masks: DataFrame, top_n: int, total: int) -> DataFrame:
    """Observed overlap of any two lists and its expectation under chance."""
    return masks.agg(
        F.count_if(F.bit_count("mask") >= 2).alias("total_overlap"),
        F.lit(3.0 * (top_n / total) ** 2 * total).alias("expected_overlap"),
    )
