"""Tie-aware classification metrics and curves.

Rows collapse to one per distinct score first; running counts over scores come
from the distributed :func:`scan`, so neither a hot score nor a large table
ends up in one task.  ``keys`` separates models, folds or datasets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from salience.operators.scan import scan


def label_metrics(df: DataFrame, keys: list[str], label: str, prediction: str) -> DataFrame:
    """Accuracy and F1 of hard predictions."""
    y, p = F.col(label), F.col(prediction)
    tp = F.count_if((y == 1) & (p == 1))
    fp = F.count_if((y == 0) & (p == 1))
    fn = F.count_if((y == 1) & (p == 0))
    return df.groupBy(*keys).agg(
        F.avg((y == p).cast("double")).alias("accuracy"),
        (2.0 * tp / F.nullif(2 * tp + fp + fn, F.lit(0))).alias("f1"),
    )


def score_counts(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Running true/false positives by descending score, one row per score.

    ``tp0``/``fp0`` are the counts before the row, so neighbouring points of a
    curve sit in one row and no second pass is needed.
    """
    grouped = df.groupBy(*keys, (-F.col(score)).alias("_down")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    whole = scan(
        grouped,
        keys,
        "_down",
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))},
        {"p_all": F.col("pos"), "n_all": F.col("neg")},
    )
    return whole.select(
        *keys,
        (-F.col("_down")).alias("threshold"),
        "pos",
        "neg",
        "tp",
        "fp",
        (F.col("tp") - F.col("pos")).alias("tp0"),
        (F.col("fp") - F.col("neg")).alias("fp0"),
        "p_all",
        "n_all",
    )


def _precision(tp: str, fp: str):
    return F.when(F.col(tp) + F.col(fp) == 0, F.lit(1.0)).otherwise(
        F.col(tp) / F.nullif(F.col(tp) + F.col(fp), F.lit(0))
    )


def curve_areas(counts: DataFrame, keys: list[str]) -> DataFrame:
    """AUROC, average precision and trapezoid PR area; null for one class."""
    p_all = F.nullif(F.col("p_all"), F.lit(0))
    n_all = F.nullif(F.col("n_all"), F.lit(0))
    pairs = F.col("neg") * (F.col("tp0") + F.col("pos") / F.lit(2.0))
    step = F.col("pos") / p_all
    return counts.groupBy(*keys).agg(
        F.sum(pairs / p_all / n_all).alias("auroc"),
        F.sum(step * _precision("tp", "fp")).alias("average_precision"),
        F.sum(step * (_precision("tp", "fp") + _precision("tp0", "fp0")) / 2.0).alias("pr_area"),
    )


def ranking_metrics(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    return curve_areas(score_counts(df, keys, label, score), keys)


def curve_points(counts: DataFrame, keys: list[str]) -> DataFrame:
    """ROC and PR points of every threshold."""
    return counts.select(
        *keys,
        "threshold",
        (F.col("fp") / F.nullif(F.col("n_all"), F.lit(0))).alias("fpr"),
        (F.col("tp") / F.nullif(F.col("p_all"), F.lit(0))).alias("tpr"),
        _precision("tp", "fp").alias("precision"),
        (F.col("tp") / F.nullif(F.col("p_all"), F.lit(0))).alias("recall"),
        (F.col("p_all") / (F.col("p_all") + F.col("n_all"))).alias("baseline"),
    )


def _cells(low, high, total, last: int):
    """Grid numbers g with low <= g*total/last < high, as an array."""
    first = F.ceil(low * last / total).cast("int")
    end = (F.ceil(high * last / total) - 1).cast("int")
    return F.when(first <= end, F.sequence(first, end))


def roc_on_grid(counts: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """TPR interpolated at ``points`` evenly spaced FPRs; 0 at FPR 0.

    Each score step emits only the grid points it covers, so no range join is
    needed.
    """
    last = points - 1
    n, p = F.col("n_all"), F.col("p_all")
    inner = counts.where(F.col("neg") > 0).select(
        *keys, "tp", "fp", "tp0", "fp0", "n_all", "p_all",
        F.explode(_cells(F.col("fp0"), F.col("fp"), n, last)).alias("grid"),
    )
    part = (F.col("grid") * n / F.lit(float(last)) - F.col("fp0")) / (F.col("fp") - F.col("fp0"))
    tpr = (F.col("tp0") + part * (F.col("tp") - F.col("tp0"))) / p
    body = inner.select(
        *keys, "grid", F.when(F.col("grid") == 0, F.lit(0.0)).otherwise(tpr).alias("tpr")
    )
    ends = counts.groupBy(*keys).agg(F.lit(last).alias("grid"), F.lit(1.0).alias("tpr"))
    return body.unionByName(ends)


def pr_on_grid(counts: DataFrame, keys: list[str], points: int = 100) -> DataFrame:
    """Precision interpolated at ``points`` evenly spaced recalls."""
    last = points - 1
    p = F.col("p_all")
    inner = counts.where(F.col("pos") > 0).select(
        *keys, "tp", "fp", "tp0", "fp0", "p_all",
        F.explode(_cells(F.col("tp0"), F.col("tp"), p, last)).alias("grid"),
    )
    part = (F.col("grid") * p / F.lit(float(last)) - F.col("tp0")) / (F.col("tp") - F.col("tp0"))
    start = _precision("tp0", "fp0")
    value = start + part * (_precision("tp", "fp") - start)
    body = inner.select(*keys, "grid", value.alias("precision"))
    ends = counts.groupBy(*keys).agg(
        F.lit(last).alias("grid"),
        (F.max("p_all") / (F.max("p_all") + F.max("n_all"))).alias("precision"),
    )
    return body.unionByName(ends)


def mean_curve(grid: DataFrame, keys: list[str], value: str, points: int = 100) -> DataFrame:
    """Average the folds' curves and add the trapezoid area of the mean curve."""
    mean = grid.groupBy(*keys, "grid").agg(F.avg(value).alias("mean_value"))
    # A curve has ``points`` rows.
    along = W.partitionBy(*keys).orderBy("grid")
    slice_area = (F.col("mean_value") + F.lag("mean_value").over(along)) / 2.0 / (points - 1)
    return mean.withColumn("_slice", slice_area).select(
        *keys,
        "grid",
        "mean_value",
        F.sum("_slice").over(W.partitionBy(*keys)).alias("mean_area"),
    )


def mean_and_std(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean and population standard deviation of each metric."""
    aggs = []
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_std")]
    return df.groupBy(*keys).agg(*aggs)
