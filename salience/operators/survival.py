"""Kaplan-Meier tables, log-rank tests and survival splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salience.functions.expressions import present
from salience.operators.scan import exact_quantiles, scan
from salience.operators.stats import at_or_below, mann_whitney


def kaplan_meier(df: DataFrame, keys: list[str], time: str, event: str) -> DataFrame:
    """Survival table per key: one row per distinct time.

    Rows whose time is null or NaN were not followed and are left out; a null event
    counts as none.
    """
    steps = df.where(present(F.col(time))).groupBy(*keys, time).agg(
        F.count_if(F.col(event) == 1).alias("deaths"), F.count(F.lit(1)).alias("leaving")
    )
    sized = scan(
        steps, keys, time, {"_upto": ("sum", F.col("leaving"))}, {"_size": F.col("leaving")}
    )
    at_risk = sized.select(
        *keys,
        time,
        "deaths",
        "leaving",
        (F.col("_size") - F.col("_upto") + F.col("leaving")).alias("at_risk"),
    )
    factor = 1.0 - F.col("deaths") / F.col("at_risk")
    return scan(at_risk, keys, time, {"survival": ("product", factor)})


def log_rank(df: DataFrame, keys: list[str], group: str, time: str, event: str) -> DataFrame:
    """Log-rank chi-square between group 0 and group 1, per key.

    Null when the variance is zero (no events, or one empty group).  Rows whose time
    is null or NaN, or whose group is neither, are left out; a null event counts as none.
    """
    in0, in1 = F.col(group) == 0, F.col(group) == 1
    died = F.col(event) == 1
    steps = df.where((in0 | in1) & present(F.col(time))).groupBy(*keys, time).agg(
        F.count_if(in0).alias("l0"),
        F.count_if(in1).alias("l1"),
        F.count_if(in0 & died).alias("d0"),
        F.count_if(in1 & died).alias("d1"),
    )
    sized = scan(
        steps,
        keys,
        time,
        {"_u0": ("sum", F.col("l0")), "_u1": ("sum", F.col("l1"))},
        {"s0": F.col("l0"), "s1": F.col("l1")},
    )
    n0 = (F.col("s0") - F.col("_u0") + F.col("l0")).cast("double")
    n1 = (F.col("s1") - F.col("_u1") + F.col("l1")).cast("double")
    n = n0 + n1
    d = (F.col("d0") + F.col("d1")).cast("double")
    expected = d * n0 / n
    variance = F.when(n > 1, n0 * n1 * d * (n - d) / (n * n * (n - 1.0))).otherwise(F.lit(0.0))
    sums = sized.groupBy(*keys).agg(
        F.sum("l0").alias("n0"),
        F.sum("l1").alias("n1"),
        F.sum(F.col("d0") - expected).alias("_excess"),
        F.sum(variance).alias("_variance"),
    )
    return sums.select(
        *keys,
        "n0",
        "n1",
        (F.col("_excess") * F.col("_excess") / F.nullif(F.col("_variance"), F.lit(0.0))).alias(
            "chi2"
        ),
    )


def median_groups(df: DataFrame, keys: list[str], value: str, name: str = "grp") -> DataFrame:
    """Add 0/1 for values at or below / above the median of their key."""
    medians = exact_quantiles(df, keys, value, {"_median": 0.5})
    if keys:
        cut = df.join(medians, keys, "left")
    else:
        cut = df.withColumn("_median", medians.scalar())
    return cut.withColumn(name, at_or_below(F.col(value), F.col("_median"))).drop("_median")


def cut_groups(df: DataFrame, value: str, cut: float | Column, name: str = "grp") -> DataFrame:
    """Add 0/1 around a fixed cut (0.5 for a 0/1 marker)."""
    level = cut if isinstance(cut, Column) else F.lit(float(cut))
    return df.withColumn(name, at_or_below(F.col(value), level))


def attach_survival(biomarkers: DataFrame, survival: DataFrame) -> DataFrame:
    """Left join by sample id after dropping repeated survival ids.

    Of repeated ids the earliest time is kept, a missing one only for want of others.  The biomarker stays in its own
    row, so repeated ids cannot shift it.
    """
    rest = [c for c in survival.columns if c not in ("sample_id", "survival_day")]
    unique = survival.groupBy("sample_id").agg(
        F.min(F.struct(F.isnull("survival_day").alias("_none"), "survival_day", *rest)).alias("_s")
    ).select("sample_id", "_s.*").drop("_none")
    return biomarkers.join(unique, "sample_id", "left")


def combined_analysis(biomarkers: DataFrame, survival: DataFrame) -> DataFrame:
    """Per model: two-group test of the biomarker and survival by its median.

    ``biomarkers`` is (model, sample_id, output, biomarker); all models run in
    one plan.
    """
    joined = attach_survival(biomarkers, survival)
    tests = mann_whitney(joined, ["model"], "biomarker", "output").select("model", "u", "z")
    split = median_groups(joined, ["model"], "biomarker")
    followed = split.where(F.col("survival_day").isNotNull())
    ranks = log_rank(followed, ["model"], "grp", "survival_day", "survival_event")
    return tests.join(ranks, "model", "left")
