"""Two-group statistics: rank tests, densities, quartiles and biomarkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salience.functions.expressions import present
from salience.functions.tails import critical_z
from salience.operators.matrix import require_columns, to_long
from salience.operators.scan import exact_quantiles, tie_ranks


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Mann-Whitney U of group 0 for every key at once.

    Asymptotic z with tie and continuity correction.  Values collapse to
    (key, value) counts before they are ranked.  Null and NaN are no values, as in
    the quantiles of the same column.
    """
    ranked = tie_ranks(
        df.where(present(F.col(value))),
        keys,
        value,
        {
            "_a": F.count_if(F.col(group) == 0),
            "_b": F.count_if(F.col(group) == 1),
        },
    )
    t = F.col("n_tied").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("_a").alias("n0"),
        F.sum("_b").alias("n1"),
        F.sum(F.col("_a") * F.col("avg_rank")).alias("rank_sum0"),
        F.sum(t * t * t - t).alias("tie_term"),
        (F.sum(F.col("_a") * F.col(value)) / F.sum("_a")).alias("mean_0"),
        (F.sum(F.col("_b") * F.col(value)) / F.sum("_b")).alias("mean_1"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = n0 + n1
    u = F.col("rank_sum0") - n0 * (n0 + 1.0) / 2.0
    # The half-step correction must not carry the statistic past its mean.
    gap = F.greatest(F.greatest(u, n0 * n1 - u) - n0 * n1 / 2.0 - 0.5, F.lit(0.0))
    sd = F.sqrt(n0 * n1 / 12.0 * ((n + 1.0) - F.col("tie_term") / (n * (n - 1.0))))
    return sums.select(
        *keys, "n0", "n1", "mean_0", "mean_1", u.alias("u"),
        (gap / F.nullif(sd, F.lit(0.0))).alias("z"),
    )


def significance(tests: DataFrame, level: float) -> DataFrame:
    """Add ``sign``: +1 over-, -1 under-expressed in group 1, 0 not significant.

    ``p < level`` is the comparison of z with a constant, so it stays a plain
    predicate.
    """
    over = F.when(F.col("mean_1") > F.col("mean_0"), F.lit(1)).otherwise(F.lit(-1))
    passed = F.coalesce(F.col("z") > critical_z(level), F.lit(False))
    return tests.withColumn("sign", F.when(passed, over).otherwise(F.lit(0)))


def significance_counts(signs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return signs.groupBy(*(keys or [])).agg(
        F.count_if(F.col("sign") != 0).alias("significant"),
        F.count_if(F.col("sign") == 1).alias("over"),
        F.count_if(F.col("sign") == -1).alias("under"),
    )


def feature_tests(samples: DataFrame, level: float) -> DataFrame:
    """Rank test and sign of every feature of a sample matrix."""
    return significance(mann_whitney(to_long(samples), ["feature_id"], "value", "output"), level)


def signed_sum(samples: DataFrame, signs: DataFrame) -> DataFrame:
    """Biomarker per sample: sum of sign * value over significant features.

    The signs are one number per feature, so they ride along as one array and
    the wide samples are neither exploded nor shuffled.
    """
    packed = signs.where(F.col("sign") != 0).agg(
        F.collect_list(F.struct("feature_id", "sign")).alias("s")
    )
    terms = F.aggregate(
        "_signs",
        F.lit(0.0),
        lambda acc, s: acc + s["sign"] * F.get(F.col("features"), s["feature_id"]),
    )
    return (
        samples.withColumn("_signs", packed.scalar())
        .select("sample_id", "output", terms.alias("biomarker"))
    )


def biomarker(samples: DataFrame, level: float) -> DataFrame:
    return signed_sum(samples, feature_tests(samples, level))


def density(
    df: DataFrame, value: str, group: str, bins: int, low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """Histogram density per class, normalised within the class.

    Null and NaN are no values: they move no edge and are in no bin.
    """
    require_columns(df, [value, group])
    df = df.where(present(F.col(value)))
    if low is None or high is None:
        edges = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
        ready = df.withColumn("_e", edges)
    else:
        ready = df.withColumn("_e", F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")))
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    slot = F.least(
        F.floor((F.col(value) - F.col("_e.lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)
    ).cast("int")
    counts = (
        ready
        .groupBy(group, slot.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(width).alias("width"), F.max("_e.lo").alias("lo"))
    )
    sizes = counts.groupBy(group).agg(F.sum("n").alias("_size"))
    return counts.join(sizes, group).select(
        group,
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        "n",
        (F.col("n") / (F.col("_size") * F.col("width"))).alias("density"),
    )


def quartiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def median_of(df: DataFrame, value: str) -> DataFrame:
    return exact_quantiles(df, [], value, {"median": 0.5})


def two_group_summary(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """Rank test plus the quartiles of both groups, one row per key and group."""
    tests = mann_whitney(df, keys, value, group).select(*keys, "u", "z")
    spread = quartiles(df, [*keys, group], value)
    return spread.join(tests, keys) if keys else spread.withColumn(
        "_t", tests.select(F.struct("u", "z")).scalar()
    ).select(*spread.columns, F.col("_t.u").alias("u"), F.col("_t.z").alias("z"))


def at_or_below(value: Column, cut: Column) -> Column:
    """Group 0 at or below the cut, 1 above it, null where the value is null."""
    return (value > cut).cast("int")
