"""Log factorials, binomials and the overlap tail, as relational expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from salience.operators.scan import scan


def log_factorials(numbers: DataFrame, column: str = "n") -> DataFrame:
    """``ln(n!)`` for a table holding every integer 1..N once."""
    out = numbers.select(F.col(column).cast("bigint").alias("n"))
    return scan(out, [], "n", {"log_factorial": ("sum", F.ln(F.col("n").cast("double")))})


def overlap_log_probability(choose: Column, overlaps: Column, top_n: int, total: int) -> Column:
    """Log probability that two top-n lists share exactly ``overlaps`` features.

    ``choose`` is the log binomial coefficient of (total, overlaps).
    """
    share = top_n / total
    return (
        choose
        + 2.0 * overlaps * math.log(share)
        + 2.0 * (F.lit(total) - overlaps) * math.log(1.0 - share)
    )


def overlap_tail(log_fact: DataFrame, total: int, share: float) -> DataFrame:
    """P(k <= X <= total) for every k, X binomial with 4*total trials.

    Convolving one binomial law with itself twice adds four copies of it, cut
    off at ``total``.  ``log_fact`` must cover 1 .. 4*total.
    """
    trials = 4 * total
    top = log_fact.where(F.col("n") == trials).agg(F.max("log_factorial")).scalar()
    left = log_fact.where(F.col("n") <= total)
    right = log_fact.where(F.col("n") >= trials - total).select(
        (F.lit(trials) - F.col("n")).alias("n"), F.col("log_factorial").alias("rest")
    )
    mass = (
        left.join(right, "n")
        .withColumn("top", top)
        .select(
            F.col("n").alias("k"),
            F.exp(
                F.col("top")
                - F.col("log_factorial")
                - F.col("rest")
                + F.col("n") * math.log(share)
                + (F.lit(trials) - F.col("n")) * math.log1p(-share)
            ).alias("mass"),
        )
    )
    zero = log_fact.sparkSession.range(1).select(
        F.col("id").alias("k"), F.lit(math.exp(trials * math.log1p(-share))).alias("mass")
    )
    mass = mass.unionByName(zero).withColumn("below", F.lit(total) - F.col("k"))
    return scan(mass, [], "below", {"probability": ("sum", F.col("mass"))}).select(
        "k", "probability"
    )
