"""Scalar column expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

RESCALED_SUFFIX = ".rescaled"


def int_array(values: list[int]) -> Column:
    """Array literal, parsed in one call rather than built value by value."""
    return F.expr(f"cast(array({','.join(str(int(v)) for v in values)}) as array<int>)")


def clean_name(name: Column) -> Column:
    """Remove every literal ``.rescaled`` from a feature name."""
    return F.replace(name, F.lit(RESCALED_SUFFIX), F.lit(""))


def sigmoid(margin: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-margin))


def binarise(probability: Column) -> Column:
    """1 when the probability is above one half; exactly one half gives 0."""
    return (probability > 0.5).cast("int")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two double arrays of equal length."""
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v
    )


def squared_distance(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: (a - b) * (a - b)),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def euclidean(left: Column, right: Column) -> Column:
    return F.sqrt(squared_distance(left, right))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scale to [0, 1]; a zero range gives null instead of a division error."""
    return (value - low) / F.nullif(high - low, F.lit(0.0))


def complete(features: Column, name: Column) -> Column:
    """The array, or an error that names the row if a cell of it is null or NaN.

    Distances, margins and fits have no value for such a row, so none is guessed.
    """
    bad = features.isNull() | F.exists(features, lambda v: v.isNull() | F.isnan(v))
    told = F.concat(F.lit("null or NaN in the features of "), F.coalesce(name.cast("string"), F.lit("a row without id")))
    return F.when(bad, F.raise_error(told)).otherwise(features)


def whole_vector(df: DataFrame, features: str = "features") -> Column:
    """An array column of ``df`` as an MLlib vector; :func:`complete` names bad rows."""
    name = next((F.col(c) for c in ("sample_id", "point_id") if c in df.columns), F.lit("a row"))
    return array_to_vector(complete(F.col(features), name))


def present(value: Column) -> Column:
    """True for a number: neither null nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def pad_to_square(features: Column) -> Column:
    """Append ones until the array length is a perfect square."""
    side = F.ceil(F.sqrt(F.size(features).cast("double"))).cast("int")
    return F.concat(features, F.array_repeat(F.lit(1.0), side * side - F.size(features)))


def format_pm(mean: Column, std: Column) -> Column:
    return F.format_string("%.4f ± %.4f", mean, std)


def parse_pm(cell: Column) -> Column:
    """Split ``"mean ± std"`` into a struct of two doubles."""
    parts = F.split(cell, " ± ")
    return F.struct(
        parts.getItem(0).cast("double").alias("mean"),
        parts.getItem(1).cast("double").alias("std"),
    )


def edge_colour(weight: Column) -> Column:
    return F.when(weight > 0, F.lit("black")).otherwise(F.lit("red"))


def node_colour(is_critical: Column) -> Column:
    return F.when(is_critical, F.lit("lightgreen")).otherwise(F.lit("lightblue"))
