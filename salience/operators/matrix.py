"""Sample-matrix operators: reshaping, projection, splits and folds.

Two shapes are used throughout: ``samples(sample_id, output, features
ARRAY<DOUBLE>)`` with one row per sample, and the long form ``(sample_id,
output, feature_id, value)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salience.functions.expressions import int_array, pad_to_square
from salience.functions.shuffling import hash_id
from salience.operators.scan import dense_position
from salience.session import cut_lineage


def require_columns(df: DataFrame, names: list[str]) -> None:
    """Fail before planning, naming every missing column."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def features_only(samples: DataFrame) -> DataFrame:
    return samples.drop("output")


def labels_only(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", "output")


def to_long(samples: DataFrame) -> DataFrame:
    return samples.select(
        "sample_id", "output", F.posexplode("features").alias("feature_id", "value")
    )


def to_arrays(long: DataFrame) -> DataFrame:
    """Long rows back to one array per sample, in the order of all feature ids.

    A cell that a sample lacks is null, so values never move to another place.
    """
    every = long.agg(F.array_sort(F.collect_set("feature_id"))).scalar()
    cells = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    packed = long.groupBy("sample_id", "output").agg(cells.alias("_c")).withColumn("_ids", every)
    own = F.transform("_c", lambda cell: cell["feature_id"])
    placed = F.transform(
        "_ids", lambda i: F.try_element_at(F.map_from_entries("_c"), i)
    )
    return packed.select(
        "sample_id",
        "output",
        F.when(own == F.col("_ids"), F.transform("_c", lambda cell: cell["value"]))
        .otherwise(placed)
        .alias("features"),
    )


def feature_count(samples: DataFrame) -> int:
    """Width of the matrix; rows of different widths are an error."""
    found = samples.agg(
        F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high")
    ).first()
    if found["low"] != found["high"]:
        raise ValueError(f"feature arrays of {found['low']} to {found['high']} values")
    return found["high"] or 0


def select_top(long: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """Keep the k best-ranked features; the label column stays."""
    top = ranking.where(F.col("position") <= k).select("feature_id")
    return long.join(top, "feature_id", "left_semi")


def take_features(samples: DataFrame, feature_ids: list[int]) -> DataFrame:
    """Project the feature arrays to a list of feature ids, in that order."""
    return samples.withColumn(
        "features", F.transform(int_array(feature_ids), lambda i: F.get(F.col("features"), i))
    )


def square_padded(samples: DataFrame) -> DataFrame:
    return samples.withColumn("features", pad_to_square(F.col("features")))


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    return df.na.drop(subset=subset)


def encode_labels(df: DataFrame, column: str, name: str = "label_index") -> DataFrame:
    """Replace labels by 0..c-1 in ascending label order."""
    distinct = df.select(F.col(column).alias("_label")).distinct()
    codes = dense_position(distinct, [], "_label", "_code").select(
        "_label", (F.col("_code") - 1).alias(name)
    )
    return df.join(codes, F.col(column).eqNullSafe(F.col("_label")), "left").drop("_label")


def stratified_split(samples: DataFrame, test_size: float = 0.2, seed: int = 12) -> DataFrame:
    """Add ``is_train``: exactly round((1-test_size)*n) rows of each class.

    Rows are ordered by a seeded hash of their id inside each class.  Only ids
    are ordered; the wide rows then compare themselves with one cut per class
    and are never shuffled.
    """
    kind = samples.schema["sample_id"].dataType.simpleString()
    order = F.struct(
        hash_id(F.col("sample_id"), kind, seed).alias("h"), F.col("sample_id").alias("id")
    )
    placed = dense_position(
        samples.select("output", order.alias("_order")), ["output"], "_order", "_place", "_n"
    )
    limit = F.floor(F.col("_n") * (1.0 - test_size) + 0.5)
    cuts = (
        placed.where(F.col("_place") <= limit)
        .groupBy("output")
        .agg(F.max("_order").alias("_cut"))
    )
    # One row per class, written once for the two or three reads of a split.
    return (
        samples.join(
            F.broadcast(cut_lineage(cuts.withColumnRenamed("output", "_class"))),
            F.col("output").eqNullSafe(F.col("_class")), "left")
        .withColumn("is_train", F.coalesce(order <= F.col("_cut"), F.lit(False)))
        .drop("_cut", "_class")
    )


def stratified_folds(samples: DataFrame, folds: int = 5) -> DataFrame:
    """Add ``fold`` 1..k: contiguous, unshuffled, balanced inside each class.

    Samples without a label are a class of their own.
    """
    placed = dense_position(
        samples.select("sample_id", "output"), ["output"], "sample_id", "_place", "_n"
    )
    row = F.col("_place") - 1
    small = F.floor(F.col("_n") / folds)
    large_rows = (F.col("_n") % folds) * (small + 1)
    fold = F.when(row < large_rows, F.floor(row / (small + 1))).otherwise(
        F.col("_n") % folds + F.floor((row - large_rows) / F.greatest(small, F.lit(1)))
    )
    starts = (
        placed.groupBy("output", fold.alias("_fold"))
        .agg(F.min("sample_id").alias("_start"))
        .groupBy("output")
        .agg(F.collect_list("_start").alias("_starts"))
    )
    # One row per class, holding k fold starts.
    return (
        samples.join(
            F.broadcast(cut_lineage(starts.withColumnRenamed("output", "_class"))),
            F.col("output").eqNullSafe(F.col("_class")))
        .withColumn(
            "fold", F.size(F.filter("_starts", lambda start: start <= F.col("sample_id")))
        )
        .drop("_starts", "_class")
    )


def class_mean_columns(value: Column) -> list[Column]:
    """Both class means of a value in one pass."""
    return [
        F.avg(F.when(F.col("output") == 0, value)).alias("mean_0"),
        F.avg(F.when(F.col("output") == 1, value)).alias("mean_1"),
    ]
