"""Input views over the given tables, in the engine's canonical shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression matrix: unit vectors with a binary phenotype."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"),
        (F.col("label") >= 5).cast("int").alias("output"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def feature_names(samples: DataFrame) -> DataFrame:
    """``(feature_id, feature_name)`` for the width of the matrix."""
    width = samples.limit(1).select(F.explode(F.sequence(F.lit(0), F.size("features") - 1)))
    return width.toDF("feature_id").withColumn(
        "feature_name",
        F.concat(F.lit("g"), F.lpad(F.col("feature_id").cast("string"), 2, "0"), F.lit(".rescaled")),
    )


def clustered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with a given cluster."""
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"),
        F.col("label").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survival table: a customer's first order; status F is an event."""
    orders = load(spark, sf_dir, "orders")
    start = orders.agg(F.min("o_orderdate")).scalar()
    first = orders.groupBy("o_custkey").agg(
        F.min(
            F.struct("o_orderdate", "o_orderkey", "o_orderstatus")
        ).alias("first")
    )
    return (
        load(spark, sf_dir, "customer")
        .join(first, F.col("c_custkey") == F.col("o_custkey"))
        .withColumn("start", start)
        .select(
            F.col("c_custkey").alias("sample_id"),
            "c_acctbal",
            F.col("c_mktsegment"),
            F.datediff(F.col("first.o_orderdate"), F.col("start"))
            .cast("double")
            .alias("survival_day"),
            (F.col("first.o_orderstatus") == "F").cast("int").alias("survival_event"),
        )
    )


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tied scores against an imbalanced binary label."""
    return (
        load(spark, sf_dir, "documents")
        .select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
        .join(load(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    )


TWO_GROUP_COLUMNS = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]


def two_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavily tied samples of flag R against all others: (output, feature, value)."""
    rows = load(spark, sf_dir, "lineitem")
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"))
            for c in TWO_GROUP_COLUMNS
        ]
    )
    return rows.select(
        (F.col("l_returnflag") == "R").cast("int").alias("output"), F.inline(cells)
    )
