"""Source and sink queries: every table is written, read back and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salience.operators import matrix
from salience.plans import fixtures, ranking_queries
from salience.plans.ranking_queries import feature_sweep
from salience.session import scratch_path
from salience.sources import tables

CHUNK = 100_000


def size_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut into chunks of about 100,000 characters."""
    docs = fixtures.load(spark, sf, "documents").select("doc_id", F.length("text").alias("size"))
    return tables.with_chunk_ids(docs, "doc_id", F.col("size"), CHUNK).select(
        "doc_id", "chunk_id"
    )


def roundtrip_split_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written in size-bounded chunk folders and read back."""
    parts = fixtures.load(spark, sf, "part")
    path = scratch_path(spark, "chunks")
    tables.split_csv(parts, "p_partkey", path, max_size=0.02)
    schema = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    back = spark.read.schema(schema + ", chunk_id bigint").option("header", True).csv(path)
    return back.select("p_partkey", "p_brand", "p_size", "p_retailprice", "chunk_id")


def roundtrip_wide_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix as a folder of wide CSV files, read back to long rows."""
    data = fixtures.samples(spark, sf)
    names = [r["feature_name"] for r in fixtures.feature_names(data).orderBy("feature_id").collect()]
    path = scratch_path(spark, "wide")
    tables.write_wide_csv(data.repartition(3), names, path)
    back, features = tables.read_csv_folder(spark, path)
    return (
        matrix.to_long(back)
        .join(features, "feature_id")
        .select(
            F.col("sample_id").cast("bigint").alias("sample_id"), "output", "feature_name",
            F.round("value", 6).alias("value"),
        )
    )


def roundtrip_breaks(spark: SparkSession, sf: str) -> DataFrame:
    """Two sets of files with differing headers, ids with line breaks and quotes, read back as one."""
    data = fixtures.samples(spark, sf)
    path = scratch_path(spark, "breaks")
    for part, first, keep in (("a", 0, F.col("sample_id") % 3 > 0), ("b", 12, F.col("sample_id") % 3 == 0)):
        rows = data.where(keep).select(
            F.concat(F.lit('say "'), F.col("sample_id").cast("string"), F.lit('",\n\nnot more\n')).alias("sample_id"),
            "output", F.slice("features", first + 1, 24).alias("features"))
        tables.write_wide_csv(rows.repartition(2), [f"g{j},\n{j}" for j in range(first, first + 24)], f"{path}/{part}")
    back, features = tables.read_csv_folder(spark, f"{path}/*")
    return matrix.to_long(back).where("value IS NOT NULL").join(features, "feature_id").select(
        "sample_id", "output", "feature_name", F.round("value", 6).alias("value"))


def roundtrip_tsv(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = scratch_path(spark, "tsv")
    tables.write_tsv(rows, path)
    return tables.read_tsv(spark, path, "c_custkey bigint, c_name string, c_acctbal double")


def roundtrip_survival(spark: SparkSession, sf: str) -> DataFrame:
    """Survival CSV with a nullable marker."""
    rows = fixtures.survival(spark, sf).select(
        F.col("sample_id").cast("string").alias("sampleName"),
        "survival_day",
        "survival_event",
        F.when(F.col("c_acctbal") > 0, (F.col("c_acctbal") > 5000).cast("int")).alias("ki67_status"),
    )
    path = scratch_path(spark, "survival")
    tables.save_table(rows, path, "csv")
    return tables.read_survival(spark, path)


def roundtrip_sweep(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "sweep")
    tables.write_sweep(feature_sweep(spark, sf).withColumn("model", F.lit("centroid")), path)
    return tables.read_sweep(spark, path).select("model", "num_features", "auroc", "auprc")


def roundtrip_json(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters with a map column, as JSON lines."""
    rows = fixtures.load(spark, sf, "customer").select(
        F.col("c_name").alias("method"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("params"),
        F.col("c_acctbal").alias("score"),
    )
    path = scratch_path(spark, "json")
    tables.save_table(rows, path, "json")
    back = tables.load_table(
        spark, path, "json", "method string, params map<string,string>, score double"
    )
    return back.select("method", F.col("params")["nation"].alias("nation"), "score")


def observed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Row count and width of the matrix, from the pass that stores it."""
    _, seen = tables.store_observed(fixtures.samples(spark, sf), scratch_path(spark, "matrix"))
    return spark.createDataFrame([(seen["n_rows"], seen["n_columns"])], "n_rows bigint, n_columns int")


def claimed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Importance runs appended one by one under numbers that are claimed first."""
    diffs = ranking_queries.importance_runs(spark, sf)
    store = scratch_path(spark, "claimed")
    for run in range(1, ranking_queries.SMALL_RUNS + 1):
        own = diffs.where(F.col("run_id") == run).drop("run_id")
        number = tables.claim_run(spark, store, "linear")
        tables.append_runs(own.withColumn("run_id", F.lit(number)), store)
    return tables.read_runs(spark, store).select(
        "run_id", "metric", "feature_id", F.round("diff", 8).alias("diff"))


QUERIES = {
    f.__name__: f
    for f in (
        size_chunks, roundtrip_split_csv, roundtrip_wide_csv, roundtrip_breaks, roundtrip_tsv, roundtrip_survival,
        roundtrip_sweep, roundtrip_json, observed_counts, claimed_runs,
    )
}
