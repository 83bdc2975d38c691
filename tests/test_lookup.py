"""Hot keys of look-ups and giant components are dealt to many tasks."""

import collections
import statistics

import pytest
from pyspark.sql import functions as F

from salience.operators import graph, lookup


@pytest.fixture
def small_limit(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HOT_ROWS", 500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_hot_key_reaches_all_tasks_alike(spark, small_limit):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(-1, 40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    found = lookup.look_up(rows, table, "k")
    assert found.count() == 40_000 and found.where("v <> 2 * k").isEmpty()
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 3 * statistics.median(sizes)
    assert lookup.look_up(rows, table.where("k > 30000"), "k", "left").where("v IS NULL").count() > 30_000


def test_components_with_a_hub(spark, small_limit):
    star = spark.range(1, 6000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    tail = spark.createDataFrame([(7000 + i, 7001 + i) for i in range(40)] + [(5999, 8000)], "src long, dst long")
    nodes = spark.range(0, 9000).select(F.col("id").alias("node"))
    got = collections.Counter(r.component for r in graph.components(nodes, star.unionByName(tail)).collect())
    assert got[0] == 6001 and got[7000] == 41 and sum(got.values()) == 9000
    tree, _ = graph.spanning_forest(nodes, star.unionByName(tail).withColumn("c", F.col("dst")), "c")
    assert tree.count() == 5999 + 41
