import numpy as np
import pytest
from pyspark.sql import functions as F

from salience.operators import metrics, scan, stats, survival


@pytest.fixture
def many_partitions(spark):
    """Keep small shuffles apart, as large ones would be."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_spreads_a_hot_key(spark, many_partitions):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, float(rng.integers(10))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o int, v double").repartition(7)
    ranged = df.repartitionByRange("k", "o").select("k", F.spark_partition_id().alias("p"))
    assert ranged.distinct().where("k = 'hot'").count() > 1
    outputs = {"run": ("sum", F.col("v")), "prod": ("product", 1 - F.col("v") / 1e4)}
    got = scan.scan(df, ["k"], "o", outputs).toPandas().sort_values(["k", "o"])
    assert len(got) == 3000
    assert np.allclose(got.run, got.groupby("k").v.cumsum())
    assert np.allclose(got["prod"], (1 - got.v / 1e4).groupby(got.k).cumprod())
    whole = scan.scan(df, [], "o", outputs).toPandas().sort_values("o")
    assert np.allclose(whole.run, whole.v.cumsum())


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    data = {g: rng.integers(0, 9, size=n).astype(float) for g, n in (("a", 101), ("b", 7), ("c", 1))}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for r in stats.quartiles(df, ["g"], "v").collect():
        assert np.allclose([r.q25, r.q50, r.q75], np.quantile(data[r.g], [0.25, 0.5, 0.75]))


@pytest.mark.parametrize(
    "rows, auroc, precision",
    [
        ([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)], 0.5, 0.5),
        ([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], 1.0, 1.0),
        ([(1, 0.1), (1, 0.2)], None, 1.0),
    ],
)
def test_ranking_metrics(spark, rows, auroc, precision):
    df = spark.createDataFrame(rows, "y int, s double")
    got = metrics.ranking_metrics(df, [], "y", "s").first()
    assert got.auroc == (None if auroc is None else pytest.approx(auroc))
    assert got.average_precision == pytest.approx(precision)


def test_grid_curve_equals_interpolation(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 57), rng.integers(0, 12, 57).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    counts = metrics.score_counts(df.withColumn("k", F.lit(1)), ["k"], "y", "s")
    got = metrics.roc_on_grid(counts, ["k"]).toPandas().sort_values("grid")
    fpr, tpr = [0.0], [0.0]
    for t in sorted(set(s), reverse=True):
        fpr.append(((s >= t) & (y == 0)).sum() / (y == 0).sum())
        tpr.append(((s >= t) & (y == 1)).sum() / (y == 1).sum())
    want = np.interp(np.linspace(0, 1, 100), fpr, tpr)
    want[0] = 0.0
    assert np.allclose(got.tpr, want)


def test_mann_whitney_against_pairs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, 30).astype(float), rng.integers(1, 7, 25).astype(float)
    rows = [(0, v) for v in a.tolist()] + [(1, v) for v in b.tolist()]
    df = spark.createDataFrame(rows, "output int, value double").withColumn("k", F.lit(1))
    got = stats.mann_whitney(df, ["k"], "value", "output").first()
    u = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert got.u == pytest.approx(u)
    assert got.mean_0 == pytest.approx(a.mean())


def test_biomarker_without_significant_features_is_zero(spark):
    rows = [(i, i % 2, [float(i // 2), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_id bigint, output int, features array<double>")
    got = stats.biomarker(df, 0.05).collect()
    assert len(got) == 20 and {r.biomarker for r in got} == {0.0}


def test_all_censored(spark):
    rows = [(i, float(i % 4), 0, i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "sample_id bigint, t double, e int, grp int").withColumn("k", F.lit(1))
    assert {r.survival for r in survival.kaplan_meier(df, ["k"], "t", "e").collect()} == {1.0}
    assert survival.log_rank(df, ["k"], "grp", "t", "e").first().chi2 is None


def test_survival_falls_to_zero(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 1)], "t double, e int").withColumn("k", F.lit(1))
    got = survival.kaplan_meier(df, ["k"], "t", "e").orderBy("t").toPandas()
    assert np.allclose(got.survival, [2 / 3, 2 / 3, 0.0])


def test_repeated_survival_ids_do_not_shift_rows(spark):
    marks = spark.createDataFrame([(1, 0.5), (2, 0.7)], "sample_id bigint, biomarker double")
    surv = spark.createDataFrame([(1, 5.0, 1), (1, 9.0, 0)], "sample_id bigint, survival_day double, survival_event int")
    got = {r.sample_id: (r.biomarker, r.survival_day) for r in survival.attach_survival(marks, surv).collect()}
    assert got == {1: (0.5, 5.0), 2: (0.7, None)}


def test_equal_groups_are_no_evidence(spark):
    rows = [(g, float(v)) for g in (0, 1) for v in (0, 1)]
    got = stats.mann_whitney(spark.createDataFrame(rows, "y int, v double"), [], "v", "y").first()
    assert got.z == 0.0


def test_quantiles_skip_nan_and_pick_infinity(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, float("inf"))] + [("b", v) for v in (1.0, 2.0, 3.0, float("nan"))]
    got = scan.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"m": 0.5})
    assert {r.k: r.m for r in got.collect()} == {"a": 2.5, "b": 2.0}


def test_null_keys_are_scanned(spark):
    rows = [(k, float(v)) for k in ("a", None) for v in range(3)]
    got = scan.dense_position(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")
    assert sorted((r.k or "", r.v, r.position) for r in got.collect()) == [
        (k, float(v), v + 1) for k in ("", "a") for v in range(3)]


def test_a_missing_day_does_not_beat_a_real_one(spark):
    marks = spark.createDataFrame([(1, 0.5)], "sample_id int, biomarker double")
    days = spark.createDataFrame([(1, None, 0), (1, 5.0, 1)], "sample_id int, survival_day double, survival_event int")
    assert survival.attach_survival(marks, days).first().survival_day == 5.0
