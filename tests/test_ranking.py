import numpy as np
import pytest
from pyspark.sql import functions as F

from salience.functions.expressions import clean_name, format_pm, parse_pm
from salience.operators import importance, matrix, models, permutation, ranking, reduction, scorers, sweep


def _samples(spark, n=60, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 0] = 1.0
    y = (x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "sample_id bigint, output int, features array<double>")


def test_average_ranks_with_ties(spark):
    df = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 5.0), ("r", 3, 3.0)], "run string, f int, v double")
    got = {r.f: r.rank for r in ranking.average_ranks(df, ["run"], "v").collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.0}


def test_zero_rank_range_is_null(spark):
    rows = [("m", 1, "accuracy", f, 0.5) for f in range(3)]
    df = spark.createDataFrame(rows, "model string, run_id int, metric string, feature_id int, diff double")
    got = ranking.aggregate_ranking(df).collect()
    assert all(r.rank_fin is None for r in got)
    assert sorted(r.position for r in got) == [1, 2, 3]


def test_rank_fin_spans_unit_interval(spark):
    data = _samples(spark)
    diffs = importance.permutation_importance(data, scorers.fit_centroid(data), 3, 2)
    got = [r.rank_fin for r in ranking.aggregate_ranking(diffs).collect()]
    assert min(got) == 0.0 and max(got) == 1.0


def test_constant_feature_has_no_importance(spark):
    data = _samples(spark)
    scorer = scorers.fit_centroid(data)
    diffs = importance.permutation_importance(data, scorer, 4)
    assert {r["diff"] for r in diffs.where("feature_id = 0").collect()} == {0.0}
    strong = {r.feature_id: r["diff"] for r in diffs.where("metric = 'accuracy'").collect()}
    assert max(strong, key=strong.get) == 1
    moved = {r.feature_id: r.sensitivity for r in importance.sensitivity(data, scorer).collect()}
    assert moved[0] == 0.0 and moved[1] > 0.0


@pytest.mark.parametrize("chunk", [64, 2])
def test_permutation_keeps_every_value(spark, chunk):
    pairs = permutation.shuffled_pairs(_samples(spark), ["sample_id"], 2, 2, 5, chunk=chunk)
    rows = pairs.select(
        "run_id", "repeat", "chunk", "sample_id", F.posexplode(F.arrays_zip("x", "x_new"))
    ).select("*", "col.*").toPandas()
    assert len(rows) == 60 * 5 * 4
    for _, part in rows.groupby(["chunk", "pos", "run_id", "repeat"]):
        assert sorted(part.x) == sorted(part.x_new)
        assert part.sample_id.nunique() == 60
    moved = rows[rows.chunk * chunk + rows.pos == 2]
    assert (moved.x != moved.x_new).mean() > 0.9


def test_draws_differ_between_repeats(spark):
    pairs = permutation.shuffled_pairs(_samples(spark), ["sample_id"], 1, 2, 5).toPandas()
    wide = pairs.pivot(index="sample_id", columns="repeat", values="x_new")
    assert not np.allclose(np.stack(wide[1]), np.stack(wide[2]))


def test_importance_does_not_depend_on_chunks_or_partitions(spark):
    data = _samples(spark)
    scorer = scorers.fit_centroid(data)
    key = ["run_id", "metric", "feature_id"]
    one = importance.permutation_importance(data, scorer, 3, 2)
    two = importance.permutation_importance(data.repartition(7), scorer, 3, 2, chunk=2)
    both = one.join(two.withColumnRenamed("diff", "other"), key).toPandas()
    assert len(both) == 20
    assert np.allclose(both["diff"], both["other"], atol=1e-12)


def test_missing_cells_keep_their_place_and_ragged_rows_fail(spark):
    long = spark.createDataFrame(
        [(1, 0, 0, 4.0), (1, 0, 2, 6.0), (2, 1, 0, 1.0), (2, 1, 1, 2.0), (2, 1, 2, 3.0)],
        "sample_id int, output int, feature_id int, value double",
    )
    got = {r.sample_id: r.features for r in matrix.to_arrays(long).collect()}
    assert got == {1: [4.0, None, 6.0], 2: [1.0, 2.0, 3.0]}
    ragged = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "features array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        matrix.feature_count(ragged)


def test_rank_one_update_equals_effective_weights(spark):
    """A logistic model on reduced features, scored both ways."""
    data = _samples(spark, n=80)
    z, _, reducer = reduction.reduce_dimensions(data, data, "PCA", 3)
    model = models.fit_model("log", z, 3, features="z")
    stage = model.stages[-1]
    weights, bias = reducer.effective_weights(stage.coefficients.toArray(), stage.intercept)
    direct = importance.permutation_importance(data, scorers.linear_scorer(spark, weights, bias), 3)
    general = importance.permutation_importance_model(
        z, model, 3, loadings=reducer.loading_table(spark)
    )
    key = ["run_id", "metric", "feature_id"]
    both = direct.join(general.withColumnRenamed("diff", "other"), key).toPandas()
    assert len(both) == 10
    assert np.allclose(both["diff"], both["other"], atol=1e-9)


def test_split_is_exact_per_class(spark):
    parts = matrix.stratified_split(_samples(spark, 61)).toPandas()
    for _, part in parts.groupby("output"):
        assert part.is_train.sum() == int(len(part) * 0.8 + 0.5)


def test_folds_cover_each_class_evenly(spark):
    folds = matrix.stratified_folds(_samples(spark, 61), 4).toPandas()
    sizes = folds.groupby(["output", "fold"]).size()
    for _, part in sizes.groupby(level=0):
        assert len(part) == 4 and part.max() - part.min() <= 1


def test_cutoff_reports_count_and_index(spark):
    rows = [("m", k + 1, v) for k, v in enumerate([0.5, 0.8, 0.82, 0.81])]
    df = spark.createDataFrame(rows, "model string, num_features int, auroc double")
    got = sweep.cutoff(df, "auroc", 0.025).first()
    assert (got.num_features, got["index"]) == (2, 1)


def test_cells_and_names(spark):
    df = spark.createDataFrame([("0.9123 ± 0.0045", "a.rescaled")], "c string, n string")
    got = df.select(parse_pm(F.col("c")).alias("p"), clean_name(F.col("n")).alias("n"),
                    format_pm(F.lit(0.5), F.lit(0.25)).alias("f")).first()
    assert (got.p.mean, got.p.std, got.n, got.f) == (0.9123, 0.0045, "a", "0.5000 ± 0.2500")


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError):
        models.create_model("cnn", 3)
    with pytest.raises(ValueError):
        reduction.reduce_dimensions(None, None, "UMAP", 2)
    with pytest.raises(ValueError, match="nope"):
        matrix.require_columns(_samples(spark), ["nope"])


def test_comparison_defaults_labels(spark):
    data = _samples(spark)
    ranks = spark.createDataFrame([(1, 1), (2, 2)], "feature_id int, position int")
    table = sweep.compare_methods(data, {"all": data}, "log", [ranks, ranks], 2, 1, max_iter=5)
    assert {r.method for r in table.collect()} == {"DataFrame 1", "DataFrame 2"}
