"""Null and NaN: what has no value is left out by one rule, what cannot be placed is named."""

import math

import pytest

from salience.operators import matrix, scorers, similarity, stats, survival

NAN = float("nan")


def test_times_that_are_missing_count_for_nothing(spark):
    rows = [(None, 1, 0), (NAN, 1, 1), (2.0, 1, 0), (3.0, 0, 1), (4.0, None, 1)]
    table = spark.createDataFrame(rows, "t double, e int, g int")
    got = {r.t: (r.at_risk, r.deaths, r.survival) for r in survival.kaplan_meier(table, [], "t", "e").collect()}
    assert {t: (a, d, round(s, 9)) for t, (a, d, s) in got.items()} == {
        2.0: (3, 1, 0.666666667), 3.0: (2, 0, 0.666666667), 4.0: (1, 0, 0.666666667)}
    ranks = survival.log_rank(table, [], "g", "t", "e").first()
    assert (ranks.n0, ranks.n1) == (1, 2)


def test_nan_is_no_value(spark):
    rows = [(0, 1.0), (0, 2.0), (1, 3.0), (1, NAN), (0, None), (1, 5.0), (0, NAN)]
    table = spark.createDataFrame(rows, "g int, v double")
    bins = stats.density(table, "v", "g", 4).collect()
    assert sum(r.n for r in bins) == 4 and all(math.isfinite(r.density) for r in bins)
    test = stats.mann_whitney(table, [], "v", "g").first()
    assert (test.n0, test.n1, test.u, test.mean_1) == (2, 2, 0.0, 4.0)


def test_samples_without_label_are_kept(spark):
    rows = [(i, None if i % 5 == 0 else i % 2, [float(i)]) for i in range(40)]
    table = spark.createDataFrame(rows, "sample_id long, output int, features array<double>")
    folded = matrix.stratified_folds(table, 4).collect()
    assert len(folded) == 40 and {r.fold for r in folded if r.output is None} == {1, 2, 3, 4}
    split = matrix.stratified_split(table, 0.25).collect()
    assert sum(r.is_train for r in split if r.output is None) == 6


@pytest.mark.parametrize("bad", [None, NAN])
def test_cells_without_value_are_named(spark, bad):
    rows = [(1, 0, [1.0, 2.0]), (42, 1, [3.0, bad])]
    table = spark.createDataFrame(rows, "sample_id long, output int, features array<double>")
    for run in (lambda: similarity.correlation_edges(table, [0, 1]).collect(),
                lambda: scorers.fit_centroid(table).collect()):
        with pytest.raises(Exception, match="null or NaN in the features of 42"):
            run()
