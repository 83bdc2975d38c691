"""Fits made together against one fit at a time."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from salience.operators import manyfits, matrix, metrics, models, scorers
from salience.operators.manyfits import Fit


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 6)) * [1, 5, 1, 0.2, 1, 1]
    y = (x @ [1, -0.3, 0.5, 2, 0, 0] + rng.normal(size=160) > 0).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(160)]
    return spark.createDataFrame(rows, "sample_id long, output int, features array<double>").cache()


def one_fit(rows, features):
    """MLlib's optimum of the same loss: its penalty is divided by the rows."""
    picked = matrix.take_features(rows, features)
    model = LogisticRegression(
        maxIter=500, tol=1e-12, regParam=1.0 / rows.count(), standardization=False,
        featuresCol="_features", labelCol="output").fit(models.vectorised(picked))
    return np.append(model.coefficients.toArray(), model.intercept)


def test_fits_made_together_equal_single_ones(data, monkeypatch):
    folded = matrix.stratified_folds(data, 4).cache()
    fits = [Fit(tuple(range(6))), Fit((0, 2)), Fit(tuple(range(6)), 3), Fit((1, 4, 5), 1), Fit((3,), 2)]
    together = manyfits.fit_logistic(folded, fits)
    for fit, got in zip(fits, together, strict=True):
        rows = folded if fit.fold is None else folded.where(f"fold <> {fit.fold}")
        want = one_fit(rows.select("sample_id", "output", "features"), list(fit.features))
        assert np.allclose(got[[*fit.features, -1]], want, atol=2e-4)
        assert (got[[j for j in range(6) if j not in fit.features]] == 0).all()
    assert all(slope < 1e-6 for _, slope in manyfits.slopes(folded, fits, together))
    monkeypatch.setattr(manyfits, "BLOCK_BYTES", 8 * 9 * 2)
    assert np.allclose(manyfits.fit_logistic(folded, fits), together, atol=1e-5)


def test_simulations_draw_with_replacement(data):
    hashes = np.arange(20_000, dtype=np.int64) * 104_729 % 2147483647
    drawn = manyfits.copies(hashes, [None, 1, 2])
    assert (drawn[:, 0] == 1).all() and (drawn[:, 1] != drawn[:, 2]).any()
    share = np.bincount(drawn[:, 1].astype(int), minlength=4)[:4] / len(hashes)
    assert np.allclose(share, [0.368, 0.368, 0.184, 0.061], atol=0.02)
    a, b, again = manyfits.fit_logistic(data, [Fit((0, 1), None, 5), Fit((0, 1), None, 6), Fit((0, 1), None, 5)])
    assert (a == again).all() and not np.allclose(a, b, atol=1e-3)


def test_folds_are_scored_by_fits_that_never_saw_them(data):
    scores = manyfits.fold_scores(data, 4, "centroid").toPandas().set_index("sample_id")
    folded = matrix.stratified_folds(data, 4)
    for fold in range(1, 5):
        scorer = scorers.fit_centroid(folded.where(f"fold <> {fold}"))
        for r in scorers.score_linear(folded.where(f"fold = {fold}"), scorer).collect():
            assert abs(scores.probability[r.sample_id] - r.probability) < 1e-12
    table = manyfits.cross_validate(data, 4, "log").toPandas()
    each = table[table.part == "fold"]
    assert len(each) == 4 and set(table.part) == {"fold", "mean", "std"}
    for m in manyfits.METRICS:
        assert abs(table[table.part == "mean"][m].iloc[0] - each[m].mean()) < 1e-12
        assert abs(table[table.part == "std"][m].iloc[0] - each[m].std(ddof=0)) < 1e-12


def test_unlabelled_samples_and_unknown_models(spark, data):
    more = data.unionByName(spark.createDataFrame(
        [(500, None, [0.0] * 6), (501, 7, [0.0] * 6)], data.schema))
    assert np.allclose(manyfits.fit_logistic(more, [Fit((0, 1))]), manyfits.fit_logistic(data, [Fit((0, 1))]), atol=1e-6)
    assert manyfits.fold_scores(more, 4, "centroid").count() == 160
    with pytest.raises(ValueError, match="unknown model"):
        manyfits.fold_scores(data, 4, "svm")


def test_sweep_has_a_row_for_each_count_and_simulation(data):
    parts = matrix.stratified_split(data, 0.3)
    train, test = parts.where("is_train").drop("is_train"), parts.where("not is_train").drop("is_train")
    curves = manyfits.sweep_many(train, test, [3, 0, 1, 2, 4, 5], [1, 3, 6], 4).toPandas()
    assert len(curves) == 12 and curves.auroc.between(0, 1).all()
    assert curves[curves.num_features == 6].auroc.mean() > 0.8
    table = manyfits.compare_many(train, {"a": train, "b": test}, {"good": [0, 3], "bad": [4, 5]}, 4).toPandas()
    assert len(table) == 4 and (table.auroc_std > 0).all()
    mean = table.groupby("method").auroc_mean.mean()
    assert mean["good"] > mean["bad"]


def test_margins_rank_as_probabilities(data):
    weights = manyfits.fit_logistic(data, [Fit((0, 1, 2, 3))])
    scored = manyfits.score_all(data, weights, ["sample_id", "output"])
    assert metrics.ranking_metrics(scored, ["fit"], "output", "score").first().auroc > 0.85


def test_a_task_holds_few_margins(spark, monkeypatch):
    """However many fits and rows, a batch of scores has a bounded size, and scores stay the same."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"features": [[float(i), 1.0] for i in range(1000)], "sample_id": list(range(1000))})
    pieces = list(manyfits._slices(iter([batch, batch.slice(0, 0)]), 3200))
    assert max(p.num_rows for p in pieces) * 3200 <= manyfits.MARGINS
    assert pa.Table.from_batches(pieces).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    monkeypatch.setattr(manyfits, "MARGINS", 7)
    data = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(20)], "sample_id long, output int, features array<double>")
    scored = manyfits.score_all(data, np.array([[1.0, 2.0, 3.0], [0.5, 0.0, 0.0]]), ["sample_id"]).collect()
    assert {(r.fit, r.sample_id, r.score) for r in scored} == {
        (f, i, s) for i in range(20) for f, s in ((0, i + 5.0), (1, i / 2))}
