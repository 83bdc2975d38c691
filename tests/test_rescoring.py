"""Rescoring after one changed value against scoring whole rows with the fitted model."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from salience.operators import importance, models, reduction, rescoring, scorers


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 7))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(int)
    rows = [(i, int(y[i]), [float(v) for v in x[i]]) for i in range(90)]
    return spark.createDataFrame(rows, "sample_id long, output int, features array<double>").cache()


def fitted(data, name, reduced):
    options = {"max_iter": 15} if name != "gbt" else {"max_iter": 6}
    if not reduced:
        return data, models.fit_model(name, data, 7, 1, **options), None
    z, _, reducer = reduction.reduce_dimensions(data, data, "PCA", 3)
    return z, models.fit_model(name, z, 3, 1, features="z", **options), reducer


def predict(model, x):
    """Probabilities of the fitted stage, one row at a time."""
    stage = model.stages[-1]
    return np.array([stage.predictProbability(Vectors.dense(row))[1] for row in x])


@pytest.mark.parametrize("name", ["log", "mlp", "gbt"])
@pytest.mark.parametrize("reduced", [False, True])
def test_changed_values_score_as_whole_rows(data, name, reduced):
    table, model, reducer = fitted(data, name, reduced)
    known = rescoring.rescorer(model, reducer.loadings if reduced else None)
    x = np.array([r.features for r in table.select("features").collect()])
    into = (lambda v: (v - reducer.mean) @ reducer.loadings) if reduced else (lambda v: v)
    state = known.state(into(x))
    assert np.allclose(known.probability(state), predict(model, into(x)), atol=1e-9)
    for j in range(7):
        new = np.roll(x[:, j], 11)
        changed = x.copy()
        changed[:, j] = new
        assert np.allclose(known.moved(state, j, x[:, j], new), predict(model, into(changed)), atol=1e-8)
        assert (known.moved(state, j, x[:, j], x[:, j]) == known.probability(state)).all()


@pytest.mark.parametrize("name, reduced", [("mlp", True), ("gbt", False)])
def test_importance_equals_scoring_whole_rows(spark, data, name, reduced):
    table, model, reducer = fitted(data, name, reduced)
    loadings = reducer.loading_table(spark) if reduced else None
    fast = importance.permutation_importance_model(table, model, 3, 2, 5, name, loadings, chunk=3)
    slow = importance._importance_by_scoring(table, model, 3, 2, 5, name, loadings, chunk=3)
    both = fast.join(slow.withColumnRenamed("diff", "other"), ["run_id", "metric", "feature_id"]).toPandas()
    assert len(both) == 2 * 2 * 7 and np.allclose(both["diff"], both["other"], atol=1e-9)


def test_change_and_sensitivity_equal_the_linear_forms(data):
    scorer = scorers.fit_centroid(data)
    known = rescoring.Linear.of_scorer(scorer)
    for one, other in (
        (importance.prediction_change(data, scorer, [0, 3, 6], 4, 9),
         importance.prediction_change_model(data, known, [0, 3, 6], 4, 9)),
        (importance.sensitivity(data, scorer), importance.sensitivity_model(data, known)),
    ):
        keys = [c for c in one.columns if c.endswith("_id")]
        both = one.toPandas().merge(other.toPandas(), on=keys, suffixes=("", "_2"))
        value = next(c for c in one.columns if c not in keys)
        assert len(both) == one.count() and np.allclose(both[value], both[f"{value}_2"], atol=1e-12)


def test_unused_features_change_nothing(data):
    _, model, _ = fitted(data, "gbt", False)
    known = rescoring.rescorer(model)
    rest = set(range(7)) - set(known.used.tolist())
    got = {r.feature_id: r.sensitivity for r in importance.sensitivity_model(data, model).collect()}
    assert set(got) == set(range(7)) and all(got[j] == 0 for j in rest)
    assert all(len(trees) <= len(known.trees) for trees in known.asked.values())


def test_unknown_models_are_named_and_scored_whole(data):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import NaiveBayes

    shifted = data.selectExpr("sample_id", "output", "transform(features, v -> v + 10) as features")
    model = Pipeline(stages=[NaiveBayes(featuresCol="_features", labelCol="output")]).fit(models.vectorised(shifted))
    assert rescoring.rescorer(model) is None
    assert importance.permutation_importance_model(shifted, model, 1).count() == 14
    with pytest.raises(ValueError, match="no rescorer for PipelineModel"):
        importance.sensitivity_model(shifted, model)
