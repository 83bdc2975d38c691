"""The randomised range finder against numpy's decompositions."""

import numpy as np
import pytest

from salience.operators import rangefinder, reduction


def _table(spark, x, parts=3):
    rows = [(i, i % 2, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, output int, features array<double>").repartition(parts)


@pytest.mark.parametrize("shape, k", [((200, 64), 8), ((40, 6), 3), ((7, 30), 5), ((300, 90), 2)])
def test_loadings_equal_the_exact_ones(spark, shape, k):
    x = np.random.default_rng(4).normal(size=shape) + 1.5
    for fit, centre in ((reduction.fit_pca, x.mean(axis=0)), (reduction.fit_svd, 0.0)):
        got = fit(_table(spark, x), k).loadings
        want = np.linalg.svd(x - centre, full_matrices=False)[2][:k].T
        assert got.shape == want.shape
        assert np.allclose(np.abs((got * want).sum(axis=0)), 1, atol=1e-9)
        assert (got[np.abs(got).argmax(axis=0), np.arange(k)] > 0).all()


def test_restarts_chunks_and_levels_of_the_tree(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(150, 60))
    monkeypatch.setattr(rangefinder, "BLOCKS", 2)
    monkeypatch.setattr(rangefinder, "CHUNK_BYTES", 8 * 12 * 7)
    monkeypatch.setattr(rangefinder, "FAN_IN", 2)
    cells = _table(spark, x, 5).select("features")
    values, vectors = rangefinder.singular_vectors(cells, reduction._rows, 60, 3, oversample=9, rounds=60)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:3], rtol=1e-9)
    assert np.allclose(np.abs((vectors * vt[:3].T).sum(axis=0)), 1, atol=1e-9)


def test_low_rank_and_no_rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 2)) @ rng.normal(size=(2, 20))
    assert reduction.fit_svd(_table(spark, x), 5).loadings.shape == (20, 2)
    none = _table(spark, x).limit(0).select("features")
    assert rangefinder.singular_vectors(none, reduction._rows, 20, 3)[1].shape == (20, 0)
    empty = _table(spark, x).select("features")
    assert rangefinder.singular_vectors(empty, reduction._rows, 0, 3)[1].shape == (0, 0)
