import numpy as np
import pytest
from pyspark.sql import functions as F

from salience.operators import attribution, clustering, graph, indices, similarity


def _points(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else 0, [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "point_id bigint, cluster int, features array<double>")


def _gaps(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def _reach(near):
    labels = np.arange(len(near))
    while True:
        new = np.array([labels[row].min() for row in near])
        if (new == labels).all():
            return labels
        labels = new


def test_spanning_forest_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 24
    pairs = {tuple(sorted(p)) for p in rng.integers(0, n, (40, 2)).tolist() if p[0] != p[1]}
    # node 0 is a hub
    pairs |= {(0, j) for j in range(1, 9)}
    edges = [(a, b, float(rng.integers(1, 9))) for a, b in sorted(pairs)]
    df = spark.createDataFrame(edges, "src bigint, dst bigint, weight double")
    nodes = spark.range(n).toDF("node")
    tree, labels = graph.spanning_forest(nodes, df, "weight")
    parent = list(range(n))

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if top(a) != top(b):
            parent[max(top(a), top(b))] = min(top(a), top(b))
            want.add((a, b, w))
    assert {tuple(r) for r in tree.collect()} == want
    assert {r.node: r.component for r in labels.collect()} == {v: top(v) for v in range(n)}


def test_long_chain_is_one_component(spark):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    nodes = spark.range(41).toDF("node")
    _, labels = graph.spanning_forest(nodes, edges.withColumn("w", F.lit(1)), "w")
    assert {r.component for r in labels.collect()} == {0}


def test_triangle_keeps_the_two_strong_edges(spark):
    edges = spark.createDataFrame([(0, 1, 0.9), (1, 2, -0.5), (0, 2, 0.2)], "src int, dst int, weight double")
    clusters = spark.createDataFrame([(i, 0) for i in range(3)], "feature_id int, cluster int")
    got = {(r.src, r.dst, r.colour) for r in graph.pruned_edges(edges, clusters).collect()}
    assert got == {(0, 1, "black"), (1, 2, "red")}


@pytest.mark.parametrize("min_nodes", [None, 100])
def test_pruning_equals_removal_loop(spark, min_nodes):
    rng = np.random.default_rng(6)
    n = 10
    edges = [(a, b, float(rng.normal())) for a in range(n) for b in range(a + 1, n) if a % 2 == b % 2]
    df = spark.createDataFrame(edges, "src int, dst int, weight double")
    clusters = spark.createDataFrame([(i, i % 2) for i in range(n)], "feature_id int, cluster int")
    got = {(r.src, r.dst) for r in graph.pruned_edges(df, clusters, min_nodes).collect()}
    want = set()
    for c in (0, 1):
        nodes = [i for i in range(n) if i % 2 == c]
        left = sorted((e for e in edges if e[0] % 2 == c), key=lambda e: -abs(e[2]))
        while left:
            rest = left[:-1]
            near = np.eye(n, dtype=bool)
            for a, b, _ in rest:
                near[a, b] = near[b, a] = True
            if min_nodes is None:
                broken = len(set(_reach(near)[nodes])) > 1
            else:
                broken = (near[nodes].sum(1) - 1 < 2).any()
            if broken:
                break
            left = rest
        want |= {(a, b) for a, b, _ in left}
    assert got == want


def test_singletons_have_zero_dunn(spark):
    x = np.random.default_rng(7).normal(size=(6, 2))
    assert indices.dunn(_points(spark, x, range(6))).first().score == 0.0


def test_indices_match_brute_force_over_many_tiles(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(50, 3))
    c = rng.integers(0, 4, 50)
    c[0] = 9
    d = _gaps(x)
    same = c[:, None] == c[None, :]
    widths = []
    for i in range(50):
        own = same[i].copy()
        own[i] = False
        if not own.any():
            widths.append(0.0)
            continue
        a = d[i][own].mean()
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        widths.append((b - a) / max(a, b))
    points = _points(spark, x, c)
    assert indices.silhouette(points, 12).first().score == pytest.approx(np.mean(widths))
    assert indices.dunn(points, 12).first().score == pytest.approx(d[~same].min() / d[same].max())
    centre = {k: x[c == k].mean(0) for k in set(c)}
    scatter = {k: np.linalg.norm(x[c == k] - centre[k], axis=1).mean() for k in set(c)}
    worst = [max((scatter[k] + scatter[m]) / np.linalg.norm(centre[k] - centre[m]) for m in set(c) if m != k) for k in set(c)]
    assert indices.davies_bouldin(points, 2).first().score == pytest.approx(np.mean(worst))


@pytest.mark.parametrize("block_rows", [1000, 13])
def test_dbscan_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.3, (25, 2)), rng.normal(4, 0.3, (15, 2)), rng.uniform(-3, 8, (15, 2))])
    near = _gaps(x) <= 0.5
    core = near.sum(1) >= 4
    links = near & core[:, None] & core[None, :]
    labels = _reach(links | np.eye(len(x), dtype=bool))
    name = np.where(core, labels, len(x))
    for i in np.flatnonzero(~core):
        hits = np.flatnonzero(near[i] & core)
        if hits.size:
            name[i] = labels[hits].min()
    order = {k: j for j, k in enumerate(sorted(set(name) - {len(x)}))}
    got = {r.point_id: r.cluster for r in clustering.dbscan(_points(spark, x).drop("cluster"), 0.5, 4, block_rows).collect()}
    assert got == {i: order.get(v, -1) for i, v in enumerate(name)}


def test_single_linkage_finds_groups(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(m, 0.1, (12, 2)) for m in (0, 5, 10)])
    got = clustering.single_linkage(_points(spark, x).drop("cluster"), 3, block_rows=8).toPandas().sort_values("point_id")
    assert [g.tolist() for _, g in got.groupby("cluster").point_id] == [list(range(k, k + 12)) for k in (0, 12, 24)]


def test_correlation_panels_and_constant_columns(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 7))
    x[:, 3] = 2.5
    rows = _points(spark, x).repartition(3)
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x.T)
    for panel in (100, 3):
        got = similarity.correlation_edges(rows, list(range(7)), panel).collect()
        assert len(got) == 21
        for r in got:
            if 3 in (r.src, r.dst):
                assert r.weight is None
            else:
                assert r.weight == pytest.approx(want[r.src, r.dst])


def test_combining_different_features_is_an_error(spark):
    a = spark.createDataFrame([(0, 1, 0.5)], "src int, dst int, weight double")
    b = spark.createDataFrame([(0, 2, 0.5)], "src int, dst int, weight double")
    with pytest.raises(ValueError):
        similarity.combine_correlations(a, b, 1, 1)
    assert similarity.combine_correlations(a, a.withColumn("weight", F.lit(0.1)), 3, 1).first().weight == pytest.approx(0.4)


def test_grid_records_failures(spark):
    x = np.random.default_rng(12).normal(size=(30, 2))
    results = clustering.grid_search(
        _points(spark, x).drop("cluster"),
        {"kmeans": [{"n_clusters": 3}, {"n_clusters": -1}]}, "dunn",
    ).collect()
    assert sorted(r.status for r in results) == ["failed", "ok"]


def test_linear_shap_sums_to_margin_gap(spark):
    from salience.operators import scorers

    rng = np.random.default_rng(13)
    rows = [(i, i % 2, rng.normal(size=3).tolist()) for i in range(30)]
    data = spark.createDataFrame(rows, "sample_id bigint, output int, features array<double>")
    scorer = scorers.linear_scorer(spark, [1.0, -2.0, 0.5], 0.1)
    shap = attribution.linear_shap(data.where("output = 1"), data, scorer).toPandas()
    margins = scorers.score_linear(data, scorer).toPandas()
    gap = margins[margins.output == 1].margin.mean() - margins.margin.mean()
    assert shap.importance.sum() == pytest.approx(gap)


def test_sampled_shap_adds_up_for_string_ids(spark):
    """With one background row the parts sum to the score's distance from it."""
    from salience.operators import models, scorers

    rng = np.random.default_rng(14)
    rows = [(f"s{i}", i % 2, rng.normal(size=4).tolist()) for i in range(40)]
    data = spark.createDataFrame(rows, "sample_id string, output int, z array<double>")
    model = models.fit_model("mlp", data, 4, 3, max_iter=5, features="z")
    base = data.where("sample_id = 's7'")
    shap = attribution.component_shap_sampled(data, base, model, 3).toPandas()
    score = lambda df: scorers.score_with_model(df, model, "z").toPandas().probability.mean()
    assert sorted(shap.component) == [0, 1, 2, 3]
    assert shap["shap"].sum() == pytest.approx(score(data) - score(base))


def test_correlation_of_offset_columns(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(40, 3))
    x[:, 1] += 0.5 * x[:, 0]
    want = np.corrcoef(x.T)
    rows = _points(spark, x + [1e7, 1e7, 0]).repartition(3)
    for r in similarity.correlation_edges(rows, [4, 5, 9], 2).collect():
        at = {4: 0, 5: 1, 9: 2}
        assert r.weight == pytest.approx(want[at[r.src], at[r.dst]], abs=1e-6)
    assert similarity.correlation_edges(rows.limit(0), [4, 5, 9]).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_density_clusters_of_large_and_string_ids(spark, kind):
    """Names near 2**60 stay whole; block counts above one cross tiles."""
    x = np.concatenate([np.linspace(0, 1, 12), np.linspace(5, 6, 12), [1.15, 20.0]])[:, None]
    ids = [2**60 + i if kind == "bigint" else f"p{i:02d}" for i in range(len(x))]
    rows = [(k, [float(v[0])]) for k, v in zip(ids, x)]
    points = spark.createDataFrame(rows, f"point_id {kind}, features array<double>")
    got = {r.point_id: r.cluster for r in clustering.dbscan(points, 0.2, 3, 5).collect()}
    assert [got[k] for k in ids] == [0] * 12 + [1] * 12 + [0, -1]
    cut = {r.point_id: r.cluster for r in clustering.linkage_threshold(points, 0.2, 5).collect()}
    assert [cut[k] for k in ids] == [0] * 12 + [1] * 12 + [0, 2]
