"""Cell joins against comparing all pairs, and how much they leave unopened."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salience.operators import cells, clustering, indices

SCHEMA = "point_id long, cluster int, features array<double>"


def blobs(rng, centres=6, each=40, width=4):
    middle = rng.normal(0, 30, (centres, width))
    x = np.concatenate([m + rng.normal(0, 1, (each, width)) for m in middle])
    return [(1000 - i, i // each, [float(v) for v in row]) for i, row in enumerate(x)]


def gap_matrix(rows, metric):
    x = np.array([r[2] for r in rows])
    if metric == "l1":
        return np.abs(x[:, None] - x[None]).sum(-1)
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1)[:, None]
        return np.maximum(1 - x @ x.T, 0)
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


@pytest.fixture(scope="module")
def rows():
    return blobs(np.random.default_rng(3))


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def groups(near, keep):
    """Component names (smallest id position) of the kept rows."""
    names = {i: i for i in np.flatnonzero(keep)}
    changed = True
    while changed:
        changed = False
        for i in names:
            best = min(names[j] for j in np.flatnonzero(near[i] & keep))
            if best < names[i]:
                names[i], changed = best, True
    return names


def partition(labels):
    out = {}
    for point, cluster in labels:
        out.setdefault(cluster, set()).add(point)
    return {frozenset(v) for k, v in out.items() if k != -1}, out.get(-1, set())


@pytest.mark.parametrize("metric, reach", [("euclidean", 1.4), ("l1", 2.5), ("cosine", 0.002)])
def test_radius_joins_equal_all_pairs(points, rows, metric, reach):
    gap = gap_matrix(rows, metric)
    near = gap <= reach
    core = near.sum(1) >= 4
    names = groups(near, core)
    found = {i: names[i] for i in names}
    for i in np.flatnonzero(~core):
        hits = [names[j] for j in np.flatnonzero(near[i] & core)]
        if hits:
            # Clusters are named by their smallest id; ids descend along the rows.
            by_id = {n: min(rows[j][0] for j in names if names[j] == n) for n in set(hits)}
            found[i] = min(set(hits), key=by_id.get)
    want = partition([(rows[i][0], found.get(i, -1)) for i in range(len(rows))])
    got = clustering.dbscan(points.drop("cluster"), reach, 4, 24, metric).collect()
    assert partition([(r.point_id, r.cluster) for r in got]) == want and len(got) == len(rows)
    everyone = groups(near, np.ones(len(rows), bool))
    cut = clustering.linkage_threshold(points.drop("cluster"), reach, 24, metric).collect()
    assert partition([(r.point_id, r.cluster) for r in cut]) == partition(
        [(rows[i][0], everyone[i]) for i in everyone])


@pytest.mark.parametrize("metric", cells.METRICS)
def test_neighbours_equal_sorting(points, rows, metric):
    gap = gap_matrix(rows, metric)
    ids = np.array([r[0] for r in rows])
    got = {(r.point_id, r.rank): (r.other, r.distance) for r in cells.neighbours(points, 5, metric, 24).collect()}
    assert len(got) == 5 * len(rows)
    for i in range(len(rows)):
        order = sorted((gap[i, j], ids[j]) for j in range(len(rows)) if j != i)[:5]
        for rank, (distance, other) in enumerate(order, 1):
            assert got[ids[i], rank][0] == other and abs(got[ids[i], rank][1] - distance) < 1e-7


def silhouettes(rows):
    gap, label = gap_matrix(rows, "euclidean"), np.array([r[1] for r in rows])
    out = {}
    for i, r in enumerate(rows):
        own = label == label[i]
        a = gap[i, own].sum() / max(own.sum() - 1, 1)
        b = min(gap[i, label == k].mean() for k in set(label) - {label[i]})
        out[r[0]] = (b - a) / max(a, b) if own.sum() > 1 else 0.0
    return out


def test_indices_equal_all_pairs(spark, rows):
    alone = [*rows, (5000, 99, [500.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([*alone, (6000, None, [0.0] * 4)], SCHEMA)
    got = {r.point_id: r.width for r in indices.silhouette_samples(table, 24).collect()}
    want = silhouettes(alone)
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    gap, label = gap_matrix(alone, "euclidean"), np.array([r[1] for r in alone])
    same = label[:, None] == label[None]
    score = indices.dunn(table, 24).first().score
    assert abs(score - gap[~same].min() / gap[same].max()) < 1e-9
    singles = spark.createDataFrame([(1, 1, [0.0]), (2, 2, [1.0])], SCHEMA)
    assert indices.dunn(singles).first().score == 0.0


def test_few_cells_are_opened(points, rows):
    """Of 11 pivots' cells a point opens few; Dunn opens only those of the extreme pairs."""
    held = cells.make_cells(points, block_rows=24)
    everything = len(rows) * len(held.pivots)
    count = lambda opens: sum(len(r.opened) for r in cells.visitors(held, opens).select("opened").collect())
    assert len(held.pivots) == 10 and held.size.sum() == len(rows)
    assert count(cells.within(1.4)) < everything / 3
    gap, width = indices.extremes(held)
    exact, label = gap_matrix(rows, "euclidean"), np.array([r[1] for r in rows])
    same = label[:, None] == label[None]
    assert gap >= exact[~same].min() - 1e-9 and width <= exact[same].max() + 1e-9
    assert count(cells.within(gap)) < everything


def test_rows_without_a_place_are_named(spark):
    for bad in (None, float("nan")):
        table = spark.createDataFrame([(1, 0, [1.0, 2.0]), (7, 0, [bad, 1.0])], SCHEMA)
        with pytest.raises(Exception, match="null or NaN in the features of 7"):
            clustering.dbscan(table.drop("cluster"), 1.0, 2).collect()
        with pytest.raises(Exception, match="null or NaN in the features of 7"):
            indices.silhouette(table).collect()
    with pytest.raises(ValueError, match="unknown metric"):
        clustering.dbscan(table, 1.0, 2, metric="l3")


def test_strings_nothing_and_zero_vectors(spark):
    names = spark.createDataFrame([("b", [0.0, 0.0]), ("a", [0.0, 1.0]), ("c", [0.0, 2.0]), ("z", [9.0, 9.0])],
                                  "point_id string, features array<double>")
    got = {r.point_id: r.cluster for r in clustering.dbscan(names, 1.0, 2).collect()}
    assert got == {"a": 0, "b": 0, "c": 0, "z": -1}
    angles = {r.point_id: r.cluster for r in clustering.linkage_threshold(names, 0.5, metric="cosine").collect()}
    assert angles["a"] == angles["c"] and len(set(angles.values())) == 2 + (angles["z"] != angles["a"])
    empty = names.limit(0)
    assert clustering.dbscan(empty, 1.0, 2).count() == 0 and clustering.linkage_threshold(empty, 1.0).count() == 0
    assert cells.neighbours(empty, 3).count() == 0


def test_spectral_finds_two_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(30 * (i % 2) + rng.normal()), float(rng.normal())]) for i in range(80)]
    rows += [(80, [15.0, 0.0])]
    table = spark.createDataFrame(rows, "point_id long, features array<double>")
    got = {r.point_id: r.cluster for r in clustering.spectral(table, 2, 6).collect()}
    assert len({got[i] for i in range(0, 80, 2)}) == 1 and len({got[i] for i in range(80)}) == 2
    assert math.isclose(clustering.similarity_graph(table, 6).agg({"weight": "sum"}).first()[0], 6 * 81 / 2)


def test_embedding_equals_dense_eigenvectors(spark):
    from salience.operators import spectral

    rng = np.random.default_rng(5)
    weight = np.triu(rng.random((30, 30)) * (rng.random((30, 30)) < 0.3), 1) + np.diag(np.full(29, 0.2), 1)
    edges = spark.createDataFrame(
        [(f"n{i:02}", f"n{j:02}", float(weight[i, j])) for i, j in zip(*np.nonzero(weight))], "src string, dst string, weight double")
    whole = weight + weight.T
    root = np.sqrt(whole.sum(0))
    values, vectors = np.linalg.eigh(whole / root[:, None] / root[None, :])
    placed, got = spectral.spectral_embedding(edges, 3)
    assert np.allclose(got, values[::-1][:3], atol=1e-6)
    rows = {r.node: r.vector for r in placed.collect()}
    mine = np.array([rows[f"n{i:02}"] for i in range(30)])
    assert np.allclose(np.abs((mine * vectors[:, ::-1][:, :3]).sum(0)), 1, atol=1e-4)
    with pytest.raises(ValueError, match="fewer than 31"):
        spectral.spectral_embedding(edges, 31)


def test_blocks_meet_without_a_shuffle(spark):
    """No copy of a point for each block it meets, and no link that a task has made before."""
    rng = np.random.default_rng(9)
    rows = [(i, 0, [float(v) for v in rng.normal(0, 0.01, 3)]) for i in range(240)]
    held = cells.make_cells(spark.createDataFrame(rows, SCHEMA), block_rows=8)

    def tell(groups):
        for x, ys in groups:
            yield {"point_id": x["point_id"], "n": np.full(len(x), sum(len(y) for y, _ in ys))}

    met = cells.meet(held, tell, "point_id long, n long", cells.within(1.0))
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    counts = {r.point_id: r.n for r in met.groupBy("point_id").agg({"n": "sum"}).toDF("point_id", "n").collect()}
    assert counts == dict.fromkeys(range(240), 240)
    links = clustering._links(held, 1.0)
    # All 28,680 pairs are near, and a star for each pair of blocks would be 6,000 links at least;
    # the four files make sixteen tasks, each with a forest over two files.
    assert links.count() < 2 * 4 * 240


def test_spanning_tree_equals_all_pairs(spark):
    """Copies, ties and lone points; what a round writes does not grow with the pairs."""
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.integers(0, 4, (60, 2)).astype(float), rng.normal(0, 1, (40, 2)), [[90.0, 0.0]]])
    ids = [200 - 2 * i for i in range(len(x))]
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x)], "point_id long, features array<double>")
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = sorted((gap[i, j], min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(len(x)) for j in range(i))
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    want = set()
    for _, a, b in pairs:
        if root(a) != root(b):
            top[root(a)] = root(b)
            want.add((a, b))
    got = clustering.minimum_spanning_tree(table, 8).collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)
    place = dict(zip(ids, range(len(x))))
    assert all(abs(r.cost - gap[place[r.src], place[r.dst]]) < 1e-12 for r in got)
    assert clustering.minimum_spanning_tree(table.limit(0)).count() == 0


def test_a_block_tells_one_way_out_of_each_component():
    x = cells.Block(0, 0, np.arange(6.0)[:, None], {"point_id": np.arange(6), "component": np.array([0, 0, 0, 3, 3, 3])})
    told = list(clustering._least(iter([(x, iter([(x, np.arange(6))] * 3))])))
    assert [(t["component"].tolist(), t["cost"].tolist(), t["src"].tolist(), t["dst"].tolist()) for t in told] == [
        ([0, 3], [1.0, 1.0], [2, 2], [3, 3])]


def test_vectors_are_written_once(spark, points, monkeypatch):
    """Numbers that single precision holds stay at four bytes, and no later table has them again."""
    slim = points.withColumn("features", F.transform("features", lambda v: v.cast("float").cast("double")))
    tables, plain = [], cells.cut_lineage

    def spy(df):
        tables.append(plain(df))
        return tables[-1]

    for module in (cells, clustering, indices):
        monkeypatch.setattr(module, "cut_lineage", spy)
    runs = [
        lambda: clustering.dbscan(slim.drop("cluster"), 1.4, 4, 24), lambda: cells.neighbours(slim, 5, "cosine", 24),
        lambda: clustering.linkage_threshold(slim.drop("cluster"), 1.4, 24, "l1"), lambda: indices.silhouette_samples(slim, 24),
    ]
    for run in runs:
        tables.clear()
        run().count()
        whole = [t for t in tables if t.count() and {"features", "vectors"} & set(t.columns)]
        assert len(whole) == 1
        assert whole[0].agg(F.sum(F.octet_length("vectors"))).first()[0] == 240 * 4 * 4


def test_a_visitor_is_summed_up_in_one_task(spark, monkeypatch):
    """However many blocks of homes there are; more only beyond the bytes that a task may hold."""
    rows = [(i, 0, [float(i % 7), 0.0]) for i in range(400)]

    def tell(groups):
        for x, ys in groups:
            yield {"point_id": x["point_id"], "n": np.full(len(x), sum(len(y) for y, _ in ys))}

    held = cells.make_cells(spark.createDataFrame(rows, SCHEMA), block_rows=4)
    assert held.blocks.count() >= 100
    assert cells.meet(held, tell, "point_id long, n long", cells.within(99.0)).count() == 400
    monkeypatch.setattr(cells, "HOME_BYTES", held.bytes // 2)
    assert cells.meet(held, tell, "point_id long, n long", cells.within(99.0)).count() == 800


def test_parts_of_homes_share_the_tasks_of_their_visitors(spark, monkeypatch):
    """What grows with the points is added up before the shuffle, not told once for each part of the homes."""
    rng = np.random.default_rng(21)
    rows = [(i, i % 3, [float(v) for v in rng.normal(0, 1, 3)]) for i in range(400)]
    table = spark.createDataFrame(rows, SCHEMA)

    def tell(groups):
        for x, ys in groups:
            yield {"point_id": x["point_id"], "n": np.full(len(x), sum(len(y) for y, _ in ys))}

    held = cells.make_cells(table, block_rows=4)
    whole = [sorted(map(tuple, run().collect())) for run in (
        lambda: clustering.dbscan(table.drop("cluster"), 0.6, 4, 4).select("point_id", "cluster"),
        lambda: cells.neighbours(table, 5, "euclidean", 4).select("point_id", "rank", "other"))]
    monkeypatch.setattr(cells, "HOME_BYTES", math.ceil(held.bytes / 3))
    met = cells.meet(held, tell, "point_id long, n long", cells.within(99.0))
    assert met.count() == 3 * 400
    told = met.withColumn("task", F.spark_partition_id()).collect()
    assert len({(r.point_id, r.task) for r in told}) == 400 and sum(r.n for r in told) == 400 * 400
    # A link for each point and task, not for each part of the homes.
    assert clustering._links(held, 9.0).count() < 400 * (held.parts + 1)
    assert sorted(map(tuple, clustering.dbscan(table.drop("cluster"), 0.6, 4, 4).select("point_id", "cluster").collect())) == whole[0]
    assert sorted(map(tuple, cells.neighbours(table, 5, "euclidean", 4).select("point_id", "rank", "other").collect())) == whole[1]


def test_a_round_of_products_writes_one_table(spark, monkeypatch):
    from salience.operators import spectral

    edges = spark.createDataFrame([(i, (i + 1) % 40, 1.0 + i % 3) for i in range(40)], "src long, dst long, weight double")
    written, plain = [], spectral.cut_lineage
    monkeypatch.setattr(spectral, "cut_lineage", lambda df: written.append(1) or plain(df))
    monkeypatch.setattr(spectral, "ROUNDS", 2)
    monkeypatch.setattr(spectral, "TOLERANCE", 0.0)
    spectral.spectral_embedding(edges, 2)
    # The graph twice, a table for each round, and what is returned.
    assert len(written) <= 5


def test_a_forest_lets_go_of_the_batches_that_it_saw():
    """Ids that are seen in a batch of Arrow would keep all of its vectors for as long as the forest."""
    batch = pa.RecordBatch.from_pydict({"point_id": pa.array([[4, 5, 6]], pa.list_(pa.int64()))})
    seen = batch.column(0)[0].values.to_numpy(zero_copy_only=False)
    forest = clustering._Forest()
    assert forest.nodes(cells.Block(0, 0, np.zeros((3, 1)), {"point_id": seen})).tolist() == [0, 1, 2]
    assert not any(np.shares_memory(seen, held) for held in forest.ids)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_neighbours_are_told_by_their_differences(spark, metric):
    """Far from zero, products lose small distances; they only choose whom to look at."""
    rng = np.random.default_rng(4)
    x = 3000.0 + rng.normal(0, 1e-5, (60, 3)) if metric == "euclidean" else rng.normal(0, 1, (60, 3))
    x[30:40] = x[:10]
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "point_id long, features array<double>")
    y = x if metric == "euclidean" else cells.located(x, "cosine")
    gap = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    got = {(r.point_id, r.rank): (r.other, r.distance) for r in cells.neighbours(table, 4, metric, 16).collect()}
    assert len(got) == 240
    for i in range(60):
        want = sorted((gap[i, j], j) for j in range(60) if j != i)[:4]
        assert [got[i, r][0] for r in range(1, 5)] == [j for _, j in want]
        told = [d if metric == "euclidean" else d * d / 2 for d, _ in want]
        assert np.allclose([got[i, r][1] for r in range(1, 5)], told, rtol=1e-12, atol=0)


@pytest.mark.parametrize("size", [0.0, 1e-170, 1e-20, 1.0, 1e20])
def test_a_screen_leaves_out_no_pair_within_its_bounds(size):
    rng = np.random.default_rng(6)
    x, y = rng.normal(7, 1, (40, 5)) * size, rng.normal(7, 1, (50, 5)) * size
    gap = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
    screen, bound = cells.Screen(x), np.partition(gap, 6, axis=1)[:, 6]
    rows = np.arange(10, 40)
    found, error = screen.squares(rows, y)
    hit = found <= screen.limits(rows, bound[rows], error).astype(found.dtype)[:, None]
    assert hit[gap[rows] <= bound[rows][:, None]].all()
    assert size < 1e-20 or hit.sum() < 30 * 12


def test_products_with_a_graph_are_added_up_in_generated_code(spark):
    """Sums of whole vectors are objects, which Spark adds up by sorting all rows."""
    from salience.operators import spectral

    graph = spark.createDataFrame([(1, 2, 0.5), (1, 3, 2.0), (2, 1, 1.0)], "src long, dst long, weight double")
    vectors = spark.createDataFrame([(i, [float(i), 10.0 * i]) for i in (1, 2, 3)], "node long, vector array<double>")
    got = spectral.product(graph, vectors, 2)
    assert {r.node: r.vector for r in got.collect()} == {1: [7.0, 70.0], 2: [1.0, 10.0]}
    plan = got._jdf.queryExecution().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_a_tree_compares_all_points_only_where_lists_end(spark, monkeypatch):
    """Lists of neighbours settle the rounds; groups larger than a list look further, but not from every point."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (90, 3)), rng.normal(0, 1e-3, (30, 3)) + 9, rng.normal(0, 1e-3, (30, 3)) - 9])
    table = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "point_id long, features array<double>")
    guests, plain = [], clustering.meet

    def spy(held, *args, **kwargs):
        guests.append(held.spots().where("out").count())
        return plain(held, *args, **kwargs)

    monkeypatch.setattr(clustering, "meet", spy)
    got = clustering.minimum_spanning_tree(table, 16).collect()
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near, far, length = np.full(150, True), gap[0].copy(), 0.0
    near[0] = False
    while near.any():
        at = np.flatnonzero(near)[far[near].argmin()]
        length, near[at], far = length + far[at], False, np.minimum(far, gap[at])
    assert len(got) == 149 and abs(sum(r.cost for r in got) - length) < 1e-9
    assert len(guests) <= 2 and sum(guests) <= 60
