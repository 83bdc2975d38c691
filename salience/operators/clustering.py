"""Clustering of points: MLlib methods, linkage and density joins, grid search.

Points are ``(point_id, features ARRAY<DOUBLE>)``; every method returns
``(point_id, cluster, features)``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.sql import DataFrame, functions as F

from salience.functions.expressions import whole_vector
from salience.operators.cells import (
    NEAR_PAIRS, Block, Cells, Screen, gaps, lengths, make_cells, meet, nearest_in, neighbours, pairs_in, radius_in,
    taken, within,
)
from salience.operators.graph import components, contracted, roots
from salience.operators.indices import HIGHER_IS_BETTER, index, small_clusters
from salience.operators.lookup import look_up
from salience.operators.scan import dense_position
from salience.operators.spectral import spectral_embedding
from salience.operators.tiles import BLOCK_ROWS
from salience.session import cut_lineage

GRID_THREADS = 4
#: Nearest neighbours of a point that the spanning tree looks at first.
TREE_NEIGHBOURS = 8


def _predict(points: DataFrame, estimator) -> DataFrame:
    vectors = points.withColumn("_v", whole_vector(points))
    fitted = estimator.setFeaturesCol("_v").setPredictionCol("cluster").fit(vectors)
    return fitted.transform(vectors).select("point_id", "cluster", "features")


def kmeans(points, n_clusters: int, init: str = "k-means||", max_iter: int = 20, seed: int = 0):
    return _predict(points, KMeans(k=n_clusters, initMode=init, maxIter=max_iter, seed=seed))


def bisecting(points, n_clusters: int, max_iter: int = 20, seed: int = 0):
    """Top-down hierarchical clustering."""
    return _predict(points, BisectingKMeans(k=n_clusters, maxIter=max_iter, seed=seed))


def gmm(points, n_components: int, max_iter: int = 50, seed: int = 0):
    """Gaussian mixture, full covariance."""
    return _predict(points, GaussianMixture(k=n_components, maxIter=max_iter, seed=seed))


def power_iteration(
    points, edges: DataFrame, n_clusters: int, max_iter: int = 20, seed: int = 0
):
    """Spectral clustering on a non-negative similarity edge table.

    Integer point ids; points without an edge get cluster -1.
    """
    model = PowerIterationClustering(
        k=n_clusters, maxIter=max_iter, srcCol="src", dstCol="dst", weightCol="weight"
    )
    assigned = model.assignClusters(
        edges.where(F.col("weight") > 0).select(
            F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"),
            F.col("weight").cast("double").alias("weight"),
        )
    )
    return points.join(assigned, points["point_id"] == assigned["id"], "left").select(
        "point_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "features"
    )


def _least(groups):
    """The shortest way out of the component of each visitor, of those up to ``reach``: of each block and component one.

    Costs of the pairs in question are worked out anew from the differences, so that
    both ends of a pair, and all tasks, agree on them; equal costs go by (src, dst).
    """
    for x, ys in groups:
        cost, other, names = np.full(len(x), np.inf), x["point_id"].copy(), x["component"]
        reach = x["reach"].astype(float) if "reach" in x.columns else cost.copy()
        parent, screen = names.copy(), Screen(x.vectors)
        for y, rows in ys:
            if not len(rows):
                continue
            found, error = screen.squares(rows, y.vectors)
            most = np.minimum(cost[rows], reach[rows])
            with np.errstate(over="ignore"):
                limits = screen.limits(rows, most, error).astype(found.dtype)
            if np.isinf(limits).any():
                found[names[rows][:, None] == y["component"][None, :]] = np.inf
                limits = np.minimum(limits, found.min(axis=1, initial=np.inf) + 4 * error)
            i, j = pairs_in(found <= limits[:, None])
            out = names[rows[i]] != y["component"][j]
            i, j = i[out], j[out]
            for k in range(0, len(i), NEAR_PAIRS):
                row, at = rows[i[k : k + NEAR_PAIRS]], j[k : k + NEAR_PAIRS]
                gap, ids = lengths(x.vectors[row], y.vectors[at]), y["point_id"][at]
                order = np.lexsort((ids, gap, row))
                row, at, gap, ids = row[order], at[order], gap[order], ids[order]
                first = np.append(True, row[1:] != row[:-1])
                row, at, gap, ids = row[first], at[first], gap[first], ids[first]
                less = (gap < cost[row]) | ((gap == cost[row]) & (ids < other[row]))
                row, at = row[less], at[less]
                cost[row], other[row], parent[row] = gap[less], ids[less], y["component"][at]
        met = np.isfinite(cost)
        src, dst = np.minimum(x["point_id"], other)[met], np.maximum(x["point_id"], other)[met]
        mine = np.unique(names[met], return_inverse=True)[1]
        order = np.lexsort((dst, src, cost[met], mine))
        order = order[np.append(True, mine[order][1:] != mine[order][:-1])] if len(order) else order
        yield {"component": names[met][order], "parent": parent[met][order], "cost": cost[met][order],
               "src": src[order], "dst": dst[order]}


def minimum_spanning_tree(points: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact Euclidean minimum spanning tree ``(src, dst, cost)``.

    Boruvka rounds on the links to the ``TREE_NEIGHBOURS`` nearest of every point.
    What is not listed is no nearer than the last of a list, so a component whose shortest
    listed way out is shorter than the last of all its lists needs to look no further.  When
    too few are so sure, the others (but the largest) look among all points, blocks
    meeting blocks: only those whose lists end before their component's way out, and only
    that far.  Components at least shrink by a quarter each round; what is written in
    a round grows with the points, not with their pairs.
    """
    kind = points.schema["point_id"].dataType.simpleString()
    cells = make_cells(points.select("point_id", "features"), "euclidean", block_rows, near=TREE_NEIGHBOURS)
    near = cut_lineage(nearest_in(cells, TREE_NEIGHBOURS))
    cells = replace(cells, blocks=cells.blocks.drop("bound"))
    ends = near.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("end"))
    ends = ends.where(F.col("n") == TREE_NEIGHBOURS).select("point_id", "end")
    # How far the list of a point is whole.
    lists = cut_lineage(cells.spots().select("point_id").distinct().join(ends, "point_id", "left").select(
        "point_id", F.coalesce("end", F.lit(float("inf"))).alias("end")))
    labels, merges = lists.select("point_id", "end", F.col("point_id").alias("component")), []
    parts = lists.select(F.col("point_id").alias("component"), F.lit(1).cast("bigint").alias("n"), "end")
    key = F.struct(F.col("distance").alias("cost"), F.least("point_id", "other").alias("src"),
                   F.greatest("point_id", "other").alias("dst"))
    live = cut_lineage(near.select(key.alias("key")).distinct().groupBy(
        F.col("key.src").alias("a"), F.col("key.dst").alias("b")).agg(F.min("key").alias("key")))
    trees = [points.sparkSession.createDataFrame([], f"src {kind}, dst {kind}, cost double")]
    while True:
        both = F.array(F.struct(F.col("a").alias("component"), F.col("b").alias("parent")),
                       F.struct(F.col("b").alias("component"), F.col("a").alias("parent")))
        ways = live.select("key", F.inline(both)).groupBy("component").agg(F.min(F.struct("key", "parent")).alias("way"))
        parts = cut_lineage(parts.join(ways, "component", "left").select(
            "component", "n", "end", "way", F.coalesce(F.col("way.key.cost") < F.col("end"), F.lit(False)).alias("sure")))
        found = parts.agg(F.max(F.struct("n", "component")).alias("o"), F.count(F.lit(1)).alias("k"),
                          F.count_if("sure").alias("sure")).first()
        if found["k"] <= 1:
            break
        picks = parts.where("sure").select("component", "way.parent", "way.key")
        if 2 * found["sure"] < found["k"]:
            for merge in merges:
                labels = cut_lineage(look_up(labels, merge, "component").select("point_id", "end", F.col("root").alias("component")))
            merges = []
            asked = parts.where(~F.col("sure") & (F.col("component") != F.lit(found["o"]["component"])))
            known = asked.select("component", F.coalesce("way.key.cost", F.lit(float("inf"))).alias("reach"))
            told = look_up(labels, known, "component", "left")
            named = cells.told(
                told, component=F.col("component"), reach=F.coalesce("reach", F.lit(0.0)),
                out=F.coalesce(F.col("end") <= F.col("reach"), F.lit(False)))
            further = meet(named, _least, f"component {kind}, parent {kind}, cost double, src {kind}, dst {kind}",
                           within(), guests="out", radius="reach")
            further = further.select("component", F.struct(F.struct("cost", "src", "dst").alias("key"), "parent").alias("way"))
            every = further.unionByName(asked.where("way is not null").select("component", "way"))
            picks = picks.unionByName(every.groupBy("component").agg(F.min("way").alias("way")).select(
                "component", "way.parent", "way.key"))
        picks = cut_lineage(picks)
        trees.append(picks.select("key.src", "key.dst", "key.cost").distinct())
        stay = parts.select("component").join(picks, "component", "left_anti").select(
            F.col("component").alias("c"), F.col("component").alias("parent"))
        pointers = roots(cut_lineage(picks.select(F.col("component").alias("c"), "parent").unionByName(stay)))
        merges.append(pointers.withColumnRenamed("c", "component"))
        parts = cut_lineage(look_up(parts.select("component", "n", "end"), merges[-1], "component").groupBy(
            F.col("root").alias("component")).agg(F.sum("n").alias("n"), F.min("end").alias("end")))
        live = contracted(live, pointers)
    return reduce(DataFrame.unionByName, trees)


def _numbered(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Component names to cluster numbers 0.. in ascending name order."""
    names = labels.select("component").distinct()
    codes = dense_position(names, [], "component", "_code").select(
        "component", (F.col("_code") - 1).cast("int").alias("cluster")
    )
    return (
        points.join(labels, points["point_id"] == labels["node"])
        .join(codes, "component")
        .select("point_id", "cluster", "features")
    )


def single_linkage(points: DataFrame, n_clusters: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Hierarchical single linkage: cut the longest edges of the spanning tree."""
    tree = cut_lineage(minimum_spanning_tree(points, block_rows))
    order = F.struct("cost", "src", "dst")
    longest = tree.select(order.alias("o")).orderBy(F.col("o").desc()).limit(n_clusters - 1)
    cut = longest.agg(F.min("o").alias("o"))
    kept = tree.withColumn("_cut", cut.scalar()).where(
        F.col("_cut").isNull() | (order < F.col("_cut"))
    )
    nodes = points.select(F.col("point_id").alias("node"))
    return _numbered(points, components(nodes, kept))


def linkage_threshold(
    points: DataFrame, distance: float, block_rows: int = BLOCK_ROWS, metric: str = "euclidean"
) -> DataFrame:
    """Single linkage cut at a distance: the components of all pairs within it.

    Only cells that can hold a partner are opened, and a task gives one link for each
    of the points that it has linked, never the pairs.
    """
    cells = make_cells(points.select("point_id", "features"), metric, block_rows)
    links = _links(cells, radius_in(metric, distance))
    nodes = points.select(F.col("point_id").alias("node"))
    return _numbered(points, components(nodes, links))


def _stars(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest row that reaches each row and each column of a boolean matrix; none is the row count."""
    none = len(near)
    rows = np.arange(none)
    while True:
        columns = np.where(near, rows[:, None], none).min(axis=0, initial=none)
        new = np.minimum(rows, np.where(near, columns[None, :], none).min(axis=1, initial=none))
        new = new[new]
        if (new == rows).all():
            return rows, columns
        rows = new


class _Forest:
    """Points of a task by block, and which of them its links have joined."""

    def __init__(self) -> None:
        self.parent, self.ids, self.first = np.zeros(0, np.int64), [], {}
        self.count = 0

    def nodes(self, block: Block) -> np.ndarray:
        if block.key not in self.first:
            self.first[block.key] = self.count
            self.count += len(block)
            # A copy, as the ids that a block shows hold the whole batch that it came in.
            self.ids.append(block["point_id"].copy())
            if self.count > len(self.parent):
                self.parent = np.append(self.parent, np.arange(len(self.parent), 2 * self.count))
        return self.first[block.key] + np.arange(len(block))

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[nodes]
            top = self.parent[up]
            if (up == top).all():
                return up
            self.parent[nodes] = top

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        apart = self.roots(left) != self.roots(right)
        for a, b in zip(left[apart].tolist(), right[apart].tolist()):
            ends = self.roots(np.array([a, b]))
            if ends[0] != ends[1]:
                self.parent[ends.max()] = ends.min()

    def stars(self) -> dict[str, np.ndarray]:
        """The points that something has joined, with the smallest id that each is joined with."""
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int64)
        names, sizes = np.unique(self.roots(np.arange(self.count)), return_inverse=True, return_counts=True)[1:]
        order = np.argsort(ids, kind="stable")
        least = ids[order][np.unique(names[order], return_index=True)[1]] if len(ids) else ids
        met = sizes[names] > 1
        return {"point_id": ids[met], "least": least[names][met]}


def _links(cells: Cells, reach: float, who: str | None = None) -> DataFrame:
    """``src < dst`` that link the points within ``reach`` of each other as the pairs would.

    A task gives for each point the smallest id that it has found it joined with, and
    does not look at pairs that it has joined already.  Of a point's smallest ids the
    least stands for all, so what is left is a link for each point and those between
    the few names that tasks gave.
    """
    kind = cells.points.schema["point_id"].dataType.simpleString()
    metric = cells.metric

    def link(groups):
        forest = _Forest()
        for x, ys in groups:
            mine = forest.nodes(x)
            for y, rows in ys:
                theirs = forest.nodes(y)
                if not len(rows) or not len(y):
                    continue
                a, b = forest.roots(mine[rows]), forest.roots(theirs)
                names, sizes = np.unique(np.concatenate([a, b]), return_counts=True)
                if len(names) == 1:
                    continue
                common = names[sizes.argmax()]
                parts = [(rows[a != common], np.arange(len(y))), (rows[a == common], np.flatnonzero(b != common))]
                for i, j in parts:
                    if not len(i) or not len(j):
                        continue
                    near = gaps(taken(x, i), taken(y, j), metric) <= reach
                    stars, columns = _stars(near)
                    met = columns < len(i)
                    forest.join(
                        np.concatenate([mine[i], theirs[j][met]]),
                        np.concatenate([mine[i][stars], mine[i][columns[met]]]))
        yield forest.stars()

    found = meet(cells, link, f"point_id {kind}, least {kind}", within(reach), who, who, once=True)
    # At most one name for each task that holds the point.
    named = found.groupBy("point_id").agg(F.collect_set("least").alias("names"))
    first = F.array_min("names").alias("src")
    return named.select(first, F.explode(F.array_union("names", F.array("point_id"))).alias("dst")).where(
        F.col("src") < F.col("dst")).distinct()


def dbscan(
    points: DataFrame, eps: float, min_samples: int, block_rows: int = BLOCK_ROWS,
    metric: str = "euclidean",
) -> DataFrame:
    """Density clustering; noise is -1.

    Points meet only the cells that can hold a point within ``eps``.  A task
    returns neighbour counts, then the smallest id that each core point is
    linked with, then the first reachable cluster of each border point.  Even if a third
    of all points are neighbours, no pair list exists.  Metrics: Euclidean, l1,
    cosine; null or NaN cells raise an error.
    """
    kind = points.schema["point_id"].dataType.simpleString()
    cells = make_cells(points.select("point_id", "features"), metric, block_rows)
    reach = radius_in(metric, eps)

    def count_near(groups):
        for x, ys in groups:
            near = np.zeros(len(x), np.int64)
            for y, rows in ys:
                # Enough is enough: only whether the count reaches min_samples is asked.
                rows = rows[near[rows] < min_samples]
                if len(rows):
                    near[rows] += (gaps(taken(x, rows), y.vectors, metric) <= reach).sum(axis=1)
            yield {"point_id": x["point_id"], "near": near}

    core = (
        meet(cells, count_near, f"point_id {kind}, near bigint", within(reach))
        .groupBy("point_id")
        .agg((F.sum("near") >= min_samples).alias("core"))
    )
    cells = cells.told(core, core=F.col("core"))
    links = _links(cells, reach, "core")
    nodes = cells.spots().where("core").select(F.col("point_id").alias("node"))
    named = cut_lineage(components(nodes, links))
    # No nulls: they would turn whole ids into floats.
    cells = cells.told(
        named.select(F.col("node").alias("point_id"), "component"), core=F.col("component").isNotNull(),
        rest=F.col("component").isNull(), component=F.coalesce("component", "point_id"))

    def first_near(groups):
        for x, ys in groups:
            met, best = np.zeros(len(x), bool), x["component"].copy()
            for y, rows in ys:
                if not len(y):
                    continue
                order = np.argsort(y["component"], kind="stable")
                names = y["component"][order]
                rows = rows[~met[rows] | (names[0] < best[rows])]
                if not len(rows):
                    continue
                near = gaps(taken(x, rows), y.vectors[order], metric) <= reach
                # Homes are in order, so the first near one has the smallest name.
                hit = near.any(axis=1)
                rows, name = rows[hit], names[near[hit].argmax(axis=1)]
                less = ~met[rows] | (name < best[rows])
                best[rows[less]], met[rows] = name[less], True
            yield {"point_id": x["point_id"][met], "component": best[met]}

    borders = (
        meet(cells, first_near, f"point_id {kind}, component {kind}", within(reach), "core", "rest")
        .groupBy("point_id")
        .agg(F.min("component").alias("component"))
    )
    labels = cut_lineage(borders.select(F.col("point_id").alias("node"), "component").unionByName(named))
    clustered = _numbered(points, labels)
    noise = points.join(labels, points["point_id"] == labels["node"], "left_anti").select(
        "point_id", F.lit(-1).alias("cluster"), "features"
    )
    return clustered.unionByName(noise)


def similarity_graph(
    points: DataFrame, k: int = 10, metric: str = "euclidean", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``(src, dst, weight)`` of points that are among each other's k nearest: 1 if both, 0.5 if one is."""
    near = neighbours(points, k, metric, block_rows)
    return near.groupBy(
        F.least("point_id", "other").alias("src"), F.greatest("point_id", "other").alias("dst")
    ).agg((F.count(F.lit(1)) / 2.0).alias("weight"))


def spectral(
    points: DataFrame, n_clusters: int, k: int = 10, metric: str = "euclidean", seed: int = 0
) -> DataFrame:
    """Spectral clustering on the graph of nearest neighbours.

    Points are placed by the leading eigenvectors of the normalised graph, scaled to
    length 1, and clustered by k-means.  A point without an edge gets cluster -1.
    """
    edges = similarity_graph(points, k, metric)
    placed, _ = spectral_embedding(edges, n_clusters, seed=seed)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
    spots = placed.withColumn("_norm", norm).select(
        F.col("node").alias("point_id"),
        F.transform("vector", lambda v: v / F.greatest("_norm", F.lit(1e-300))).alias("features"))
    found = kmeans(spots, n_clusters, max_iter=50, seed=seed).select(F.col("point_id").alias("_id"), "cluster")
    return points.join(found, points["point_id"] == F.col("_id"), "left").select(
        "point_id", F.coalesce("cluster", F.lit(-1)).alias("cluster"), "features")


METHODS = {
    "kmeans": kmeans,
    "gmm": gmm,
    "bisecting": bisecting,
    "single_linkage": single_linkage,
    "dbscan": dbscan,
    "spectral": spectral,
}

RESULT_SCHEMA = (
    "method string, params map<string,string>, sim int, score double, clusters int, "
    "violations int, status string, error string"
)


def parameter_grid(choices: dict[str, list]) -> list[dict]:
    return [dict(zip(choices, values)) for values in product(*choices.values())]


def run_configuration(
    points: DataFrame, method: str, params: dict, sim: int, scoring: str,
    min_clusters: int, max_clusters: int, drop_noise: bool = False,
) -> tuple[tuple, DataFrame | None]:
    """Fit one configuration and score it; failures are recorded, not hidden."""
    shown = {k: str(v) for k, v in params.items() if not isinstance(v, DataFrame)}
    try:
        options = dict(params)
        if method in ("kmeans", "gmm", "bisecting"):
            options["seed"] = sim
        labelled = cut_lineage(METHODS[method](points, **options))
        count = labelled.select("cluster").distinct().count()
        if method == "dbscan" and not min_clusters <= count <= max_clusters:
            return (method, shown, sim, None, count, None, "rejected", "cluster count"), None
        judged = labelled.where(F.col("cluster") != -1) if drop_noise else labelled
        score = index(scoring)(judged).first()[0]
        thin = small_clusters(labelled).count()
        return (method, shown, sim, float(score), count, thin, "ok", None), labelled
    except Exception as failure:
        return (method, shown, sim, None, None, None, "failed", str(failure)), None


def grid_search(
    points: DataFrame,
    grids: dict[str, list[dict]],
    scoring: str = "silhouette",
    simulations: int = 1,
    min_clusters: int = 5,
    max_clusters: int = 20,
    drop_noise: bool = False,
) -> DataFrame:
    """Score every configuration and seed; one result row each."""
    index(scoring)
    unknown = set(grids) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown clustering methods: {sorted(unknown)}")
    fixed = cut_lineage(points)
    jobs = [
        (method, params, sim)
        for method, grid in grids.items()
        for params in grid
        for sim in range(simulations)
    ]
    with ThreadPoolExecutor(GRID_THREADS) as pool:
        rows = list(
            pool.map(
                lambda j: run_configuration(
                    fixed, *j, scoring, min_clusters, max_clusters, drop_noise
                )[0],
                jobs,
            )
        )
    return points.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def best_per_method(results: DataFrame, scoring: str) -> DataFrame:
    """Best and worst score and the best configuration of each method, ranked."""
    high = HIGHER_IS_BETTER[scoring]
    good = results.where(F.col("status") == "ok")
    best, worst = (F.max, F.min) if high else (F.min, F.max)
    pick = F.max_by if high else F.min_by
    table = good.groupBy("method").agg(
        best("score").alias("best_score"),
        worst("score").alias("worst_score"),
        pick("params", "score").alias("best_params"),
        pick("violations", "score").alias("violations"),
    )
    order = F.col("best_score").desc() if high else F.col("best_score").asc()
    return table.orderBy(order, "method")


def rerun_best(
    points: DataFrame,
    method: str,
    params: dict,
    scoring: str = "silhouette",
    simulations: int = 10,
    min_clusters: int = 5,
    max_clusters: int = 20,
) -> tuple[DataFrame, DataFrame]:
    """Repeat one configuration over seeds; (best labels, best/worst score)."""
    high = HIGHER_IS_BETTER[scoring]
    fixed = cut_lineage(points)
    with ThreadPoolExecutor(GRID_THREADS) as pool:
        done = list(
            pool.map(
                lambda sim: run_configuration(
                    fixed, method, params, sim, scoring, min_clusters, max_clusters
                ),
                range(simulations),
            )
        )
    scored = [(row, labels) for row, labels in done if labels is not None]
    if not scored:
        raise ValueError(f"no run of {method} succeeded: {done[0][0][-1]}")
    by_score = sorted(scored, key=lambda pair: pair[0][3], reverse=high)
    scores = points.sparkSession.createDataFrame(
        [(method, by_score[0][0][3], by_score[-1][0][3])],
        "method string, best_score double, worst_score double",
    )
    return by_score[0][1], scores
