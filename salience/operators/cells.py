"""Points in cells around pivots, so that a distance join opens only cells that can matter.

A pivot is one of the points; every point belongs to the cell of its nearest
pivot, and a cell's radius is the largest distance from its pivot.  By the
triangle inequality a point's distance to every member of a cell lies within
the radius of its distance to the pivot, so most cells are settled without
looking at their members.  What is left is a join on cells: the members of a
cell ("homes") meet the points that opened it ("visitors").  Both are dealt to
written blocks, so a hot cell is many bounded rows; pairs of blocks are formed by
reading them again, never by a shuffle, and no pair of points ever leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from salience.functions.expressions import complete
from salience.functions.shuffling import hash_id
from salience.operators.tiles import distances
from salience.session import cut_lineage, parallelism

#: Members or visitors of a cell in a block, bytes of their vectors, and blocks in a file.
BLOCK_ROWS, BLOCK_BYTES, FILE_BLOCKS = 512, 1 << 22, 8
#: Bytes of vectors of the homes in a partition; a task holds them while its visitors pass.
HOME_BYTES = 1 << 26
#: Pivots at most, and bytes of all of them; tasks hold them whole.
MOST_PIVOTS, PIVOT_BYTES = 2048, 1 << 25
#: Share by which a bound is loosened, so that rounding never closes a cell.
SLACK = 1e-9
METRICS = ("euclidean", "l1", "cosine")
#: Pairs whose distances are worked out from their differences at a time.
NEAR_PAIRS = 1 << 13

#: (distances to pivots, own distance to the own pivot, radii, own radius) -> opened cells.
Opens = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def gaps(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of a and b."""
    if metric != "l1":
        return distances(a, b)
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True) if len(a) and len(b) else ():
        out += np.abs(x[:, None] - y[None, :])
    return out


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of a and b, pair by pair; the same whichever comes first."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


class Screen:
    """Which homes can be near the visitors of a block, by products in single precision.

    Squares of the distances less those of the visitors are one product of centred,
    prolonged rows.  What rounding can do to them is bounded and added to every
    bound, so no pair within a bound is left out; :func:`lengths` settles the few that are told.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.middle = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        self.own = x - self.middle
        self.square = (self.own * self.own).sum(axis=1)
        self.size = np.sqrt(self.square.max(initial=0.0))
        self.long = {}

    def squares(self, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Squared distances less the visitors' own squares, and how far off they can be."""
        theirs = y - self.middle
        square = (theirs * theirs).sum(axis=1)
        size = float(self.size + np.sqrt(square.max(initial=0.0)))
        # Beyond these sizes squares leave the range of single precision.
        kind = np.float32 if size == 0 or 1e-15 < size < 1e15 else np.float64
        if kind not in self.long:
            self.long[kind] = np.hstack([-2.0 * self.own, np.ones((len(self.own), 1))]).astype(kind)
        mine = self.long[kind] if len(rows) == len(self.own) else self.long[kind][rows]
        prolonged = np.empty((len(y), y.shape[1] + 1), kind)
        prolonged[:, :-1], prolonged[:, -1] = theirs, square
        return mine @ prolonged.T, (y.shape[1] + 16) * float(np.finfo(kind).eps) * size * size

    def limits(self, rows: np.ndarray, bound: np.ndarray, error: float) -> np.ndarray:
        """What :meth:`squares` are at most for homes within the bounds."""
        return bound * bound - self.square[rows] + 2 * error


def pairs_in(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is set, in order of rows."""
    return np.divmod(np.flatnonzero(hit), max(1, hit.shape[1]))


def positions(points: DataFrame, metric: str) -> DataFrame:
    """The points; a null or NaN cell raises an error that names its row, an unknown metric a ValueError."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose from {METRICS}")
    return points.withColumn("features", complete(F.col("features"), F.col("point_id")))


def located(x: np.ndarray, metric: str) -> np.ndarray:
    """Rows as vectors in which the metric is l1 or Euclidean.

    Cosine distance of two rows is half the squared Euclidean distance of their
    directions.  A row of zeros has no direction and gets one of its own, at cosine
    distance 1 from all others.
    """
    if metric != "cosine":
        return x
    norm = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:]) if x.shape[1] else np.zeros((len(x), 1))
    real = norm > 0
    with np.errstate(invalid="ignore", over="ignore"):
        return np.hstack([np.where(real, x / np.where(real, norm, 1.0), 0.0), np.where(real, 0.0, 1.0)])


def radius_in(metric: str, radius: float) -> float:
    """A radius of the metric as a distance between :func:`positions`."""
    return math.sqrt(2.0 * radius) if metric == "cosine" else radius


@dataclass
class Cells:
    """Points, pivots, radii and sizes of their cells, and the written blocks of the points.

    A row of ``blocks`` is a block of points of one cell: ``block``, ``cell``, ``vectors``
    (the rows as they came, see :func:`located`) and an array for each other column.
    """

    points: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    size: np.ndarray
    metric: str
    #: Whole rows of the pivots.
    rows: list
    blocks: DataFrame
    #: Numbers in a row of ``vectors``, bytes of all of them, and partitions in which the blocks are read.
    width: int
    bytes: int
    parts: int

    @property
    def slack(self) -> float:
        return SLACK * (1.0 + float(np.abs(self.pivots).max(initial=0.0)) * max(1, self.pivots.shape[1]))

    @property
    def names(self) -> list[str]:
        return [c for c in self.blocks.columns if c not in ("block", "cell", "vectors")]

    def spots(self) -> DataFrame:
        """A row for each point that has an id, with its block, its place there and its columns."""
        zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in self.names])
        return self.blocks.select("block", F.posexplode(zipped).alias("place", "_c")).select(
            "block", "place", *[F.col("_c").getField(c).alias(c) for c in self.names])

    def told(self, values: DataFrame, **columns: Column) -> Cells:
        """The blocks with more columns, from ``values`` by ``point_id`` (points without a row there get nulls).

        Only ids and values are dealt anew and written; the vectors are joined by the
        number of their block where they are read.
        """
        once = values.groupBy("point_id").agg(*[F.min(c).alias(c) for c in values.columns if c != "point_id"])
        known = self.spots().select("block", "place", "point_id").join(once, "point_id", "left")
        each = F.struct("place", *[c.alias(n) for n, c in columns.items()])
        listed = known.groupBy("block").agg(F.array_sort(F.collect_list(each)).alias("_l"))
        more = cut_lineage(listed.select("block", *[F.col("_l").getField(n).alias(n) for n in columns]))
        return replace(self, blocks=self.blocks.drop(*columns).join(more, "block"))


def make_cells(
    points: DataFrame, metric: str = "euclidean", block_rows: int = BLOCK_ROWS, near: int | None = None
) -> Cells:
    """Place every point in the cell of its nearest pivot.

    Pivots are the points with the smallest id hashes, about one for each block of
    points, bounded in number and bytes.  ``points`` are read several times and
    written once, as blocks.  With ``near`` the blocks tell ``bound``, see :func:`pack`.
    """
    whole = positions(points, metric)
    n = points.count()
    first = whole.select(F.size("features")).first()
    width = first[0] if first else 0
    most = max(1, min(MOST_PIVOTS, PIVOT_BYTES // (8 * max(1, width + (metric == "cosine")))))
    wanted = min(most, max(1, math.ceil(n / block_rows)))
    kind = points.schema["point_id"].dataType.simpleString()
    chosen = whole.withColumn("_h", hash_id(F.col("point_id"), kind)).orderBy(
        "_h", "point_id").limit(wanted).collect()  # at most PIVOT_BYTES
    pivots = located(np.array([r["features"] for r in chosen], float).reshape(len(chosen), width), metric)
    return pack(whole, pivots, metric, block_rows, n, width, chosen, near=near)


def _with(table: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*table.schema.fields, *(T.StructField(n, t) for n, t in more.items())])


def _matrix(batch: pa.RecordBatch, column: str, width: int) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column)).flatten()
    return values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def within(radius: float | None = None) -> Opens:
    """Cells that can hold a point within the radius (or within each visitor's own)."""

    def opens(found, own, radii, mine):
        r = mine[:, None] if radius is None else radius
        # Members of another cell are nearer to its pivot than to this point's.
        return (found <= radii[None, :] + r) & (found - own[:, None] <= 2 * r)

    return opens


def beyond(distance: float) -> Opens:
    """Cells that can hold a point farther away than the distance."""
    return lambda found, own, radii, mine: found + radii[None, :] >= distance


def _asks(cells: Cells, opens: Opens) -> Callable[[Block, np.ndarray], np.ndarray]:
    """(block, own radii) -> opened cells, a row for each point."""
    pivots, radii, slack, metric = cells.pivots, cells.radius + cells.slack, cells.slack, cells.metric

    def ask(x: Block, mine: np.ndarray) -> np.ndarray:
        found = gaps(x.vectors, pivots, metric) if len(x) else np.zeros((0, len(pivots)))
        return opens(found, found[:, x.cell], radii, mine + slack)

    return ask


def _reader(cells: Cells) -> Callable[..., Block]:
    """(batch, row, prefix of the columns, column of the points that count) -> block."""
    names, width, metric = cells.names, cells.width, cells.metric

    def read(batch: pa.RecordBatch, row: int, side: str = "", who: str | None = None) -> Block:
        at = lambda c: batch.column(batch.schema.get_field_index(f"{side}{c}"))
        # Copies, as a view of one value would keep its whole batch.
        columns = {c: at(c)[row].values.to_numpy(zero_copy_only=False).copy() for c in names}
        data = located(_unpacked(at("vectors")[row].as_buffer(), len(columns["point_id"]), width), metric)
        if who:
            own = columns[who].astype(bool)
            data, columns = data[own], {c: v[own] for c, v in columns.items()}
        return Block(at("block")[row].as_py(), at("cell")[row].as_py(), data, columns)

    return read


def _radii(x: Block, radius: str | None) -> np.ndarray:
    """What a radius names for each point: its cell, one of its columns, or nothing."""
    if radius == "cell":
        return np.full(len(x), float(x.cell))
    return x[radius].astype(float) if radius else np.zeros(len(x))


def visitors(cells: Cells, opens: Opens, who: str | None = None, radius: str | None = None) -> DataFrame:
    """``(point_id, opened)``: the cells that a point's bounds leave open."""
    ask, read = _asks(cells, opens), _reader(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x = read(batch, row, "", who)
                point, cell = np.nonzero(ask(x, _radii(x, radius)))
                ends = np.searchsorted(point, np.arange(len(x) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["point_id"]), pa.ListArray.from_arrays(pa.array(ends), pa.array(cell.astype(np.int32)))],
                    names=["point_id", "opened"])

    kind = cells.points.schema["point_id"].dataType.simpleString()
    return cells.blocks.mapInArrow(run, f"point_id {kind}, opened array<int>")


@dataclass
class Block:
    """Points of one cell: vectors and their other columns."""

    key: int
    cell: int
    vectors: np.ndarray
    columns: dict[str, np.ndarray]
    open: np.ndarray | None = None  # of visitors: the cells that each point opens

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __len__(self) -> int:
        return len(self.vectors)


#: A block of visitors, and the blocks of homes that it meets with the visitors that opened each.
Groups = Iterator[tuple[Block, Iterator[tuple[Block, np.ndarray]]]]


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: of single precision where that holds them exactly, else of double."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [(short[i] if exact[i] else x[i]).tobytes() for i in range(len(x))]


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    """The rows in the bytes, all of one precision."""
    kind = np.float32 if len(data) == 4 * rows * width else np.float64
    return np.frombuffer(data, kind).reshape(rows, width).astype(np.float64)


def _joined(rows: list[bytes], width: int) -> bytes:
    """Packed rows one after the other, of one precision."""
    if len({len(r) for r in rows}) > 1:
        rows = [_unpacked(r, 1, width).tobytes() for r in rows]
    return b"".join(rows)


def pack(
    whole: DataFrame, pivots: np.ndarray, metric: str, block_rows: int, n: int, width: int, rows: list,
    radius: np.ndarray | None = None, near: int | None = None,
) -> Cells:
    """Write the points as blocks, each of points of one cell: the nearest pivot's, or that of ``cell``.

    Points are dealt by (cell, id hash) once.  A row of the table holds a whole block
    of at most ``block_rows`` points and ``BLOCK_BYTES`` of vectors.  With ``near``, the
    column ``bound`` tells for each point a distance that holds so many other points:
    those of its cell in its file.  Radii, unless given, are the largest distances to the pivots.
    """
    kind = whole.schema["point_id"].dataType.simpleString()
    placed = "cell" in whole.columns
    held = [f for f in whole.schema.fields if f.name not in ("features", "cell")]
    names = [f.name for f in held]
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(1, width))))
    files = max(1, math.ceil(n / (FILE_BLOCKS * most)), min(math.ceil(n / most), parallelism(whole.sparkSession)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "features", width)
            if placed:
                cell = batch.column(batch.schema.get_field_index("cell"))
            else:
                cell = pa.array((gaps(located(x, metric), pivots, metric).argmin(axis=1) if len(x)
                                 else np.zeros(0, int)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in names], cell, pa.array(_packed(x), pa.binary())],
                names=[*names, "cell", "vectors"])

    # Points without an id meet nobody, but theirs must be whole vectors too.
    cut = whole.mapInArrow(place, T.StructType([
        *held, T.StructField("cell", T.IntegerType()), T.StructField("vectors", T.BinaryType())]))
    order = F.col("cell"), hash_id(F.col("point_id"), kind)
    dealt = cut.where(F.col("point_id").isNotNull()).repartitionByRange(files, *order).sortWithinPartitions(*order)

    def bounds(x: np.ndarray, ids: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
        out = np.full(len(x), np.inf)
        for low, high in parts:
            if high - low > near:
                for a, b in parts:
                    found = gaps(x[a:b], x[low:high], metric)
                    found[ids[a:b, None] == ids[None, low:high]] = np.inf
                    least = np.partition(found, near - 1, axis=1)[:, near - 1]
                    if metric != "l1":
                        # Products cancel: near 0 the true distance can be the root of their rounding.
                        size = np.sqrt(((x[low:high] - x[a:b].mean(axis=0)) ** 2).sum(axis=1).max()) + np.sqrt(
                            ((x[a:b] - x[a:b].mean(axis=0)) ** 2).sum(axis=1).max())
                        least = np.sqrt(least * least + (x.shape[1] + 16) * np.finfo(float).eps * size * size)
                    out[a:b] = np.minimum(out[a:b], least)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)  # about FILE_BLOCKS blocks
        if not table.num_rows:
            return
        table = table.combine_chunks().to_batches()[0]
        at = table.schema.get_field_index
        cell = table.column(at("cell")).to_numpy()
        data = table.column(at("vectors")).to_pylist()
        ids = table.column(at("point_id")).to_numpy(zero_copy_only=False)
        number = TaskContext.get().partitionId() << 32
        edges = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        for start, end in zip(edges, edges[1:]):
            cuts = np.linspace(start, end, math.ceil((end - start) / most) + 1).astype(int).tolist()
            parts = list(zip(cuts, cuts[1:]))
            x = located(np.concatenate([_unpacked(d, 1, width) for d in data[start:end]]), metric)
            reach = gaps(x, pivots[cell[start]][None, :], metric)[:, 0]
            bound = bounds(x, ids[start:end], [(a - start, b - start) for a, b in parts]) if near else None
            for low, high in parts:
                own = slice(low - start, high - start)
                out = {"block": pa.array([number], pa.int64()), "cell": pa.array([cell[low]], pa.int32()),
                       "vectors": pa.array([_joined(data[low:high], width)], pa.binary()),
                       "_far": pa.array([float(reach[own].max())])}
                for c in names:
                    out[c] = pa.ListArray.from_arrays(
                        pa.array([0, high - low], pa.int32()), table.column(at(c)).slice(low, high - low))
                if near:
                    out["bound"] = pa.array([bound[own]], pa.list_(pa.float64()))
                number += 1
                yield pa.RecordBatch.from_pydict(out)

    fields = [T.StructField("block", T.LongType()), T.StructField("cell", T.IntegerType()),
              T.StructField("vectors", T.BinaryType()), T.StructField("_far", T.DoubleType()),
              *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in held)]
    if near:
        fields.append(T.StructField("bound", T.ArrayType(T.DoubleType())))
    written = cut_lineage(dealt.mapInArrow(run, T.StructType(fields)))
    far, size, total = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64), 0
    for c, reach, count, data in written.groupBy("cell").agg(
        F.max("_far"), F.sum(F.size("point_id")), F.sum(F.octet_length("vectors"))).collect():
        far[c], size[c], total = reach, count, total + data  # a row for each pivot
    return Cells(whole, pivots, far if radius is None else radius, size, metric, rows,
                 written.drop("_far"), width, total, written.rdd.getNumPartitions())


def meet(
    cells: Cells,
    fold: Callable[[Groups], Iterator[dict[str, np.ndarray]]],
    schema: str,
    opens: Opens,
    homes: str | None = None,
    guests: str | None = None,
    radius: str | None = None,
    once: bool = False,
) -> DataFrame:
    """Let every block of visitors meet the blocks of the cells that its points open.

    A point meets each member of the cells it opens exactly once as a visitor, its
    own cell and itself included if it opens that; with ``once``, a pair of blocks
    meets in one order only.  ``homes`` and ``guests`` name boolean columns that restrict
    the two roles.  ``fold`` gets, in each task, blocks of visitors one after the other,
    each with the homes it meets there, and yields what it has summed up.

    The blocks are paired by a nested loop over partitions of their files, so tasks
    read them again instead of a shuffle copying each to all its partners, and nothing
    is written.  Homes are read in few partitions of up to ``HOME_BYTES``, which a task
    holds one after the other, so what is told of a visitor can be added up in its task
    before it is shuffled, however many points there are.
    """
    names, ask, read = cells.names, _asks(cells, opens), _reader(cells)
    columns = ["block", "cell", "vectors", *names]
    some = lambda who: F.lit(True) if who is None else F.exists(F.col(who), lambda c: c)

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                x = read(batch, row, "", guests)
                found.append(np.flatnonzero(ask(x, _radii(x, radius)).any(axis=0)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "opened"])

    calls = cells.blocks.select(*columns).where(some(guests))
    calls = calls.mapInArrow(call, _with(calls, opened=T.ArrayType(T.IntegerType())))
    left = calls.select(*[F.col(f"`{c}`").alias(f"x_{c}") for c in [*columns, "opened"]])
    few = max(1, math.ceil(cells.bytes / HOME_BYTES))
    right = cells.blocks.where(some(homes)).select(*[F.col(f"`{c}`").alias(f"y_{c}") for c in columns]).coalesce(few)
    meets = F.array_contains("x_opened", F.col("y_cell"))
    if once:
        # By parity, so that every block has about half of the others.
        x, y = F.col("x_block"), F.col("y_block")
        meets &= (x == y) | ((x != y) & ((x < y) == ((x + y) % 2 == 0)))
    # The hint keeps small tables from one task, too: the loop is heavy in CPU, not in bytes.
    met = left.join(right.hint("shuffle_replicate_nl"), meets).drop("x_opened")
    if few > 1:
        # The loop's partitions are in order of visitors: this puts those of the same visitors together.
        met = met.coalesce(cells.parts)
    shape = T.StructType.fromDDL(schema)
    told = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((int(key), batch, row) for batch in batches
                 for row, key in enumerate(batch.column(batch.schema.get_field_index("x_block")).to_numpy()))

        def groups() -> Groups:
            for _, own in groupby(pairs, key=lambda p: p[0]):
                _, batch, row = next(own)
                x, first = read(batch, row, "x_", guests), read(batch, row, "y_", homes)
                x.open = ask(x, _radii(x, radius))
                # Batches that the visitors' homes are past are let go.
                del batch

                def ys(x=x, own=own, first=first):
                    yield first, np.flatnonzero(x.open[:, first.cell])
                    for _, batch, row in own:
                        y = read(batch, row, "y_", homes)
                        yield y, np.flatnonzero(x.open[:, y.cell])

                yield x, ys()

        for found in fold(groups()):
            if len(found[told.names[0]]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[f.name], type=f.type) for f in told], schema=told)

    return met.mapInArrow(run, shape)


def taken(x: Block, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows of a block, itself if of all."""
    return x.vectors if len(rows) == len(x) else x.vectors[rows]


def neighbours(points: DataFrame, k: int, metric: str = "euclidean", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other points of every point: ``(point_id, rank, other, distance)``.

    The k-th distance inside a block of the own cell bounds each point's search;
    then only cells within that bound are opened.  Equal distances are ranked by
    id; fewer than k other points give fewer rows.
    """
    return nearest_in(make_cells(points.select("point_id", "features"), metric, block_rows, near=k), k)


def nearest_in(cells: Cells, k: int) -> DataFrame:
    """:func:`neighbours` of points in cells that were made with ``near=k``."""
    kind, metric = cells.points.schema["point_id"].dataType.simpleString(), cells.metric

    def all_near(x: Block, rows: np.ndarray, y: Block, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(rows, homes, distances) within the bounds, by the sum of absolute differences."""
        found = gaps(taken(x, rows), y.vectors, metric)
        found[x["point_id"][rows][:, None] == y["point_id"][None, :]] = np.inf
        hit = found <= last[rows][:, None]
        if hit.sum() > 4 * k * len(rows) and len(y) > k:
            hit &= found <= np.partition(found, k - 1, axis=1)[:, k - 1][:, None]
        hit &= np.isfinite(found)
        i, j = pairs_in(hit)
        return rows[i], j, found[i, j]

    def screened(x: Block, screen: Screen, rows: np.ndarray, y: Block, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for Euclidean distances."""
        found, error = screen.squares(rows, y.vectors)
        with np.errstate(over="ignore"):
            limits = screen.limits(rows, last[rows], error).astype(found.dtype)
        hit = found <= limits[:, None]
        if np.count_nonzero(hit) > 4 * k * len(rows) and len(y) > k:
            found[x["point_id"][rows][:, None] == y["point_id"][None, :]] = np.inf
            hit &= found <= np.partition(found, k - 1, axis=1)[:, k - 1][:, None] + 4 * error
        i, j = pairs_in(hit)
        i = rows[i]
        other = x["point_id"][i] != y["point_id"][j]
        i, j = i[other], j[other]
        gap = np.concatenate([np.zeros(0), *(
            lengths(x.vectors[i[s : s + NEAR_PAIRS]], y.vectors[j[s : s + NEAR_PAIRS]])
            for s in range(0, len(i), NEAR_PAIRS))])
        hit = (gap <= last[i]) & np.isfinite(gap)
        return i[hit], j[hit], gap[hit]

    def nearest(groups):
        for x, ys in groups:
            # The k nearest so far in this task, in order of row, distance and id; then what came since.
            row, gap, other = np.zeros(0, int), np.zeros(0), x["point_id"][:0]
            rest, count = [], 0
            last = x["bound"].astype(float) * (1 + SLACK) + SLACK
            screen = None if metric == "l1" else Screen(x.vectors)
            for y, rows in chain(ys, [(None, None)]):
                if y is not None and len(rows):
                    i, j, found = all_near(x, rows, y, last) if screen is None else screened(x, screen, rows, y, last)
                    if len(i):
                        rest.append((i, found, y["point_id"][j]))
                        count += len(i)
                if count < k * len(x) and (y is not None or not count):
                    continue
                row, gap, other = (np.concatenate([a, *b]) for a, b in zip((row, gap, other), zip(*rest)))
                order = np.lexsort((other, gap, row))
                row, gap, other = row[order], gap[order], other[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                full = place == k - 1
                last[row[full]] = np.minimum(last[row[full]], gap[full])
                row, gap, other = row[place < k], gap[place < k], other[place < k]
                rest, count = [], 0
            yield {"point_id": x["point_id"][row], "other": other, "distance": gap}

    found = meet(cells, nearest, f"point_id {kind}, other {kind}, distance double", within(), radius="bound")
    # Each task gives a point at most k rows.
    rank = F.row_number().over(W.partitionBy("point_id").orderBy("distance", "other"))
    gap = F.col("distance") * F.col("distance") / 2.0 if metric == "cosine" else F.col("distance")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("point_id", "rank", "other", gap.alias("distance"))
