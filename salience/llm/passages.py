"""Passages repeated within and across documents, found by chaining shared seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.words import Words, blocks, spare, windows
from salience.session import cut_lineage

#: Words in a seed, and seeds among which the smallest is taken: a common run of
#: SEED + WINDOW - 1 words has a common seed.
SEED, WINDOW = 6, 16
#: Matches on one diagonal this close make one block.
CLOSE = 32
#: Cost of each word between chained blocks, on either side.
GAP_COST = 0.25
#: An extension ends when its score (match 1, mismatch -2) falls so far below its best.
DROP = 10
#: Words on either side of a pair's outermost seeds that are fetched at first.
MARGIN = 64
#: Bytes of the text's key before its words.
KEY = 8
#: Rows without an id are numbered from here down.
NO_ID = -(2**62)


def seeds(grams: np.ndarray) -> np.ndarray:
    """Positions that are the smallest of some ``WINDOW`` neighbours (or of all, if fewer)."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= WINDOW:
        return np.flatnonzero(grams == grams.min())
    low, width = grams, 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    # A position is chosen if the largest minimum of the windows over it is its own value.
    pad = np.zeros(WINDOW - 1, low.dtype)
    high, width = np.concatenate([pad, low, pad]), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        high = np.maximum(high[: len(high) - step], high[step:])
        width += step
    return np.flatnonzero(high == grams)


def _scan(docs: DataFrame) -> DataFrame:
    """Each text's key and words as 16-bit hashes in one binary, and its seeds with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                words = Words(block.column(2))
                hashes = words.hashes(lower=True)
                grams, at = windows(hashes, words.doc, SEED)
                cuts = np.searchsorted(at, words.first)
                short = (hashes >> np.uint64(48)).astype("<u2")
                places = []
                for row in range(words.n):
                    own = seeds(grams[cuts[row] : cuts[row + 1]])
                    places.append((own, grams[cuts[row] + own].view(np.int64)))
                ends = np.concatenate([[0], np.cumsum([len(p) for p, _ in places])])
                ends = pa.array(ends.astype(np.int32))
                keys = block.column(1).to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), block.column(1),
                     pa.array([k.tobytes() + short[a:b].tobytes() for k, a, b in zip(
                         keys, words.first[:-1], words.first[1:], strict=True)], pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s for _, s in places]))),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p for p, _ in places]).astype(np.int32)))],
                    names=["uid", "text_key", "words", "seeds", "places"],
                )

    return docs.mapInArrow(
        run, "uid long, text_key long, words binary, seeds array<long>, places array<int>"
    )


def merge_diagonals(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Blocks (start, end, start in the leader) of matches on one diagonal and close by."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    breaks = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(p) > CLOSE)) + 1
    first = np.concatenate([[0], breaks])
    last = np.concatenate([breaks, [len(p)]]) - 1
    made = np.stack([p[first], p[last] + SEED, q[first]], axis=1)
    return made[np.argsort(made[:, 0], kind="stable")]


def chains(made: np.ndarray) -> list[list[int]]:
    """Best chains of blocks that ascend on both sides, the best first, each block once.

    A chain's score is its blocks' words less ``GAP_COST`` for each word between
    them.  That cost is a difference of ends, so the best block to chain to is a
    prefix maximum over the leader's positions, which a Fenwick tree keeps while
    blocks enter in the order of their ends.
    """
    n = len(made)
    start, end, lead = made.T
    lead_end = lead + end - start
    slots = np.unique(lead_end)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(slots) + 1)
    slot_of = (np.searchsorted(slots, lead_end) + 1).tolist()
    upto = np.searchsorted(slots, lead, side="right").tolist()
    score, back = [0.0] * n, [-1] * n
    waiting, entered = np.argsort(end, kind="stable").tolist(), 0
    for j in range(n):  # blocks are in the order of their starts
        while entered < n and end[waiting[entered]] <= start[j]:
            i = waiting[entered]
            entered += 1
            value, at = score[i] + GAP_COST * float(end[i] + lead_end[i]), slot_of[i]
            while at < len(tree):
                if tree[at][0] < value or tree[at][1] < 0:
                    tree[at] = (value, i)
                at += at & -at
        best, at = (0.0, -1), upto[j]
        while at:
            if tree[at][1] >= 0 and (best[1] < 0 or tree[at][0] > best[0]):
                best = tree[at]
            at -= at & -at
        score[j] = float(end[j] - start[j])
        gain = best[0] - GAP_COST * float(start[j] + lead[j])
        if best[1] >= 0 and gain > 0:
            score[j], back[j] = score[j] + gain, best[1]
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda k: (-score[k], k)):
        path = []
        while j >= 0 and not used[j]:
            used[j] = True
            path.append(j)
            j = back[j]
        if path:
            out.append(path[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest common subsequence (bit-parallel over b)."""
    if not len(a) or not len(b):
        return 0
    where: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


class Cut(Exception):
    """An extension met the end of a slice that is not the end of the text."""


def _extend(a: np.ndarray, b: np.ndarray, a_cut: bool = False, b_cut: bool = False) -> tuple[int, int]:
    """How far equal words go on from the start of both, and how many are equal.

    Raises Cut if the answer may depend on words behind a cut end.
    """
    n, size = min(len(a), len(b)), 64
    while True:
        size = min(n, 4 * size)
        equal = a[:size] == b[:size]
        score = np.cumsum(np.where(equal, 1, -2))
        fallen = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
        if len(fallen) or size == n:
            score = score[: fallen[0]] if len(fallen) else score
            break
    if not len(fallen) and (a_cut and len(a) == n or b_cut and len(b) == n):
        raise Cut
    if not len(score) or score.max() <= 0:
        return 0, 0
    far = int(score.argmax()) + 1
    return far, int(equal[:far].sum())


def equal_words(a: np.ndarray, b: np.ndarray, path: np.ndarray) -> list[int]:
    """Equal words of each block of a chain (even places) and of the gap after it (odd places)."""
    out: list[int] = []
    for k, (s, e, q) in enumerate(path.tolist()):
        if k:
            x, y = a[path[k - 1, 1] : s], b[path[k - 1, 2] + path[k - 1, 1] - path[k - 1, 0] : q]
            straight = int((x == y).sum()) if len(x) == len(y) else 0
            out.append(straight if straight == len(x) else _common(x, y))
        out.append(int((a[s:e] == b[q : q + e - s]).sum()))
    return out


def align(
    a: np.ndarray, b: np.ndarray, path: np.ndarray, same: int, cut: tuple[bool, bool, bool, bool] = (False,) * 4
) -> tuple[int, int, int, int, int]:
    """Ends of a chain's alignment in a and in b, after extension, and its equal words.

    ``cut`` tells of the start of a, of b, the end of a, of b whether the text goes on there.
    """
    (start, _, lead), (last, end, q) = path[0].tolist(), path[-1].tolist()
    lead_end = q + end - last
    left, more = _extend(a[:start][::-1], b[:lead][::-1], *cut[:2])
    right, yet = _extend(a[end:], b[lead_end:], *cut[2:])
    return start - left, end + right, lead - left, lead_end + right, same + more + yet


def halves(a: np.ndarray, b: np.ndarray, path: np.ndarray, same: list[int]) -> list[tuple[np.ndarray, list[int]]]:
    """A chain cut at its costliest gap, or a block at its longest run of unequal words."""
    if len(path) > 1:
        between = path[1:, 0] - path[:-1, 1] + path[1:, 2] - (path[:-1, 2] + path[:-1, 1] - path[:-1, 0])
        k = int(between.argmax()) + 1
        return [(path[:k], same[: 2 * k - 1]), (path[k:], same[2 * k :])]
    s, e, q = path[0].tolist()
    equal = np.flatnonzero(a[s:e] == b[q : q + e - s])
    if len(equal) < 2 or (np.diff(equal) == 1).all():
        return []
    k = int(np.diff(equal).argmax())
    cut = [(s, s + equal[k] + 1, q), (s + equal[k + 1], e, q + equal[k + 1])]
    return [(np.array([x]), [n]) for x, n in zip(cut, (k + 1, len(equal) - k - 1), strict=True)]


def repeats_of(
    a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, min_words: int, identity: float,
    cut: tuple[bool, bool, bool, bool] = (False,) * 4,
) -> list[tuple[int, int, int, int, int]]:
    """Aligned passages of ``min_words`` or more, from the seeds that a and b share."""
    fit = (p + SEED <= len(a)) & (q + SEED <= len(b))
    if not fit.any():
        return []
    made = merge_diagonals(p[fit], q[fit])
    out: list[tuple[int, int, int, int, int]] = []

    def long_and_equal(found: tuple[int, int, int, int, int]) -> bool:
        length = max(found[1] - found[0], found[3] - found[2])
        return length >= min_words and found[4] >= identity * length

    for path in chains(made):
        inside = [k for k in path if not any(
            f[0] <= made[k, 0] and made[k, 1] <= f[1] for f in out)]
        if not inside:
            continue
        parts = [(made[inside], equal_words(a, b, made[inside]))]
        while parts:  # a part that fails is cut until its parts pass or have no gap
            part, same = parts.pop()
            found = align(a, b, part, sum(same), cut)
            if not long_and_equal(found):
                parts += halves(a, b, part, same)[::-1]
            elif found not in out:
                out.append(found)
    return out


def _leaders(rows: DataFrame, key: str, place: list[str]) -> DataFrame:
    """The first occurrence of each key that occurs more than once.

    Written first, so that both sides of the join with it are plain shuffles, of
    which a hot key's partition is split.
    """
    return cut_lineage(rows.groupBy(key).agg(
        F.min(F.struct("uid", *place)).alias("lead"), F.count("*").alias("n")
    ).where("n > 1").select(
        key, F.col("lead.uid").alias("lead"), *(F.col(f"lead.{c}").alias(c.replace("p", "q")) for c in place)))


def _matches(table: DataFrame) -> DataFrame:
    """For each row and each leader that it shares seeds with, the places on both sides.

    A seed leads to its first occurrence.  Where two neighbouring seeds lead to
    different places, the pair leads to the first place that has them as neighbours
    too, so a passage whose parts occurred in different texts meets an earlier text
    that holds it whole.  Pairs whose seeds lead to one place would lead there again.
    """
    one = table.select(
        "uid", F.shiftright("text_key", 32).cast("int").alias("tag"),
        F.explode(F.arrays_zip(F.col("seeds").alias("s"), F.col("places").alias("p"))).alias("e")
    ).select(F.col("e.s").alias("seed"), "uid", "tag", F.col("e.p").alias("p"))
    met = cut_lineage(one.join(_leaders(one, "seed", ["p"]).hint("merge"), "seed").groupBy("uid", "tag").agg(
        F.array_sort(F.collect_set(F.struct("p", "lead", "q"))).alias("met")))
    # A seed is told by the place that it leads to.
    pairs = met.select("uid", F.explode(F.expr(
        "filter(transform(slice(met, 2, greatest(size(met) - 1, 0)), (y, k) -> struct(met[k] as x, y as y)), "
        "e -> e.x.lead <> e.y.lead or e.y.q - e.x.q <> e.y.p - e.x.p)")).alias("e")).select(
        F.xxhash64("e.x.lead", "e.x.q", "e.y.lead", "e.y.q").alias("pair"), "uid",
        F.col("e.x.p").alias("p1"), F.col("e.y.p").alias("p2"))
    joint = pairs.join(_leaders(pairs, "pair", ["p1", "p2"]).hint("merge"), "pair").where(
        "uid <> lead OR p1 <> q1").select("uid", "lead", F.explode(F.array(
            F.struct(F.col("p1").alias("p"), F.col("q1").alias("q")),
            F.struct(F.col("p2").alias("p"), F.col("q2").alias("q")))).alias("at"))
    single = met.select("uid", F.explode("met").alias("e")).where(
        "uid <> e.lead OR e.p <> e.q").select("uid", "e.lead", F.struct("e.p", "e.q").alias("at"))
    return single.unionByName(joint).groupBy("uid", "lead").agg(F.collect_set("at").alias("seeds"))


def _aligned(
    pairs: DataFrame, table: DataFrame, min_words: int, identity: float, margin: int | None
) -> DataFrame:
    """The passages of pairs (uid, lead, seeds); both joins read one exchange of the words.

    Of both texts only the words from ``margin`` before the first to ``margin``
    behind the last shared seed are shipped (all without a margin).  A pair whose
    extension would go on behind such an end gives a row without places that
    keeps the seeds, so that it can be aligned with whole texts.
    """
    schema = ("uid long, text_key long, start_word int, end_word int, lead long, lead_start int, "
              "lead_end int, n_equal int, seeds array<struct<p:int,q:int>>")
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.int32()] * 3,
             pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in range(batch.num_rows):
                uid, lead, key, a_from, b_from, a_size, b_size = (
                    batch.column(c)[row].as_py() for c in range(7))
                key = int.from_bytes(key, "little", signed=True)
                a, b = (np.frombuffer(batch.column(c)[row].as_buffer(), "<u2") for c in (7, 8))
                p, q = (x.to_numpy().astype(np.int64) for x in batch.column(9)[row].values.flatten())
                cut = (a_from > 0, b_from > 0, a_from + len(a) < a_size, b_from + len(b) < b_size)
                try:
                    for s, e, u, v, n in repeats_of(a, b, p - a_from, q - b_from, min_words, identity, cut):
                        out.append((uid, key, s + a_from, e + a_from, lead, u + b_from, v + b_from, n, None))
                except Cut:
                    while out and out[-1][:2] == (uid, key) and out[-1][4] == lead:
                        out.pop()
                    out.append((uid, key, None, None, lead, None, None, None, batch.column(9)[row].as_py()))
            columns = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                names=["uid", "text_key", "start_word", "end_word", "lead", "lead_start", "lead_end",
                       "n_equal", "seeds"])

    def part(side: str, first: str) -> list:
        """Words of the text from a place on, the place, and the size of the whole."""
        length = F.expr(f"(octet_length(words) - {KEY}) div 2").cast("int")
        if margin is None:
            at, to = F.lit(0), length
        else:
            at = F.greatest(F.array_min(f"seeds.{first}") - margin, F.lit(0))
            to = F.least(F.array_max(f"seeds.{first}") + SEED + margin, length)
        to = F.greatest(to, at)
        return [F.substring("words", KEY + 1 + 2 * at, 2 * (to - at)).alias(side),
                at.alias(f"{side}_from"), length.alias(f"{side}_size")]

    words = table.select("uid", "words")
    # The same joins at every size: no side is bounded.
    led = pairs.alias("pair").hint("merge").join(
        words.alias("text"), F.col("pair.lead") == F.col("text.uid")
    ).select("pair.uid", "lead", "seeds", *part("b", "q"))
    told = led.hint("merge").join(words, "uid").select(
        "uid", "lead", "seeds", "b", "b_from", "b_size",
        F.substring("words", 1, KEY).alias("key"), *part("a", "p"))
    return told.select("uid", "lead", "key", "a_from", "b_from", "a_size", "b_size", "a", "b", "seeds"
                       ).mapInArrow(run, schema)


def repeated_passages(
    docs: DataFrame, min_words: int = 50, identity: float = 0.8, text: str = "text"
) -> DataFrame:
    """Passages of ``min_words`` words or more that an earlier text has too.

    Sparse seeds of six words are joined to their first occurrence (smallest
    doc_id, then place), the leader, and neighbouring seeds with different leaders
    to the first occurrence of both together, never all to each other.  Matches of a document
    with a leader are merged along diagonals, chained in ascending order with gap
    costs, and each chain is aligned word by word and extended at its ends, so
    passages with changed, added or missing words are found.  Pairs are aligned on
    the part of their texts around their seeds; the few whose extension reaches
    the end of such a part are aligned again on whole texts.  Case of A-Z is
    ignored.

    Gives a row for each passage: doc_id, text_key (xxhash64 of the text),
    start_word, end_word, lead_doc_id, lead_start, lead_end, n_equal.  A passage
    of a whole copy is the whole text.  Repeats within one text count, with the
    first place as the leader.  Rows with one doc_id and one text are one
    document; with one doc_id and several texts each is aligned by itself.  Null
    or wordless texts have no passages; a row without id keeps a null doc_id.  No
    rows give no rows; other columns are not read.
    """
    table = cut_lineage(_scan(docs.where(F.col(text).isNotNull()).select(
        F.coalesce(
            F.col("doc_id").cast("long"),
            F.lit(NO_ID) - F.shiftrightunsigned(F.xxhash64(text), 2),
        ).alias("uid"),
        F.xxhash64(text).alias("text_key"), F.col(text).alias("text"),
    )))
    near = cut_lineage(_aligned(_matches(table), table, min_words, identity, MARGIN))
    rest = near.where("start_word IS NULL").select("uid", "lead", "seeds").distinct()
    found = near.where("start_word IS NOT NULL").unionByName(
        _aligned(rest, table, min_words, identity, None))
    real = lambda c: F.when(F.col(c) > NO_ID, F.col(c))
    return found.select(
        real("uid").alias("doc_id"), "text_key", "start_word", "end_word",
        real("lead").alias("lead_doc_id"), "lead_start", "lead_end", "n_equal",
    ).distinct()


def without_repeats(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the words of their passages cut out; all columns are kept.

    A row of which no word is left goes.  Rows without passages, null and wordless
    texts included, stay as they are.
    """
    cut, key, number, other, other_key = spare(docs.columns, "spans", "key", "id", "doc", "text")
    spans = passages.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias(cut)
    )
    keyed = docs.withColumns({key: F.xxhash64(text), number: F.col("doc_id").cast("long")})
    joined = keyed.join(
        spans.select(F.col("doc_id").alias(other), F.col("text_key").alias(other_key), cut).hint("merge"),
        F.col(number).eqNullSafe(F.col(other)) & (F.col(key) == F.col(other_key)), "left",
    ).drop(other, other_key, key, number)
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for block in blocks(batch, text):
                texts, keep = [], []
                scanned = Words(block.column(at))
                for row, spans in enumerate(block.column(len(names)).to_pylist()):
                    if not spans:
                        texts.append(block.column(at)[row].as_py())
                        keep.append(True)
                        continue
                    first, last = scanned.first[row], scanned.first[row + 1]
                    rest = np.ones(last - first, bool)
                    for span in spans:
                        rest[span["start_word"] : span["end_word"]] = False
                    opens = scanned.start[first:last]
                    closes = np.append(opens[1:], scanned.offsets[row + 1])
                    data = scanned.data
                    head = data[scanned.offsets[row] : opens[0]].tobytes() if rest[0] else b""
                    texts.append((head + b"".join(
                        data[opens[k] : closes[k]].tobytes() for k in np.flatnonzero(rest)
                    )).decode())
                    keep.append(bool(rest.any()))
                columns = [
                    pa.array(texts, block.column(at).type) if k == at else block.column(k)
                    for k in range(len(names))
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.select(*[f"`{c}`" for c in names], cut).mapInArrow(run, schema)
