"""Mixing, ranked search and spelling variants against brute force."""

import collections
import math
import random
import re
import zlib

import pytest

from salience.llm import mixing, search, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Columns named as what the operators make.
SCHEMA = "doc_id long, text string, source string, size long, key string, n long, word string, terms string, m int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "k", 1, "w", "t", 2) for i, t, s in rows], SCHEMA)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{int(vocabulary * rng.random() ** 2)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """A hot source, null sources, ids and texts, copies, repeated rows, one very long text."""
    rng = random.Random(5)
    out = [(i, prose(rng, rng.randrange(1, 90)), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(400)]
    out += [(1000 + i, "The SAME w1 w2 été été", None) for i in range(150)]
    out += [(2000, None, "s1"), (2001, "", "s1"), (2002, " \n\t", None), (None, "w1 w2 w3", "s2"), (None, None, None)]
    out += [(2003, prose(rng, 30_000, 4000), "long"), (2004, "a w1", "s3"), (2004, "a w1", "s3"), (2004, "b w2", "s3")]
    out += [(2005, None, "none"), (2006, "#*$% |<> w1 w1\nw1 w1\nw1 w1", "zz")]
    return out


def water_level(sizes, weights, most):
    """Targets by resharing the excess until none is above."""
    total, target, full = sum(sizes), [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[i] for i in full)
        share = sum(weights[i] for i in range(len(sizes)) if i not in full)
        target = [most * s if i in full else rest * weights[i] / share for i, s in enumerate(sizes)]
        above = {i for i, s in enumerate(sizes) if i not in full and target[i] > most * s}
        if not above:
            return target
        full |= above


def test_mix_meets_targets(spark, rows):
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    size_of = [(i, len(WORD.findall(t or "")), s) for i, t, s in rows]
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, n) for i, n, _ in size_of)
    names = sorted({s for *_, s in size_of}, key=lambda s: (s is None, s))
    sizes = [sum(n for _, n, s in size_of if s == name) for name in names]
    want = water_level(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))], 3)
    seen = {(r.source_size, r.target) for r in got}
    assert len(seen) == len(set(zip(sizes, want, strict=True)))
    for size, target in zip(sizes, want, strict=True):
        near = [t for s, t in seen if s == size and abs(t - target) <= 1e-9 * max(target, 1)]
        assert near, (size, target)
        own = [r for r in got if (r.source_size, r.target) == (size, near[0])]
        error = abs(sum(r.taken for r in own) - target)
        assert error <= max((r.size for r in own), default=0) / 2 + 1e-6
        assert len({r.epochs for r in own if r.size}) <= 2
    assert abs(sum(want) - sum(sizes)) < 1e-6
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.size * r.epochs for r in got)
    again = mixing.mix(docs.repartition(7)).collect()
    told = lambda rs: sorted((r.doc_id or -1, r.size, r.taken) for r in rs)
    assert told(got) == told(again)
    assert told(mixing.mix(docs, seed=12).collect()) != told(got)


def test_mix_prefers_better_documents(spark):
    """Of equally long texts a third is chosen; clean ones more often than noisy ones."""
    clean, noisy = "word " * 20, "wo#rd%%& " * 10 + "word " * 10
    rows = [(i, clean if i % 2 else noisy, "a") for i in range(1200)] + [(5000 + i, clean * 5, "b") for i in range(900)]
    got = [r for r in mixing.mix(table(spark, rows), weights=(1, 10)).collect() if r.doc_id < 5000 and r.taken]
    share = sum(r.doc_id % 2 for r in got) / len(got)
    assert 100 < len(got) < 1200 and share > 0.6


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    only = mixing.mix(table(spark, [(1, None, None), (2, "", "a")])).collect()
    assert all((r.size, r.source_size, r.target, r.taken) == (0, 0, 0.0, 0) for r in only) and len(only) == 2
    alone = mixing.mix(table(spark, [(1, "a b c", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(3, 3.0, 3)]


def ranked(rows, items, keep):
    """The contract, document by document."""
    bags = [(i, collections.Counter(x.translate(FOLD) for x in TERM.findall(t or ""))) for i, t, *_ in rows]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= {x.translate(FOLD) for x in TERM.findall(text or "")}
    out = []
    for item, terms in asked.items():
        found = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:keep])]
    return out


ITEMS = [(0, "W1 w2, ÉTÉ été the."), (1, "w3 w3 w59 nothing"), (2, "absent"), (3, None), (4, ""), (5, "same"),
         (6, "w0 W5 b"), (6, "a"), (None, "w7 été"), (7, " ".join(f"w{k}" for k in range(60)))]


@pytest.mark.parametrize("pairs, cells", [(1 << 17, 4_000_000), (4, 40)])
def test_search_equals_scoring_all(spark, rows, monkeypatch, pairs, cells):
    monkeypatch.setattr(search, "BLOCK_PAIRS", pairs)
    monkeypatch.setattr(search, "CELLS", cells)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS], "item_id long, text string, rank int, score string")
    got = search.search(table(spark, rows), items)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked(rows, ITEMS, 50), key=key)


def test_search_scores_copies_once(spark, rows):
    items = next(search.item_blocks(spark.createDataFrame(ITEMS, "item_id long, text string")))
    held = search.bags(table(spark, rows), items.terms).where("size(terms) > 0")
    assert held.count() - held.dropDuplicates(["terms", "counts", "n"]).count() >= 149


def test_search_of_nothing(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(table(spark, []), items).count() == 0
    assert search.search(table(spark, [(1, "...", "a"), (2, None, "a")]), items).count() == 0
    assert search.search(table(spark, rows), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_finder_reads_bytes_not_only_hashes():
    import pyarrow as pa

    from salience.llm.words import LETTERS, Words

    find = search.Finder([b"abc", "été".encode(), b"x"])
    find.hashes = find.hashes.copy()
    words = Words(pa.array(["ABC été xyz x", "", "abc"]), LETTERS)
    at, number = find(words)
    assert list(zip(at.tolist(), number.tolist(), strict=True)) == [(0, 0), (1, 1), (3, 2), (4, 0)]
    find.size = find.size + 1  # the hash agrees, the word does not
    assert len(find(words)[0]) == 0


def spelled(rows, occurrences=5):
    """Words, near words, forms and roots by comparing all pairs."""
    count = collections.Counter()
    for i, text, *_ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= occurrences}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, met = {}, {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        met[w] = len(others)
        form[w] = others[0][1] if others and -others[0][0] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, met[w], words[form[w]] if form[w] else None))
    return sorted(out)


def variants_of(docs):
    return sorted(tuple(r) for r in spelling.variants(docs).select(
        "word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_equal_all_pairs(spark):
    rng = random.Random(8)
    letters = "abcdeéÿ÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))) for _ in range(25)]
    bag = []
    for stem in stems:
        times = 700
        while times >= 3:
            bag += [stem] * times
            k = rng.randrange(len(stem))
            stem = rng.choice([stem[:k] + stem[k + 1 :], stem[:k] + rng.choice(letters) + stem[k:],
                               stem[:k] + rng.choice(letters) + stem[k + 1 :], stem + stem[-1], stem[0] + stem])
            times //= rng.choice([2, 5, 6])
    bag += ["aaaaaa"] * 40 + ["aaaaaaa"] * 8 + ["aaaaaaaa"] * 5 + ["short"] * 9 + ["àèìòùá"] * 30 + ["ÀÈÌÒÙÁ"] * 6
    rng.shuffle(bag)
    rows = [(k, " ".join(x.title() if rng.random() < 0.2 else x for x in bag[at : at + 40]) + ".", "s")
            for k, at in enumerate(range(0, len(bag), 40))]
    rows += [(None, "zzzzzz " * 6, "s"), (None, None, "s"), (9000, "", "s"), (9001, "qqqqqq " * 20_000, "s"),
             (9002, "repeated " * 3, "s"), (9002, "repeated " * 3, "s")]
    want = spelled(rows)
    assert sum(w[1] is not None for w in want) > 10 and any(w[2] not in (w[0], w[1]) for w in want)
    assert variants_of(table(spark, rows)) == want


def test_variants_of_one_reduced_form(spark):
    """Many words of one reduced form, as a hot key would be."""
    same = [c for c in "abcdefghijklmnopqrstuvwxyz" if (ord(c) * 0x9E3779B1 >> 16) % spelling.SYMBOLS == (
        ord("a") * 0x9E3779B1 >> 16) % spelling.SYMBOLS]
    rng = random.Random(9)
    words = {"".join(rng.choice(same) for _ in range(6)) for _ in range(300)}
    rows = [(k, f"{w} " * (5 + 40 * (k % 9 == 0)), "s") for k, w in enumerate(sorted(words))]
    assert variants_of(table(spark, rows)) == spelled(rows)


def test_variants_of_nothing(spark):
    assert variants_of(table(spark, [])) == []
    assert variants_of(table(spark, [(1, None, "s"), (2, "few words", "s")])) == []
