"""The operators for training data against brute force and planted cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salience.llm import (
    bpe, decontaminate, jaccard, language, licenses, passages, quality, sharding, toxicity, warc, words,
)
from salience.llm.queries import TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, size long, node string"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Null ids and texts, empty and long texts, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    long = prose(rng, 20_000, 5000)
    rows = [
        (1, None, "en", 1, "a"), (2, "", None, 2, "b"), (3, " \n\t", "en", 3, None), (None, "x y z w v", "en", 4, "c"),
        (4, long, "en", 5, "d"), (5, long, "fr", 6, "e"), (6, "a b", "en", 7, "f"), (6, "a b", "en", 7, "f"),
        (7, "The the THE " * 30, "en", 8, "g"), (8, "123 ###", "de", 9, "h"), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_equal_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \n\t\x0b\x0cé\xa0あ.") for _ in range(rng.randrange(40))) for _ in range(300)] + [""]
    found = words.Words(pa.array(texts))
    hashes = found.hashes()
    seen = {}
    for row, text in enumerate(texts):
        own = [w.translate(LOWER) for w in WORD.findall(text)]
        assert len(own) == found.first[row + 1] - found.first[row]
        for w, h in zip(own, hashes[found.first[row] :], strict=False):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_shards_are_contiguous_and_even(spark, edge, nothing):
    rng = random.Random(2)
    rows = [(i if i % 3 else 7, prose(rng, rng.randrange(60)), "en", 0, "") for i in range(600)]
    got = sharding.byte_shards(spark.createDataFrame(rows, SCHEMA), 10).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted(
        (len(t.encode()) + 16, zlib.crc32(t.encode())) for _, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    total, most = sum(r.size for r in got), max(r.size for r in got)
    for shard, own in by.items():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 10) <= 2 * most
        if shard + 1 in by:
            assert max(r.doc_id for r in own) <= min(r.doc_id for r in by[shard + 1])
    assert sharding.byte_shards(edge).count() == 11 and sharding.byte_shards(nothing).count() == 0


def test_tokens_equal_the_library(spark, edge, nothing):
    from tokenizers import Tokenizer

    reference, rng = Tokenizer.from_file(TOKENIZER), random.Random(4)
    texts = [r.text or "" for r in edge.collect()] + ["<|endoftext|>a <|endoftext|>", "don't  I'LL\n\n x", "a" * 500, "🙂 é 日本 ٣½"]
    texts += ["".join(rng.choice("abcdeth ,.\n1éßあ") for _ in range(80)) for _ in range(300)]
    got = {r.doc_id: r for r in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), TOKENIZER).collect()}
    for i, text in enumerate(texts):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == reference.decode(ids, skip_special_tokens=False)
    one = {r.n_tokens: r for r in bpe.digests(edge, TOKENIZER).collect()}[0]
    assert one.ids_sha256 == one.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(edge, TOKENIZER).count() == 11 and bpe.digests(nothing, TOKENIZER).count() == 0


def test_slices_give_what_whole_texts_give(spark, monkeypatch):
    """Passages that go far beyond their seeds, with changed words, in long and short texts."""
    rng = random.Random(21)
    shared = [prose(rng, n, 5000).split() for n in (60, 90, 300, 700)]
    rows = []
    for i in range(60):
        own = prose(rng, rng.randrange(400), 5000).split()
        for part in rng.sample(shared, 2):
            part = [w if rng.random() > 0.12 else f"x{rng.randrange(9999)}" for w in part]
            at = rng.randrange(len(own) + 1)
            own[at:at] = part[rng.randrange(20):]
        rows.append((i // 2 if i > 50 else i + 100, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = []
    for margin in (1, 64, 10**6):
        monkeypatch.setattr(passages, "MARGIN", margin)
        told.append(sorted(map(tuple, passages.repeated_passages(docs).collect())))
    assert len(told[0]) > 30 and told[0] == told[1] == told[2]


def test_every_code_point_is_split_as_in_the_library():
    from tokenizers import Tokenizer

    cut, coder = Tokenizer.from_file(TOKENIZER).pre_tokenizer.pre_tokenize_str, bpe.Coder(TOKENIZER)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 512):
        text = "".join(f"{c}'ll{c}1{c}a{c}. {c} \n" for c in points[at : at + 512])
        assert [len(w) for w in coder.split(text)] == [b - a for _, (a, b) in cut(text)], hex(ord(points[at]))


def test_convolution_equals_a_loop():
    """Scores of the batch code against one text, one filter and one place at a time."""
    rng = random.Random(13)
    texts = [prose(rng, n, 50) for n in (0, 1, 2, 3, 40, 7)] + ["one two", ""]
    model = toxicity.train(texts * 4, np.arange(len(texts) * 4) % 2, ["en", "de"] * 16)
    raw, _ = toxicity.logits(model, pa.array(texts))
    for row, text in enumerate(texts):
        codes, _ = toxicity.features(pa.array([text]))
        x = [sum(model.embed[c].astype(float) for c in word) for word in codes]
        want = model.base
        for w, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0  # of places where a filter reaches over the end, the rest counts as nothing
                for at in range(len(x)):
                    seen = x[at : at + width]
                    out = model.bias[width][f] + sum(
                        v @ model.filters[width][k * toxicity.DIM : (k + 1) * toxicity.DIM, f] for k, v in enumerate(seen))
                    best = max(best, float(out))
                want += best * model.dense[w * toxicity.FILTERS + f]
        assert abs(raw[row] - want) < 1e-3


def test_toxicity_draws_the_smallest_hashes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    docs = spark.createDataFrame(
        [(i, "x" * (20_000 if i % 10 == 0 else 5), "en", 0, "") for i in range(900)]
        + [(i, None, "en", 0, "") for i in range(900, 950)] + [(3, "x", "en", 0, "")] * 30, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000)] + [(None, 1), (5, 0)], "doc_id long, toxic int")
    usable = docs.where(~toxicity.held_out(F.col("doc_id")) & (F.length("text") < 100)).select("doc_id").distinct()
    hashed = usable.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()
    want = {(r.doc_id, t) for t in (0, 1) for r in sorted(
        (r for r in hashed if int(r.doc_id % 4 == 0) == t), key=lambda r: r.h)[:40]}
    assert {(r.doc_id, r.toxic) for r in toxicity.draw(docs, labels).collect()} == want


def test_ledger_equals_counting(spark, edge, nothing):
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(80), rng.choice([3, 9, 500])) + rng.choice(["", "\nx\nx", " ## |"]) for _ in range(200)]
    docs = edge.unionByName(spark.createDataFrame([(i, t, "en", 1, "q") for i, t in enumerate(texts)], SCHEMA))
    entries = quality.ledger(docs)
    rows = entries.collect()
    assert len(rows) == 211 and {"size", "node", "lang"} <= set(entries.columns)
    for r in rows:
        text = r.text or ""
        own = WORD.findall(text)
        grams = [tuple(own[j : j + 5]) for j in range(len(own) - 4)]
        often, covered = collections.Counter(grams), set()
        for j, g in enumerate(grams):
            if often[g] > 1:
                covered.update(range(j, j + 5))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r.failed & 3 != 0) == (len(own) < 10 or 100 * len(covered) > 20 * len(own))
    mask = quality.mask_of(quality.POLICIES["v1"])
    for r in quality.ablation(entries, "v1").collect():
        bit = next(1 << x.bit for x in quality.RULES if x.name == r.rule)
        assert r.n_only == sum(x.failed & mask == bit for x in rows)
        assert r.n_kept_without == sum(x.failed & mask & ~bit == 0 for x in rows)
    assert quality.ledger(nothing).count() == 0


def components_by_force(texts, size, percent):
    sets = []
    for text in texts:
        own = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(own[j : j + size]) for j in range(max(1, len(own) - size + 1))} if own else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("rare, block", [(64, 512), (2, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, rare, block):
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, texts = random.Random(6), ["", None, "A b", "a B", "one"]
    for length in (4, 6, 30, 120):
        for _ in range(4):
            base = prose(rng, length, 5000).split()
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.randrange(4)):
                    copy[rng.randrange(len(copy))] = f"n{rng.randrange(9999)}"
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    got = jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    want = components_by_force(texts, 4, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == dict(enumerate(want))


def test_join_edges(edge, nothing):
    got = jaccard.near_copies(edge).collect()
    assert len(got) == 11 and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    assert jaccard.near_copies(nothing).count() == 0
    kept = jaccard.one_of_each(edge)
    assert kept.columns == edge.columns and 5 not in {r.doc_id for r in kept.collect()}


def test_passages_with_changes_are_found(spark, edge, nothing):
    rng = random.Random(7)
    shared = prose(rng, 90, 9000).split()
    changed = shared[:40] + ["new", "words"] + shared[41:70] + shared[72:]
    texts = [" ".join(prose(rng, 60, 9000).split() + p + prose(rng, 60, 9000).split()) for p in (shared, shared, changed, [])]
    docs = spark.createDataFrame([(i, t, "en", 0, "") for i, t in enumerate(texts)], SCHEMA)
    found = passages.repeated_passages(docs)
    got = {r.doc_id: r for r in found.collect()}
    assert sorted(got) == [1, 2] and {r.lead_doc_id for r in got.values()} == {0}
    assert (got[1].start_word, got[1].end_word) == (60, 150) and got[2].end_word - got[2].start_word >= 85
    rest = {r.doc_id: len(r.text.split()) for r in passages.without_repeats(docs, found).collect()}
    assert rest[0] == 210 and rest[1] == 120 and rest[3] == 120 and rest[2] <= 125
    ids = {r.doc_id for r in passages.repeated_passages(edge).collect()}
    assert 5 in ids and 4 not in ids
    assert passages.repeated_passages(nothing).count() == 0
    assert passages.without_repeats(edge, passages.repeated_passages(edge)).count() >= 9


def test_passages_of_parts_from_different_texts_are_found(spark):
    rng, rows = random.Random(17), []
    for i in range(20):
        first, second = prose(rng, 26, 9000), prose(rng, 26, 9000)
        rows += [(4 * i + k, " ".join([prose(rng, 30, 9000), t, prose(rng, 30, 9000)]))
                 for k, t in enumerate([first, second, f"{first} {second}", f"{first} {second}"])]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {(r.doc_id, r.lead_doc_id, r.start_word, r.end_word) for r in got} == {(4 * i + 3, 4 * i + 2, 30, 82) for i in range(20)}


def test_parts_of_a_failing_chain_are_found():
    rng = np.random.default_rng(14)

    def found(copy, leader):
        copy, leader = (np.concatenate(w).astype("<u2") for w in (copy, leader))
        places: dict[bytes, int] = {}
        for q in range(len(leader) - passages.SEED, -1, -1):
            places[leader[q : q + passages.SEED].tobytes()] = q
        pairs = [(p, places[copy[p : p + passages.SEED].tobytes()]) for p in range(len(copy) - passages.SEED + 1)
                 if copy[p : p + passages.SEED].tobytes() in places]
        return passages.repeats_of(copy, leader, *np.array(pairs).T, 50, 0.8)

    word = lambda n: rng.integers(0, 1 << 16, n)
    first, second, third = word(40), word(40), word(40)
    got = found([word(30), first, word(1), second, word(10), third], [word(20), first, second, word(60), third])
    assert [(s, e) for s, e, *_ in got] == [(30, 111)]
    run = word(55)  # and a block that holds a passage and more, on one diagonal
    got = found([word(30), run, word(25), third[:8], word(30)], [word(20), run, word(25), third[:8]])
    assert [(s, e) for s, e, *_ in got] == [(30, 85)]


def test_chain_score_equals_all_orders():
    rng = np.random.default_rng(8)
    for _ in range(50):
        made = np.sort(rng.integers(0, 200, (12, 1)), axis=0)
        made = np.hstack([made, made + rng.integers(6, 20, (12, 1)), rng.integers(0, 200, (12, 1))])
        best = [0.0] * 12
        for j, (s, e, q) in enumerate(made.tolist()):
            best[j] = e - s
            for i, (a, b, c) in enumerate(made.tolist()):
                if b <= s and c + b - a <= q:
                    best[j] = max(best[j], best[i] + e - s - passages.GAP_COST * (s - b + q - (c + b - a)))
        path = passages.chains(made)[0]
        total = sum(made[k, 1] - made[k, 0] for k in path)
        for i, j in zip(path, path[1:], strict=False):
            total -= passages.GAP_COST * (made[j, 0] - made[i, 1] + made[j, 2] - (made[i, 2] + made[i, 1] - made[i, 0]))
        assert total == pytest.approx(max(best))


def test_leaked_items_are_found(spark, edge, nothing):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randrange(15, 60), 4000)) for i in range(30)]
    texts = []
    for i in range(60):
        middle = items[i][1].split() if i < 30 else []
        if 10 <= i < 20:
            middle[len(middle) // 2] = "changed"
        texts.append(" ".join(prose(rng, 50, 4000).split() + middle + prose(rng, 50, 4000).split()))
    docs = spark.createDataFrame([(i, t, "en", 0, "") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(30)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == set(range(30, 60))
    assert decontaminate.leaks(edge, bench).count() == 0
    assert decontaminate.without_leaks(edge, bench).count() == 11
    assert decontaminate.leaks(nothing, nothing.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_exact_copies_are_found_in_a_large_benchmark(spark):
    rng = random.Random(15)
    items = [(i, prose(rng, 150 if i % 10 == 0 else 32, 3000)) for i in range(1500)]
    texts = [prose(rng, rng.randrange(40, 60), 3000) + " " + t + " " + prose(rng, 50, 3000) for _, t in items[:80]]
    # An item of common words between rare ones has next to no cosine.
    items.append((1500, "a b c d e a c b d e c a d b e a"))
    texts += [" ".join(f"rare{i}x{k}" for k in range(20)) + " " + items[-1][1] + " " + " ".join(f"rare{i}y{k}" for k in range(20)) for i in range(80, 90)]
    texts += ["a b c d e " * 8 + prose(rng, 24, 3000) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id int, text string")).collect()}
    assert {(i, i) for i in range(80)} | {(i, 1500) for i in range(80, 90)} <= got
    assert all(i == k for i, k in got if k < 1500)


def _subsequence(a, b):
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def _leaked(text, item):
    """Whether a text holds 60 % of an item's words and half of its answer in order."""
    text, item = text.split(), item.split()
    answer = item[-max(3, len(item) // 5) :]
    return _subsequence(item, text) >= 0.6 * len(item) and 2 * _subsequence(answer, text) >= len(answer)


@pytest.mark.parametrize("rank", [decontaminate.RANK, 96])
def test_paraphrases_equal_brute_force(spark, rank):
    """Items with a third of the words replaced, dropped or inserted, in a space of full and of reduced rank."""
    rng = random.Random(21)
    items = [(i, prose(rng, rng.choice([14, 24, 32, 45, 64, 120]), 3000)) for i in range(200)]
    texts = []
    for _, item in items[:60]:
        own = item.split()
        changed = [
            [f"w{rng.randrange(3000)}" if rng.random() < 0.25 else w for w in own],
            [w for w in own if rng.random() > 0.2],
            [x for w in own for x in ([w, f"w{rng.randrange(3000)}"] if rng.random() < 0.3 else [w])],
        ]
        texts += [f"{prose(rng, 60, 3000)} {' '.join(c)} {prose(rng, 40, 3000)}" for c in changed]
    texts += [prose(rng, 200, 3000) for _ in range(60)]
    want = {(d, i) for d, t in enumerate(texts) for i, item in items if set(item.split()) & set(t.split()) and _leaked(t, item)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = decontaminate.leaks(docs, spark.createDataFrame(items, "item_id int, text string"), rank=rank).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 150
    for r in rows[::7]:
        wide = texts[r.doc_id].split()
        assert r.coverage <= _subsequence(dict(items)[r.item_id].split(), wide) / len(dict(items)[r.item_id].split())


def test_latent_space_equals_the_exact_one(spark):
    rng = random.Random(22)
    items = spark.createDataFrame([(i, prose(rng, 40, 300)) for i in range(60)], "item_id int, text string")
    docs = spark.createDataFrame([(i, prose(rng, 90, 300)) for i in range(40)], "doc_id int, text string")
    space = decontaminate.fit_space(docs, items, 60)
    used = int(space.row_of.max())

    def terms(text):
        hashes = words.Words(pa.array([text]), words.LETTERS).hashes(lower=True)
        return (hashes >> decontaminate.SHIFT).astype(np.int64)

    pieces = [terms(r.text) for r in items.collect()]
    passages = [t[a : a + 32] for t in [terms(r.text) for r in docs.collect()] + pieces for a in range(0, len(t), 32)]
    held = collections.Counter(t for p in passages for t in set(p.tolist()))
    weights = np.array([np.log((1 + len(passages)) / (1 + held[t])) for t in np.flatnonzero(space.row_of < used)])
    rows = [np.bincount(space.row_of[p], minlength=used) for p in pieces]
    # A full rank keeps all angles between the weighted rows.
    latent = np.stack(rows).astype(float) @ space.basis[:used]
    heavy = np.stack(rows) * weights
    assert np.allclose(latent @ latent.T, heavy @ heavy.T, rtol=1e-3, atol=1e-3)


def test_toxic_words_are_learned(spark, edge, nothing):
    rng, rows = random.Random(10), []
    for i in range(400):
        own = prose(rng, 40).split()
        if i % 3 == 0:
            own[rng.randrange(40)] = rng.choice(["vile", "nasty", "nastily"])
        rows.append((i, " ".join(own), rng.choice(["en", "de"]), 0, ""))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(edge.withColumn("doc_id", F.col("doc_id") + 1000))
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert held and np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.95
    assert len(got) == 411 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(nothing, labels.limit(0)).count() == 0


def test_languages_are_told_apart(spark, edge, nothing):
    rng, rows = random.Random(11), []
    parts = {"en": ["the", "and", "ing"], "fr": ["eau", "é", "que"], "de": ["sch", "ung", "ß"]}
    for i in range(300):
        lang = rng.choice(sorted(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(20)), lang, 0, ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.language(docs).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows if got[i].held_out]) > 0.95
    marks = language.language(edge).collect()
    assert {r.lang_pred for r in marks if r.doc_id in (1, 2, 3, 8)} == {"und"} and len(marks) == 11
    assert language.language(nothing).count() == 0


def test_licenses_are_found_in_place(spark, edge, nothing):
    rng = random.Random(12)
    apache = licenses.TEMPLATES["Apache-2.0"].replace("may obtain", "can get")
    text = prose(rng, 30) + "\n" + apache + "\n" + prose(rng, 30)
    rows = [(1, text), (2, prose(rng, 60)), (3, "x Released under the MIT License. y"), (4, None)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    found = {(r.doc_id, r.license): r for r in got}
    assert {d for d, _ in found} == {1, 3} and found[1, "Apache-2.0"].coverage > 0.9
    r = found[1, "Apache-2.0"]
    assert text.encode()[r.start_byte : r.end_byte].decode().startswith("Licensed under")
    assert found[3, "MIT-notice"].coverage == 1.0
    assert licenses.scan(edge).count() == 0 and licenses.scan(nothing).count() == 0


def test_parts_and_neighbouring_licenses_are_found(spark):
    rng = random.Random(16)
    own = prose(rng, 99).split()
    own = [f"{w}x{k}" for k, w in enumerate(own)]
    changed = own[:37] + prose(rng, 25, 9000).split() + own[62:]
    rows = [(1, " ".join(prose(rng, 20).split() + changed)), (2, "Released under the MIT License. Released under the MIT License."),
            (3, "Licensed under CC BY-NC 4.0. " * 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = licenses.scan(docs, licenses.TEMPLATES | {"own": " ".join(own)}).collect()
    at = lambda d, name: sorted((r.start_word, r.end_word) for r in got if (r.doc_id, r.license) == (d, name))
    assert at(1, "own") == [(20, 57), (82, 119)]
    assert at(2, "MIT-notice") == [(0, 5), (5, 10)] and at(3, "CC-BY-NC-notice") == [(0, 7), (7, 14)]


def test_audit_finds_the_damaged_records(spark):
    rng = random.Random(13)
    pages = [(i, f"http://a/{i}", prose(rng, 3000)) for i in range(120)] + [(None, None, None), (5, "http://a/5", "")]
    table = spark.createDataFrame(pages, "page_id int, url string, html string")
    records = warc.manifest(table)
    rows = sorted(records.collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(122))
    assert all(a.offset + a.length == b.offset for a, b in zip(rows, rows[1:], strict=False))
    held = records.where("number <> 17").select(
        "number", F.when(F.col("number").isin(3, 90), "bad").otherwise(F.col("digest")).alias("digest"))
    states = {r.number: r.state for r in warc.audit(records, held).collect()}
    assert {n: s for n, s in states.items() if s != "intact"} == {3: "corrupt", 90: "corrupt", 17: "missing"}
    assert {r.state for r in warc.audit(records, records.select("number", "digest")).collect()} == {"intact"}
    empty = warc.manifest(table.limit(0))
    assert warc.audit(empty, empty.select("number", "digest")).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}
    assert 0 < len(got) < docs.count() and all(len(r.ids) > 0 for r in got.values())


def test_audit_tells_surplus_and_moved_records(spark):
    rng = random.Random(14)
    pages = [(i, f"http://a/{i}", prose(rng, 3000)) for i in range(60)]
    records = warc.manifest(spark.createDataFrame(pages, "page_id int, url string, html string"))
    held = records.select("number", "digest", "offset")
    more = spark.createDataFrame([(60, "new", 10**7), (None, "none", 0), (7, "twice", 0)], "number long, digest string, offset long")
    swapped = held.withColumn("offset", F.when(F.col("number") == 20, F.col("offset") + 1).otherwise(F.col("offset")))
    got = warc.audit(records, swapped.unionByName(more).unionByName(held.where("number = 30"))).collect()
    assert {r.number: r.state for r in got if r.state != "intact"} == {60: "surplus", 20: "moved", 7: "corrupt"}
    extra = next(r for r in got if r.state == "surplus")
    assert (extra.page_id, extra.offset, extra.digest) == (None, 10**7, "new") and len(got) == 61
    slim = warc.audit(records, held.drop("offset").unionByName(more.select("number", "digest").where("number = 60"))).collect()
    assert {r.number: r.state for r in slim if r.state != "intact"} == {60: "surplus"}
    empty = records.limit(0)
    assert [r.state for r in warc.audit(empty, more.where("number = 60")).collect()] == ["surplus"]
    # The tree's root is the digest of digests that hashlib gives.
    one = warc.tree(records.where("node = 0").select("number", "digest", "node")).collect()
    first = sorted((r.number, r.digest) for r in records.where("node = 0").collect())
    assert one[0].digest == hashlib.sha256("".join(d for _, d in first).encode()).hexdigest()
    body = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:0>\r\nWARC-Target-URI: http://a/0\r\nContent-Type: text/html\r\nContent-Length: {len(pages[0][2])}\r\n\r\n{pages[0][2]}\r\n\r\n"
    assert records.where("number = 0").first().digest == hashlib.sha256(body.encode()).hexdigest()


CLASHES = ["grams", "_words", "_Codes", "_lines", "_entry", "__words", "_grams", "_key", "_id", "_doc", "_text", "_spans", "_gone"]


def test_stages_take_any_column_names(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in CLASHES})
    for run in (
        lambda d: quality.ledger(d).drop("failed"),
        lambda d: jaccard.one_of_each(d, 5, 80),
        lambda d: passages.without_repeats(d, passages.repeated_passages(d)),
    ):
        plain = sorted(tuple(r) for r in run(docs).select("doc_id", "text").collect())
        got = run(wide)
        assert sorted(tuple(r) for r in got.select("doc_id", "text").collect()) == plain
        assert all(got.where(F.col(f"`{c}`") != F.concat(F.lit(c), F.col("doc_id"))).isEmpty() for c in CLASHES)


def test_cuts_come_from_all_labelled_rows(spark, monkeypatch):
    """Rows beyond the sample, and texts too long for it, count; rows that were fitted on and the held-out fold do not."""
    monkeypatch.setattr(toxicity, "SAMPLE", 20)
    rng = random.Random(12)
    docs = spark.createDataFrame(
        [(i, prose(rng, 12 if i % 50 else 4000) + " vile" * (i % 2), "en", 0, "") for i in range(600)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, toxic int")
    counted, plain = [], toxicity._set_cuts

    def spy(model, group, raw, clean, toxic):
        counted.append((int(clean.sum()), int(toxic.sum())))
        plain(model, group, raw, clean, toxic)

    monkeypatch.setattr(toxicity, "_set_cuts", spy)
    toxicity.fit(docs, labels)
    kept = docs.where(~toxicity.held_out(F.col("doc_id"))).count()
    # Of 40 drawn rows every fifth is not fitted on.
    assert sum(counted[-1]) == kept - 32 and min(counted[-1]) > 150
