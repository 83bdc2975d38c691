"""Byte-level BPE encoding by proposing tokens greedily and verifying every pair."""

from __future__ import annotations

import hashlib
import functools
import heapq
import json
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from salience.llm.words import blocks

#: Fixed value: the split pattern of the byte-level pre-tokenizer that the files name.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens one task remembers before it starts afresh.
MEMORY = 400_000
#: Words of more bytes are merged with a heap.
LONG_WORD = 64


def _byte_letters() -> dict[str, int]:
    """The printable letter by which a vocabulary file writes each byte.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in plain]
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and how each token is made, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *(
            t["id"] for t in spec["added_tokens"])]) + 1)
        for text, number in vocab.items():
            self.bytes[number] = bytes(letters[c] for c in text)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, number in self.special.items():
            self.bytes[number] = text.encode()
        size = len(self.bytes)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        #: Left and right half and the rank of the merge that makes each token; rank -1: a byte.
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.birth = np.full(size, -1, np.int64)
        for rank, (a, b) in enumerate(merges):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair] = rank
            self.made.append(whole)
            if self.birth[whole] < 0:
                self.left[whole], self.right[whole], self.birth[whole] = *pair, rank
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.key_rank = np.array(list(self.rank.values()), np.int64)[order]
        self.of_byte = {self.bytes[i]: i for i in vocab.values() if len(self.bytes[i]) == 1}
        self.number = {self.bytes[i]: i for i in vocab.values()}
        self.longest = max(map(len, self.number))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a large number."""
        never = np.iinfo(np.int64).max
        if not len(self.keys):
            return np.full(len(a), never)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], never)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of neighbours gives just the pair.

        While merges run in rank order, the symbol left of the border grows along
        the right edge of ``a`` and the symbol right of it along the left edge of
        ``b``.  The pair holds unless, for two symbols that meet at the border,
        their own merge comes before either of them grows.  A merge that ties
        with the left symbol's growth comes after it, one that ties with the
        right symbol's growth before it.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        u, v = a.copy(), b.copy()
        grow_u = np.full(len(a), np.iinfo(np.int64).max)
        grow_v = grow_u.copy()
        while len(live):
            rank = self.pair_rank(u, v)
            bad = (rank < grow_u) & (rank <= grow_v) & (rank < np.iinfo(np.int64).max)
            good[live[bad]] = False
            back_u = self.birth[u] >= self.birth[v]  # the later born of both is taken back first
            done = bad | ((self.birth[u] < 0) & (self.birth[v] < 0))
            grow_u = np.where(back_u, self.birth[u], grow_u)
            grow_v = np.where(back_u, grow_v, self.birth[v])
            u, v = np.where(back_u, self.right[u], u), np.where(back_u, v, self.left[v])
            go = ~done
            live, u, v, grow_u, grow_v = live[go], u[go], v[go], grow_u[go], grow_v[go]
        return good

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place, from the left."""
        out, at, n, number = [], 0, len(word), self.number
        while at < n:
            for to in range(min(n, at + self.longest), at, -1):
                token = number.get(word[at:to])
                if token is not None:
                    break
            else:
                raise ValueError(f"byte {word[at]} is not in the vocabulary")
            out.append(token)
            at = to
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the pair of lowest rank first, the leftmost of equals."""
        symbols = [self.of_byte[word[i : i + 1]] for i in range(len(word))]
        if len(symbols) > LONG_WORD:
            return self._merged_long(symbols)
        rank_of, never = self.rank.get, len(self.rank)
        ranks = [rank_of(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks and (least := min(ranks)) < never:
            i = ranks.index(least)
            symbols[i] = self.made[least]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank_of((symbols[i], symbols[i + 1]), never)
        return symbols

    def _merged_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap of pairs and links between the symbols left."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < len(symbols):
                rank = self.rank.get((symbols[i], symbols[j]))
                if rank is not None:
                    heapq.heappush(heap, (rank, i, symbols[i], symbols[j]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= len(symbols) or symbols[j] != b:
                continue
            symbols[i], symbols[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in symbols if s >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token numbers of each word."""
        raw = [w.encode() for w in words]
        proposed = [self.greedy(w) for w in raw]
        flat = np.array([t for p in proposed for t in p], np.int64)
        owner = np.repeat(np.arange(len(proposed)), [len(p) for p in proposed])
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        good = self.compatible(flat[inside], flat[inside + 1])
        # A token of its own must also be what merging its bytes gives.
        made = self.whole(flat)
        for k in np.unique(np.concatenate([owner[inside[~good]], owner[~made]])):
            proposed[k] = self.merged(raw[k])
        return proposed

    def whole(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each token gives the token."""
        if not hasattr(self, "_whole"):
            self._whole: dict[int, bool] = {}
        known = self._whole
        fresh = [t for t in set(tokens.tolist()) if t not in known]
        for t in fresh:
            known[t] = self.merged(self.bytes[t]) == [t]
        unsound = np.array([t for t, ok in known.items() if not ok], np.int64)
        return ~np.isin(tokens, unsound)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file that every machine has; read once in a process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


@functools.cache
def stand_ins() -> dict[int, str]:
    """A code point of the right class for each one that ``regex`` classes otherwise than the library.

    Their tables are of different Unicode versions.  The library is asked for the
    runs of each class in one text of all code points.
    """
    whole = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    kinds = {r"\p{L}": "\u00e9", r"\p{N}": "\u00b2", r"\s": "\u00a0"}
    other = "\ue000"
    out: dict[int, str] = {}
    for kind, sign in kinds.items():
        told = Split(Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(whole)
        theirs = set("".join(piece for piece, _ in told))
        ours = set("".join(regex.findall(kind + "+", whole)))
        out |= {ord(c): sign for c in theirs - ours}
        out |= {ord(c): out.get(ord(c), other) for c in ours - theirs}
    return out


def _class_of(codes: list[int]) -> re.Pattern | None:
    """A pattern for any of the code points, which are ascending."""
    cuts = [k for k in range(1, len(codes)) if codes[k] != codes[k - 1] + 1]
    runs = zip([0, *cuts], [*cuts, len(codes)], strict=True)
    spans = "".join(f"{re.escape(chr(codes[a]))}-{re.escape(chr(codes[b - 1]))}" for a, b in runs)
    return re.compile(f"[{spans}]") if codes else None


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Coder:
    """Encodes texts and keeps the tokens of the words it has met, up to a bound."""

    def __init__(self, path: str, memory: int = MEMORY, signs: dict[int, str] | None = None):
        self.vocabulary, self.memory = vocabulary(path), memory
        self.pattern = regex.compile(PATTERN)
        self.signs = stand_ins() if signs is None else signs
        self.odd = _class_of(sorted(self.signs))
        #: Whether all code points of Latin-1 are classed alike, so that such texts need no search.
        self.plain_latin = min(self.signs, default=256) >= 256
        marks = sorted(map(regex.escape, self.vocabulary.special), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(marks) + ")") if marks else None
        #: The tokens of each word as little-endian 32-bit numbers.
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if self.odd is None or self.plain_latin and _is_latin(text) or not self.odd.search(text):
            return self.pattern.findall(text)
        return [text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.signs))]

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if self.marks is None or not any(s in text for s in self.vocabulary.special):
            return self.split(text)
        out: list[str] = []
        for part in self.marks.split(text):
            if part in self.vocabulary.special:
                out.append("\0special" + part)
            elif part:
                out += self.split(part)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token numbers of each text."""
        words = [self.pieces(t) for t in texts]
        if len(self.known) > self.memory:
            self.known = {}
        known = self.known
        fresh = {w for w in set().union(*words) if w not in known}
        special = [w for w in fresh if w.startswith("\0special")]
        for w in special:
            known[w] = np.array([self.vocabulary.special[w[8:]]], "<u4").tobytes()
        plain = list(fresh.difference(special))
        for w, ids in zip(plain, self.vocabulary.encode_words(plain), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
        return [np.frombuffer(b"".join(map(known.__getitem__, ws)), "<u4") for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text of token numbers; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode(
            "utf-8", errors="replace"
        )


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ``ids`` (array of int) and ``decoded`` of every whole text.

    The text is cut into words by the pre-tokenizer's pattern.  For words not met
    before in the task, greedy longest matches propose tokens, one vectorised
    check tests every pair of neighbours in the batch, and words with a failing
    pair are merged exactly.  ``decoded`` joins the tokens' bytes again.  A null
    text is an empty one and has no tokens; special tokens written in a text are
    encoded as such.  Rows keep their number and order within a task; columns
    other than doc_id and ``text`` are not read.
    """
    return _map(docs, path, text, _whole_rows, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    As :func:`encode`, but ids and texts leave the task as digests only.
    """
    return _map(
        docs, path, text, _digest_rows,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def _whole_rows(coder: Coder, doc_id: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
         pa.array([coder.decode(i) for i in ids], pa.string())],
        names=["doc_id", "ids", "decoded"],
    )


def _digest_rows(coder: Coder, doc_id: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, pa.array([len(i) for i in ids], pa.int64()),
         pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
         pa.array([hashlib.sha256(coder.decode(i).encode()).hexdigest() for i in ids],
                  pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


def _map(docs: DataFrame, path: str, text: str, rows, schema: str) -> DataFrame:
    signs = docs.sparkSession.sparkContext.broadcast(stand_ins())  # a sign for a code point at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path, signs=signs.value)
        for batch in batches:
            for block in blocks(batch):
                texts = [t or "" for t in block.column(1).to_pylist()]
                yield rows(coder, block.column(0), coder.encode(texts))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, schema)
