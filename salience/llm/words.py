"""Words, word hashes and shingles of whole Arrow batches in numpy.

The UTF-8 buffer of a text column is scanned as one array: word borders come
from a byte table, word hashes from differences of one running sum, so no
Python code runs per word.  Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds (one longer text makes a block of its own).
BLOCK_BYTES = 2_000_000

_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
#: Bytes of letters and digits; all of a letter outside ASCII counts.
LETTERS = np.array([chr(b).isalnum() or b >= 128 for b in range(128)] + [True] * 128)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """The first powers of the base and of its inverse modulo 2**64.

    Tables stay in the process that made them; a pickled copy starts empty.
    """

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __reduce__(self):
        return Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full(max(n, BLOCK_BYTES + 1), _BASE, dtype=np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps)
            steps[1:] = pow(_BASE, -1, 2**64)
            self.down = np.cumprod(steps)
        return self.up, self.down


_powers = Powers()


class Words:
    """The words of a block of texts.

    ``start`` and ``end`` are byte positions in ``data``, ``doc`` is the row of
    each word, and the words of row r are ``first[r]:first[r + 1]``.  ``solid``
    says which bytes a word is made of.
    """

    def __init__(self, texts: pa.Array, solid: np.ndarray = ~SPACE):
        if texts.null_count:
            texts = pa.compute.fill_null(texts, "")
        n = len(texts)
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * kind().itemsize)
        offsets = offsets.astype(np.int64)
        buffer = texts.buffers()[2]
        whole = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]] if n else whole[:0]
        self.offsets = offsets - offsets[0] if n else np.zeros(1, np.int64)
        solid = solid[self.data]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        closes = solid.copy()
        closes[:-1] &= ~solid[1:]
        borders = self.offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(self.data))]
        opens[borders] |= solid[borders]
        closes[borders - 1] |= solid[borders - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.n = n

    def prefix_sums(self, lower: bool) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        up, _ = _powers.upto(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * up[: len(data)], out=sums[1:])
        return sums

    @staticmethod
    def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte spans start:end of the data that ``sums`` runs over."""
        _, down = _powers.upto(len(sums))
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self, lower: bool = True) -> np.ndarray:
        return self.span_hash(self.prefix_sums(lower), self.start, self.end)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words within a row, and their first words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for j in range(size):
        total += hashes[j : j + count] * np.uint64(pow(_BASE, j + 1, 2**64))
    inside = doc[:count] == doc[size - 1 :]
    return mix(total[inside]), np.flatnonzero(inside)


def spare(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has one of them."""
    used, mark = {c.lower() for c in taken}, "_"
    while any(mark + n.lower() in used for n in names):
        mark += "_"
    return [mark + n for n in names]


def blocks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``BLOCK_BYTES`` of text, or one row."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + BLOCK_BYTES, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to
