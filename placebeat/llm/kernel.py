"""Words, shingles and their hashes of a batch of texts, as numpy arrays.

The functions here run inside Arrow tasks. A batch is cut into chunks of a megabyte (a longer text is a chunk of
its own), so memory follows the longest text and not the batch. Texts stay UTF-8 bytes; every position is a byte
position in the chunk. Hashes are polynomial prefix hashes modulo 2**64 over a random byte table, finished with a mixer,
so the hash of any span of words costs two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Blanks and ASCII punctuation, for words without the marks around them.
MARKS = SPACE.copy()
MARKS[[x for x in range(33, 127) if not chr(x).isalnum()]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the largest n so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n <= 2 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of SplitMix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Prefix:
    """Hashes of spans of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray) -> None:
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * _power(_BASE, len(values)), out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _power(_INVERSE, len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(U))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets of the rows in them) of a text column; null counts as empty."""
    text = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        behind = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        yield row, behind, data[offsets[row] : offsets[behind]], offsets[row : behind + 1] - offsets[row]
        row = behind


class Words:
    """The words of a chunk: byte spans, the row of each, and where each row's words begin.

    blank: the bytes between words; the default gives the words ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = SPACE) -> None:
        self.data, self.offsets = data, offsets
        filled = offsets[1:] > offsets[:-1]
        inside = ~blank[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][filled]] = False
        self.start = np.flatnonzero(inside & ~before)
        behind = np.empty_like(inside)
        behind[-1:] = False
        behind[:-1] = inside[1:]
        behind[offsets[1:][filled] - 1] = False
        self.end = np.flatnonzero(inside & ~behind) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, fold: bool = False) -> np.ndarray:
        """A hash of each word; with fold, A-Z count as a-z."""
        return Prefix((_FOLDED if fold else _BYTES)[self.data]).spans(self.start, self.end)

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words at which a whole window of so many words of one row begins."""
        at = np.arange(len(self.start))
        return at[at + size <= self.first[self.row + 1]] if len(at) else at


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of flags between offsets."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each key is found twice or more in its row."""
    order = np.argsort(mix(keys + rows.astype(U) * U(0xD1342543DE82EF95)), kind="stable")
    k, r = keys[order], rows[order]
    same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(keys), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(keys), bool)
    out[order] = twice
    return out
