"""Words, word hashes and window hashes of many texts at once, in numpy over Arrow's UTF-8 buffers.

A *slab* is a run of rows whose texts have at most ``SLAB`` bytes together (or one longer
text), so memory stays bounded whatever the batch holds. Hashes are 64-bit polynomials with
an odd base, finished with a bijective mixer; where equality decides a result, two of them
with different seeds are used together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For loose words: everything in ASCII but letters and digits separates.
_LOOSE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_bytes = [np.random.default_rng(7 + k).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in range(2)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the splitmix64 finisher)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of base k and of its inverse, modulo 2^64."""
    have = _powers.get(k)
    if have is None or len(have[0]) < n:
        size = max(n, SLAB + 64)
        both = []
        for base in (_BASE[k], pow(_BASE[k], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = (both[0], both[1])
        if size <= 4 * SLAB:
            _powers[k] = have
    return have[0][:n], have[1][:n]


def sums(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values[i] * base^i, and the inverse powers: spans hash to (c[e] - c[s]) * inv[s]."""
    p, inv = powers(len(values) + 1, k)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=c[1:])
    return c, inv


def span_hash(c: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64))


def byte_sums(data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    return sums(_bytes[k][data], k)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slabs(offs: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, one row at least."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


class Words:
    """The words of a slab: byte spans ``start``/``end``, row index ``row``, and per row ``first``[row]..``first``[row + 1]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, loose: bool = False):
        self.data, self.offs = data, offs
        gap = (_LOOSE if loose else _SPACE)[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        word = ~gap
        begin, finish = word.copy(), word.copy()
        if len(data):
            begin[1:] &= gap[:-1] | edge[1:-1]
            finish[:-1] &= gap[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offs)
        self.row = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, k: int = 0) -> np.ndarray:
        c, inv = byte_sums(self.data, k)
        return span_hash(c, inv, self.start, self.end)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space between those of a row, and where each starts and ends in them."""
        edges = np.zeros(len(self.data) + 1, np.int8)
        edges[self.start] += 1
        edges[self.end] -= 1  # a word may start where another row's ends
        keep = np.cumsum(edges[:-1], dtype=np.int8) > 0
        after = self.end[self.end < len(self.data)]
        after = after[~keep[after]]
        data = self.data.copy()
        data[after] = 32
        keep[after] = True
        place = np.cumsum(keep) - 1
        return data[keep], place[self.start], place[self.end - 1] + 1

    def windows(self, hashes: np.ndarray, width: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Start index and hash of every window of ``width`` words that stays in its row."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[width - 1 :])
        c, inv = sums(hashes, k)
        return at, span_hash(c, inv, at, at + width)


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    size = end - start
    offs = np.append(0, np.cumsum(size))
    at = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def lowered_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 that Spark's bigint holds."""
    return x.view(np.int64)
