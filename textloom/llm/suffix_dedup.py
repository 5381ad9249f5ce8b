"""Suffix-array dedup: repeated byte strings by merging Burrows-Wheeler transforms (operator 5).

Documents become shards, each with its own suffix array and transform, and transforms are merged
by interleave refinement: a pass orders the rows of all shards by the characters before them,
stably, and follows each to the row that begins there, so rows come to be ordered by ever longer
prefixes, and no suffixes are sorted anew. Intervals part where characters or the interval before
differ; the last pass in which a row has company gives its common prefix, and the intervals whose
common prefix reaches the width are the repeated strings. Nothing else decides a repeat, but for
what survives in the pieces of an interval group too large for a task (see ``_cross``).

A merge of everything with everything would take a pass over the corpus for every character, so
strings only meet where they can repeat. Every window elects the least of its 28-byte grams;
windows that are equal elect equal grams, so a group of one gram holds all copies of its windows
(``repeats``). A group belongs to the first place that has its gram, neighbouring groups that
belong to one stretch of one document form a bucket, and shards of a bucket are merged. This
happens twice: among the documents that a task holds, after which only first occurrences go
on, and then across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import columns, covered, segments, with_spans
from .session import fresh, read_table, staged
from .vectext import SLAB, _bytes, mix, signed, slabs, span_hash, sums, utf8

WIDTH = 100
GRAM = 28
#: Bytes of a shard, of the shards that are merged at a time, and of a bucket beyond which it is merged in pieces.
SHARD, MERGE, PIECE = 1 << 14, 1 << 16, 1 << 22
#: Segments that a task holds before it merges them and passes the first ones on.
HOLD = 1 << 19
#: Units of a document whose groups form one bucket.
CELL = 12
_ROWS = "kind tinyint, key bigint, doc bigint, row bigint, start bigint, count bigint"


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _bytes[0][data], np.repeat(np.arange(len(offs) - 1), np.diff(offs)), offs


def elect(width: int) -> Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least hash of GRAM bytes stands for a window."""

    def run(values: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c, inv = sums(values, 0)
        n, span = len(values) - GRAM + 1, width - GRAM + 1
        name = mix((c[GRAM:] - c[:-GRAM]) * inv[:n])
        table = (name & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            table = np.minimum(table[:-step], table[step:])
            step *= 2
        table = np.minimum(table[: n - span + 1], table[span - step : span - step + n - span + 1]) if span > step else table
        lo = np.arange(n)
        return (table[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), lo, lo + GRAM

    return run


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, for strings of symbols above 0 that end in 0; of equal ones the earlier string is less.

    Eight symbols make a first key; ranks of what is still equal are doubled.
    """
    n = len(symbols)
    key, inside = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(8):
        here = np.zeros(n, np.uint64)
        here[: max(0, n - k)] = symbols[k:]
        here[~inside] = 0
        inside &= here != 0
        key = (key << np.uint64(8)) | here
    order = np.argsort(key)
    key = key[order]
    ended = np.flatnonzero(key & np.uint64(0xFF) == 0)  # of equal ones the earlier is less
    order[ended] = order[ended][np.lexsort((order[ended], key[ended]))]
    new = np.append(True, (key[1:] != key[:-1]) | (key[1:] & np.uint64(0xFF) == 0))
    rank, step = np.empty(n, np.int64), 8
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        single = np.append(new, True)
        slots = np.flatnonzero(~(single[:-1] & single[1:]))
        if not len(slots):
            return order
        at = order[slots]
        after, own = rank[at + step], rank[at]
        again = np.argsort((own << 32) | after)
        at, after, own = at[again], after[again], own[again]
        order[slots] = at
        head = np.append(True, (own[1:] != own[:-1]) | (after[1:] != after[:-1]))
        new[slots] = head
        rank[at] = np.maximum.accumulate(np.where(head, slots, 0))
        step *= 2


class Shard:
    """Strings (bytes one after another, and lengths), their suffix array, and the transform: 1 + the byte before each suffix (0: none, a string begins)."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        ends = np.cumsum(lengths + 1) - 1
        symbols, at = np.zeros(int(ends[-1]) + 1, np.uint8), np.ones(int(ends[-1]) + 1, bool)
        at[ends] = False
        symbols[at] = data + np.uint8(1)  # UTF-8 has no byte above 0xF7
        self.order = suffix_array(symbols)
        self.transform = symbols[self.order - 1]
        self.string = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.begin = ends - lengths
        self.count = len(lengths)


def merge(shards: list[Shard], depth: int, step: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (numbered through all shards) that share their first ``depth`` characters with another, in merged order; their interval; and for every row its longest common prefix with another, up to ``depth`` and as passes tell it (exact with a ``step`` of 1).

    A pass that takes the interleave from the first h to h + 1 characters sorts by the character
    before each row and follows it to the row that starts there. Up to ``step`` of these (1, 2, 4
    or 8, as long as their joint codes fit 16 bits) are taken at once. A row alone in its
    interval is settled, and so is whatever leads on from it, so passes only touch rows whose
    order among equals still matters.
    """
    base = np.cumsum([0, *(len(s.order) for s in shards)])
    transform = np.concatenate([s.transform for s in shards])
    leads = np.zeros(len(transform), np.int32)
    for s, b in zip(shards, base, strict=False):
        by_code = np.argsort(s.transform, kind="stable")[s.count :]
        leads[b + by_code] = b + s.count + np.arange(len(by_code), dtype=np.int32)
    # for 1, 2, 4, 8 characters: their joint code (0: a string begins before), and where they lead
    joint, inside, to, steps = transform.astype(np.uint64), transform > 0, leads, [(1, transform, leads)]
    while 2 * steps[-1][0] <= min(step, depth):
        k = steps[-1][0]
        joint, inside, to = (joint[to] << np.uint64(8 * k)) | joint, inside[to] & inside, to[to]
        if k == 1:
            code = np.where(inside, joint, 0).astype(np.uint16)
        else:
            known, rank = np.unique(joint[inside], return_inverse=True)
            if len(known) >= 1 << 16:
                break
            code = np.zeros(len(joint), np.uint16)
            code[inside] = rank + 1
        steps.append((2 * k, code, to))
    rows, block = np.arange(len(transform), dtype=np.int32), np.zeros(len(transform), np.int32)
    shared = np.zeros(len(transform), np.int16)
    h = 0
    while h < depth and len(rows):
        k, of, to = next(x for x in reversed(steps) if x[0] <= depth - h)
        h += k
        now = of[rows]
        order = np.argsort(now, kind="stable")
        order = order[np.searchsorted(now[order], 1) :]  # where a string begins, nothing leads on
        now, was, rows = now[order], block[order], to[rows[order]]
        parted = np.ones(len(rows) + 1, bool)
        parted[1:-1] = (now[1:] != now[:-1]) | (was[1:] != was[:-1])
        block = np.cumsum(parted[:-1], dtype=np.int32)
        keep = ~(parted[:-1] & parted[1:])
        if not keep.all():
            rows, block = rows[keep], block[keep]
        shared[rows] = h
    return rows, block, shared


def repeated_intervals(data: np.ndarray, lengths: np.ndarray, depth: int, shard_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, offset and interval of every ``depth``-byte string that occurs at least twice, in the order of intervals."""
    shards, base, at, first, limit = [], [], 0, 0, shard_bytes or SHARD
    cut = np.flatnonzero(np.diff((np.cumsum(lengths) - 1) // limit, append=-1)) + 1
    for last in cut.tolist():
        size = int(lengths[first:last].sum())
        shards.append(Shard(data[at : at + size], lengths[first:last]))
        base.append(first)
        at, first = at + size, last
    rows, interval, _ = merge(shards, depth)
    of = np.concatenate([s.order for s in shards])[rows]
    which = np.searchsorted(np.cumsum([len(s.order) for s in shards]), rows, side="right")
    string, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for k, s in enumerate(shards):
        mine = which == k
        own = s.string[of[mine]]
        string[mine], offset[mine] = own + base[k], of[mine] - s.begin[own]
    return string, offset, interval


def later(string: np.ndarray, offset: np.ndarray, interval: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of the rows of intervals are not the first of theirs, by (doc, row, place)."""
    if not len(string):
        return np.zeros(0, bool)
    d, r, p = doc[string], row[string], start[string] + offset
    order = np.lexsort((p, r, d, interval))
    d, r, p, i = d[order], r[order], p[order], interval[order]
    head = np.maximum.accumulate(np.where(np.append(True, i[1:] != i[:-1]), np.arange(len(i)), 0))
    out = np.empty(len(i), bool)
    out[order] = (d != d[head]) | (r != r[head]) | (p != p[head])
    return out


def cut_out(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """data[at[0] : at[0] + length[0]], data[at[1] : ...] and so on, one after another."""
    first = np.cumsum(length) - length
    return data[np.repeat(at - first, length) + np.arange(int(length.sum()))]


def runs_of(*columns: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where a run begins, for sorted stretches: at a change in ``columns``, or where the stretch before has another end."""
    new = np.ones(len(start), bool)
    new[1:] = start[1:] != start[:-1] + count[:-1]
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def bucket_of(doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    return signed(mix(mix(doc.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) ^ mix(row.view(np.uint64)) + (start >> CELL).astype(np.uint64)))


def _batches(size: np.ndarray, bucket: np.ndarray, own: np.ndarray, piece: int) -> Iterator[np.ndarray]:
    """Indices of strings (in the order of buckets) that are merged together: whole buckets of MERGE bytes or just above, or a piece of a large one with its owner's strings in each."""
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    total = np.append(0, np.cumsum(size))
    a = 0
    while a < len(edges) - 1:
        b = a + 1
        while b < len(edges) - 1 and total[edges[b]] - total[edges[a]] < MERGE:
            b += 1
        if b == a + 1 and total[edges[b]] - total[edges[a]] > piece:
            at = np.arange(edges[a], edges[b])
            mine, others = at[own[at]], at[~own[at]]
            part = (np.cumsum(size[others]) - 1) // piece
            if not len(others):
                yield mine
            for k in np.unique(part):
                yield np.concatenate([mine, others[part == k]])
        else:
            yield np.arange(edges[a], edges[b])
        a = b


class _Held:
    """The segments and texts that a task holds, settled among themselves."""

    def __init__(self, width: int, piece: int):
        self.piece, self.width, self.parts, self.texts, self.size, self.count = piece, width, [], [], 0, 0

    def add(self, data: np.ndarray, key: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((key, doc, row, start, count, at + self.size))
        self.texts.append(data)
        self.size += len(data)
        self.count += len(key)

    def settled(self) -> pa.RecordBatch:
        """Repeated stretches (kind 0), and segments without another of their gram or with first windows (kind 1)."""
        key, doc, row, start, count, at = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        data = np.concatenate(self.texts)
        order = np.lexsort((start, row, doc, key))
        key, doc, row, start, count, at = (x[order] for x in (key, doc, row, start, count, at))
        same = np.append(False, (key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1]))
        key, doc, row, start, count, at = (x[~same] for x in (key, doc, row, start, count, at))
        new = np.append(True, key[1:] != key[:-1])
        many = ~(new & np.append(new[1:], True))
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        single = [x[~many] for x in (key, doc, row, start, count)]
        bucket = bucket_of(doc[head], row[head], start[head])[many]
        own = ((doc == doc[head]) & (row == row[head]) & (start >> CELL == start[head] >> CELL))[many]
        key, doc, row, start, count, at = (x[many] for x in (key, doc, row, start, count, at))
        if not len(key):
            return self._made([key] * 5, single, [key] * 5)
        order = np.lexsort((start, row, doc, bucket))
        key, doc, row, start, count, at, bucket, own = (x[order] for x in (key, doc, row, start, count, at, bucket, own))
        new = runs_of(bucket, doc, row, own, start >> CELL, start=start, count=count)
        f = np.flatnonzero(new)
        first = np.append(0, np.cumsum(count))
        windows = np.diff(np.append(first[f], first[-1]))
        gone = np.zeros(int(first[-1]), bool)
        for pick in _batches(windows + self.width - 1, bucket[f], own[f], self.piece):
            length = windows[pick] + self.width - 1
            string, offset, interval = repeated_intervals(cut_out(data, at[f[pick]], length), length, self.width)
            again = later(string, offset, interval, doc[f[pick]], row[f[pick]], start[f[pick]])
            gone[first[f[pick]][string[again]] + offset[again]] = True
        # the stretches that are gone, and what each segment still has between its first and last window that is not
        opens = gone & ~np.append(False, gone[:-1])
        opens[first[f]] |= gone[first[f]]
        closes = np.append(opens[1:], True) | ~np.append(gone[1:], False)
        a, b = np.flatnonzero(opens), np.flatnonzero(closes & gone)
        of = np.searchsorted(first, a, side="right") - 1
        cut = (doc[of], row[of], start[of] + a - first[of], b - a + 1)
        left = np.append(0, np.cumsum(~gone))
        lives = left[first[1:]] > left[first[:-1]]
        stay = np.flatnonzero(~gone)
        lo, hi = stay[left[first[:-1]][lives]], stay[left[first[1:]][lives] - 1]
        rest = (key[lives], doc[lives], row[lives], start[lives] + lo - first[:-1][lives], hi - lo + 1)
        spread = signed(mix(cut[0].view(np.uint64) * np.uint64(31) + cut[2].view(np.uint64)))
        return self._made([spread, *cut], single, rest)

    @staticmethod
    def _made(cut: list[np.ndarray], single: list[np.ndarray], rest: list[np.ndarray]) -> pa.RecordBatch:
        kind = np.concatenate([np.zeros(len(cut[0]), np.int8), np.ones(len(single[0]) + len(rest[0]), np.int8)])
        out = [np.concatenate(x) for x in zip(cut, single, rest, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, out)], names=["kind", "key", "doc", "row", "start", "count"])


def _anchored(width: int, piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(width, piece)
        for batch in batches:
            data, offs = utf8(batch.column(2))
            doc, row = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for i, j in slabs(offs):
                values, of, first = units(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                key, _, at, count = segments(values, of, width, elect(width), None)
                if len(key):
                    r = of[at]
                    held.add(data[offs[i] : offs[j]], signed(key), doc[i + r], row[i + r], at - first[r], count, at)
                if held.count >= HOLD or held.size >= 64 * SLAB:
                    yield held.settled()
                    held = _Held(width, piece)
        if held.count:
            yield held.settled()

    return run


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of segments in the order of (key, doc, row, start): those whose gram has another place, with their bucket and whether they are of its first document (kind 1); repeated stretches as they are (kind 0)."""
    state = None  # key, the first's doc, row and start, and the first itself while it is alone
    for batch in batches:
        kind, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        done = [c[kind == 0] for c in columns[1:]]
        key, doc, row, start, count = (c[kind == 1] for c in columns)
        n = len(key)
        waiting = None
        if n:
            new = np.append(True, key[1:] != key[:-1])
            if state is not None and state[0] == key[0]:
                new[0] = False
                waiting, state = state[4], (*state[:4], None)
            head = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            old = head < 0
            fd, fr, fs = (np.where(old, state[k] if old[0] else 0, x[head]) for k, x in ((1, doc), (2, row), (3, start)))
            emit = ~(new & np.append(new[1:], True))
            held = None
            if new[-1]:
                held = tuple(int(x[-1]) for x in (doc, row, start, count))
            state = (key[-1], fd[-1], fr[-1], fs[-1], held)
            made = [np.zeros(int(emit.sum()), np.int64), bucket_of(fd, fr, fs)[emit], doc[emit], row[emit], start[emit], count[emit], ((doc == fd) & (row == fr) & (start >> CELL == fs >> CELL))[emit]]
            if waiting is not None:
                one = [np.array([x]) for x in waiting]
                made = [np.concatenate(x) for x in zip([np.zeros(1, np.int64), bucket_of(*one[:3]), *one, np.array([True])], made, strict=True)]
        else:
            made = [np.zeros(0, np.int64)] * 6 + [np.zeros(0, bool)]
        kinds = np.concatenate([np.zeros(len(done[0]), np.int8), np.ones(len(made[0]), np.int8)])
        own = np.concatenate([np.zeros(len(done[0]), bool), made[6]])
        out = [np.concatenate(x) for x in zip([np.zeros(len(done[0]), np.int64), *done], made[1:6], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(kinds), *map(pa.array, out), pa.array(own)], names=["kind", "bucket", "doc", "row", "start", "count", "own"])


_STRINGS = "deal bigint, doc bigint, row bigint, start bigint, own boolean, pieces int, content binary"


def _strings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For each document with segments to look at (doc, row, text, looks): the bytes of its runs of neighbouring segments of a bucket."""
    last = None
    for batch in batches:
        data, offs = utf8(batch.column(2))
        docs, rows, looks = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        flat, size = looks.flatten(), looks.value_lengths().to_numpy(zero_copy_only=False)
        fields = {name: flat.field(name).to_numpy(zero_copy_only=False) for name in ("bucket", "start", "count", "own", "pieces")}
        of = np.repeat(np.arange(len(size)), size)
        again = np.zeros(len(size), bool)  # equal rows are one document
        for k, own in enumerate(zip(docs, rows, strict=True)):
            again[k], last = own == last, own
        order = np.lexsort((fields["start"], fields["bucket"], of))
        order = order[~again[of[order]]]
        of, (bucket, start, count, own, pieces) = of[order], (x[order] for x in fields.values())
        f = np.flatnonzero(runs_of(of, bucket, own, start >> CELL, start=start, count=count))
        length = (np.add.reduceat(count, f) if len(f) else count[:0]) + width - 1
        at = offs[:-1][of[f]] + start[f]
        for i in range(0, max(1, len(f)), 1 << 14):  # some at a time, to bound the batches
            j = slice(i, i + (1 << 14))
            content = cut_out(data, at[j], length[j])
            ends = np.append(0, np.cumsum(length[j])).astype(np.int64)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(content)]).cast(pa.binary())
            d, r = (np.array(x, np.int64)[of[f[j]]] for x in (docs, rows))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (bucket[f[j]], d, r, start[f[j]], own[f[j]], pieces[f[j]])), binary], names=["deal", "doc", "row", "start", "own", "pieces", "content"])


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of strings in the order of deals: stretches that are not the first of their content in the deal (kind 0), and the windows of a piece that are, its owner's aside (kind 1, with hashes)."""
    held, size, last = [], 0, None

    def settle() -> pa.RecordBatch:
        doc, row, start, own, pieces, content = (np.array(x) if k < 5 else x for k, x in enumerate(zip(*held, strict=True)))
        data, length = np.frombuffer(b"".join(content), np.uint8), np.array([len(x) for x in content])
        string, offset, interval = repeated_intervals(data, length, width)
        again = later(string, offset, interval, doc, row, start)
        windows = length - width + 1
        first = np.append(0, np.cumsum(windows))
        gone = np.zeros(int(first[-1]), bool)
        gone[first[string[again]] + offset[again]] = True
        opens = gone & ~np.append(False, gone[:-1])
        opens[first[:-1]] |= gone[first[:-1]]
        closes = np.append(opens[1:], True) | ~np.append(gone[1:], False)
        a, b = np.flatnonzero(opens), np.flatnonzero(closes & gone)
        of = np.searchsorted(first, a, side="right") - 1
        ask = np.flatnonzero(~gone & np.repeat((pieces > 1) & ~own, windows))
        by = np.searchsorted(first, ask, side="right") - 1
        at = (np.cumsum(length) - length)[by] + ask - first[by]
        hashes = [span_hash(*sums(_bytes[k][data], k), at, at + width) if len(at) else np.zeros(0, np.uint64) for k in (0, 1)]
        kind = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(ask), np.int8)])
        none = np.zeros(len(a), np.int64)
        out = [np.concatenate([none, signed(h)]) for h in hashes] + [np.concatenate(x) for x in ((doc[of], doc[by]), (row[of], row[by]), (start[of] + a - first[of], start[by] + ask - first[by]), (b - a + 1, np.ones(len(ask), np.int64)))]
        return pa.RecordBatch.from_arrays([pa.array(kind), *map(pa.array, out)], names=["kind", "h0", "h1", "doc", "row", "start", "count"])

    for batch in batches:
        for deal, *string in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if deal != last and size >= MERGE:
                yield settle()
                held, size = [], 0
            last = deal
            held.append(string)
            size += len(string[-1])
    if held:
        yield settle()


def _cross(survivors: DataFrame) -> DataFrame:
    """Of windows (h0, h1, doc, row, start) that are first in their piece those that another piece has earlier: the only ones that hashes decide."""
    place = F.struct("doc", "row", "start")
    firsts = staged(survivors.groupBy("h0", "h1").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")  # written, so that the join can split a hot window
    return survivors.join(firsts.select("h0", "h1", "first"), ["h0", "h1"]).filter(place > F.col("first")).select("doc", "row", "start", "count")


def repeated_strings(docs: DataFrame, width: int = WIDTH, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, start, count): stretches of ``width``-byte strings each of which starts earlier too."""
    texts = columns(docs, id_col, text_col)
    anchors = texts.mapInArrow(_anchored(width, piece), _ROWS)
    dealt = staged(anchors.repartition("key").sortWithinPartitions("key", "doc", "row", "start").mapInArrow(_dealt, "kind tinyint, bucket bigint, doc bigint, row bigint, start bigint, count bigint, own boolean"), "dealt")
    looks = dealt.filter("kind = 1").drop("kind")
    large = looks.groupBy("bucket").agg(F.sum(F.col("count") + F.when(F.col("own"), 0).otherwise(width - 1)).alias("bytes")).filter(F.col("bytes") > piece)
    large = staged(large.select("bucket", F.ceil(F.col("bytes") / piece).cast("int").alias("pieces")), "large")
    looks = looks.join(large, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    by_row = looks.groupBy("doc", "row").agg(F.collect_set(F.struct("bucket", "start", "count", "own", "pieces")).alias("looks"))
    strings = texts.join(by_row, ["doc", "row"]).select("doc", "row", "text", "looks").mapInArrow(lambda b: _strings(b, width), _STRINGS)
    # a large bucket is dealt out by document, its owner's strings to every piece
    piece = F.when(F.col("own"), F.sequence(F.lit(0), F.col("pieces") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "row"), F.col("pieces")).cast("int")))
    strings = strings.withColumn("piece", F.explode(piece)).withColumn("deal", F.when(F.col("pieces") > 1, F.xxhash64("deal", "piece")).otherwise(F.col("deal"))).drop("piece")
    merged = strings.repartition("deal").sortWithinPartitions("deal", "doc", "row", "start").select("deal", "doc", "row", "start", "own", "pieces", "content")
    merged = staged(merged.mapInArrow(lambda b: _merged(b, width), "kind tinyint, h0 bigint, h1 bigint, doc bigint, row bigint, start bigint, count bigint"), "merged")
    stretches = [dealt.filter("kind = 0"), merged.filter("kind = 0"), _cross(merged.filter("kind = 1"))]
    found = stretches[0].select("doc", "row", "start", "count")
    for s in stretches[1:]:
        found = found.union(s.select("doc", "row", "start", "count"))
    return found


def _cut(text: np.ndarray, places: pa.Scalar, width: int) -> np.ndarray | None:
    """Which bytes go; None if none do."""
    if not places.is_valid or not len(text):
        return None
    spans = places.values
    return covered(len(text), spans.field("start").to_numpy(zero_copy_only=False), spans.field("count").to_numpy(zero_copy_only=False), width)


def _rows(width: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            places, out = batch.column(2), []
            for i in range(batch.num_rows):
                text, gone, spans = data[offs[i] : offs[i + 1]], 0, 0
                mask = _cut(text, places[i], width)
                if mask is not None:
                    gone = int(mask.sum())
                    spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    text = text[~mask]
                kept = text.tobytes()
                out.append((int(offs[i + 1] - offs[i]), gone, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else ""))
            n, gone, spans, sha, kept = zip(*out, strict=True) if out else ((), (), (), (), ())
            made = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                made.append(pa.array(kept, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(made, names=names)

    return run


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, texts: bool = True, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte in a ``width``-byte string (56 to 200) that also starts earlier.

    Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (``texts``) kept_text, which
    leaves out what a cut through a character left of it. Null and empty texts have no bytes.
    Null ids come last; rows that share an id (null ones too) come in the order of their texts'
    hashes and are compared with each other, and rows equal in id and text are one document,
    each keeping what the others keep. Texts may have any length; an empty table gives an empty
    one; other columns are ignored.
    """
    if not 2 * GRAM <= width <= 200:
        raise ValueError("width must be from 56 to 200 bytes")
    kind = dict(docs.dtypes)[id_col]
    spans = repeated_strings(docs, width, piece, id_col, text_col)
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), spans, "doc_id", "text", "places")
    return rows.mapInArrow(_rows(width, texts), f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept_text string" * texts)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read_table(spark, sf_dir, "documents"), texts=False)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their repeated strings cut out; a document of which nothing is left goes.

    Rows are cut one by one: those that share an id, or have none, keep their own texts (see
    ``dedup_suffixes`` for their order). Rows without repeats, null and empty texts among them,
    stay as they are; other columns stay, but for n_chars, which counts the new text. Texts may
    have any length; of an empty table nothing is left.
    """
    names, places = docs.columns, fresh("places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            data, offs = utf8(batch.column(at))
            texts, stays, spans = batch.column(at).to_pylist(), [], batch.column(len(names))
            for i in range(batch.num_rows):
                mask = _cut(data[offs[i] : offs[i + 1]], spans[i], WIDTH)
                if mask is not None:
                    texts[i] = data[offs[i] : offs[i + 1]][~mask].tobytes().decode("utf-8", "ignore")
                stays.append(mask is None or bool(texts[i].strip(" \t\n\x0b\x0c\r")))
            made = list(batch.columns[: len(names)])
            made[at] = pa.array(texts, made[at].type)
            if "n_chars" in names:
                k, changed = names.index("n_chars"), spans.is_valid()
                made[k] = pc.if_else(changed, pc.utf8_length(made[at]).cast(made[k].type), made[k])
            yield pa.RecordBatch.from_arrays(made, names=names).filter(pa.array(stays, pa.bool_()))

    return with_spans(docs, repeated_strings(docs.select("doc_id", "text")), "doc_id", "text", places).mapInArrow(cut, docs.schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w),
a AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS opens FROM f WHERE k > 1),
b AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM a),
s AS (SELECT doc_id, min(i) AS b, max(i) + 99 AS e FROM b GROUP BY doc_id, span),
g AS (SELECT s.doc_id, b, e, substr(h, 2 * lag(e, 1, 0) OVER o + 1, 2 * (b - 1 - lag(e, 1, 0) OVER o)) AS gap FROM s JOIN d USING (doc_id) WINDOW o AS (PARTITION BY s.doc_id ORDER BY b)),
t AS (SELECT doc_id, count(*) AS n, sum(e - b + 1) AS gone, max(e) AS e, string_agg(gap, '' ORDER BY b) AS kept FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * e + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
