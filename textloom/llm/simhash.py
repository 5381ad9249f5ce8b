"""SimHash near duplicates by pigeonhole blocks (operator 13).

A fingerprint has a bit set where over half of a text's shingle hashes have it. Distinct
fingerprints are nodes. Cut into m blocks, two that differ in at most d bits agree in m - d blocks
at least, so every choice of m - d blocks is a key, and nodes that share a key are compared by
their Hamming distance; m grows with the number of nodes, so that unlike nodes seldom share one.
Only a forest of each bucket's links leaves its task, which connects what all of its links connect.

A bucket beyond ``LARGE`` isn't compared pair by pair. Two fingerprints that differ in at most d
bits have one between them that differs from each in at most ceil(d / 2), and two that
have such a point in common are linked or, for odd d, looked at; so the members' balls are joined
on their points, which takes a number of points that grows with the members, not with
their pairs. Points are dealt out by parities of random bits: the slice of a member and that of
a mask give the slice of their sum, so a task makes only the points of its own slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .session import read_table, staged
from .vectext import Words, lowered_ascii, signed, slabs, utf8

WIDTH, DISTANCE, SEED = 4, 4, 42
#: Members of a bucket that is compared pair by pair; points that a slice holds on average; shingles at a time.
LARGE, POINTS, BLOCK = 1 << 14, 1 << 23, 1 << 17
#: Bytes of a shingle that is hashed by itself.
SINGLE = 1 << 12
# fixed values: the primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of bytes at once: each step of the hash is taken for all spans that are long enough."""
    padded = np.append(data, np.zeros(8, np.uint8))
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    halves = np.ndarray(len(padded) - 7, "<u4", padded, strides=(1,))
    s = np.uint64(seed)
    with np.errstate(over="ignore"):
        out = np.full(len(start), s + _P5, np.uint64)
        stripes = size >> 5
        far = np.flatnonzero(size > SINGLE)
        long = np.flatnonzero((stripes > 0) & (size <= SINGLE))
        if len(long):
            acc = [np.full(len(long), v, np.uint64) for v in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            at, k = np.arange(len(long)), 0
            while len(at):
                here = start[long[at]] + 32 * k
                for q in range(4):
                    acc[q][at] = _round(acc[q][at], lanes[here + 8 * q])
                k += 1
                at = at[stripes[long[at]] > k]
            mixed = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for q in range(4):
                mixed = (mixed ^ _round(np.uint64(0), acc[q])) * _P1 + _P4
            out[long] = mixed
        out += size.astype(np.uint64)
        here, left = start + (stripes << 5), size & 31
        for k in range(3):
            at = np.flatnonzero(left >= 8 * (k + 1))
            out[at] = _turn(out[at] ^ _round(np.uint64(0), lanes[here[at] + 8 * k]), 27) * _P1 + _P4
        here = here + (left & 24)
        at = np.flatnonzero(left & 4)
        out[at] = _turn(out[at] ^ (halves[here[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        here = here + (left & 4)
        for k in range(3):
            at = np.flatnonzero((left & 3) > k)
            out[at] = _turn(out[at] ^ (padded[here[at] + k].astype(np.uint64) * _P5), 11) * _P1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        out ^= out >> np.uint64(32)
    for k in far.tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]].tobytes(), seed)
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text of a slab; texts without words have zero."""
    words = Words(lowered_ascii(data), offs)
    n, count = len(words), np.diff(words.first)
    out = np.zeros(len(count), np.uint64)
    if not n:
        return out
    joined, start, end = words.joined()
    # a shingle begins at each word that has width - 1 more behind it in its text, or at a shorter text's first
    last = np.minimum(np.arange(n) + width, words.first[words.row + 1])
    begins = np.flatnonzero((last - np.arange(n) == width) | (np.arange(n) == words.first[words.row]))
    row, size = words.row[begins], end[last[begins] - 1] - start[begins]
    ones = np.zeros((len(count), 64), np.int64)
    for k in range(0, len(begins), BLOCK):
        part = slice(k, k + BLOCK)
        hashes = xxh64(joined, start[begins[part]], size[part])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, row[part][1:] != row[part][:-1]))
        ones[row[part][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    total = np.bincount(row, minlength=len(count))
    over = (2 * ones > total[:, None]).astype(np.uint8)
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _fingerprinted(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            made = [fingerprints(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], width) for i, j in slabs(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed(np.concatenate([np.zeros(0, np.uint64), *made])))], names=["doc_id", "print"])

    return run


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of rows a[k] and b[k]; a class is named by its least row."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def _close(group: np.ndarray, prints: np.ndarray, distance: int) -> np.ndarray:
    """Each row's class by links within groups (ascending)."""
    label = np.arange(len(prints))
    end = np.searchsorted(group, group, side="right")
    at, step = np.arange(len(prints)), 0
    while True:
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            return label
        near = at[label[at] != label[at + step]]
        near = near[np.bitwise_count(prints[near] ^ prints[near + step]) <= distance]
        unite(label, near, near + step)


def _links(label: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    on = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(signed(prints[on])), pa.array(signed(prints[label[on]]))], names=["a", "b"])


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """The sorted rows' columns, cut between groups; a group is the values of all columns but the last."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * columns
    for batch in batches:
        held = [np.append(h, batch.column(k).to_numpy(zero_copy_only=False)) for k, h in enumerate(held)]
        if not len(held[0]):
            continue
        same = np.logical_and.reduce([h == h[-1] for h in held[:-1]])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield [h[:cut] for h in held]
            held = [h[cut:] for h in held]
    if len(held[0]):
        yield held


def _bucketed(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) of rows (way, key, print) sorted by (way, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for way, key, found in _whole_groups(batches, 3):
            group = np.cumsum(np.append(0, (way[1:] != way[:-1]) | (key[1:] != key[:-1])))
            prints = found.view(np.uint64)
            yield _links(_close(group, prints, distance), prints)

    return run


def block_masks(m: int) -> list[int]:
    """64 bits in m blocks, the first ones a bit longer where m doesn't divide 64."""
    ends = [64 * k // m for k in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:], strict=False)]


def ways(n: int, distance: int) -> list[int]:
    """The bits that each key has: all choices of m - distance of m blocks, for the m of least cost with n nodes.

    A key costs a row to send, a pair that shares one without need about a 500th of that.
    """

    def cost(m: int) -> float:
        return comb(m, distance) * (n + n * n / 2 / 2 ** (64 * (m - distance) / m) / 500)

    m = min(range(distance + 1, min(distance + 8, 64)), key=cost)
    return [sum(chosen) for chosen in combinations(block_masks(m), m - distance)]


def ball(radius: int) -> np.ndarray:
    """All words of 64 bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)


def _parities(words: np.ndarray, checks: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.int64)
    for k, c in enumerate(checks):
        out |= (np.bitwise_count(words & c) & 1).astype(np.int64) << k
    return out


def _sliced(masks: np.ndarray, checks: np.ndarray, distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (a, b) of rows (slice, print) sorted by slice: members whose balls meet in a point of the slice."""
    of_mask = _parities(masks, checks)
    order = np.argsort(of_mask, kind="stable")
    ends = np.searchsorted(of_mask[order], np.arange((1 << len(checks)) + 1))

    def points(prints: np.ndarray, own: np.ndarray, here: int) -> tuple[np.ndarray, np.ndarray]:
        z, who = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s in np.unique(own).tolist():
            members = np.flatnonzero(own == s)
            used = masks[order[ends[here ^ s] : ends[(here ^ s) + 1]]]
            z.append((prints[members][:, None] ^ used[None, :]).ravel())
            who.append(np.repeat(members, len(used)))
        return np.concatenate(z), np.concatenate(who)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slices, found in _whole_groups(batches, 2):
            first = np.flatnonzero(np.append(True, slices[1:] != slices[:-1]))
            for a, b in zip(first, [*first[1:], len(slices)], strict=True):
                prints = found[a:b].view(np.uint64)
                z, who = points(prints, _parities(prints, checks), int(slices[a]))
                by = np.argsort(z, kind="stable")
                z, who = z[by], who[by]
                label = np.arange(len(prints))
                if distance % 2:  # members of one ball may be one bit too far apart, so they are compared
                    group = np.cumsum(np.append(0, z[1:] != z[:-1]))
                    tied = _close(group, prints[who], distance)
                    unite(label, who, who[tied])
                else:
                    same = np.flatnonzero(z[1:] == z[:-1])
                    unite(label, who[same], who[same + 1])
                yield _links(label, prints)

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, large: int = LARGE, points: int = POINTS) -> DataFrame:
    """Edges (a, b) that connect what differs in at most ``distance`` bits, for distinct fingerprints ``print``."""
    found = ways(nodes.count(), distance)
    keys = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("way"), F.col("print").bitwiseAND(int(np.uint64(mask).view(np.int64))).alias("key")) for k, mask in enumerate(found)]))
    dealt = nodes.select("print", keys.alias("k")).select("k.way", "k.key", "print")
    sizes = staged(dealt.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    most = sizes.agg(F.max("n"), F.sum(F.when(F.col("n") > large, F.col("n")))).first()
    pairs = dealt.join(sizes.filter(F.col("n") <= large).select("way", "key"), ["way", "key"], "left_semi") if (most[0] or 0) > large else dealt
    out = pairs.repartition("way", "key").sortWithinPartitions("way", "key").mapInArrow(_bucketed(distance), "a bigint, b bigint")
    if not most[1]:
        return out
    hot = staged(dealt.join(sizes.filter(F.col("n") > large).select("way", "key"), ["way", "key"], "left_semi").select("print").distinct(), "hot")
    masks = ball((distance + 1) // 2)
    bits = min(20, max(4, int(np.ceil(np.log2(hot.count() * len(masks) / points + 1)))))
    checks = np.random.default_rng(SEED).integers(0, 1 << 63, bits, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(SEED + 1).integers(0, 2, bits, dtype=np.uint64)
    own: Column = F.lit(0).cast("bigint")
    for k, c in enumerate(signed(checks).tolist()):
        own = own.bitwiseOR(F.shiftleft((F.bit_count(F.col("print").bitwiseAND(c)) % 2).cast("bigint"), k))
    turns = F.array(*[F.lit(x).cast("bigint") for x in np.unique(_parities(masks, checks)).tolist()])
    sliced = hot.select(F.explode(F.transform(turns, lambda x: x.bitwiseXOR(own))).alias("slice"), "print")
    return out.unionByName(sliced.repartition("slice").sortWithinPartitions("slice").mapInArrow(_sliced(masks, checks, distance), "a bigint, b bigint"))


def simhash_classes(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for each row.

    Null, empty and wordless texts have the fingerprint zero and are linked like others; texts may
    be of any length. Rows with equal fingerprints are one node, so copies and repeated rows
    cost nothing; of ids null counts for nothing in component_id, which is null where all are.
    An empty table gives an empty one; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = staged(texts.mapInArrow(_fingerprinted(width), f"doc_id {kind}, print bigint"), "prints")
    nodes = staged(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "nodes")
    label = components(staged(links(nodes.select("print"), distance, large), "links")).withColumnRenamed("node", "print")
    named = nodes.join(label, "print", "left").withColumn("class", F.coalesce("class", "print"))
    least = named.groupBy("class").agg(F.min("first").alias("component_id"))
    own = staged(named.join(least, "class").select("print", "component_id"), "named")
    return prints.join(own, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(read_table(spark, sf_dir, "documents"))
