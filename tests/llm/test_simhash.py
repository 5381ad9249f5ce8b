from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from textloom.llm.simhash import ball, block_masks, fingerprints, links, simhash_classes, ways, xxh64
from textloom.llm.vectext import utf8

from .helpers import LONG, corpus, frame


def fingerprint(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[k : k + width]).encode(), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, distance):
    """Each fingerprint's class, by its least member's place."""
    a, top = np.array(prints, np.uint64), list(range(len(prints)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for k in range(len(a)):
        for other in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= distance) + k + 1:
            x, y = root(k), root(int(other))
            top[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(a))]


def brute(rows, distance=4):
    prints = [fingerprint(t) for _, t in rows]
    group = classes(prints, distance)
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min((x for x in (d, least.get(g)) if x is not None), default=None)
    return sorted(((d, f"{p:016x}", least[g]) for (d, _), p, g in zip(rows, prints, group, strict=True)), key=str)


def test_hashes_of_many_spans():
    rng = random.Random(3)
    spans = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(140), 500, 4096, 4097, 9000]]
    size = np.array([len(s) for s in spans])
    got = xxh64(np.frombuffer(b"".join(spans), np.uint8), np.cumsum(size) - size, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(s, 42) for s in spans]


def test_fingerprints():
    rng = random.Random(5)
    texts = [None, "", "  ", "A", "a B", "É x\ty\n", "One two THREE four five", "x" * 5000 + " b c d e", "w " * 900, " lead", "trail ", "a b c d", LONG]
    texts += [" ".join(rng.choice("abcdefgHIJ") * rng.randrange(1, 12) for _ in range(rng.randrange(60))) for _ in range(200)]
    data, offs = utf8(pa.array(texts))
    assert fingerprints(data, offs).tolist() == [fingerprint(t) for t in texts]


def near(seed, n):
    """Texts of which many differ by a word or two."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(300)]
    out = []
    for k in range(n):
        t = list(base)
        for _ in range(rng.randrange(5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(40)}"
        out.append((1000 + k, " ".join(t)))
    return out


@pytest.mark.parametrize("large", [1 << 14, 3])
def test_classes(spark, large):
    rows = [*corpus(2), *near(1, 120), (None, "own text without an id"), (None, None), (7000, LONG), (7001, LONG + " tail"), (3, "an id again")]
    want = brute(rows)
    got = simhash_classes(frame(spark, rows), large=large).select("doc_id", "fingerprint", "component_id")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({c for *_, c in want}) < len({f for _, f, _ in want})  # different fingerprints are linked


def test_empty_table(spark):
    assert simhash_classes(frame(spark, [])).collect() == []


@pytest.mark.parametrize(("distance", "large", "points"), [(4, 1 << 14, 1 << 20), (4, 8, 1 << 12), (3, 8, 1 << 14), (0, 8, 1 << 12), (1, 4, 1 << 12), (2, 8, 1 << 10)])
def test_links_connect_what_all_links_connect(spark, distance, large, points):
    """Chains and dense groups of fingerprints, in buckets compared pair by pair and by the points between."""
    rng = random.Random(distance)
    prints = set()
    for _ in range(6):
        at = rng.getrandbits(64)
        for _ in range(40):
            prints.add(at)
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                at ^= 1 << b
        centre = rng.getrandbits(64)
        prints.update(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(60))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(p,) for p in signed], "print bigint").repartition(3)
    place = {p: k for k, p in enumerate(signed)}
    top = list(range(len(prints)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links(nodes, distance, large, points).collect():
        x, y = root(place[a]), root(place[b])
        top[max(x, y)] = min(x, y)
    assert [root(k) for k in range(len(top))] == classes(prints, distance)


@pytest.mark.parametrize("n", [10, 10**6, 10**9, 10**12])
@pytest.mark.parametrize("distance", [0, 1, 4])
def test_close_pairs_share_a_key(n, distance):
    found, rng = ways(n, distance), random.Random(n)
    for _ in range(50):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), distance):
            b ^= 1 << bit
        assert any(a & mask == b & mask for mask in found)


def test_blocks_and_balls():
    assert all(sum(block_masks(m)) == (1 << 64) - 1 for m in range(1, 13))
    assert len(ball(2)) == 1 + 64 + 64 * 63 // 2 and int(np.bitwise_count(ball(2)).max()) == 2
