from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import repeats
from textloom.llm.vectext import mix
from textloom.llm.substring_dedup import dedup_substrings, recompress, roots
from textloom.llm.suffix_dedup import Shard, dedup_suffixes, merge, repeated_intervals, suffix_array, without_repeats

from .helpers import LONG, corpus, frame, words


def order_of(spark, rows):
    """The documents' order, as the operators state it: id, null last, then the hash of the text."""
    hashes = [r[0] for r in spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "k int, text string").repartition(1).sortWithinPartitions("k").select(F.xxhash64("text")).collect()]
    return [((d is None, d or 0), h) for (d, _), h in zip(rows, hashes, strict=True)]


def brute(spark, units, width, rows):
    """Which units of each row go; rows as (id, text), equal ones are one document."""
    order, seen, done = order_of(spark, rows), set(), {}
    for i in sorted(range(len(rows)), key=order.__getitem__):
        if order[i] in done:
            continue
        u = units(rows[i][1])
        gone = [False] * len(u)
        for k in range(len(u) - width + 1):
            w = tuple(u[k : k + width]) if not isinstance(u, bytes) else u[k : k + width]
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        done[order[i]] = gone
    return [done[o] for o in order]


def utf8(text):
    return (text or "").encode()


def crowded(seed):
    """Rows that share ids or have none, some of them equal, with passages that repeat among them."""
    rng = random.Random(seed)
    passage = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(60)) for _ in range(3)]
    rows = [(rng.choice([1, 2, 3, None, None]), " ".join([f"o{k}", rng.choice(passage), "-", rng.choice(passage), f"{k}"][rng.randrange(2) :])) for k in range(24)]
    return [*rows, *rows[::5], (None, "x"), (None, "short"), (2, ""), (2, None), (None, passage[0] + " " + passage[0])]


def compare_words(spark, rows):
    gone = brute(spark, words, 20, rows)
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in dedup_substrings(frame(spark, rows)).collect())))
    kept = [" ".join(w for w, g in zip(words(t), gone[i], strict=True) if not g) for i, (_, t) in enumerate(rows)]
    assert got == sorted(map(str, ((d, len(words(t)), sum(gone[i]), hashlib.sha256(kept[i].encode()).hexdigest()) for i, (d, t) in enumerate(rows))))


def compare_bytes(spark, rows, piece):
    gone = brute(spark, utf8, 100, rows)
    got = sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in dedup_suffixes(frame(spark, rows), piece=piece).collect())))
    want = []
    for i, (doc, t) in enumerate(rows):
        kept = bytes(b for b, g in zip(utf8(t), gone[i], strict=True) if not g)
        spans = sum(g and not (k and gone[i][k - 1]) for k, g in enumerate(gone[i]))
        want.append(str((doc, len(gone[i]), sum(gone[i]), spans, hashlib.sha256(kept).hexdigest())))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    compare_words(spark, [*corpus(seed), (999, LONG[:20_000]), (1000, LONG[5_000:15_000])])
    compare_words(spark, crowded(seed))


@pytest.mark.parametrize(("seed", "piece"), [(1, 1 << 20), (2, 500)])
def test_suffixes(spark, seed, piece):
    compare_bytes(spark, [*corpus(seed), (999, LONG[:20_000]), (1000, "é" + LONG[5_000:15_000])], piece)  # 500: most buckets are merged in pieces
    compare_bytes(spark, crowded(seed), piece)


def test_text_that_repeats_itself(spark):
    block = " ".join(f"w{k * 7919 % 1000}" for k in range(150)) + " "
    text = block * 3000  # 2 MB
    got = dedup_suffixes(frame(spark, [(1, text), (2, "own " + text)]), piece=1 << 18).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: len(text) - len(block), 2: len(text) + 1}
    got = dedup_substrings(frame(spark, [(1, text), (2, "own " + text)])).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 2999 * 150, 2: 3000 * 150}


def test_equal_ids_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(50))
    got = dedup_substrings(frame(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 50)]
    assert dedup_substrings(frame(spark, [])).count() == 0 and dedup_suffixes(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        dedup_suffixes(frame(spark, []), width=10)


def test_stage_keeps_columns(spark):
    text = " ".join(f"w{k}" for k in range(80))
    df = frame(spark, [(1, text), (2, "own words " + text), (3, text), (4, None), (None, "x y"), (5, "")]).withColumn("n_chars", F.length("text"))
    out = without_repeats(spark, df, "")
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == df.columns and set(got) == {1, 2, 4, 5, None} and got[1] == text and got[2].startswith("own words")
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_stage_cuts_rows_not_ids(spark):
    passage, other = (" ".join(f"{x}{k}" for k in range(90)) for x in "pq")
    rows = [(1, passage), (2, f"aa bb {passage} cc dd"), (2, other), (None, other + " tail"), (None, "alone " * 3), (None, passage)]
    got = sorted((str(r["doc_id"]), r["text"]) for r in without_repeats(spark, frame(spark, rows), "").collect())
    assert got == sorted([("1", passage), ("2", "aa bb  cc dd"), ("2", other), ("None", " tail"), ("None", "alone " * 3)])


@pytest.mark.parametrize("seed", range(5))
def test_roots_name_contents(seed):
    rng = np.random.default_rng(seed)
    names = mix(rng.integers(1, 4, 4000).astype(np.uint64))
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(1, 60, 3000)
    seen: dict = {}
    for r, a, b in zip(roots(names, start, end).tolist(), start, end, strict=True):
        assert seen.setdefault(r, names[a:b].tobytes()) == names[a:b].tobytes()
    assert len(seen) == len({names[a:b].tobytes() for a, b in zip(start, end, strict=True)})


def test_recompression_is_local():
    rng = np.random.default_rng(3)
    for _ in range(50):
        common = rng.integers(0, 4, 30).astype(np.uint64)
        parts = [np.concatenate([rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64), common, rng.integers(0, 4, rng.integers(1, 30)).astype(np.uint64)]) for _ in range(2)]
        sets = []
        for p in parts:
            at = next(k for k in range(len(p) - 29) if (p[k : k + 30] == common).all())
            name, lo, hi = recompress(p, np.zeros(len(p), np.int64))
            inside = (lo >= at) & (hi <= at + 30)
            sets.append(list(zip(name[inside], lo[inside] - at, hi[inside] - at, strict=True)))
        assert sets[0] == sets[1]


def test_range_argmin():
    rng = np.random.default_rng(1)
    names = rng.integers(0, 1 << 62, 50).astype(np.uint64)
    f = rng.integers(0, 50, 200)
    g = np.minimum(49, f + rng.integers(-1, 25, 200))
    want = [int(a + names[a : b + 1].argmin()) if b >= a else -1 for a, b in zip(f, g, strict=True)]
    assert repeats.range_argmin(names, f, g).tolist() == want


def joined(strings):
    return np.frombuffer(b"".join(strings), np.uint8), np.array([len(x) for x in strings])


@pytest.mark.parametrize("seed", range(25))
def test_merged_transforms(seed):
    rng = random.Random(seed)
    depth = rng.choice([2, 3, 5, 9, 30])
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
    string, offset, interval = repeated_intervals(*joined(strings), depth, shard_bytes=rng.choice([5, 20, 1000]))
    got: dict = {}
    for s, o, i in zip(string.tolist(), offset.tolist(), interval.tolist(), strict=True):
        got.setdefault(i, []).append((s, o))
    want: dict = {}
    for s, x in enumerate(strings):
        for o in range(len(x) - depth + 1):
            want.setdefault(x[o : o + depth], []).append((s, o))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


@pytest.mark.parametrize("seed", range(10))
def test_common_prefixes_of_merged_shards(seed):
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25))) for _ in range(6)]
    shards = [Shard(*joined(strings[k : k + 2])) for k in (0, 2, 4)]
    _, _, shared = merge(shards, 10, step=1)
    suffixes = [(x[o:], 1 if o < len(x) else 0) for x in strings for o in range(len(x) + 1)]
    place, base = [], 0
    for k, s in zip((0, 2, 4), shards, strict=True):
        own = [x[o:] for x in strings[k : k + 2] for o in range(len(x) + 1)]
        place += [own[p] for p in s.order]
        base += len(own)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b), 10) and a[n] == b[n]:
            n += 1
        return n

    assert len(suffixes) == len(place)
    assert shared.tolist() == [max((common(a, b) for j, b in enumerate(place) if j != i), default=0) for i, a in enumerate(place)]


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(30):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randint(1, 5))]
        text = b"\0".join([*strings, b""])
        want = sorted(range(len(text)), key=lambda k: (text[k:].split(b"\0")[0] + b"\0", text[:k].count(b"\0")))
        assert suffix_array(np.frombuffer(text, np.uint8)).tolist() == want


def test_long_repeats_fit_their_places():
    n, each = 400_000, 50  # 20 million windows in a row, all but the first segment repeated
    start = np.arange(n, dtype=np.int64) * each + 1000
    same, none = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    out = repeats._combined([(same, same, none, none, start, np.full(n, each))]).to_pydict()
    spans = [(s, c) for k, s, c in zip(out["kind"], out["start"], out["count"], strict=True) if k == 0]
    gone = repeats.covered(1000 + n * each, *map(np.array, zip(*spans, strict=True)), 1)
    assert len(spans) == 1 and not gone[: 1000 + each].any() and gone[1000 + each :].all()
