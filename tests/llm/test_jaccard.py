from __future__ import annotations

import itertools
import random

import pytest

from textloom.llm.components import components
from textloom.llm.jaccard_join import jaccard_classes, least_agreement, one_of_each_class

from .helpers import LONG, corpus, frame, words


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, threshold):
    """Class id and links of every row."""
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))
    links = [0] * len(rows)

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a] | sets[b])):
            links[a] += 1
            links[b] += 1
            top[max(root(a), root(b))] = min(root(a), root(b))
    classes: dict = {}
    for a, (d, _) in enumerate(rows):
        classes.setdefault(root(a), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in classes.items()}
    return sorted(((d, least[root(a)], links[a]) for a, (d, _) in enumerate(rows)), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    base = [f"n{k}" for k in range(120)]
    out = []
    for k in range(40):
        t = list(base)
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = f"e{k}{rng.randrange(9)}"
        out.append((500 + k, " ".join(t)))
    return out


def test_long_near_copies_make_blocks_of_bounded_weight(spark, monkeypatch):
    """Blocks are cut by shingles as well as by nodes: near copies of 60,000 words, two or so a block."""
    monkeypatch.setattr("textloom.llm.jaccard_join.WEIGHT", 100_000)
    rows = [(k, LONG + f" tail{k} and more{k}") for k in range(6)] + [(9, "short one " * 4), (10, "short one " * 4 + "x")]
    assert found(jaccard_classes(frame(spark, rows), 0.8)) == brute(rows, 0.8)


@pytest.mark.parametrize("threshold", [0.8, 0.9])
def test_classes(spark, threshold, monkeypatch):
    monkeypatch.setattr("textloom.llm.jaccard_join.BLOCK", 16)
    rows = [*corpus(5), *near_copies(1), (900, LONG), (901, LONG + " tail"), (None, None), (902, "")]
    assert found(jaccard_classes(frame(spark, rows), threshold)) == brute(rows, threshold)


def found(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=str)


def test_rows_that_repeat_or_share_an_id(spark):
    text, other = " ".join(f"n{k}" for k in range(60)), " ".join(f"q{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text + " tail")]
    assert found(jaccard_classes(frame(spark, rows))) == [(1, 1, 2), (1, 1, 2), (2, 1, 2)]
    rows = [(1, text), (1, other), (2, text + " tail"), (3, text), (3, text), (None, text), (None, text), (None, other + " end"), (None, "alone by itself"), *near_copies(7), *near_copies(7)[:9]]
    df = frame(spark, rows)
    assert found(jaccard_classes(df)) == brute(rows, 0.8)
    left = one_of_each_class(spark, df, "")
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect() if r["doc_id"] is None or r["doc_id"] < 500) == [("1", text), ("1", other), ("None", "alone by itself")]
    assert left.columns == df.columns


def test_stage_and_edges(spark):
    rows = [*near_copies(2), (1, None), (2, ""), (2, ""), (None, "n1 n2"), (None, "n1 n2"), (3, "n1 n2"), (4, "n1 n2"), (None, "m1"), (None, "m1"), (None, None)]
    df = frame(spark, rows)
    kept = one_of_each_class(spark, df, "")
    ids = [r["doc_id"] for r in kept.collect()]
    want = {d for d, c, _ in brute(rows, 0.8) if c == d and d is not None}
    assert kept.columns == df.columns and ids.count(None) == 2 and {i for i in ids if i is not None} == want and ids.count(2) == 2 and ids.count(3) == 1
    assert jaccard_classes(frame(spark, [])).count() == 0 and one_of_each_class(spark, frame(spark, []), "").count() == 0
    with pytest.raises(ValueError):
        jaccard_classes(df, 0.2)


def test_pruning_keeps_the_threshold():
    least = least_agreement(0.8, 1e-4)
    assert least == sorted(least) and least[-1] < 0.8 * 128


def test_components(spark):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + rng.randrange(50)) for _ in range(60)] + [(7, 7)]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(41)) and all(v == 100 for k, v in got.items() if k >= 100)


def test_components_of_long_chains(spark):
    rng = random.Random(3)
    ids = rng.sample(range(10_000), 800)
    edges = [*zip(ids[:400], ids[1:400]), *zip(ids[400:], ids[401:]), *((20_000 + k, 20_001 + k) for k in range(300))]
    got = {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {**{i: min(ids[:400]) for i in ids[:400]}, **{i: min(ids[400:]) for i in ids[400:]}, **{20_000 + k: 20_000 for k in range(301)}}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    want = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(300):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert {r["node"]: r["class"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == want
