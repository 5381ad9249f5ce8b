from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm.merkle import dataset_manifest, placed, proof_digest

from .helpers import CLASHES, LONG

KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[k : k + fanout])) for k in range(0, len(last), fanout)])
    return levels


def proof(levels, at, fanout):
    out = []
    for level in levels[:-1]:
        run = at - at % fanout
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + fanout])))
        at //= fanout
    return out


def brute(rows, change, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in groups[s]], fanout))
    top = tree([t[-1][0] for t in trees], fanout)
    out = []
    for g, (s, levels) in enumerate(zip(names, trees, strict=True)):
        for k, r in enumerate(groups[s]):
            path = proof(levels, k, fanout) + proof(top, g, fanout)
            h = leaf((*r[:4], change(r)))
            for before, after in path:
                h = digest(before + h + after)
            out.append((r[0], levels[0][k], levels[-1][0], top[-1][0], digest("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


def dataset(seed, n, sources):
    rng = random.Random(seed)
    text = ["a\nb", "é\n", "", "one two", None, "\n\n", "🙂 x"]
    rows = [(rng.randrange(-50, 10**6), rng.choice(sources), rng.choice(["en", None]), rng.choice([5, None]), rng.choice(text)) for _ in range(n)]
    return [*rows, *rows[:7], rows[0], (None, sources[0], None, None, None), (None, sources[0], None, None, "x\n"), (5, "only", "fr", 1, LONG + "\n")]


def found(spark, rows, fanout=3):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    for c in f"{CLASHES}, grp string, idx bigint, digest string, kids string, path int, root int, leaf int".split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = dataset_manifest(df, {"text": text}, fanout=fanout)
    return sorted((tuple(r) for r in made.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), "folded_root", "verified").collect()), key=str)


def change(r):
    return r[4].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r[4]


@pytest.mark.parametrize(("n", "sources", "fanout"), [(200, ["s", None, "", "ü", "z", "A", "b1", "b2", "b3", "b4", "b5"], 3), (40, [None], 2), (3, ["s"], 3), (90, ["hot"], 4)])
def test_manifest(spark, n, sources, fanout):
    rows = dataset(n, n, sources)
    assert found(spark, rows, fanout) == brute(rows, change, fanout)


def test_one_row_and_none(spark):
    assert found(spark, [(1, "s", "en", 2, "x")]) == brute([(1, "s", "en", 2, "x")], change)
    assert found(spark, []) == []


def test_untampered_rows_verify(spark):
    rows = dataset(1, 30, ["s", "t"])
    made = dataset_manifest(spark.createDataFrame(rows, KIND))
    assert made.filter("NOT verified").count() == 0 and made.count() == len(rows)


def test_places_of_a_hot_group(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("grp"), (F.col("id") * 7919 % 5003).alias("v"))
    got = placed(rows.repartition(5), ["v"]).collect()
    by = defaultdict(list)
    for r in got:
        by[r.grp].append((r.idx, r.v, r["size"]))
    for rows in by.values():
        rows.sort()
        assert [k for k, *_ in rows] == list(range(len(rows))) and [v for _, v, _ in rows] == sorted(v for _, v, _ in rows) and {n for *_, n in rows} == {len(rows)}
