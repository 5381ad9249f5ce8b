from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import phrases
from textloom.llm.phrases import ORACLE, collocations

from .helpers import CLASHES, LONG


def brute(rows, most, least, share, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {(lang, p[i:j]) for (lang, p), a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= share * f[lang, p[i:j]]}
    out = {}
    for (lang, p), a in candidates.items():
        if (lang, p) not in covered:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def texts(seed, n=80):
    rng = random.Random(seed)
    words = ["a", "B", "é", "É", "of", "the", "new", "York", "city", "🙂", "x-y", "d'or", "\x85"]
    out = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(60))]
        if rng.random() < 0.5:
            t[len(t) // 2 : len(t) // 2] = ["New", "york", "CITY", "hall"]
        out.append((rng.choice(["en", "en", "fr", None, "und", ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"]) for w in t)))
    return [*out, *out[:5], (None, None), ("en", None), ("en", ""), ("fr", " .. , \n"), ("fr", LONG), ("de", "ab " * 3000), ("de", "one")]


def found(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for c in f"{CLASHES}, phrase string, n bigint, rank int, score double".split(", "):
        name, kind = c.split(" ")
        df = df.withColumn(name, F.lit(1).cast(kind))
    return sorted(tuple(r) for r in collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("most", "least", "share", "top", "slab"), [(5, 3, 100, 2000, None), (3, 2, 80, 9, 256), (2, 6, 100, 3, 1024)])
def test_phrases(spark, monkeypatch, most, least, share, top, slab):
    if slab:
        monkeypatch.setattr(phrases, "SLAB", slab)
    rows = texts(most)
    want = brute(rows, most, least, share, top)
    assert found(spark, rows, most=most, least=least, share=share, top=top) == want and len(want) > 5


def test_no_phrase(spark):
    assert found(spark, []) == [] and found(spark, [("en", None), (None, "a b c")]) == []


def test_full_map_gives_the_same(spark, monkeypatch):
    """A map that lets everything through prunes nothing and changes nothing."""
    import numpy as np

    rows = texts(9, 30)
    monkeypatch.setattr(phrases, "bit_map", lambda hashes, size: np.full(1 << (size - 6), 0xFFFFFFFFFFFFFFFF, np.uint64))
    assert found(spark, rows, least=3) == brute(rows, 5, 3, 100, 2000)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([("en", "big number", 4 * 10**9, 3 * 10**15)], "lang string, phrase string, a bigint, n bigint")
    over = F.lit(1000).cast("decimal(4,0)") * phrases._exact("a") * F.col("n").cast("decimal(16,0)")
    got = df.withColumn("over", over).withColumn("under", phrases._exact("a") * phrases._exact("a")).select(F.expr("over div under")).first()[0]
    assert got == 1000 * 3 * 10**15 // (4 * 10**9)


def test_sql(spark):
    rows = [r for r in texts(4) if r[1] is None or len(r[1]) < 20_000] * 9
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    want = con.sql(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLE})").fetchall()
    assert found(spark, rows) == sorted(want) and len(want) > 5
