from __future__ import annotations

import random

import pytest

from textloom.llm.quality_rules import RULES, good_documents, measures, posteriors, quality, repeated_words, vote_table, votes

from .helpers import LONG, corpus, frame, words


@pytest.mark.parametrize("seed", range(8))
def test_repeated_words(seed):
    rng = random.Random(seed)
    w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(60))]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = {k + i for k, x in enumerate(windows) if windows.count(x) > 1 for i in range(5)}
    assert repeated_words(w) == len(want)


def test_long_texts_count_too():
    w = [b"%d" % k for k in range(9000)]
    assert repeated_words(w + w[:6]) == 12


def test_base_columns(spark):
    rows = [*corpus(3), (700, "# a b\n# a b\n\n|x|"), (701, LONG)]
    got = {r["doc_id"]: r for r in quality(frame(spark, rows)).collect()}
    for doc, t in rows:
        w, lines, seen, dup = words(t), (t or "").split("\n"), set(), 0
        for line in lines:
            if words(line):
                dup += line in seen
                seen.add(line)
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup)
        assert r["base_failed"] == (len(w) < 10 or 100 * r["n_repeat_words"] > 20 * len(w)) and not (r["base_failed"] and r["kept"])


def test_model_tells_junk_from_prose(spark):
    rng = random.Random(1)
    stop = "the of and to in is that it was for".split()
    prose = [(k, " ".join(rng.choice(stop) if rng.random() < 0.3 else f"w{'abcdefgh'[rng.randrange(8)]}{'xyzuv'[rng.randrange(5)]}{k}o" for _ in range(60)) + ".") for k in range(80)]
    junk = [(k, " | ".join(f"ITEM{rng.randrange(900)}$$$" for _ in range(40))) for k in range(100, 120)]
    got = {r["doc_id"]: r["kept"] for r in quality(frame(spark, prose + junk)).collect()}
    assert all(got[d] for d, _ in prose) and not any(got[d] for d, _ in junk)
    df = frame(spark, [*prose, *junk, (None, prose[0][1]), (1000, None)])
    out = good_documents(spark, df, "")
    assert out.columns == df.columns and out.count() == 81
    assert quality(frame(spark, [])).count() == 0 and good_documents(spark, frame(spark, []), "").count() == 0


def test_posteriors_follow_the_votes():
    good, bad = 3 ** len(RULES) - 1, (3 ** len(RULES) - 1) // 2
    p = posteriors({good: 900, bad: 100, 0: 5})
    assert p[good] > 0.99 and p[bad] < 0.01 and abs(p[0] - 0.9) < 0.05 and posteriors({}) == {}
    assert votes(measures(b"")[1]) == 0


def by_hand(documents, rounds):
    """Expectation-maximisation document by document, in plain Python."""
    p = [0.95 * 0.4 ** sum(v == 1 for v in d) if any(d) else 0.5 for d in documents]
    for _ in range(rounds):
        prior = [(sum(1 - x for x in p) + 1) / (len(p) + 2), (sum(p) + 1) / (len(p) + 2)]
        right = []
        for weight in ([1 - x for x in p], p):
            right.append([(sum(w for w, d in zip(weight, documents) if d[k] == 2) + 1) / (sum(w for w, d in zip(weight, documents) if d[k]) + 2) for k in range(len(RULES))])
        new = []
        for d in documents:
            odds = list(prior)
            for c in (0, 1):
                for k, v in enumerate(d):
                    odds[c] *= right[c][k] if v == 2 else 1 - right[c][k] if v == 1 else 1
            new.append(odds[1] / sum(odds))
        p = new
    return p


@pytest.mark.parametrize("seed", range(6))
def test_posteriors_against_documents_one_by_one(seed):
    rng = random.Random(seed)
    documents = []
    for _ in range(150):
        good = rng.random() < 0.7
        documents.append(tuple(0 if rng.random() < 0.3 else (2 if good else 1) if rng.random() < 0.8 else rng.choice([1, 2]) for _ in RULES))
    pattern = [sum(v * 3 ** (len(RULES) - 1 - k) for k, v in enumerate(d)) for d in documents]
    counts = {x: pattern.count(x) for x in pattern}
    assert [tuple(v) for v in vote_table(pattern).tolist()] == documents
    trace: list = []
    got = posteriors(counts, rounds=12, settle=0.0, trace=trace)
    assert all(abs(got[x] - p) < 1e-9 for x, p in zip(pattern, by_hand(documents, 12), strict=True))
    assert all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))


def test_verdicts_follow_the_posteriors(spark):
    rows = [*corpus(8), (None, "one two three"), (None, LONG[:300])]
    made = [(d, measures((t or "").encode())) for d, t in rows]
    counts: dict = {}
    for _, (_, shares) in made:
        counts[votes(shares)] = counts.get(votes(shares), 0) + 1
    p = posteriors(counts)
    want = sorted(str((d, base[0], p[votes(shares)] >= 0.5 and base[0] >= 10 and 100 * base[4] <= 20 * base[0])) for d, (base, shares) in made)
    assert sorted(str((r["doc_id"], r["n_words"], r["kept"])) for r in quality(frame(spark, rows)).collect()) == want
