from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontamination, session
from textloom.llm.chat_format import as_events, escape, fold, format_chats, parse, render, unescape
from textloom.llm.decontamination import contained_items, without_benchmark
from textloom.llm.licenses import _MIT, TEMPLATES, TITLES, Templates, _terms, _words, cosines, license_texts, scan_licenses
from textloom.llm.mixing import fit, knapsack, mix_sources, source_targets, targets
from textloom.llm.site_style import Page, main_text
from textloom.llm.warc import read_warc, record, write_warc

from .helpers import LONG, corpus, frame, words

ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), (2, "short one"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten eleven")]


def loose(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def grams(words, width):
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute_containments(docs, items, least):
    out = []
    for d, text in docs:
        for i, item in items:
            w = loose(item)
            own = grams(w, min(5, len(w))) if w else set()
            shared = own & grams(loose(text), min(5, len(w))) if own else set()
            if own and len(shared) >= least * len(own) - 1e-9:
                out.append((d, i, len(own), len(shared)))
    return sorted(out, key=str)


def contained(df):
    return sorted(((r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in df.collect()), key=str)


def test_decontamination(spark):
    docs = [(1, "x ALPHA beta, gamma delta epsilon zeta eta theta iota kappa y"), (2, "a Short one b"), (3, None), (4, ""), (None, "one two three four five six seven eight nine ten eleven"), (5, "one two three four five six seven x ten eleven"), (6, LONG + " short, one " + LONG), (6, LONG), (None, "clean"), (7, "a short one"), (7, "a short one")]
    items = spark.createDataFrame([*ITEMS, (2, "short one"), (None, "Short!")], "item_id bigint, text string").withColumn("hash", F.lit(1)).withColumn("item", F.lit(2))
    got = contained_items(frame(spark, docs), items)
    assert contained(got) == brute_containments(docs, [*ITEMS, (2, "short one"), (None, "Short!")], 0.8) and got.columns == ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
    assert contained_items(frame(spark, docs), items.limit(0)).count() == 0 and contained_items(frame(spark, []), items).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_is_exact(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 5, 8, 30])))) for k in range(25)]
    docs = []
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        own = loose(rng.choice(items)[1])
        if rng.random() < 0.5 and len(own) > 6:
            own[rng.randrange(len(own))] = "other"
        docs.append((rng.choice([k, None, 5]), " ".join(text + own + text[::-1])))
    assert contained(contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))) == brute_containments(docs, items, 0.8)


def test_a_stock_phrase_makes_no_candidates(spark, monkeypatch):
    """Documents and items that all share a phrase of seven words: a candidate is what holds more than the phrase."""
    seen = []
    monkeypatch.setattr(decontamination, "staged", lambda df, name: (seen.append((name, out := session.staged(df, name))), out)[1])
    rng = random.Random(1)
    phrase = "all of them share this stock phrase".split()
    docs = [(k, " ".join(phrase + [f"d{k}x{rng.randrange(10**6)}" for _ in range(30)])) for k in range(300)]
    items = [(k, " ".join([f"i{k}y{rng.randrange(10**6)}" for _ in range(6)] + phrase)) for k in range(300)]
    docs += [(1000 + k, f"before {items[k][1]} after") for k in range(5)]
    rows = contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(1000 + k, k) for k in range(5)]
    assert dict(seen)["candidates"].count() <= 10


def test_items_of_stock_shingles_only(spark):
    """Every shingle is everywhere, so sketches hold them as well; sizes of documents still count."""
    text = "one two three four five six seven eight nine ten"
    docs = [(k, text) for k in range(9)] + [(20, "one two three four five"), (21, text + " " + text), (22, None), (23, "")]
    items = [(1, text), (2, text + " eleven"), (3, "three four"), (4, None), (1, text)]
    assert contained(contained_items(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"))) == brute_containments(docs, items, 0.8)


def test_decontamination_stage(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = frame(spark, [(1, "a short one b"), (2, "clean text"), (None, "clean too"), (3, None), (None, "this short one leaks"), (4, "leaks a short one"), (4, "clean three")])
    out = without_benchmark(spark, df, str(tmp_path))
    assert out.columns == df.columns and sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([(2, "clean text"), (None, "clean too"), (3, None), (4, "clean three")], key=str)


def best_sum(lengths, counts, budget):
    """The greatest sum up to ``budget``, by all sums that can be made."""
    sums = {0}
    for n, c in zip(lengths, counts, strict=True):
        sums = {x + k * n for x in sums for k in range(c + 1) if x + k * n <= budget}
    return max(sums)


@pytest.mark.parametrize("seed", range(10))
def test_fit(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 400, 60))
    counts = rng.integers(1, 30, len(lengths))
    budget = int(rng.integers(0, (lengths * counts).sum() + 10))
    take = fit(lengths, counts, budget)
    total = int((take * lengths).sum())
    assert (take >= 0).all() and (take <= counts).all() and total <= budget
    assert budget - total == 0 or (take == counts).all()


@pytest.mark.parametrize("seed", range(40))
def test_fit_of_long_documents_is_exact(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(1, 10 ** int(rng.integers(2, 7)), 6))
    counts = rng.integers(1, 3, len(lengths))
    budget = int(rng.integers(1, (lengths * counts).sum()))
    take = fit(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == best_sum(lengths.tolist(), counts.tolist(), budget)


def test_fit_beyond_the_programme():
    assert fit(np.array([200_000, 1_000_000]), np.array([1, 1]), 210_000).tolist() == [1, 0]
    assert fit(np.array([180_000, 300_000]), np.array([1, 1]), 200_000).tolist() == [1, 0]
    big = 1 << 25
    assert fit(np.array([3, big]), np.array([10, 4]), 2 * big + 31).tolist() == [10, 2]
    assert fit(np.array([5, 90_000_000]), np.array([2, 1]), 90_000_004).tolist() == [0, 1]


@pytest.mark.parametrize("budget", [20_000, 100_000, 1_000_000, 10_000_000])
@pytest.mark.parametrize("longest", [2_000, 500])
def test_what_is_taken_is_like_its_source(budget, longest):
    """Mean, quartiles of documents and of words, at every budget alike."""
    lengths = np.arange(10, longest)
    counts = 1 + (3_000_000 // lengths**2)
    counts[lengths > 200] = 30
    take = fit(lengths, counts, budget)
    assert int((take * lengths).sum()) == min(budget, int((counts * lengths).sum()))
    mean, own = (counts * lengths).sum() / counts.sum(), (take * lengths).sum() / take.sum()
    spread = ((lengths - mean) ** 2 * counts).sum() / counts.sum()
    assert abs(own - mean) < 4 * (spread / take.sum()) ** 0.5  # what a random choice keeps to
    for weight in (1, lengths):
        have, want = (np.cumsum(x * weight) / (x * weight).sum() for x in (take, counts))
        assert np.abs(have - want).max() < 3 / take.sum() ** 0.5


def test_work_of_the_programme_is_bounded():
    began = time.perf_counter()
    lengths = np.arange(2, 40_000, 2)
    take = fit(lengths, np.full(len(lengths), 50), 20_000_001)
    assert int((take * lengths).sum()) == 20_000_000
    take = fit(np.array([10, 3_000_000]), np.array([10**8, 5]), 100_000_003)
    assert int((take * [10, 3_000_000]).sum()) == 100_000_000 and take[1] <= 2
    take = fit(np.array([1000, 1001]), np.array([10**6, 10**6]), 700_500)
    assert 700_500 - int((take * [1000, 1001]).sum()) <= 1000
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("seed", range(20))
def test_knapsack(seed):
    rng = random.Random(seed)
    items = [rng.randrange(1, 90) for _ in range(rng.choice([3, 40, 300]))]
    target = rng.randrange(1, max(2, sum(items) // 2))
    chosen = knapsack(items, target)
    assert len(set(chosen)) == len(chosen) and sum(items[k] for k in chosen) == best_sum(items, [1] * len(items), target)


@pytest.mark.parametrize("seed", range(3))
def test_targets_over_sums(spark, seed):
    rng = random.Random(seed)
    names = [None, "é", "z", "a", "Z", "🙂", *(f"s{k}" for k in range(12))]
    sizes = {n: rng.choice([0, 1, 7, 100, 5000]) for n in names}
    rows = [(n, k) for n, total in sizes.items() for k in ([total] if total < 3 else [total - 2, 2])]
    got = {r["source"]: (r["source_size"], r["target"]) for r in source_targets(spark.createDataFrame(rows, "source string, size bigint").repartition(3), (5, 2, 1), 1.5, 2).collect()}
    order = sorted(names, key=lambda n: (n is None, (n or "").encode()))
    want = targets([sizes[n] for n in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 1.5 * sum(sizes.values()))
    assert {n: x[0] for n, x in got.items()} == sizes and all(abs(got[n][1] - w) < 1e-6 for n, w in zip(order, want, strict=True))


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 60)), rng.choice(["a", "a", "a", "b", None, "é"])) for k in range(1500)]
    rows += [(None, "x y", "a"), (2000, None, "a"), (2001, "", "zero"), (5, "w w", "a"), (5, "w w", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit(1)).withColumn("slot", F.lit(2)).withColumn("lot", F.lit(3))
    got = mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(5)).collect()))
    taken: dict = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken.setdefault((r["source"], r["target"]), []).append(r["taken"])
    assert all(abs(sum(v) - target) <= 2 for (_, target), v in taken.items()) and abs(sum(t for _, t in taken) - 1.5 * sum(r["size"] for r in got)) < 1e-6
    assert mix_sources(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "a<|end|>b", "</s>[INST] ok [/INST]", "\\", "\\<|", "<<SYS>><</SYS>><s>", "<<|turn|>", "tail<", "[INST", "é🙂\n\\n"])
def test_chat_escapes(text):
    assert unescape(escape(text)) == text
    formatted, mask = render([("user", text), ("assistant", text), (text, "x")])
    assert parse(formatted) == [("user", text), ("assistant", text), (text, "x")]
    assert [unescape(formatted[a:b]) for a, b in mask] == [text]
    for control in ("<|", "</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>"):
        assert control not in escape(text)


def test_chat_events(spark):
    log = [("m", "message", "user", "hi"), ("a", "message", "assistant", None), ("a", "delta", None, "he"), ("a", "delta", None, "llo"), ("b", "message", "user", "more"), ("m", "edit", None, "hey"), ("zz", "delta", None, "lost"), ("a", "regenerate", None, "bye")]
    assert fold(iter(log)) == [("user", "hey"), ("assistant", "bye")]
    rows = [(1, k, {"m": 1, "a": 2, "b": 3, "zz": 4}[m], kind, role, text) for k, (m, kind, role, text) in enumerate(log)] + [(None, 0, 1, "message", None, None), (2, None, 1, "message", "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string").repartition(4)
    got = {r["conv_id"]: parse(r["formatted"]) for r in format_chats(df.withColumn("formatted", F.lit(1))).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "bye")], None: [("", "")], 2: [("assistant", LONG)]}
    assert format_chats(df.limit(0)).count() == 0


def test_many_regenerations_take_linear_time():
    began = time.perf_counter()
    log = [(k, "message", "user", "x") for k in range(20_000)] + [e for k in range(20_000, 60_000) for e in ((k, "message", "assistant", "y"), (k, "regenerate", None, "z"))] + [(5, "regenerate", None, "end")]
    assert fold(iter(log)) == [("user", "x")] * 5 + [("user", "end")] and time.perf_counter() - began < 2


def test_deltas_of_one_seq_follow_their_message(spark):
    rows = [(1, 0, 1, "delta", None, " you"), (1, 0, 1, "message", "user", "hello"), (1, 1, 2, None, "assistant", "x"), (1, 1, 2, "what", None, "?"), (1, 1, 2, "edit", None, "y")]
    df = spark.createDataFrame(rows, "conv_id bigint, seq bigint, message bigint, kind string, role string, text string")
    assert [parse(r["formatted"]) for r in format_chats(df).collect()] == [[("user", "hello you"), ("assistant", "y")]]


def test_turns_come_back_from_their_events(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a", "é🙂", "</s>[INST] ok [/INST]", "long " * rng.randrange(9), "\\<|end|>"])) for c in (1, 2, None) for t in (0, 1, 1, 2, 3, 3, None)]
    rows += rows[:4]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("message", F.lit(1)).withColumn("seq", F.lit(0)).repartition(3)
    events = as_events(df)
    assert {r[0] for r in events.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r["conv_id"]: parse(r["formatted"]) for r in format_chats(events).collect()} == want


def test_warc(spark):
    rows = [(3, "a\nb", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "ü", None), (None, "z", ""), (5, "q", "\x1f\x08" + "y" * 300_000), (5, "q", "again"), (7, "n", LONG)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha", F.lit(1)).withColumn("first", F.lit(2))
    archives = write_warc(df)
    want = sorted(str((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if p in (3, None) else "response", {3: 1, None: 2}.get(p))) for p, _, h in rows)
    for size in (50, 1000, 1 << 24):
        got = read_warc(archives, True, size).collect()
        assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])) for r in got) == want
    assert {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}[7].decode() == LONG
    assert read_warc(write_warc(df.limit(0))).count() == 0
    few = read_warc(write_warc(df, least=1)).filter("payload_bytes = 0").collect()
    assert all(r["record_type"] == "response" for r in few)


def test_warc_reader_skips_what_is_no_record(spark, tmp_path):
    inner = record(9, "u", b"inner", None, "D")
    body = b"junk \x1f\x8b\x08 junk" + record(1, "u", b"a", None, "X") + b"\x1f\x8b\x08" + record(2, None, inner, None, "Y") + b"tail"
    (tmp_path / "x.warc.gz").write_bytes(body)
    files = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", len(body))], "path string, size bigint")
    for size in (11, 4096):
        assert sorted(r["page_id"] for r in read_warc(files, False, size).collect()) == [1, 2]


PAGE = "<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a href=x>menu</a></nav><div class=ad>buy</div>{}<footer>&copy; f</footer></body></html>"


def test_pages(spark):
    cases = {
        PAGE.format("<article><h1>T &amp; U</h1><p><b>bo</b>ld<br>next<p>two<ul><li>a<li>b</ul><div class='comments'>no</div><form>f</form><aside>s</aside><!-- c --></article>"): "T & U bold next two a b",
        "plain &lt; text\n\n x": "plain < text x",
        "<p>un<p>closed <b>ta": "un closed ta",
        "<article><p>cut <a hre": "cut",
        "": "",
        None: "",
        "<article>" + LONG + "</article>": LONG,
        "<div hidden>x</div><p>a&nbsp;&#233;&#x1F642;</p><svg><text>n</text></svg>": "a é🙂",
    }
    rows = [(k, f"http://h{k}.example/p", h) for k, h in enumerate(cases)] + [(None, None, "<p>x</p>"), (0, "u", "<p>y</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("row", F.lit(1)).withColumn("look", F.lit(1))
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["text"]) for r in main_text(df).collect())
    assert got == sorted((p is None, p or 0, cases.get(h, {"<p>x</p>": "x", "<p>y</p>": "y"}.get(h))) for p, _, h in rows)
    assert main_text(df.limit(0)).count() == 0


def test_site_style(spark):
    rows = []
    for k in range(30):
        rows.append((k, f"http://a.example/{k}", f"<body><div><ul><li>home<li>about us</ul></div><div class=x><p>Story {k} is about {k * 7}</p><p>More of {k}</p></div><div><span>all rights reserved by us</span></div></body>"))
        rows.append((100 + k, f"http://b.example/{k}", f"<body><div>site words</div><article><h1>T{k}</h1><p>Same text</p><div>tell everyone about this now</div><div><p>own {k}</p></div></article></body>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(df).collect()}
    assert all(got[k] == f"Story {k} is about {k * 7} More of {k}" and got[100 + k] == f"T{k} Same text own {k}" for k in range(30))


def test_importance_judges_marked_pages(spark):
    rows = [(k, f"http://a.example/{k}", f"<body class='has-sidebar'><form><article><header><h2>Part</h2></header><p>Story {k} is about {k * 7}</p><p>Write to us and tell your friends</p></article></form></body>") for k in range(30)]
    rows += [(100 + k, f"http://b.example/{k}", f"<body><div class='content related-on'><main><p>Tale {k * 3}</p><p>Read on</p></main></div></body>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k] == f"Story {k} is about {k * 7} Write to us and tell your friends" for k in range(30)) and all(got[100 + k] == f"Tale {k * 3} Read on" for k in range(3))


def test_names_are_evidence(spark):
    cases = {
        "<html class='menu-closed'><body class='single right-sidebar'><article><h1>T</h1><h2 id='related-work'>R</h2><p>a</p><h3 id=menu>m</h3><section id='notice-of-appeal'><p>n</p></section><div class='share'>no</div></article></body></html>": "T R a m n",
        "<body><div class=overlay><main><p>x</p></main></div><div class=sidebar>no</div></body>": "x",
        "<body><div class='with-sidebar'><article><p>x</p><pre><b class=comment># c</b></pre></article></div></body>": "x # c",
        "<form><div><h1>A</h1><p>All of the page is in it</p><form><input></form></div></form>": "A All of the page is in it",
        "<body><article><header><h1>Title</h1></header><p>x</p><form>no</form></article><footer>no</footer></body>": "Title x",
        "<body><div class=comments><article>no</article></div><div hidden><main>no</main></div><p>y</p></body>": "y",
    }
    rows = [(k, f"http://h{k}.example/p", h) for k, h in enumerate(cases)]
    rows += [(100 + k, f"http://a.example/{k}", f"<body><div class='related-work'><p>Story {k} is about {k * 7}</p></div><div class='site-footer'><p>all rights</p><p>seen {k % 5}</p></div></body>") for k in range(30)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == dict(enumerate(cases.values())) | {100 + k: f"Story {k} is about {k * 7}" for k in range(30)}


def test_composed_names_declare_noise(spark):
    """Comments, adverts, menus and footers by names of several words, on hosts seen once and often."""
    inside = "<article><h1>T</h1><p>Text {k} of {n}</p><div class='comment-list'><p>reader says {k}</p><p>me too {n}</p></div><div class='ad-slot'>Buy {k}</div><div id='adSlot3'>Buy {n} now</div><section id='related-work'><h2>Related work of {k}</h2><p>others {n}</p></section></article>"
    often = [(k, f"http://a.example/{k}", f"<body><div class='main-nav'><a href=/{k}>Home {k}</a></div><div class='ad-slot'>Buy {k} now</div>{inside.format(k=k, n=7 * k)}<div class='post-comments'>says {k}</div></body>") for k in range(30)]
    once = {
        "<body><div class='main-nav'>Home About</div><div><p>Lone story</p><p>told at some length</p></div><div class='site-footer'>all rights</div></body>": "Lone story told at some length",
        "<body><div class='content-sidebar-wrap'><div id=content><p>A layout of two columns holds it all</p></div></div><div class='footer-widgets-2 footer-area'>x</div></body>": "A layout of two columns holds it all",
        "<body><div class='has-right-sidebar'><article><p>x</p></article></div><div id='comment-12'><p>a long comment, longer than all else on the page</p></div></body>": "x",
        "<body><p>y</p><div id='user-comments'><article>a reader's comment, which is longer than the page</article></div></body>": "y",
        "<body><article><div class='article-header'><h1>Title</h1></div><p>x</p><div class='menu-design'><p>design of menus</p></div><div class='entry-footer'>tags</div></article></body>": "Title x design of menus",
    }
    rows = often + [(100 + k, f"http://h{k}.example/p", h) for k, h in enumerate(once)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert {k: got[k] for k in range(30)} == {k: f"T Text {k} of {7 * k} Related work of {k} others {7 * k}" for k in range(30)}
    assert {k: v for k, v in got.items() if k >= 100} == {100 + k: v for k, v in enumerate(once.values())}


def test_outside_of_landmarks_is_judged(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><a href=#x>skip</a><article><p>Lead</p></article><div><p>Story {k} is about {k * 7}</p><p>More of {k}</p></div><div>site words</div></body>") for k in range(30)]
    rows.append((99, "http://lone.example/", "<body><article><p>Lead</p></article><div>no other page tells</div></body>"))
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {k: f"Lead Story {k} is about {k * 7} More of {k}" for k in range(30)} | {99: "Lead"}


def test_broken_markup_is_quick():
    assert Page("<a b='" * 3000).text() is not None and Page("<" * 5000).text() == "<" * 5000


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "x y z"), (3, "d/e.py", None), (4, None, ""), (5, "a/b/LICENSE.txt", "Licensed under CC BY-NC 4.0."), (None, "a/b/q/z/w", "hello"), (6, "a/c/f", "# Licensed under the Apache License, Version 2.0.\n" + LONG), (7, "z/top", _MIT), (8, "z/y/k", "words"), (8, "z/y/k", "words")]
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string").withColumn("name", F.lit(1)).withColumn("directory", F.lit("q"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["from_directory"]) for r in scan_licenses(df).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: (None, "CC-BY-NC-4.0", "a/b"), 3: (None, None, None), 4: (None, None, None), 5: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), None: (None, "CC-BY-NC-4.0", "a/b"), 6: ("Apache-2.0", "Apache-2.0", None), 7: ("MIT", "MIT", None), 8: (None, "MIT", "z")}
    assert scan_licenses(df.limit(0)).count() == 0


def by_hand(templates, texts, documents, frequency):
    """Best cosine of each text as a whole, with dictionaries."""
    idf = lambda w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 1
    out = []
    for text in texts:
        best = 0.0
        a = Counter(loose(text))
        for _, t in templates:
            b = Counter(loose(t))
            dot = sum(n * b[w] * idf(w) ** 2 for w, n in a.items() if w in b)
            # a word of no template weighs each time it occurs
            known = {w for _, x in templates for w in loose(x)}
            norm = math.sqrt(sum((n * idf(w)) ** 2 if w in known else n * (math.log(1 + documents) + 1) ** 2 for w, n in a.items()))
            best = max(best, dot / norm / math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items())) if norm else 0.0)
        out.append(best)
    return out


def test_cosines_against_dictionaries():
    rng = random.Random(5)
    vocabulary = sorted({w for _, t in TEMPLATES for w in loose(t)})
    frequency = {w: rng.randrange(500) for w in vocabulary}
    made = Templates(TEMPLATES)
    order = {int(_words([w])[0][0]): frequency[w] for w in vocabulary}
    made.weigh(1000, np.array([order[int(h)] for h in made.vocabulary]))
    texts = [" ".join(rng.choice([*vocabulary, "other", "words"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)] + [t for _, t in TEMPLATES[:6]] + ["", "nothing known"]
    bags = _words(texts)
    unit = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    best, _ = cosines(made, _terms(made, np.concatenate(bags)), unit, len(bags))
    assert np.allclose(best, by_hand(TEMPLATES, texts, 1000, frequency))


def scanned_by_hand(rows, templates, titles, least=0.75, file_least=0.5):
    """Every row's licence, file and inheritance by dictionaries: lines, blocks and wholes one by one, directories by walking up."""
    every, documents = [*templates, *titles], len(rows)
    known = {w for _, t in every for w in loose(t)}
    frequency = Counter(w for _, _, text in rows for w in set(loose(text or "")))
    idf = lambda w: math.log((1 + documents) / (1 + frequency[w])) + 1 if w in known else math.log(1 + documents) + 1
    bags = [Counter(loose(t)) for _, t in every]
    norms = [math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items())) for b in bags]

    def best(text):
        a = Counter(loose(text))
        norm = math.sqrt(sum((n * idf(w)) ** 2 if w in known else n * idf(w) ** 2 for w, n in a.items()))
        scores = [sum(n * b[w] * idf(w) ** 2 for w, n in a.items() if w in b) / norm / size if norm else 0.0 for b, size in zip(bags, norms, strict=True)]
        scores = [round(x, 9) for x in scores]
        top = max(range(len(scores)), key=lambda k: (scores[k], -k))
        return scores[top], top

    out, files = [], {}
    for doc, path, text in rows:
        blocks = [b for b in re.split(r"\n[ \t\r]*(?=\n)", text or "") if loose(b)]
        units = [[x for x in (text or "").split("\n") if loose(x)], blocks, [text] if loose(text or "") else []]
        score, name, whole = 0.0, None, 0.0
        for kind, parts in enumerate(units):
            found = [best(p) for p in parts]
            if found:
                top = max(found, key=lambda x: (x[0], -x[1]))
                if top[0] > score:
                    score, name = top[0], every[top[1]][0]
                if kind == 1 and found[0][0] >= least and found[0][1] >= len(templates):
                    whole, name, score = found[0][0], every[found[0][1]][0], max(score, found[0][0])
                if kind == 2:
                    whole = max(whole, top[0])
        own = name if score >= least else None
        is_file = (own is not None and path is not None and bool(re.match(r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$", path.rpartition("/")[2]))) or whole >= file_least
        out.append([doc, path, own, is_file])
        if is_file and path is not None:
            files.setdefault(path.rpartition("/")[0], []).append((score, name))
    for row in out:
        _, path, own, _ = row
        at, found = path.rpartition("/")[0] if path is not None else None, (None, None)
        while at is not None:
            if at in files:
                found = (max(files[at])[1], at)
                break
            at = at.rpartition("/")[0] if at else None
        row += [own or found[0], None if own else found[1]]
    return sorted(map(str, out))


@pytest.mark.parametrize("seed", range(4))
def test_licenses_against_dictionaries(spark, seed):
    """The operator as a whole: lines, blocks, titles, whole texts, files by name, and directories."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)]
    some = [t for t in TEMPLATES if len(t[1]) < 400][:14] + [t for t in TEMPLATES if t[0] == "BSD-2-Clause"][:1]
    titles = TITLES[:4]
    rows = []
    for k in range(70):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(6))]
        if rng.random() < 0.5:
            own = rng.choice(some)[1].split(" ")
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(words)
            lines.insert(rng.randrange(len(lines) + 1), " ".join(own))
        if rng.random() < 0.15:
            lines = [rng.choice(titles)[1], "", *lines]
        path = "/".join([*(rng.choice("ab") for _ in range(rng.randrange(4))), rng.choice([f"{k}.txt", f"{k}.py", "LICENSE", "copying.md", "Notice-2"])])
        rows.append((k, rng.choice([path, path, path, path, None]), rng.choice(["\n", "\n\n", "\n \t\n", "\r\n"]).join(lines) if k % 11 else rng.choice([None, ""])))
    got = scan_licenses(spark.createDataFrame(rows, "doc_id bigint, path string, text string").repartition(3), tuple(some), titles)
    columns = ("doc_id", "path", "own_license", "is_file", "license", "from_directory")
    assert sorted(str([r[c] for c in columns]) for r in got.collect()) == scanned_by_hand(rows, some, titles)


@pytest.mark.skipif(not Path("/usr/share/common-licenses").is_dir(), reason="no licence texts here")
def test_whole_licence_texts_are_templates(spark):
    whole = license_texts("/usr/share/common-licenses")
    texts = dict(whole)
    assert {"GPL-3.0", "Apache-2.0"} <= set(texts)
    rng = random.Random(1)
    rows = []
    for k, (name, text) in enumerate(whole):
        body = text.split()
        for _ in range(len(body) // 50):  # worn copies without their titles
            body[rng.randrange(len(body))] = "other"
        rows.append((k, f"{k}/sub/{name}.text", " ".join(body[40:])))
        rows.append((100 + k, f"{k}/sub/x/code.py", "code only"))
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, path string, text string"), (*TEMPLATES, *whole)).collect()}
    right = [got[k]["own_license"] == name and got[k]["is_file"] and got[100 + k]["license"] == name for k, (name, _) in enumerate(whole)]
    assert sum(right) >= len(right) - 1  # two versions of one licence may be nearer than two copies


def test_licenses_are_told_apart(spark):
    every = dict(TEMPLATES)
    bsd2, bsd3 = (next(t for n, t in TEMPLATES if n == x and len(t) > 500) for x in ("BSD-2-Clause", "BSD-3-Clause"))
    gpl = "GNU GENERAL PUBLIC LICENSE\r\nVersion 3, 29 June 2007\r\n  \r\n" + " ".join(f"the terms of this licence say {k}" for k in range(3000))
    rows = [(1, "a/1.txt", "Copyright (c) 2020 X\n\n" + bsd2), (2, "b/2.txt", "Copyright (c) 2020 X\r\n\r\n" + bsd3.replace("\n", "\r\n")), (3, "c/3.txt", gpl), (4, "c/d/4.txt", "words"), (5, "e/5.txt", "This library is free software\n \n" + every["LGPL-3.0"])]
    df = spark.createDataFrame([*rows, *((10 + k, f"z/{k}", LONG[:2000]) for k in range(20))], "doc_id bigint, path string, text string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["is_file"]) for r in scan_licenses(df).collect()}
    assert got[1][0] == "BSD-2-Clause" and got[2][0] == "BSD-3-Clause" and got[1][2] and got[2][2]
    assert got[3] == ("GPL-3.0", "GPL-3.0", True) and got[4] == (None, "GPL-3.0", False) and got[5][0] == "LGPL-3.0"


def test_words_helper():
    assert words("a\x0bb\x1cc d") == ["a", "b\x1cc", "d"] and len(corpus(0)) > 60
