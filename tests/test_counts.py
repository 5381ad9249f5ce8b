from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from textloom import token_frequencies, token_frequency_stats
from textloom.functions.tokenize import NATIVE
from textloom.operators.frequencies import as_dict
from textloom.operators.keyness import COLUMNS, ieee_div
from textloom.operators.topic_words import ctfidf, rollup, soft_sizes, topic_centroids


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "token string, count bigint")


def test_frequencies(spark):
    df = spark.createDataFrame([("Hello world",), ("Hello there",), (None,), ("  ",)], "t string")
    assert as_dict(token_frequencies(df, "t", NATIVE)) == {"hello": 2, "world": 1, "there": 1}
    df = spark.createDataFrame([("Hello, [UNK] ##sta Queensland",)], "t string")
    assert as_dict(token_frequencies(df, "t", NATIVE)) == {"hello": 1, "sta": 1, "queensland": 1}
    with pytest.raises(TypeError):
        token_frequencies(["x"], "t", NATIVE)
    with pytest.raises(ValueError):
        token_frequencies(df, "t", "")


def test_keyness(spark):
    df = token_frequency_stats(table(spark, {"hello": 2, "world": 1}), table(spark, {"hello": 1, "there": 2}))
    assert df.columns == list(COLUMNS)
    rows = {r["token"]: r for r in df.collect()}
    assert list(rows) == ["hello", "there", "world"]
    hello = rows["hello"]
    assert hello["expected_0"] == 1.5 and math.isclose(hello["log_likelihood_llv"], 2 * (2 * math.log(2 / 1.5) + math.log(1 / 1.5)))
    assert hello["relative_risk"] == 2 and math.isclose(hello["log_ratio"], math.log(2)) and math.isclose(hello["odds_ratio"], 4)
    assert rows["there"]["relative_risk"] == 0 and rows["there"]["log_ratio"] is None and rows["world"]["relative_risk"] is None
    assert math.isinf(rows["world"]["effect_size_ell"]) or rows["world"]["effect_size_ell"] is not None
    empty = table(spark, {"x": 1}).limit(0)
    assert token_frequency_stats(empty, empty).count() == 0
    one = token_frequency_stats(empty, table(spark, {"x": 1})).first()
    assert math.isnan(one["percent_corpus_0"]) and one["percent_corpus_1"] == 100


def test_division(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 3.0), (None, 0.0)], "a double, b double").select(ieee_div(F.col("a"), F.col("b")).alias("x")).collect()
    x = [r["x"] for r in rows]
    assert x[0] == math.inf and x[1] == -math.inf and math.isnan(x[2]) and x[3] == 2 and x[4] is None


def test_topic_words(spark):
    counts = spark.createDataFrame([(0, "alpha", 5), (0, "shared", 5), (1, "beta", 5), (1, "shared", 5)], "topic int, token string, count bigint")
    best = {r["topic"]: r["token"] for r in ctfidf(counts, 2, 1).collect()}
    assert best == {0: "alpha", 1: "beta"}


def test_rollup(spark):
    chunks = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (0, -1), (1, 0), (1, 1), (2, -1)], "doc_id int, topic int")
    docs = spark.createDataFrame([(0,), (1,), (2,), (3,)], "doc_id int")
    got = {r["doc"]: r for r in rollup(docs, chunks).collect()}
    assert [got[k]["dominant_topic"] for k in range(4)] == [0, 1, -1, -1]  # of equals the greater
    assert [tuple(x) for x in got[0]["topic_distribution"]] == [(-1, 0.25), (0, 0.5), (1, 0.25)] and got[3]["topic_distribution"] == []


def test_sizes_and_centroids(spark):
    chunks = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("b", 1, 0), ("b", 1, 0), ("b", 1, 0), ("b", 1, -1)], "corpus string, doc_id int, topic int")
    got = {(r["corpus"], r["topic_id"]): r["size"] for r in soft_sizes(chunks, 2).collect()}
    assert got == {("a", 0): 0.5, ("a", 1): 0.5, ("b", 0): 0.75, ("b", 1): 0.0}
    points = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 2.0), (1, 10.0, 10.0), (-1, 999.0, 999.0)], "topic int, x double, y double")
    assert {r["topic_id"]: (r["x"], r["y"]) for r in topic_centroids(points, 3).collect()} == {0: (1, 1), 1: (10, 10), 2: (0, 0)}
