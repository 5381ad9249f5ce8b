from __future__ import annotations

import glob

import numpy as np
from pyspark.sql import functions as F

from textloom.functions.tokenize import NATIVE
from textloom.operators import neighbours
from textloom.operators.neighbours import knn_lists
from textloom.operators.reduce import neighbourhood, reduce_table
from textloom.sources import cache


def _vectors(spark, n):
    points = np.random.default_rng(4).normal(size=(n, 6))
    return spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id bigint, v array<double>")


def test_parts_of_a_round_give_the_same_graph(spark, monkeypatch):
    df, graphs = _vectors(spark, 400), []
    for size in (1 << 20, 150):
        monkeypatch.setattr(neighbours, "SLICE", size)
        graphs.append([(r["id"], r["others"]) for r in knn_lists(df, "id", "v", 8, run=32, passes=2).orderBy("id").collect()])
    assert graphs[0] == graphs[1] and len(graphs[0]) == 400


def test_rounds_leave_only_the_last_result(spark):
    """What the graph and each round of the blocks wrote is gone once the next one is there."""
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(glob.glob(f"{at}/*"))
    near = neighbourhood(_vectors(spark, 240), "id", "v")
    places = reduce_table(near, 2, block=60)
    assert places.count() == 240 and places.agg(F.max(F.size("y"))).first()[0] == 2
    assert len(set(glob.glob(f"{at}/*")) - before) == 2  # the neighbourhood and the places
    near.release()
    assert len(set(glob.glob(f"{at}/*")) - before) == 1


def test_a_cache_is_no_larger_than_its_texts(spark, tmp_path):
    """Its filters and offsets are small, and a run that finds all texts there writes nothing."""
    text = "some words that come again and again, " * 400
    df = spark.createDataFrame([(k, f"{k} {text}") for k in range(40)], "id int, t string")
    for _ in range(2):
        found = cache.tokens(df, "t", str(tmp_path), model=NATIVE)
        assert found.select("id", F.inline("t")).filter("id = 7 AND start = 0").collect() == [(7, "7", 0, 1)]
        files = [x for x in tmp_path.rglob("*.parquet")]
        assert sum(x.stat().st_size for x in files) < 40 * len(text) and len(list((tmp_path / "data").iterdir())) == 1
