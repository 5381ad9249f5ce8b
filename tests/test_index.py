from __future__ import annotations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom import concordance
from textloom.operators.index import PositionalIndex
from textloom.operators.neighbours import knn_graph

TEXTS = ["New York is new. In new york, NEW  York!", "the new York; yorks new", None, "", "new", "[MASK] new mask york pad. ,", "ünew New\nYork 🙂 end"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame([(k % 5, t) for k, t in enumerate(TEXTS)], "doc int, t string").repartition(2)
    return df, PositionalIndex.build(df, "doc", "t", f"file://{tmp_path_factory.mktemp('index')}/i")


def sides(rows):
    return sorted(tuple(r[c] for c in ("id", "start_idx", "end_idx", "left_context", "right_context", "l1", "r1")) for r in rows)


@pytest.mark.parametrize("word", ["new", "york", "NEW", ",", "end", "mask", "nothing"])
@pytest.mark.parametrize(("left", "right", "cased"), [(2, 3, False), (0, 1, True), (1, 0, False), (-1, 20, False)])
def test_words_as_a_concordance_has_them(index, word, left, right, cased):
    df, found = index
    got = found.search([word], num_left_tokens=left, num_right_tokens=right, case_sensitive=cased).collect()
    plain = df.select(F.col("doc").alias("id"), F.inline(concordance("t", word, num_left_tokens=left, num_right_tokens=right, case_sensitive=cased)), "t").collect()
    edge = lambda c: not c or not (c.isalnum() or c == "🙂")
    whole = [r for r in plain if edge(r["t"][r["start_idx"] - 1 : r["start_idx"]]) and edge(r["t"][r["end_idx"] : r["end_idx"] + 1]) and word != "mask"] if word != "," else plain
    assert sides(got) == sides(whole)


def test_phrases(index):
    _, found = index
    rows = found.search(["new york", "new", "york new", "is not there"], num_left_tokens=1, num_right_tokens=1).collect()
    got = sorted((r["phrase"], r["id"], r["hit"], r["left_context"], r["matched_text"], r["right_context"]) for r in rows if r["phrase"] != "new")
    assert got == sorted([
        ("new york", 0, 1, "", "New York", "is"), ("new york", 0, 2, "In", "new york", ","), ("new york", 0, 3, ",", "NEW York", "!"),
        ("new york", 1, 1, "the", "new York", ";"), ("new york", 1, 1, "ünew", "New York", "🙂"), ("new york", 0, 1, "]", "new york", "."),
    ])
    assert {r["phrase"] for r in rows} == {"new york", "new"}
    assert found.search(["pad"]).count() == 0
    with pytest.raises(ValueError, match="no phrase"):
        found.search([])


def exact(points, k):
    d = np.round(((points[:, None] - points[None]) ** 2).sum(axis=2), 12)
    np.fill_diagonal(d, np.inf)
    return [sorted(range(len(points)), key=lambda j: (d[i, j], j))[:k] for i in range(len(points))], d


def test_exact_neighbours(spark):
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(60, 4)), np.ones((5, 4))])
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)] + [(99, None)], "id int, v array<float>")
    want, d = exact(points.astype(np.float32).astype(np.float64), 6)
    got: dict = {}
    for r in knn_graph(df, "id", "v", 6).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
        assert abs(r["distance"] ** 2 - d[r["id"], r["other"]]) < 1e-9
    assert [got[k] for k in range(65)] == want and 99 not in got
    assert knn_graph(df.limit(0), "id", "v").count() == 0 and knn_graph(df.filter("id < 3"), "id", "v").count() == 6


@pytest.mark.parametrize("hot", [0, 700])
def test_recall_of_approximate_neighbours(spark, hot):
    """Clustered vectors in runs of 64, where exact neighbours would need one of 2,000; a third of them may be equal."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(40, 24))[rng.integers(0, 40, 2000)] + 0.4 * rng.normal(size=(2000, 24))
    points[:hot] = points[0]
    df = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(points)], "id bigint, v array<double>")
    want, d = exact(points, 10)
    rows = knn_graph(df, "id", "v", 10, run=64).collect()
    assert len(rows) == 20_000
    far = np.array([d[i, w[-1]] for i, w in enumerate(want)])
    assert np.mean([r["distance"] ** 2 <= far[r["id"]] + 1e-9 for r in rows]) >= 0.9  # as near as the tenth nearest


def test_tasks_grow_no_larger_with_the_texts(spark, tmp_path, monkeypatch):
    """Twice the tokens are sorted in twice as many parts, and no search deals tokens out one by one."""
    monkeypatch.setattr("textloom.operators.index.PART", 100)
    for n in (10, 20):
        df = spark.createDataFrame([(k, f"one two three {k} " * 10) for k in range(n)], "doc int, t string")
        found = PositionalIndex.build(df, "doc", "t", f"file://{tmp_path}/{n}")
        parts = 40 * n // 100 + 1
        assert found.parts == parts and found.postings.select(F.input_file_name()).distinct().count() > parts * 0.7
        assert found.texts.count() == n
        rows = found.search(["two three"], num_left_tokens=1, num_right_tokens=1).filter("id = 3 AND hit = 2").collect()
        assert [(r["left_context"], r["matched_text"], r["right_context"]) for r in rows] == [("one", "two three", "3")]


def test_an_index_keeps_numbers_as_differences(spark, tmp_path):
    """And ends follow of the tokens."""
    words = np.array([f"Wört{k:x}" for k in range(500)])
    texts = [" ".join(words[np.random.default_rng(n).integers(0, 500, 300)]) for n in range(10)]
    found = PositionalIndex.build(spark.createDataFrame(list(enumerate(texts)), "doc int, t string"), "doc", "t", f"file://{tmp_path}/i")
    group = pq.ParquetFile(next((tmp_path / "i" / "postings").glob("*.parquet"))).metadata.row_group(0)
    kinds = {group.column(k).path_in_schema: group.column(k).encodings for k in range(group.num_columns)}
    assert all("DELTA_BINARY_PACKED" in kinds[c] for c in ("row", "place", "start", "end"))
    row = found.search([str(words[7])]).orderBy("id", "hit").first()
    assert texts[row["id"]][row["start_idx"] : row["end_idx"]] == row["matched_text"] == words[7]
