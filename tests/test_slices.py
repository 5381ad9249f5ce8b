from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import embedding as e
from textloom.functions.slices import ITEM, PART, sliced
from textloom.functions.tokenize import NATIVE, token_rows, token_strings, tokenize
from textloom.sources import store
from textloom.sources.store import Lookup, Store, hash_text


@pytest.mark.parametrize("rows, most, want", [
    (pa.array(["aa", None, "bbb", "", "c" * 9]), 5, [3, 1, 1]),
    (pa.array(["é" * 3, "x"]), 3, [1, 1]),
    (pa.array([], pa.string()), 5, [0]),
    (pa.array([["a", "b"], None, [], ["c"], ["d" * 5000]], pa.list_(pa.string())), 3 * ITEM + 3, [4, 1]),
])
def test_slices_are_bounded_and_whole(rows, most, want):
    found = list(sliced(rows, most))
    assert pa.concat_arrays(found) == rows
    assert sum(want) == len(rows) and all(len(x) == 1 or sum(map(len, filter(None, x.to_pylist()))) <= most for x in found if len(x))
    assert len(found) <= len(want) + 1


def test_tokens_and_vectors_of_a_batch_of_many_slices(spark):
    """Texts of several slices in one batch, nulls and one longer than a slice among them."""
    texts = [(k, None if k % 7 == 0 else f"word{k} the end. " * (PART // 400)) for k in range(40)] + [(40, "long one " * PART)]
    df = spark.createDataFrame(texts, "id int, t string").coalesce(1)
    assert sum(len(t or "") for _, t in texts) > 3 * PART
    plain = df.select("id", F.size(token_strings("t")).alias("n")).collect()
    made = df.select("id", F.size(tokenize("t", model=NATIVE)).alias("n")).collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, made))
    assert token_rows(df, "id", "t").count() == sum(r["n"] for r in plain)
    lists = df.select("id", F.split("t", "[.]").alias("t"))
    sizes = lists.select("id", F.size(e.embedding_lists("t", embedder_model="hashing:4")).alias("n"), F.coalesce(F.size("t"), F.lit(0)).alias("want")).collect()
    assert all(r["n"] == max(r["want"], 0) for r in sizes)


def test_each_word_is_hashed_once(monkeypatch):
    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(e.hashlib, "md5", lambda data, **options: calls.append(data) or md5(data, **options))
    made = e._hashing(8)(["a b a", "", "B a  c" * 3])
    assert len(calls) == len(set(calls)) and made.shape == (3, 8) and made.dtype == np.float32
    assert not made[1].any() and np.allclose(np.linalg.norm(made[[0, 2]], axis=1), 1)


def test_a_lookup_holds_what_it_was_asked_for(tmp_path, monkeypatch):
    """And not all row groups that random hashes can be in; what was computed is added once it is large."""
    schema = pa.schema([("k", pa.string()), ("content_hash", pa.string()), ("v", pa.list_(pa.int64()))])
    made = lambda todo: pa.table({"v": pa.array([range(20_000)] * len(todo), pa.list_(pa.int64()))})
    lookup = Lookup(Store(str(tmp_path), schema, {"k": "x"}), made)
    texts = [f"t{k}" for k in range(600)]
    for at in range(0, 600, 50):
        lookup.rows(texts[at : at + 50])
    assert len(lookup.store.log.live) > 1
    lookup.close()
    del lookup
    seen, before, is_in = [], pa.total_allocated_bytes(), store.pc.is_in
    monkeypatch.setattr(store.pc, "is_in", lambda *x, **y: seen.append(pa.total_allocated_bytes() - before) or is_in(*x, **y))
    found = Store(str(tmp_path), schema, {"k": "x"}).fetch([hash_text(t) for t in texts[::60]])
    assert found.num_rows == 10 and max(seen) < 600 * 160_000 / 3
