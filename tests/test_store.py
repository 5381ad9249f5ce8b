from __future__ import annotations

import random
import threading

import numpy as np
import pyarrow as pa
import pytest

from textloom.functions.embedding import Settings, embedding, load, model_folder, settings
from textloom.functions.tokenize import NATIVE, native_spans, native_tokens, tokenize
from textloom.sources import cache
from textloom.sources.store import Store, get_or_insert


@pytest.mark.parametrize("seed", range(6))
def test_native_tokens_are_the_spans(seed):
    rng = random.Random(seed)
    letters = ["a", "B", "é", "İ", "ς", "Σ", "1", "²", "你", "。", " ", "　", "\xa0", "\x1c", "\n", "-", "_", "[", "]", "$", "^", "🙂", "́", "'", "mask", "CLS", " pad ", "Unk", "[SEP]"]
    texts = [rng.choice([None, "", "".join(rng.choice(letters) for _ in range(rng.randrange(60)))]) for _ in range(80)]
    for lowercase in (True, False):
        for remove in (True, False):
            got = native_tokens(texts, lowercase, remove).to_pylist()
            want = [native_spans(t.lower() if lowercase else t, remove) if t else [] for t in texts]
            assert [[(x["token"], x["start"], x["end"]) for x in row] for row in got] == want
    assert native_tokens([], True, True).to_pylist() == [] and native_tokens([None, ""], True, True).to_pylist() == [[], []]


def test_cached_columns(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(1, "Alpha b"), (2, "beta"), (3, "Alpha b"), (4, None), (5, "")], "id int, t string").repartition(2)
    plain = df.select("id", tokenize("t", model=NATIVE).alias("x")).orderBy("id").collect()
    for _ in range(2):
        assert df.select("id", tokenize("t", model=NATIVE, cache=path).alias("x")).orderBy("id").collect() == plain
        rows = cache.token_cache_snapshot(spark, path)[1]
        assert {r[2] for r in rows} == {cache_hash(t) for t in ("Alpha b", "beta", "")}
    more = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "id int, t string")
    more.filter("id = 3").select(tokenize("t", model=NATIVE, cache=path)).collect()
    assert len({r[2] for r in cache.token_cache_snapshot(spark, path)[1]}) == 4
    vectors = str(tmp_path / "vectors")
    want = df.select("id", embedding("t", embedder_model="hashing:8").alias("x")).orderBy("id").collect()
    for _ in range(2):
        assert df.select("id", embedding("t", embedder_model="hashing:8", cache=vectors).alias("x")).orderBy("id").collect() == want
    assert cache.embeddings(df, "t", vectors, embedder_model="hashing:8", dim=8, out_col="x").select("id", "x").orderBy("id").collect() == want


def cache_hash(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def test_a_wrong_number_of_results_is_an_error(tmp_path):
    store = Store(str(tmp_path / "s"), pa.schema([("k", pa.string()), ("content_hash", pa.string()), ("v", pa.int64())]), {"k": "x"})
    with pytest.raises(ValueError, match="0 results for 1 texts"):
        get_or_insert(store, ["a"], lambda todo: pa.table({"v": pa.array([], pa.int64())}))
    assert get_or_insert(store, [None], lambda todo: None) == [None]


def test_clashing_names_and_two_writers(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(1, "alpha", "h", "v"), (2, "beta", "h", "v")], "id int, t string, content_hash string, _value string")
    out = cache.tokens(df, "t", path, model=NATIVE, out_col="x")
    assert out.columns == ["id", "t", "content_hash", "_value", "x"] and [len(r["x"]) for r in out.collect()] == [1, 1]
    texts = spark.createDataFrame([(k, f"text {k % 7}") for k in range(30)], "id int, t string")
    writers = [threading.Thread(target=lambda: cache.tokens(texts, "t", path, model=NATIVE).count()) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    rows = cache.token_cache_snapshot(spark, path)[1]
    assert len(rows) == len({r[2] for r in rows}) == 9


def test_lock_is_exclusive(spark, tmp_path):
    path = str(tmp_path / "c")
    with cache.locked(spark, path):
        with pytest.raises(TimeoutError, match="no lock"):
            with cache.locked(spark, path, wait=0.3):
                pass
    with cache.locked(spark, path, wait=0.3):
        pass


def _field(number, kind, value):
    """One field of a protocol buffer: kind 0 an integer, 2 bytes."""
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3 | kind) + (varint(value) if kind == 0 else varint(len(value)) + value)


def write_model(folder, vocabulary):
    """A model whose graph looks up a one-hot row for each token: an embedding is the share of each word."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({w: k for k, w in enumerate(["[UNK]", *vocabulary])}, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    folder.mkdir(parents=True)
    tokenizer.save(str(folder / "tokenizer.json"))
    n = len(vocabulary) + 1

    def value(name, kind, dims):
        shape = b"".join(_field(1, 2, _field(2, 2, d.encode())) if isinstance(d, str) else _field(1, 2, _field(1, 0, d)) for d in dims)
        return _field(1, 2, name) + _field(2, 2, _field(1, 2, _field(1, 0, kind) + _field(2, 2, shape)))

    table = _field(1, 0, n) + _field(1, 0, n) + _field(2, 0, 1) + _field(8, 2, b"table") + _field(9, 2, np.eye(n, dtype=np.float32).tobytes())
    node = _field(1, 2, b"table") + _field(1, 2, b"input_ids") + _field(2, 2, b"hidden") + _field(4, 2, b"Gather")
    graph = _field(1, 2, node) + _field(2, 2, b"g") + _field(5, 2, table) + _field(11, 2, value(b"input_ids", 7, ["b", "t"])) + _field(12, 2, value(b"hidden", 1, ["b", "t", n]))
    model = _field(1, 0, 8) + _field(7, 2, graph) + _field(8, 2, _field(2, 0, 13))
    (folder / "onnx").mkdir()
    (folder / "onnx" / "model.onnx").write_bytes(model)


def test_onnx_graph(spark, tmp_path):
    folder = tmp_path / "models" / "some" / "model"
    write_model(folder, ["a", "b", "c"])
    df = spark.createDataFrame([(1, "a b a"), (2, "c"), (3, None), (4, "other words a")], "id int, t string")
    got = [r["x"] for r in df.select("id", embedding("t", embedder_model=str(folder), batch_size=2).alias("x")).orderBy("id").collect()]
    assert np.allclose(got[0], np.array([0, 2, 1, 0]) / 5**0.5) and np.allclose(got[1], [0, 0, 0, 1]) and got[2] == []
    assert np.allclose(got[3], np.array([2, 1, 0, 0]) / 5**0.5)
    assert load(str(folder))(["a"]).shape == (1, 4)


def test_sessions_take_their_settings(spark, tmp_path, monkeypatch):
    assert settings() == Settings() and settings().provider == "cpu"
    monkeypatch.setenv("TEXTLOOM_EMBEDDING_THREADS", "3")
    monkeypatch.setenv("TEXTLOOM_EMBEDDING_PROVIDERS", " NoneExecutionProvider, CPUExecutionProvider")
    assert settings() == Settings(3, ("NoneExecutionProvider", "CPUExecutionProvider")) and settings().provider == "NoneExecutionProvider+CPUExecutionProvider"
    folder = tmp_path / "m"
    write_model(folder, ["a", "b"])
    with pytest.raises(ValueError, match="no execution provider NoneExecutionProvider"):
        load(str(folder), settings())
    monkeypatch.delenv("TEXTLOOM_EMBEDDING_PROVIDERS")
    for bad in ("0", "-1", "x", ""):
        monkeypatch.setenv("TEXTLOOM_EMBEDDING_THREADS", bad)
        assert settings().threads == 1
    monkeypatch.setenv("TEXTLOOM_EMBEDDING_THREADS", "2")
    df = spark.createDataFrame([("a b",)], "t string")
    assert np.allclose(df.select(embedding("t", embedder_model=str(folder)).alias("x")).first()["x"], np.array([0, 1, 1]) / 2**0.5)


def test_models_by_id(tmp_path, monkeypatch):
    monkeypatch.setenv("TEXTLOOM_MODELS", str(tmp_path))
    (tmp_path / "org" / "name").mkdir(parents=True)
    assert model_folder("org/name") == tmp_path / "org" / "name"
    with pytest.raises(FileNotFoundError, match="nothing is downloaded"):
        model_folder("org/none")
