from __future__ import annotations

from textloom.functions.tokenize import NATIVE, tokenize
from textloom.models import compiled_features, predefined_model_records
from textloom.sources import cache
from textloom.streaming.counts import streaming_token_counts


def test_hashes(spark):
    assert cache.params_hash(True, True) == "be73bb51742131fb5ab3882e0ed24e6770718b6e0e17f0ffaec125e170970960"
    assert spark.createDataFrame([("hello",)], "t string").select(cache.content_hash("t").alias("h")).first()["h"].startswith("2cf24dba5fb0a30e")


def test_token_cache(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(1, "alpha"), (2, "beta x"), (3, "alpha"), (4, None)], "id int, t string")
    got = {r["id"]: r["t"] for r in cache.tokens(df, "t", path, model=NATIVE).collect()}
    plain = {r["id"]: r["t"] for r in df.select("id", tokenize("t", model=NATIVE).alias("t")).collect()}
    assert got == plain and len(cache.token_cache_snapshot(spark, path)[1]) == 2
    cache.tokens(df, "t", path, model=NATIVE).collect()
    columns, rows = cache.token_cache_snapshot(spark, path)
    assert len(rows) == 2 and columns[:3] == ["model", "params_hash", "content_hash"]
    more = spark.createDataFrame([(k, f"text {k}") for k in range(5)], "id int, t string")
    cache.tokens(more.filter("id = 3"), "t", path, model=NATIVE).collect()
    assert len(cache.token_cache_snapshot(spark, path)[1]) == 3
    cache.tokens(more, "t", path, model=NATIVE, lowercase=False).collect()
    assert len(cache.token_cache_snapshot(spark, path)[1]) == 8


def test_embedding_cache(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id int, t string")
    first = cache.embeddings(df, "t", path, embedder_model="hashing:8", dim=8, out_col="v").orderBy("id").collect()
    again = cache.embeddings(df, "t", path, embedder_model="hashing:8", dim=8, out_col="v").orderBy("id").collect()
    assert first == again and first[2]["v"] == [] and len(first[0]["v"]) == 8
    assert cache.read_cache(spark, path, cache.EMBEDDING_CACHE).count() == 1


def test_models():
    assert "tokenization" in compiled_features() and len(predefined_model_records()) == 8


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a b a",), ("b c",)], "t string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    run = streaming_token_counts(stream, "t").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert {r["token"]: r["count"] for r in spark.table("counts").collect()} == {"a": 2, "b": 2, "c": 1}
