from __future__ import annotations

import hashlib
import threading
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest

from textloom.functions.embedding import embedding
from textloom.functions.tokenize import NATIVE, tokenize
from textloom.sources import cache, store
from textloom.sources.log import ArrowFiles, File, HadoopFiles, Log, shared_path
from textloom.sources.store import Lookup, Store, hash_text

SCHEMA = pa.schema([("k", pa.string()), ("content_hash", pa.string()), ("v", pa.int64())])


def table(texts):
    return pa.table({"k": ["x"] * len(texts), "content_hash": [hash_text(t) for t in texts], "v": pa.array([len(t) for t in texts], pa.int64())})


def lengths(todo):
    return pa.table({"v": pa.array([len(t) for t in todo], pa.int64())})


def test_a_lookup_reads_the_row_groups_of_its_hashes(tmp_path, monkeypatch):
    monkeypatch.setattr(store, "GROUP", 50)
    Store(str(tmp_path), SCHEMA, {"k": "x"}).add(table([f"t{k}" for k in range(2500)]))
    one = Store(str(tmp_path), SCHEMA, {"k": "x"})
    got = one.fetch([hash_text(f"t{k}") for k in range(0, 100, 10)])
    assert got.num_rows == 10 and one.groups_read <= 10  # of 50
    assert one.fetch([hash_text("none"), "0" * 64, "f" * 64]).num_rows == 0 and one.groups_read <= 13
    assert Store(str(tmp_path), SCHEMA, {"k": "other"}).fetch([hash_text("t1")]).num_rows == 0


def test_files_out_of_range_stay_closed(tmp_path):
    ordered = sorted((f"t{k}" for k in range(400)), key=hash_text)
    for part in range(4):
        Store(str(tmp_path), SCHEMA, {"k": "x"}).add(table(ordered[100 * part : 100 * part + 100]))
    one = Store(str(tmp_path), SCHEMA, {"k": "x"})
    assert one.fetch([hash_text(t) for t in ordered[210:220]]).num_rows == 10 and len(one.opened) == 1


def test_writers_leave_each_key_once(tmp_path):
    def write(n):
        for part in range(5):
            lookup = Lookup(Store(str(tmp_path), SCHEMA, {"k": "x"}), lengths)
            lookup.rows([f"text {(k + n) % 40}" for k in range(8 * part, 8 * part + 12)])
            lookup.close()

    writers = [threading.Thread(target=write, args=(n,)) for n in range(6)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    one = Store(str(tmp_path), SCHEMA, {"k": "x"})
    rows = one.fetch([hash_text(f"text {k}") for k in range(60)])
    assert rows.num_rows == len(set(rows["content_hash"].to_pylist())) == sum(f.rows for f in one.log.live.values()) == 40


def test_a_killed_writer_leaves_nothing_and_stops_nobody(spark, tmp_path):
    path = str(tmp_path / "c")
    dead = Store(path, SCHEMA, {"k": "x"})
    dead.log.commit = lambda files: (_ for _ in ()).throw(KeyboardInterrupt)  # after its file, before its commit
    with pytest.raises(KeyboardInterrupt):
        dead.add(table(["a", "b"]))
    began = time.perf_counter()
    Store(path, SCHEMA, {"k": "x"}).add(table(["a"]))
    assert time.perf_counter() - began < 5
    schema = "k string, content_hash string, v bigint"
    assert cache.read_cache(spark, path, schema).count() == 1 and len(ArrowFiles(path).names("data")) == 2
    assert cache.compact(spark, path, schema, grace=3600) == 1 and len(ArrowFiles(path).names("data")) == 3
    cache.compact(spark, path, schema, grace=-1)
    assert len(ArrowFiles(path).names("data")) == 1 and len(ArrowFiles(path).names("log")) == 1 and cache.read_cache(spark, path, schema).count() == 1
    late = Store(path, SCHEMA, {"k": "x"})
    late.add(table(["c"]))
    assert late.fetch([hash_text("a"), hash_text("c")]).num_rows == 2


def test_a_lease_of_a_killed_process_runs_out(spark, tmp_path):
    path = str(tmp_path / "c")
    held = cache.locked(spark, path, lease=0.5)
    held.__enter__()  # and never given back
    with pytest.raises(TimeoutError, match="no lock"):
        with cache.locked(spark, path, wait=0.1):
            pass
    with cache.locked(spark, path, wait=5):
        pass
    with cache.locked(spark, path, wait=0.1):
        pass


@pytest.mark.parametrize("kind", ["arrow", "hadoop"])
def test_files_are_put_once(spark, tmp_path, kind):
    files = ArrowFiles(str(tmp_path)) if kind == "arrow" else HadoopFiles(spark, f"file://{tmp_path}")
    assert files.names("log") == []
    log, other = Log(files), Log(files)
    assert log.commit([File("data/a", "0", "5", 1)]) and not other.commit([File("data/b", "2", "4", 2)])
    assert [f.name for f in other.refresh()] == ["data/a"] and other.commit([File("data/b", "2", "4", 2)])
    assert [f.name for f in log.refresh()] == ["data/b"] and log.refresh() == []
    assert log.commit([File("data/c", "0", "5", 3)], base=True) and set(log.live) == {"data/c"}
    late = Log(files)
    late.refresh()
    assert set(late.live) == {"data/c"} and late.version == 3
    files.delete("log/" + files.names("log")[0][0])
    assert len(files.names("log")) == 2


def test_both_routes_share_a_cache(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.createDataFrame([(k, f"text number {k % 60}") for k in range(200)], "id int, t string").repartition(6)
    plain = df.select("id", tokenize("t", model=NATIVE).alias("x")).orderBy("id").collect()
    for n in range(3):
        part = df.filter(f"id % 3 <= {n}")
        assert part.select("id", tokenize("t", model=NATIVE, cache=path).alias("x")).count() == part.count()
        part.select("id", tokenize("t", model=NATIVE, cache=path).alias("x")).write.format("noop").mode("overwrite").save()
    assert cache.tokens(df, "t", path, model=NATIVE, out_col="x").select("id", "x").orderBy("id").collect() == plain
    rows = cache.token_cache_snapshot(spark, path)[1]
    assert sorted(r[2] for r in rows) == sorted({hashlib.sha256(f"text number {k}".encode()).hexdigest() for k in range(60)})
    assert cache.compact(spark, path, cache.TOKEN_CACHE) <= 4
    assert df.select("id", tokenize("t", model=NATIVE, cache=path).alias("x")).orderBy("id").collect() == plain
    assert sorted(cache.token_cache_snapshot(spark, path)[1]) == sorted(rows)


def test_what_a_limit_leaves_is_kept(spark, tmp_path):
    path = str(tmp_path / "tokens")
    df = spark.range(30_000).selectExpr("id", "concat('text ', id) AS t").coalesce(1)
    assert len(df.select(tokenize("t", model=NATIVE, cache=path).alias("x")).limit(2).collect()) == 2
    df.limit(2).select(tokenize("t", model=NATIVE, cache=path)).collect()
    rows = cache.token_cache_snapshot(spark, path)[1]
    assert len(rows) == len({r[2] for r in rows}) >= 2


def test_many_files_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MANY", 3)
    path = str(tmp_path / "vectors")
    for k in range(6):
        df = spark.createDataFrame([(1, f"a {k}"), (2, f"b {k}"), (3, None)], "id int, t string")
        got = cache.embeddings(df, "t", path, embedder_model="hashing:8", out_col="x").select("id", "x").orderBy("id").collect()
        assert got == df.select("id", embedding("t", embedder_model="hashing:8").alias("x")).orderBy("id").collect()
    assert cache.read_cache(spark, path, cache.EMBEDDING_CACHE).count() == 12
    assert any(Log(ArrowFiles(path))._commit(int(n.removesuffix(".json")))["base"] for n, _ in ArrowFiles(path).names("log"))


def test_bare_paths_are_refused_on_clusters():
    cluster, local = (SimpleNamespace(sparkContext=SimpleNamespace(master=m)) for m in ("spark://host:7077", "local[4]"))
    with pytest.raises(ValueError, match="with its scheme"):
        shared_path("/x", cluster)
    assert shared_path("/x/", local) == "/x" and shared_path("hdfs://h/x", cluster) == "hdfs://h/x"
