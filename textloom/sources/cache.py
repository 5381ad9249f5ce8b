"""Caches of results by content: folders of Parquet files with a commit log (``log``).

A text's key is the SHA-256 of its UTF-8. A run hashes, looks the keys up by a join, computes what
is missing once per distinct text into files of its own, commits them, less what other writers have
committed meanwhile, and joins everything back. ``cache=`` of ``tokenize`` and ``embedding`` adds to
the same folders from its tasks (``store``). A key is there once, whoever writes. ``compact`` makes
few files of many, sorted by key.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import EMBEDDING_CACHE, REVISION, embedding, normalize_embedder, settings
from ..functions.tokenize import TOKEN_CACHE, normalize_model, params_hash, tokenize
from ..names import fresh
from ..operators.stages import swept
from .log import ArrowFiles, File, HadoopFiles, Log, driver_log, is_local, shared_path

#: Seconds that a lease lasts, and that one is waited for; files that a cache may have before it is compacted; seconds that unnamed files stay.
LEASE, LEASE_WAIT, MANY, GRACE = 600.0, 600.0, 64, 3600.0
#: Of Spark's Parquet writer: small row groups and Bloom filters of the keys (of a megabyte each, if nothing says how many there are), for lookups of single hashes; offsets as differences, which need few bits.
_WRITE = {"parquet.block.size": str(1 << 20), "parquet.bloom.filter.enabled#content_hash": "true", "parquet.bloom.filter.expected.ndv#content_hash": "4096", "compression": "zstd", "parquet.writer.version": "v2"}
_WRITE |= {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("start_offsets", "end_offsets")}


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.encode(F.col(c) if isinstance(c, str) else c, "UTF-8"), 256)


def _rows(spark: SparkSession, path: str, names: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The cache at ``path`` as of now, empty if there is none yet."""
    path = shared_path(path, spark)
    return _rows(spark, path, list(driver_log(spark, path).live), schema)


@contextlib.contextmanager
def locked(spark: SparkSession, path: str, wait: float = LEASE_WAIT, lease: float = LEASE) -> Iterator[None]:
    """Hold the lease on a cache's upkeep. Writers don't need it; one that was killed loses it when its time is over.

    Leases are numbered files that only one can create; the next number may be taken once the last
    lease is given back or has run out.
    """
    path = shared_path(path, spark)
    files = ArrowFiles(path) if is_local(path) else HadoopFiles(spark, path)
    until = time.monotonic() + wait
    while True:
        names = [n for n, _ in files.names("lease")]
        last = max((int(n.partition(".")[0]) for n in names), default=0)
        free = not last or f"{last:020d}.done" in names or json.loads(files.read(f"lease/{last:020d}.held"))["until"] < time.time()
        mine = f"lease/{last + 1:020d}"
        if free and files.put(f"{mine}.held", json.dumps({"until": time.time() + lease}).encode()):
            break
        if time.monotonic() > until:
            raise TimeoutError(f"no lock on the cache {path}: another process has the lease {last}")
        time.sleep(0.1)
    for name in names:
        if int(name.partition(".")[0]) < last:
            files.delete(f"lease/{name}")
    try:
        yield
    finally:
        files.put(f"{mine}.done", b"")


def _written(spark: SparkSession, log: Log, path: str, schema: str, rows: DataFrame) -> list[File]:
    """Write rows below ``data``; the files and their ranges of keys, none if there are no rows."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.write.options(**_WRITE).parquet(f"{path}/{folder}")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    found = spark.read.schema(schema).parquet(f"{path}/{folder}").groupBy(name.alias("name")).agg(F.min("content_hash").alias("least"), F.max("content_hash").alias("greatest"), F.count(F.lit(1)).alias("rows"))
    files = [File(f"{folder}/{r['name']}", r["least"], r["greatest"], r["rows"]) for r in found.collect()]  # a row a file
    if not files:
        log.files.delete(folder)
    swept(spark)  # texts were shuffled
    return files


def compact(spark: SparkSession, path: str, schema: str, grace: float = GRACE) -> int:
    """Write all rows anew, dealt out by ranges of hashes and sorted, and commit that as the base; the number of files.

    What writers commit meanwhile stays beside it. Files that nothing names any more go when they
    are ``grace`` seconds old, so that jobs which still read them can end.
    """
    path = shared_path(path, spark)
    with locked(spark, path):
        log = driver_log(spark, path)
        old = set(log.live)
        rows = _rows(spark, path, list(old), schema)
        files = _written(spark, log, path, schema, rows.repartitionByRange("content_hash").sortWithinPartitions("content_hash")) if old else []
        while not log.commit([*files, *(f for name, f in log.live.items() if name not in old)], base=True):
            log.refresh()
        log.sweep(grace)
        return len(log.live)


def misses(texts: DataFrame, cached: DataFrame, text_col: str = "text") -> DataFrame:
    """(content_hash, text) of distinct texts that ``cached`` has not; nulls aside."""
    hashed = texts.filter(F.col(text_col).isNotNull()).select(content_hash(text_col).alias("content_hash"), F.col(text_col).alias("text"))
    return hashed.dropDuplicates(["content_hash"]).join(cached.select("content_hash"), "content_hash", "left_anti")


def _cached(df: DataFrame, text_col: str, out_col: str, path: str, schema: str, keys: dict[str, str], compute: Callable[[DataFrame], DataFrame], stored: tuple[str, ...], value: Callable[[Column], Column], kind: str, valid: Column | None = None) -> DataFrame:
    spark, path = df.sparkSession, shared_path(path, df.sparkSession)
    log = driver_log(spark, path)

    def own(names: list[str]) -> DataFrame:
        rows = _rows(spark, path, names, schema)
        for k, v in keys.items():
            rows = rows.filter(F.col(k) == v)
        return rows.filter(valid) if valid is not None else rows

    new = compute(misses(df, own(list(log.live)), text_col))
    rows = new.select(*[F.lit(v).alias(k) for k, v in keys.items()], *new.columns)
    files = _written(spark, log, path, schema, rows.sortWithinPartitions("content_hash"))
    while files and not log.commit(files):
        others = own([f.name for f in log.refresh()]).select("content_hash")
        made = _rows(spark, path, [f.name for f in files], schema)
        if not made.join(others, "content_hash", "left_semi").isEmpty():
            files = _written(spark, log, path, schema, made.join(others, "content_hash", "left_anti").sortWithinPartitions("content_hash"))
    if files and len(log.live) > MANY:
        compact(spark, path, schema)
        log.refresh()
    own_hash, cached_hash, found_value = fresh("own"), fresh("hash"), fresh("value")
    found = own(list(log.live)).select(F.col("content_hash").alias(cached_hash), F.struct(*stored).alias(found_value)).dropDuplicates([cached_hash])  # made into a value once it is where it belongs
    joined = df.withColumn(own_hash, content_hash(text_col)).join(found, F.col(own_hash) == F.col(cached_hash), "left")
    kept = [c for c in df.columns if c != out_col]
    return joined.select(*kept, F.coalesce(value(F.col(found_value)), F.array().cast(kind)).alias(out_col))


def tokens(df: DataFrame, text_col: str, path: str, *, model: str, lowercase: bool = True, remove_punct: bool = True, out_col: str | None = None) -> DataFrame:
    """``df`` with its texts tokenized through the cache at ``path``; filters and limits on ``df`` hold before."""
    model = normalize_model(model)

    def compute(todo: DataFrame) -> DataFrame:
        t = todo.withColumn("t", tokenize("text", model=model, lowercase=lowercase, remove_punct=remove_punct))
        return t.select("content_hash", F.col("t.token").alias("tokens"), F.col("t.start").alias("start_offsets"), F.col("t.end").alias("end_offsets"))

    def zipped(x: Column) -> Column:
        return F.transform(x["tokens"], lambda t, k: F.struct(t.alias("token"), F.get(x["start_offsets"], k).alias("start"), F.get(x["end_offsets"], k).alias("end")))

    return _cached(df, text_col, out_col or text_col, path, TOKEN_CACHE, {"model": model, "params_hash": params_hash(lowercase, remove_punct)}, compute, ("tokens", "start_offsets", "end_offsets"), zipped, "array<struct<token: string, start: bigint, end: bigint>>")


def embeddings(df: DataFrame, text_col: str, path: str, *, embedder_model: str | None = None, dim: int | None = None, batch_size: int | None = None, out_col: str | None = None) -> DataFrame:
    """``df`` with its texts embedded through the cache at ``path``; with ``dim``, vectors of another size are computed anew."""
    model = normalize_embedder(embedder_model)

    def compute(todo: DataFrame) -> DataFrame:
        made = todo.withColumn("embedding", embedding("text", embedder_model=model, batch_size=batch_size))
        return made.select("content_hash", F.size("embedding").cast("bigint").alias("dim"), "embedding", F.current_timestamp().alias("created_at"))

    valid = (F.size("embedding") == dim) if dim else None
    return _cached(df, text_col, out_col or text_col, path, EMBEDDING_CACHE, {"model": model, "revision": REVISION, "provider": settings().provider}, compute, ("embedding",), lambda x: x["embedding"], "array<float>", valid)


def token_cache_snapshot(spark: SparkSession, path: str) -> tuple[list[str], list[tuple]]:
    """Columns and rows of a token cache in the order of content hashes, for looking at."""
    rows = read_cache(spark, path, TOKEN_CACHE).orderBy("content_hash")
    return rows.columns, [tuple(r) for r in rows.collect()]
