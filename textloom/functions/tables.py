"""Concordances and chunks in SQL.

``register_tables(spark)`` gives a session two forms of each. ``concordance_hits`` and ``text_chunks``
are table functions over ``TABLE(...)`` of an id and a text, batch by batch with Arrow.
``concordance`` and ``chunks`` are functions of a row's text for ``LATERAL VIEW``:

    SELECT doc_id, h.* FROM documents LATERAL VIEW inline(concordance(text, 'word', 3, 4, false, false)) h
    SELECT * FROM concordance_hits(TABLE(SELECT doc_id AS id, text FROM documents), 'word', 3, 4, false, false)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, arrow_udtf

from .chunking import chunk_texts, count_words
from .concordance import HIT, HITS, compile_search, hit_lists


def _scalar(x: object) -> object:
    """An argument that is one for all rows."""
    x = x[0] if isinstance(x, pa.Array | pa.ChunkedArray) else x
    return x.as_py() if isinstance(x, pa.Scalar) else x


def _hits(texts: pa.Array, word: object, left: object, right: object, regex: object, case_sensitive: object) -> pa.ListArray:
    search, left, right, regex, case_sensitive = map(_scalar, (word, left, right, regex, case_sensitive))
    pattern = compile_search(search, bool(regex), bool(case_sensitive)) if search else None
    return hit_lists(texts.to_pylist(), pattern, max(0, left), max(0, right))


def _ids(ids: pa.Array, lists: pa.ListArray) -> pa.Array:
    return ids.cast(pa.int64()).take(lists.value_parent_indices())


class ConcordanceHits:
    """A table of (id, text) and the arguments of ``concordance`` to a row for each hit."""

    def eval(self, rows: pa.RecordBatch, word: pa.Array, left: pa.Array, right: pa.Array, regex: pa.Array, case_sensitive: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            found = _hits(rows.column(1), word, left, right, regex, case_sensitive)
            flat = found.flatten()
            yield pa.table([_ids(rows.column(0), found), *flat.flatten()], names=["id", *(f.name for f in flat.type)])


def _chunked(texts: pa.Array, max_tokens: object, overlap: object) -> pa.ListArray:
    return pa.array(chunk_texts(texts.to_pylist(), _scalar(max_tokens), _scalar(overlap), count_words), pa.list_(pa.string()))


class TextChunks:
    """A table of (id, text), the budget of words and the overlap to a row for each chunk."""

    def eval(self, rows: pa.RecordBatch, max_tokens: pa.Array, overlap: pa.Array) -> Iterator[pa.Table]:
        if rows.num_rows:
            found = _chunked(rows.column(1), max_tokens, overlap)
            index = pa.array([k for own in found.to_pylist() for k in range(len(own))], pa.int32())
            yield pa.table({"id": _ids(rows.column(0), found), "chunk_index": index, "chunk": found.flatten()})


def _concordance(text: pa.Array, word: pa.Array, left: pa.Array, right: pa.Array, regex: pa.Array, case_sensitive: pa.Array) -> pa.Array:
    return _hits(text, word, left, right, regex, case_sensitive) if len(text) else hit_lists([], None, 0, 0)


def _chunks(text: pa.Array, max_tokens: pa.Array, overlap: pa.Array) -> pa.Array:
    return _chunked(text, max_tokens, overlap) if len(text) else pa.array([], pa.list_(pa.string()))


def register_tables(spark: SparkSession) -> None:
    """Make both forms usable in this session's SQL; the arguments besides the text must be constants."""
    spark.udtf.register("concordance_hits", arrow_udtf(ConcordanceHits, returnType=f"id bigint, {HIT}"))
    spark.udtf.register("text_chunks", arrow_udtf(TextChunks, returnType="id bigint, chunk_index int, chunk string"))
    spark.udf.register("concordance", arrow_udf(_concordance, HITS))
    spark.udf.register("chunks", arrow_udf(_chunks, "array<string>"))
