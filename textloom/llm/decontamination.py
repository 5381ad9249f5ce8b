"""Benchmark decontamination by size-partitioned MinHash containment search (operator 3).

Words are lower-cased runs of letters, digits and non-ASCII characters; an item's set holds its
word 5-grams (all of its words where it has fewer). Items are partitioned by the size of their
sets, which sets the depth of their sketch and the least document they are looked for in: a
document that holds a share c of an item's n shingles has at least ceil(c * n), and holds one of
any n - ceil(c * n) + 1 of them, so no true container is missed, however long it is. (MinHash of
whole documents, as in LSH ensembles, would need over 10,000 bands for a 10-shingle item in a
20,000-word document.) A sketch takes the shingles that fewest documents hold, of equally rare
ones the least hashes, so what an item shares with many documents makes no candidates.

Documents are read once: they emit the shingles that a bit map of all items' shingles lets pass.
Joined with the sketches these give candidates, and each candidate is settled by the
item's own shingles among the document's, which is the exact containment. Neither side
passes through the driver but for the map of fixed size; a larger benchmark fills it more, and
then more shingles go to the joins, but no other results come of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .repeats import document
from .session import fresh, read_table, staged
from .vectext import Words, mix, signed, slabs, utf8

SHINGLE, CONTAINMENT = 5, 0.8
#: Bits of a map, as a power of two: 2 MB.
MAP = 24


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array([None if x is None else x.lower() for x in column.to_pylist()], pa.string()))


def shingles(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``width`` words; the width is part of the hash."""
    at, found = words.windows(hashes, width)
    return words.row[at], mix(found + np.uint64(width))


def _item_rows(containment: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(item, size, need, hash) of the distinct shingles of items (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = lowered(batch.column(1))
            for i, j in slabs(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], loose=True)
                hashes, count = words.hashes(), np.diff(words.first)
                parts = []
                for width in range(1, SHINGLE + 1):
                    row, found = shingles(words, hashes, width)
                    own = np.minimum(count[row], SHINGLE) == width
                    parts.append((row[own], found[own]))
                row, found = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((found, row))
                row, found = row[order], found[order]
                new = np.append(True, (row[1:] != row[:-1]) | (found[1:] != found[:-1]))[: len(row)]
                row, found = row[new], found[new]
                size = np.bincount(row, minlength=j - i)
                need = np.ceil(containment * size - 1e-9).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array(size[row]), pa.array(need[row]), pa.array(signed(found))], names=["item", "size", "need", "hash"])

    return run


def bit_map(hashes: DataFrame, size: int = MAP) -> np.ndarray:
    """The map of a column ``hash``: at most 2^(size - 6) words of 64 bits reach the driver, whatever the number of hashes."""
    at = F.shiftrightunsigned("hash", 64 - size)
    words = hashes.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(63).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _passing(bits: np.ndarray, widths: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc, row, words, hash) of the distinct shingles of documents (doc, row, text) that the map has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, offs = lowered(batch.column(2))
            rows, hashes, count = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], np.zeros(len(doc), np.int64)
            for i, j in slabs(offs):
                words = Words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], loose=True)
                one, count[i:j] = words.hashes(), np.diff(words.first)
                for width in widths:
                    row, found = shingles(words, one, width)
                    at = found >> np.uint64(64 - MAP)
                    has = (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    row, found = row[has], found[has]
                    order = np.lexsort((found, row))
                    new = np.append(True, (row[order][1:] != row[order][:-1]) | (found[order][1:] != found[order][:-1]))[: len(row)]
                    rows.append(i + row[order][new])
                    hashes.append(found[order][new])
            row, found = np.concatenate(rows), np.concatenate(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(own[row]), pa.array(count[row]), pa.array(signed(found))], names=["doc", "row", "words", "hash"])

    return run


def candidates(held: DataFrame, sets: DataFrame) -> DataFrame:
    """(doc, row, item) of the documents with a sketched shingle, from ``held`` (doc, row, words, hash) and ``sets`` (item, size, need, hash)."""
    known = sets.join(held.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")), "hash")
    absent = sets.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(known.groupBy("item").agg(F.count(F.lit(1)).alias("met")), "item").select("item", (F.col("n") - F.col("met")).alias("absent"))
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("docs", "hash")) + F.col("absent")  # what no document holds comes first
    sketches = known.join(absent, "item").withColumn("rank", rarest).filter("rank <= size - need + 1").select("item", "need", "hash")
    met = held.join(sketches, "hash").filter(F.col("need") <= F.greatest(F.lit(1), F.col("words") - (SHINGLE - 1)))
    return met.select("doc", "row", "item").distinct()


def containments(docs: DataFrame, items: DataFrame, containment: float, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """(doc, row, item_id, n_shingles, n_shared) for each row of ``items`` and each document (``repeats.document``) that holds enough of it."""
    doc, row = document(id_col, text_col)
    texts = docs.select(doc.alias("doc"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    rows = staged(items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).cast("string").alias("text")).withColumn("item", F.monotonically_increasing_id()), "items")
    sets = staged(rows.select("item", "text").mapInArrow(_item_rows(containment), "item bigint, size bigint, need bigint, hash bigint"), "sets")
    words = F.least(F.lit(SHINGLE), F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))))
    widths = sorted(r[0] for r in rows.select(words).distinct().collect() if (r[0] or 0) > 0)  # five at most
    held = staged(texts.mapInArrow(_passing(bit_map(sets), widths), "doc bigint, row bigint, words bigint, hash bigint"), "held")
    asked = staged(candidates(held, sets), "candidates")
    shared = asked.join(sets, "item").join(held.select("doc", "row", "hash"), ["doc", "row", "hash"], "left_semi")
    counted = shared.groupBy("doc", "row", "item").agg(F.count(F.lit(1)).alias("n_shared"), F.first("size").alias("n_shingles"), F.first("need").alias("need")).filter("n_shared >= need")
    return counted.join(rows.select("item", "item_id"), "item").select("doc", "row", "item_id", "n_shingles", "n_shared")


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of documents that hold ``containment`` or more of an item.

    Null and empty texts and items hold and match nothing, and so does an empty table; rows that
    repeat, of either table, give rows that repeat; null ids stay null, and of rows that share an
    id each is judged by its own text. Texts may have any length; other columns are ignored.
    """
    d, r = fresh("doc"), fresh("row")
    doc, row = document(id_col, text_col)
    found = staged(containments(docs, items, containment, id_col, text_col, item_id, item_text), "contained").withColumnsRenamed({"doc": d, "row": r})
    own = docs.select(F.col(id_col).alias("doc_id"), doc.alias(d), row.alias(r))
    share: Column = (F.col("n_shared") / F.col("n_shingles")).alias("containment")
    return own.join(found, [d, r]).select("doc_id", "item_id", "n_shingles", "n_shared", share)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that hold a benchmark item, all columns as they were.

    Rows are judged one by one by their own texts: those without an id as well, and of those that
    share an id only the ones that hold an item go. Null and empty texts stay, texts may have any
    length, and of an empty table nothing is left; without items nothing goes.
    """
    d, r = fresh("doc"), fresh("row")
    doc, row = document("doc_id", "text")
    found = containments(docs.select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), CONTAINMENT, "doc_id", "text", "item_id", "text")
    leaks = staged(found.select(F.col("doc").alias(d), F.col("row").alias(r)).distinct(), "leaks")
    return docs.withColumn(d, doc).withColumn(r, row).join(leaks, [d, r], "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
bs AS (SELECT DISTINCT item_id, least(len(ws), 5) AS w, unnest(list_transform(generate_series(1, len(ws) - least(len(ws), 5) + 1), lambda i: array_to_string(ws[i:i + least(len(ws), 5) - 1], ' '))) AS s FROM b WHERE len(ws) > 0),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (SELECT DISTINCT doc_id, w, unnest(list_transform(generate_series(1, len(ws) - w + 1), lambda i: array_to_string(ws[i:i + w - 1], ' '))) AS s FROM d, (SELECT DISTINCT w FROM bs) WHERE len(ws) >= w),
m AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (w, s) GROUP BY 1, 2)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(k AS BIGINT) AS n_shared, CAST(k AS DOUBLE) / n AS containment FROM m JOIN n USING (item_id) WHERE k >= 0.8 * n
"""
