"""Substring dedup by recompression (operator 8).

Words are named by their hash, so a name is global without a lookup. A first round names runs
of one word, two more rounds name pairs: a name's bit, drawn anew each round, makes it a left
or a right half, and each left half merges with a right half after it. Whether two neighbours
merge depends on them alone, so the symbols inside equal passages are equal; ``lo`` and ``hi``
keep how much text decided a symbol. Of the symbols that a 20-word window decides by itself,
the one of least name stands for it. Neighbouring windows of one symbol form a segment, which
is recompressed by itself, round after round, until one symbol names it: shared symbols, met in
one shuffle, reveal the repeats, and equal top symbols verify them as a whole. Only where
segments of one symbol differ are their windows compared one by one (see ``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .repeats import covered, range_argmin, repeated_spans, with_spans
from .session import read_table
from .vectext import Words, mix, span_hash, sums, utf8

WIDTH = 20
_FAR = 1 << 60


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = Words(data, offs)
    return words.hashes(), words.row, words.first


def recompress(names: np.ndarray, row: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of each top symbol, and the span [lo, hi) of words that decides it (outside any row at a row's ends)."""
    n = len(names)
    joins = (names[1:] == names[:-1]) & (row[1:] == row[:-1])
    start = np.flatnonzero(np.append(True, ~joins))
    end = np.append(start[1:], n)
    owner = row[start]
    length = (end - start).astype(np.uint64)
    name = np.where(length > 1, mix(names[start] ^ (length * np.uint64(0x9E3779B97F4A7C15))), names[start])
    opens = np.append(True, owner[1:] != owner[:-1])
    closes = np.append(opens[1:], True)
    lo, hi = np.where(opens, -_FAR, start - 1), np.where(closes, _FAR, end + 1)
    for r in range(1, rounds + 1):
        right = mix(name + np.uint64(r * 0xA0761D6478BD642F % (1 << 64))) >> np.uint64(63) == 1
        merges = np.append(~right[:-1] & right[1:] & ~opens[1:], False)
        first = np.flatnonzero(np.append(True, ~merges[:-1]))
        last = first + merges[first]
        new = np.where(merges[first], mix(name[first] * np.uint64(0xE7037ED1A0B428DB) + name[last] + np.uint64(r)), name[first])
        new_lo = np.where(opens[first], -_FAR, lo[first - 1])
        new_hi = np.where(closes[last], _FAR, hi[np.minimum(last + 1, len(hi) - 1)])
        name, lo, hi, opens, closes = new, new_lo, new_hi, opens[first], closes[last]
    inside = (lo >= 0) & (hi < _FAR)
    return name[inside], lo[inside], hi[inside]


def elect(width: int) -> Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]:
    def run(values: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        name, lo, hi = recompress(values, row)
        return range_argmin(mix(name), np.searchsorted(lo, at), np.searchsorted(hi, at + width, side="right") - 1), lo, hi

    return run


def roots(names: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The symbol that each names[start : end] becomes when it is recompressed by itself, round by round, to one symbol.

    Rounds go on with what is not one symbol yet; what is left after many of them is named as it is.
    """
    length = end - start
    row = np.repeat(np.arange(len(start)), length)
    name = names[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    out = np.zeros(len(start), np.uint64)
    for r in range(1, 32):
        # runs become symbols, then pairs
        new = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))[: len(name)]
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(name))).astype(np.uint64)
        name, row = np.where(run > 1, mix(name[first] ^ (run * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(r)), name[first]), row[first]
        right = mix(name + np.uint64(r * 0xA0761D6478BD642F % (1 << 64))) >> np.uint64(63) == 1
        joins = np.append(~right[:-1] & right[1:] & (row[1:] == row[:-1]), False)[: len(name)]
        first = np.flatnonzero(np.append(True, ~joins[:-1])[: len(name)])
        last = first + joins[first]
        name, row = np.where(joins[first], mix(name[first] * np.uint64(0xE7037ED1A0B428DB) + name[last] + np.uint64(r)), name[first]), row[first]
        opens = np.append(True, row[1:] != row[:-1])[: len(row)]
        one = opens & np.append(opens[1:], True)[: len(row)]
        out[row[one]] = mix(name[one] + np.uint64(r))
        name, row = name[~one], row[~one]
        if not len(name):
            return mix(out + length.astype(np.uint64))
    c, inv = sums(name, 1)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    out[row[first]] = span_hash(c, inv, first, np.append(first[1:], len(name)))
    return mix(out + length.astype(np.uint64))


def _rows(width: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            raw, places, out = data.tobytes(), batch.column(2), []
            for i in range(batch.num_rows):
                words = raw[offs[i] : offs[i + 1]].split()
                n, gone = len(words), 0
                if places[i].is_valid and n:
                    spans = places[i].values
                    mask = covered(n, spans.field("start").to_numpy(zero_copy_only=False), spans.field("count").to_numpy(zero_copy_only=False), width)
                    gone = int(mask.sum())
                    words = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                kept = b" ".join(words)
                out.append((n, gone, hashlib.sha256(kept).hexdigest(), kept if texts else b""))
            n, gone, sha, kept = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word in a window of ``width`` words (20 to 200) that occurs earlier.

    Per row: doc_id, n_words, n_removed, kept_sha256 and (``texts``) kept_text, the kept words
    joined by one space. Null and empty texts have no words. Null ids come last; rows that share
    an id (null ones too) come in the order of their texts' hashes and are compared with each
    other, and rows equal in id and text are one document, each keeping what the others keep.
    Texts may have any length; an empty table gives an empty one; other columns are ignored.
    """
    if not 20 <= width <= 200:
        raise ValueError("width must be from 20 to 200 words")
    kind = dict(docs.dtypes)[id_col]
    spans = repeated_spans(docs, units, elect(width), roots, width, id_col, text_col)
    rows = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), spans, "doc_id", "text", "places")
    return rows.mapInArrow(_rows(width, texts), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * texts)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read_table(spark, sf_dir, "documents"), texts=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 19)) AS i, ws FROM w WHERE len(ws) >= 20),
h AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM win),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM f WHERE k > 1),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
