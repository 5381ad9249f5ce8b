"""Phrase collocation mining (operator 12).

Texts become rows of n-grams, hash-aggregated per language: each task sends an n-gram and how often
it has it. No phrase is more frequent than what it is made of, so hashes of n-grams are counted length by
length, of those only whose first and last n - 1 words are frequent; bit maps of a fixed size tell,
which let some others through but keep none back. The phrases themselves then go out once, those
whose hashes are frequent, and are counted as what they are.
Counts of a phrase's parts, cuts, extensions and ranks are joins and windows over the frequent phrases.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontamination import bit_map
from .session import read_table, staged
from .vectext import Words, byte_sums, lowered_ascii, mix, signed, slabs, span_hash, strings, utf8

MOST, LEAST, SHARE, TOP, SALTS = 5, 100, 100, 2000, 64
#: Bytes of a slab, within which equal n-grams are counted; bits of a map, as a power of two: 4 MB.
SLAB, MAP = 1 << 20, 25
_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", 10, 11, 12, 13]] = True


def _grams(words: Words, langs: np.ndarray, width: int, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash, by language, of each run of ``width`` words of a row."""
    at, found = words.windows(words.hashes(k), width, k)
    return at, mix(found ^ langs[words.row[at]] ^ np.uint64(width))


def _row_hashes(column: pa.Array) -> np.ndarray:
    data, offs = utf8(column)
    c, inv = byte_sums(data, 0)
    return span_hash(c, inv, offs[:-1], offs[1:])


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - MAP)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words, np.ndarray, np.ndarray]]:
    """The texts (lang, text) some at a time: languages, words of pieces, their languages' hashes, and the piece of each word."""
    for batch in batches:
        langs = _row_hashes(batch.column(0))
        data, offs = utf8(batch.column(1))
        for i, j in slabs(offs, SLAB):
            low = lowered_ascii(data[offs[i] : offs[j]])
            cut = _CUTS[low]
            words = Words(np.where(cut, 32, low), offs[i : j + 1] - offs[i])
            yield batch.column(0).slice(i, j - i), words, langs[i:j], np.cumsum(cut)[words.start]


def _inside(words: Words, langs: np.ndarray, piece: np.ndarray, width: int, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the n-grams of ``width`` words that lie in a piece, and whose both parts one word shorter ``frequent`` has."""
    at, found = _grams(words, langs, width)
    own = piece[at] == piece[at + width - 1]
    if frequent is not None:
        begins, less = _grams(words, langs, width - 1)
        passes = np.zeros(len(words), bool)
        passes[begins] = _has(frequent, less)
        own &= passes[at] & passes[at + 1]
    return at[own], found[own]


def _hash_counts(width: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(hash, n) of the n-grams of texts (lang, text), once a slab; ``frequent`` is the map of those one word shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words, langs, piece in _slabs(batches):
            found, n = np.unique(_inside(words, langs, piece, width, frequent)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n)], names=["hash", "n"])

    return run


def _counted(widths: list[int], frequent: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, phrase, width, n) of the n-grams of texts (lang, text) that the maps of their widths have, once a slab; all of a width without a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_langs, words, langs, piece in _slabs(batches):
            text, start, end = words.joined()
            for width in widths:
                at, first = _inside(words, langs, piece, width, None)
                if width in frequent:
                    has = _has(frequent[width], first)
                    at, first = at[has], first[has]
                second = np.zeros(len(words), np.uint64)
                starts, found = _grams(words, langs, width, 1)
                second[starts] = found
                order = np.argsort(first, kind="stable")
                at, first, second = at[order], first[order], second[at[order]]
                new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(at)])
                one = at[new]
                phrase = strings(text, start[one], end[one + width - 1]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([own_langs.take(pa.array(words.row[one])), phrase, pa.array(np.full(len(one), width, np.int32)), pa.array(np.diff(np.append(new, len(at))))], names=["lang", "phrase", "width", "n"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each phrase (lang, phrase), as ``_grams`` has it."""
    for batch in batches:
        langs, (data, offs) = _row_hashes(batch.column(0)), utf8(batch.column(1))
        words = Words(data, offs)
        count = np.diff(words.first)
        out = np.zeros(len(count), np.uint64)
        for width in np.unique(count).tolist():
            at, found = _grams(words, langs, width)
            whole = at == words.first[words.row[at]]
            mine = whole & (count[words.row[at]] == width)
            out[words.row[at[mine]]] = found[mine]
        yield pa.RecordBatch.from_arrays([pa.array(signed(out))], names=["hash"])


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, width, f) of the phrases of up to ``most`` words that occur ``least`` times or more, and (lang, n), all words of a language."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counted = "lang string, phrase string, width int, n bigint"

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lang", "phrase", "width").agg(F.sum("n").alias("f"))

    words = staged(summed(texts.mapInArrow(_counted([1], {}), counted)), "words")
    totals, single = words.groupBy("lang").agg(F.sum("f").alias("n")), words.filter(F.col("f") >= least)
    maps = {1: bit_map(single.select("lang", "phrase").mapInArrow(_hashed, "hash bigint"), MAP)}
    for width in range(2, most + 1):
        hashes = texts.mapInArrow(_hash_counts(width, maps[width - 1]), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
        maps[width] = bit_map(hashes.filter(F.col("n") >= least), MAP)
    longer = {w: bits for w, bits in maps.items() if w > 1}
    phrases = summed(texts.mapInArrow(_counted(sorted(longer), longer), counted)).filter(F.col("f") >= least)
    return single.unionByName(staged(phrases, "phrases")), totals


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(18,0)")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, share: int = SHARE, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases.

    A phrase has 2 to ``most`` words of one piece and occurs ``least`` times or more; it goes where
    a longer such phrase around it occurs at least ``share`` per cent as often. Scores are the
    least over all cuts of 1000 * a * n / (l * r), rounded down. Null texts are empty, null
    languages are ``und``; texts may be empty or of any length; rows that repeat count
    each, ids play no part, equal scores and counts rank by phrase. Empty tables give no rows.
    """
    counts, totals = phrase_counts(docs, most, least, lang_col, text_col)
    phrases = counts.filter("width > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("tail"))
    heads = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    exact = scored.withColumn("over", F.lit(1000).cast("decimal(4,0)") * _exact("a") * F.col("n").cast("decimal(16,0)")).withColumn("under", _exact("l") * _exact("r"))
    exact = exact.withColumn("score", F.expr("over div under"))
    best = exact.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = phrases.filter("width > 2").select("lang", "a", F.split("phrase", " ").alias("words"))
    inner = F.explode(F.array(*[F.array_join(F.slice("words", first, F.size("words") - 1), " ") for first in (1, 2)]))
    around = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", (F.xxhash64("phrase") % SALTS).alias("salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(ws) >= k),
c AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1 AND f >= 100),
s AS (SELECT x.lang, phrase, a, h, array_to_string(ws[1:h], ' ') AS head, array_to_string(ws[h + 1:], ' ') AS tail FROM x, (SELECT unnest(generate_series(1, 4)) AS h) WHERE h < k),
v AS (SELECT s.lang, s.phrase, s.a, h, l.f AS l, r.f AS r, n, CAST((1000::HUGEINT * s.a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM s JOIN c l ON s.lang = l.lang AND head = l.phrase JOIN c r ON s.lang = r.lang AND tail = r.phrase JOIN n ON s.lang = n.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) AS best FROM v),
e AS (SELECT DISTINCT x.lang, x.phrase FROM x JOIN x y ON x.lang = y.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= 100 * x.a),
o AS (SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b ANTI JOIN e USING (lang, phrase) WHERE best = 1)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM o WHERE rank <= 2000
"""
