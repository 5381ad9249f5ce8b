"""Queries over the test tables by name, with SQL for DuckDB where SQL can say them."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunks
from ..functions.concordance import concordance
from ..functions.embedding import embedding, with_embedding
from ..functions.offsets import byte_spans_to_char_spans
from ..functions.scalar import CJK, TERMINATORS, char_count, clean_text, sentence_count, word_count
from ..functions.tables import register_tables
from ..functions.tokenize import NATIVE, token_rows, token_strings, tokenize
from ..functions.vectors import l2_normalize
from ..models import model_inventory, predefined_model_records
from ..operators.frequencies import token_frequencies
from ..operators.index import PositionalIndex
from ..operators.keyness import COLUMNS, compare_corpora, token_frequency_stats
from ..operators.neighbours import knn_exact
from ..operators.topic_model import topic_modeling
from ..operators.topic_words import ctfidf, rollup, soft_sizes, topic_centroids, topic_term_counts
from ..sources.cache import content_hash, misses, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLAIN = "'[!-/:-@\\[-`{-~\\p{P}]|[^\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}!-/:-@\\[-`{-~\\p{P}]+'"
WS = "\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
SPECIAL = "lower(t) NOT IN ('cls', 'mask', 'pad', 'sep', 'unk')"
ALNUM = "regexp_matches(t, '[\\p{L}\\p{N}\\p{M}]')"


def tokens_sql(cols: str, text: str, table: str) -> str:
    return f"SELECT {cols}, t AS token FROM (SELECT {cols}, unnest(regexp_extract_all(lower({text}), {PLAIN})) AS t FROM {table}) WHERE {SPECIAL} AND {ALNUM}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


@query("clean_text", f"SELECT doc_id, coalesce(trim(regexp_replace(regexp_replace(lower(text), '[!-/:-@\\[-`{{-~0-9]', ' ', 'g'), '[{WS}]+', ' ', 'g')), '') AS cleaned FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", clean_text("text").alias("cleaned"))


_WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{WS}]+')"


@query("word_count", f"SELECT doc_id, CAST(CASE WHEN len(ws) = 1 AND regexp_full_match(ws[1], '[{CJK}]+') THEN length(ws[1]) ELSE len(ws) END AS BIGINT) AS words FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", word_count("text").alias("words"))


@query("char_count", "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS chars FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", char_count("text").alias("chars"))


@query("sentence_count", f"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?。！？۔؟।॥]'), lambda x: regexp_matches(x, '[^{WS}]'))) AS BIGINT) AS sentences FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", sentence_count("text").alias("sentences"))


def _joined(tokens: str, more: str) -> str:
    return f"SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, array_to_string(ts, ' ') AS tokens FROM (SELECT doc_id, list_filter(regexp_extract_all({tokens}, {PLAIN}), lambda t: {SPECIAL}{more}) AS ts FROM documents)"


def _strings(s: SparkSession, d: str, **options: bool) -> DataFrame:
    tokens = token_strings("text", **options)
    return docs(s, d).select("doc_id", tokens.alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("tokenize_plain", _joined("lower(text)", f" AND {ALNUM}"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _strings(s, d)


@query("tokenize_keep_punct", _joined("lower(text)", ""))
def _(s: SparkSession, d: str) -> DataFrame:
    return _strings(s, d, remove_punct=False)


@query("tokenize_keep_case", _joined("text", f" AND {ALNUM}"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _strings(s, d, lowercase=False)


_OFFSETS = f"""
WITH p AS (SELECT doc_id, regexp_extract_all(lower(text), {PLAIN[:-1]}|[{WS}]+') AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS t, unnest(generate_series(1, len(ps))) AS pos FROM p),
o AS (SELECT doc_id, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM x)
SELECT doc_id, t AS token, CAST(e - length(t) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM o WHERE {SPECIAL} AND {ALNUM}
"""


@query("token_offsets", _OFFSETS)
def _(s: SparkSession, d: str) -> DataFrame:
    return token_rows(docs(s, d), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query("tokenize_offsets_column", _OFFSETS)
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.inline(tokenize("text", model=NATIVE)))


@query("token_frequencies", f"SELECT token, count(*) AS \"count\" FROM ({tokens_sql(cols='doc_id', text='text', table='documents')}) GROUP BY token")
def _(s: SparkSession, d: str) -> DataFrame:
    return token_frequencies(docs(s, d), "text", NATIVE)


@query("token_frequencies_by_lang", f"SELECT lang, token, count(*) AS \"count\" FROM ({tokens_sql(cols='lang', text='text', table='documents')}) GROUP BY lang, token")
def _(s: SparkSession, d: str) -> DataFrame:
    return token_frequencies(docs(s, d), "text", NATIVE, by=("lang",))


def _keyness(table_name: str, text: str, zero: str, one: str) -> str:
    tokens = tokens_sql(cols="g", text=text, table=f"(SELECT *, CASE WHEN {zero} THEN 0 WHEN {one} THEN 1 END AS g FROM {table_name} WHERE {zero} OR {one})")
    return f"""
WITH j AS MATERIALIZED (SELECT token, CAST(count(*) FILTER (g = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (g = 1) AS DOUBLE) AS b FROM ({tokens}) GROUP BY token),
t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM j),
e AS (SELECT *, (a + b) * ta / (ta + tb) AS e0, (a + b) * tb / (ta + tb) AS e1, ta + tb AS n FROM j, t),
l AS (SELECT *, 2 * (CASE WHEN a > 0 THEN a * ln(a / greatest(e0, 1e-10)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / greatest(e1, 1e-10)) ELSE 0 END) AS ll FROM e)
SELECT token, CAST(a AS BIGINT) AS freq_corpus_0, CAST(b AS BIGINT) AS freq_corpus_1, CAST(ta AS BIGINT) AS corpus_0_total, CAST(tb AS BIGINT) AS corpus_1_total,
  round(e0, 6) AS expected_0, round(e1, 6) AS expected_1, round(ll, 6) AS log_likelihood_llv, round(ll - ln(n), 6) AS bayes_factor_bic,
  round(CASE WHEN least(e0, e1) > 0 THEN ll / (n * ln(greatest(least(e0, e1), 1e-10))) ELSE 0 END, 9) AS effect_size_ell,
  CASE WHEN ll >= 15.13 THEN '****' WHEN ll >= 10.83 THEN '***' WHEN ll >= 6.63 THEN '**' WHEN ll >= 3.84 THEN '*' ELSE '' END AS significance,
  round(a / ta * 100, 9) AS percent_corpus_0, round(b / tb * 100, 9) AS percent_corpus_1, round(a / ta - b / tb, 9) AS percent_diff,
  round(CASE WHEN b > 0 THEN (a / ta) / (b / tb) END, 6) AS relative_risk, round(CASE WHEN a > 0 AND b > 0 THEN ln((a / ta) / (b / tb)) END, 9) AS log_ratio,
  round(CASE WHEN a > 0 AND b > 0 AND ta > a AND tb > b THEN a * (tb - b) / (b * (ta - a)) END, 6) AS odds_ratio
FROM l"""


_DIGITS = {c: 6 for c in ("expected_0", "expected_1", "log_likelihood_llv", "bayes_factor_bic", "relative_risk", "odds_ratio")} | {c: 9 for c in ("effect_size_ell", "percent_corpus_0", "percent_corpus_1", "percent_diff", "log_ratio")}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, _DIGITS[c]).alias(c) if c in _DIGITS else F.col(c) for c in COLUMNS])


def _compared(df: DataFrame, zero: str, one: str) -> DataFrame:
    return compare_corpora(df, "text", NATIVE, F.expr(zero), F.expr(one))


@query("keyness_en_vs_fr", _keyness("documents", "text", "lang = 'en'", "lang = 'fr'"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_compared(docs(s, d), "lang = 'en'", "lang = 'fr'"))


@query("keyness_user_vs_assistant", _keyness("conversations", "text", "role = 'user'", "role = 'assistant'"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _rounded(_compared(table(s, d, "conversations"), "role = 'user'", "role = 'assistant'"))


@query("keyness_significant", "SELECT token, significance FROM (" + _keyness("documents", "text", "lang = 'de'", "lang = 'es'") + ") WHERE significance <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    de, es = (token_frequencies(docs(s, d).filter(F.col("lang") == x), "text", NATIVE) for x in ("de", "es"))
    return token_frequency_stats(de, es).filter("significance <> ''").select("token", "significance")


_KWIC = """
WITH RECURSIVE m AS (
  SELECT doc_id, {low} AS low, text, 0 AS base, strpos({low}, '{word}') AS k FROM documents
  UNION ALL
  SELECT doc_id, low, text, base + k + {n} - 1, strpos(substr(low, CAST(base + k + {n} AS BIGINT)), '{word}') FROM m WHERE k > 0)
SELECT doc_id, CAST(base + k - 1 AS BIGINT) AS start_idx, CAST(base + k - 1 + {n} AS BIGINT) AS end_idx, substr(text, CAST(base + k AS BIGINT), {n}) AS matched_text FROM m WHERE k > 0
"""


def _hits(s: SparkSession, d: str, word: str, **options: object) -> DataFrame:
    found = docs(s, d).select("doc_id", F.inline(concordance("text", word, **options)))  # type: ignore[arg-type]
    return found.select("doc_id", "start_idx", "end_idx", "matched_text")


@query("kwic_literal", _KWIC.format(low="lower(text)", word="than", n=4))
def _(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "than")


@query("kwic_case_sensitive", _KWIC.format(low="text", word="The", n=3))
def _(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, "The", case_sensitive=True)


@query("kwic_regex", "SELECT doc_id, array_to_string(regexp_extract_all(text, '(?i)th[aei]n[a-z]+'), ' ') AS found, CAST(len(regexp_extract_all(text, '(?i)th[aei]n[a-z]+')) AS BIGINT) AS hits FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", concordance("text", "th[aei]n[a-z]+", regex=True).alias("h")).select("doc_id", F.array_join("h.matched_text", " ").alias("found"), F.size("h").cast("bigint").alias("hits"))


@query("kwic_explode_outer", "SELECT doc_id, CAST(greatest(1, (length(text) - length(replace(text, 'license', ''))) / 7) AS BIGINT) AS n, contains(text, 'license') AS found FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    found = docs(s, d).select("doc_id", F.inline_outer(concordance("text", "license", case_sensitive=True)))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.count("matched_text") > 0).alias("found"))


@query("kwic_context", """
WITH t AS (SELECT item_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS pos FROM (SELECT item_id, regexp_extract_all(text, """ + PLAIN + """) AS ts FROM benchmark)),
w AS (SELECT item_id, pos, t, coalesce(lag(t) OVER o, '') AS l1, coalesce(lead(t) OVER o, '') AS r1 FROM t WINDOW o AS (PARTITION BY item_id ORDER BY pos))
SELECT item_id, l1, t AS matched_text, r1, count(*) AS n FROM w WHERE lower(t) = 'the' GROUP BY ALL
""")
def _(s: SparkSession, d: str) -> DataFrame:
    found = table(s, d, "benchmark").select("item_id", F.inline(concordance("text", r"\bthe\b", regex=True, num_left_tokens=1, num_right_tokens=1)))
    return found.groupBy("item_id", "l1", "matched_text", "r1").agg(F.count(F.lit(1)).alias("n"))


_FULL = """
WITH t AS (SELECT doc_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, """ + PLAIN + """) AS ts FROM documents)),
k AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM t WHERE """ + SPECIAL + """),
w AS (SELECT doc_id, pos, t, coalesce(string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS left_context,
  coalesce(string_agg(t, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), '') AS right_context,
  coalesce(lag(t) OVER (PARTITION BY doc_id ORDER BY pos), '') AS l1, coalesce(lead(t) OVER (PARTITION BY doc_id ORDER BY pos), '') AS r1 FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS hit, left_context, t AS matched_text, right_context, l1, r1 FROM w WHERE lower(t) = 'license'
"""


@query("kwic_full", _FULL)
def _(s: SparkSession, d: str) -> DataFrame:
    """All the output of a concordance, for a word that the search delimits as the tokenizer does."""
    edge = "[\\p{IsWhite_Space}\\p{P}!-/:-@\\[-`{-~]"
    found = docs(s, d).select("doc_id", F.posexplode(concordance("text", "license", num_left_tokens=3, num_right_tokens=4)).alias("hit", "x"), "text")
    before, after = F.substring("text", F.col("x.start_idx").cast("int"), F.lit(1)), F.substring("text", F.col("x.end_idx").cast("int") + 1, F.lit(1))
    whole = found.filter(((F.col("x.start_idx") == 0) | before.rlike(edge)) & ((F.col("x.end_idx") == F.char_length("text")) | after.rlike(edge)))
    numbered = whole.withColumn("hit", F.row_number().over(Window.partitionBy("doc_id").orderBy("hit")).cast("bigint"))
    return numbered.select("doc_id", "hit", "x.left_context", "x.matched_text", "x.right_context", "x.l1", "x.r1")


_WORD = "[^\\P{L}tT]"


@query("kwic_multiline", f"SELECT doc_id, array_to_string(f, '|') AS found, CAST(len(f) AS BIGINT) AS hits FROM (SELECT doc_id, regexp_extract_all(text, '(?im)^{_WORD}+|{_WORD}+\\x{{2E}}$') AS f FROM documents)")
def _(s: SparkSession, d: str) -> DataFrame:
    """First words of lines and last ones before a full stop, of letters but t: a pattern of several lines, with a class less another."""
    found = concordance("text", r"(?m)^[\p{L}--[t]]+|[\pL&&[^t]]+\x{2E}$", regex=True)
    return docs(s, d).select("doc_id", found.alias("h")).select("doc_id", F.array_join("h.matched_text", "|").alias("found"), F.size("h").cast("bigint").alias("hits"))


_INDEXED = """
WITH t AS (SELECT doc_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, """ + PLAIN + """) AS ts FROM documents)),
k AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos FROM t WHERE """ + SPECIAL + """),
w AS (SELECT doc_id, pos, t, lead(t) OVER o AS n1, coalesce(string_agg(t, ' ') OVER (o ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS left_context, coalesce(lag(t) OVER o, '') AS l1,
  coalesce(string_agg(t, ' ') OVER (o ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING), '') AS right1, coalesce(lead(t) OVER o, '') AS r1,
  coalesce(string_agg(t, ' ') OVER (o ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING), '') AS right2, coalesce(lead(t, 2) OVER o, '') AS r2 FROM k WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT lower(t) AS phrase, doc_id, pos, left_context, t AS matched_text, right1 AS right_context, l1, r1 FROM w WHERE lower(t) IN ('license', 'than', 'the')
  UNION ALL SELECT 'licensed under', doc_id, pos, left_context, t || ' ' || n1, right2, l1, r2 FROM w WHERE lower(t) = 'licensed' AND lower(n1) = 'under')
SELECT phrase, doc_id, row_number() OVER (PARTITION BY phrase, doc_id ORDER BY pos) AS hit, left_context, matched_text, right_context, l1, r1 FROM f
"""


@query("kwic_index", _INDEXED)
def _(s: SparkSession, d: str) -> DataFrame:
    """Three words and a phrase, with their contexts, from a positional index of all documents."""
    index = PositionalIndex.build(docs(s, d), "doc_id", "text", scratch(s))
    found = index.search(["license", "than", "the", "licensed under"], num_left_tokens=3, num_right_tokens=4)
    return found.select("phrase", F.col("id").alias("doc_id"), F.col("hit").cast("bigint").alias("hit"), "left_context", "matched_text", "right_context", "l1", "r1")


@query("sql_concordance", _KWIC.format(low="text", word="The", n=3))
def _(s: SparkSession, d: str) -> DataFrame:
    """The table function over all documents, in SQL."""
    register_tables(s)
    rows = docs(s, d).select(F.col("doc_id").alias("id"), "text")
    return s.sql("SELECT id AS doc_id, start_idx, end_idx, matched_text FROM concordance_hits(TABLE(SELECT * FROM {rows}), 'The', 5, 5, false, true)", rows=rows)


@query("sql_chunks", f"SELECT doc_id, CAST(length(regexp_replace(text, '[{WS}]+', '', 'g')) AS BIGINT) AS letters FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    """Chunks without an overlap by LATERAL VIEW; together they have all of a document but its white space."""
    register_tables(s)
    cut = s.sql("SELECT doc_id, c.chunk FROM {rows} LATERAL VIEW OUTER posexplode(chunks(text, 64, 0)) c AS place, chunk", rows=docs(s, d))
    letters = F.char_length(F.regexp_replace(F.coalesce("chunk", F.lit("")), r"[\p{IsWhite_Space}]+", ""))
    return cut.groupBy("doc_id").agg(F.sum(letters).cast("bigint").alias("letters"))


_BYTES = """
WITH c AS (SELECT doc_id, unnest(cs) AS c, unnest(generate_series(0, len(cs) - 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '(?s).') AS cs FROM documents)),
o AS (SELECT doc_id, k, CAST(sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) - strlen(c) AS o FROM c),
l AS (SELECT doc_id, unnest(generate_series(o + 1, o + strlen(c))) AS b, k + 1 AS n FROM (SELECT doc_id, c, k, o FROM o JOIN c USING (doc_id, k))),
s AS (SELECT doc_id, strlen(text) AS z, unnest(generate_series(0, strlen(text) - 1, 7)) AS b FROM documents WHERE text <> '')
SELECT s.doc_id, CAST(s.b AS BIGINT) AS byte, CAST(coalesce(f.n, 0) AS BIGINT) AS "start", CAST(t.n AS BIGINT) AS "end" FROM s LEFT JOIN l f ON f.doc_id = s.doc_id AND s.b > 0 AND f.b = least(s.b + 3, z) JOIN l t ON t.doc_id = s.doc_id AND t.b = least(s.b + 10, z)
"""


@query("byte_spans", _BYTES)
def _(s: SparkSession, d: str) -> DataFrame:
    """Spans of ten bytes, every seven bytes, so each overlaps the one before, in code points."""
    every = F.transform(F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(7)), lambda b: F.struct(b.cast("bigint").alias("start"), (b + 10).cast("bigint").alias("end")))
    rows = docs(s, d).filter("text <> ''").select("doc_id", F.posexplode(byte_spans_to_char_spans("text", every)).alias("k", "x"))
    return rows.select("doc_id", (F.col("k") * 7).cast("bigint").alias("byte"), "x.start", "x.end")


def _sources(s: SparkSession, d: str) -> DataFrame:
    """The documents as if each were a chunk whose topic is the number in its source."""
    return docs(s, d).select("doc_id", "lang", "text", F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("topic"))


_CTFIDF = f"""
WITH t AS ({tokens_sql(cols="topic", text="text", table="(SELECT *, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS topic FROM documents)")}),
c AS (SELECT topic, token, count(*) AS n FROM t GROUP BY 1, 2), w AS (SELECT topic, sum(n) AS words FROM c GROUP BY 1), a AS (SELECT token, sum(n) AS f FROM c GROUP BY 1), k AS (SELECT sum(n) / 20.0 AS average FROM c),
s AS (SELECT topic, token, CAST(n / words * ln(1 + average / f) AS FLOAT) AS score FROM c JOIN w USING (topic) JOIN a USING (token), k),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, token) AS rank FROM s)
SELECT topic, token, CAST(rank AS INT) AS rank, round(CAST(score AS DOUBLE), 6) AS score FROM r WHERE rank <= 10
"""


@query("ctfidf_by_source", _CTFIDF)
def _(s: SparkSession, d: str) -> DataFrame:
    path = scratch(s)
    topic_term_counts(_sources(s, d)).write.parquet(path)  # texts are tokenized once
    ranked = ctfidf(s.read.parquet(path), 20, 10)
    return ranked.select("topic", "token", F.col("rank").cast("int").alias("rank"), F.round(F.col("score").cast("double"), 6).alias("score"))


_CHUNKS = "(SELECT conv_id AS doc_id, CAST(CASE role WHEN 'system' THEN -1 WHEN 'user' THEN 0 ELSE 1 END AS INT) AS topic FROM conversations)"


def _turns(s: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of conversations, the role as their topic."""
    role = F.when(F.col("role") == "system", -1).when(F.col("role") == "user", 0).otherwise(1)
    return table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), role.alias("topic"), (F.col("conv_id") % 3).alias("corpus"))


@query("rollup", f"SELECT doc_id, topic AS topic_id, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS proportion FROM {_CHUNKS} GROUP BY doc_id, topic")
def _(s: SparkSession, d: str) -> DataFrame:
    turns = _turns(s, d)
    rolled = rollup(turns.select("doc_id").distinct(), turns)
    return rolled.select(F.col("doc").alias("doc_id"), F.inline("topic_distribution")).select("doc_id", "topic_id", F.round(F.col("proportion").cast("double"), 6).alias("proportion"))


@query("dominant_topic", f"SELECT doc_id, CAST(coalesce(max_by(topic, n * 10 + topic) FILTER (topic >= 0), -1) AS INT) AS dominant_topic FROM (SELECT doc_id, topic, count(*) AS n FROM {_CHUNKS} GROUP BY 1, 2) GROUP BY doc_id")
def _(s: SparkSession, d: str) -> DataFrame:
    turns = _turns(s, d)
    return rollup(turns.select("doc_id").distinct(), turns).select(F.col("doc").alias("doc_id"), "dominant_topic")


@query("soft_sizes", f"SELECT doc_id % 3 AS corpus, topic AS topic_id, round(sum(p), 3) AS size FROM (SELECT doc_id, topic, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM {_CHUNKS} GROUP BY doc_id, topic) WHERE topic >= 0 GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return soft_sizes(_turns(s, d), 2).withColumn("size", F.round("size", 3))


@query("topic_centroids", "SELECT CAST(label AS INT) AS topic_id, CAST((k + 1) // 2 AS INT) AS axes, round(avg(CAST(embedding[k] AS DOUBLE)), 6) AS x, round(avg(CAST(embedding[k + 1] AS DOUBLE)), 6) AS y FROM embeddings, (SELECT unnest(generate_series(1, 63, 2)) AS k) GROUP BY label, k")
def _(s: SparkSession, d: str) -> DataFrame:
    """Centroids in every pair of axes of the vectors, as topics of their own: one scan and one aggregation."""
    points = table(s, d, "embeddings")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.struct(F.get("embedding", 2 * k).cast("double").alias("x"), F.get("embedding", 2 * k + 1).cast("double").alias("y")))
    each = points.select("label", F.posexplode(pairs).alias("k", "p")).select((F.col("label") * 32 + F.col("k")).alias("topic"), "p.x", "p.y")
    found = topic_centroids(each, 320).withColumn("axes", F.col("topic_id") % 32 + 1)
    return found.select(F.floor(F.col("topic_id") / 32).cast("int").alias("topic_id"), F.col("axes").cast("int").alias("axes"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("l2_normalize", "SELECT vec_id, unnest(generate_series(0, len(v) - 1))::INT AS axis, unnest(v) AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: round(CAST(CAST(CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y))) AS FLOAT) AS DOUBLE), 5)) AS v FROM embeddings)")
def _(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", F.posexplode(l2_normalize("embedding")).alias("axis", "value"))
    return v.select("vec_id", "axis", F.round(F.col("value").cast("double"), 5).alias("value"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", content_hash("text").alias("content_hash"))


@query("cache_misses", "SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE lang = 'fr' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0')")
def _(s: SparkSession, d: str) -> DataFrame:
    have = docs(s, d).filter("source = 'src0'").select(content_hash("text").alias("content_hash"))
    return misses(docs(s, d).filter("lang = 'fr'"), have).select("content_hash")


_MODELS = ", ".join(f"('{r['model']}', '{r['label']}', '{','.join(r['languages'])}')" for r in predefined_model_records())


@query("model_inventory", f"SELECT model, label, languages, CAST(count(d.lang) AS BIGINT) AS n_documents FROM (VALUES {_MODELS}) AS t(model, label, languages) LEFT JOIN documents d ON list_contains(string_split(languages, ','), d.lang) GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    """The models, and how many documents are in a language of theirs."""
    counts = docs(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    models = model_inventory(s).select("model", "label", F.array_join("languages", ",").alias("languages"), F.explode("languages").alias("lang"))
    return models.join(counts, "lang", "left").groupBy("model", "label", "languages").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"))


@query("chunking")
def _(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.posexplode(chunks("text", max_tokens=64, overlap=8)).alias("chunk_index", "chunk"))


_LINES = f"list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: regexp_replace(regexp_replace(x, '^[{WS}]+', ''), '[{WS}]+$', ''))"


@query("chunking_whole", f"SELECT doc_id, CAST(0 AS INT) AS chunk_index, c AS chunk FROM (SELECT doc_id, regexp_replace(trim(array_to_string({_LINES}, chr(10)), chr(10)), chr(10) || chr(10) || '+', ' ', 'g') AS c FROM documents) WHERE c <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    """Chunks that are whole texts: paragraphs found, trimmed and joined."""
    return docs(s, d).select("doc_id", F.posexplode(chunks("text", max_tokens=1 << 30, overlap=0)).alias("chunk_index", "chunk"))


_PACKED = f"""
WITH RECURSIVE s AS (SELECT doc_id, unnest(generate_series(1, len(ps))) AS i, regexp_extract_all(unnest(ps), '[^{WS}]+') AS ws FROM (SELECT doc_id, regexp_split_to_array(text, '[{TERMINATORS}\\n]') AS ps FROM documents)),
u AS (SELECT doc_id, i, p, array_to_string(ws[64 * p + 1:64 * p + 64], ' ') AS t, len(ws[64 * p + 1:64 * p + 64]) AS n FROM s, (SELECT unnest(generate_series(0, 2000)) AS p) WHERE 64 * p < len(ws)),
d AS (SELECT doc_id, list(t ORDER BY i, p) AS ts, list_concat([0], list(b ORDER BY i, p)) AS ps FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i, p) AS BIGINT) AS b FROM u) GROUP BY doc_id),
c AS (SELECT doc_id, ts, ps, 0 AS k, 0 AS a, len(list_filter(ps, lambda x: x <= 64)) - 1 AS e FROM d
  UNION ALL SELECT doc_id, ts, ps, k + 1, f, greatest(e + 1, len(list_filter(ps, lambda x: x <= ps[f + 1] + 64)) - 1) FROM (
    SELECT *, least(e, greatest(a, len(list_filter(ps, lambda x: x <= ps[e + 1] - 8)) - 1, len(list_filter(ps, lambda x: x <= ps[e + 1] - 64)), len(list_filter(ps, lambda x: x < ps[e + 2] - 64)))) AS f FROM c WHERE e < len(ts)))
SELECT doc_id, CAST(k AS INT) AS chunk_index, array_to_string(ts[a + 1:e], ' ') AS chunk FROM c
"""


@query("chunking_packed", _PACKED)
def _(s: SparkSession, d: str) -> DataFrame:
    """Documents as paragraphs of one sentence each, packed into chunks of 64 words that share 8 or more."""
    plain = F.transform(F.split("text", f"[{TERMINATORS}\\n]"), lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"[^\p{IsWhite_Space}]+"), F.lit(0)), " "))
    paragraphs = docs(s, d).select("doc_id", F.array_join(F.filter(plain, lambda x: x != ""), "\n\n").alias("t"))
    return paragraphs.select("doc_id", F.posexplode(chunks("t", max_tokens=64, overlap=8)).alias("chunk_index", "chunk"))


def scratch(s: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver ends; a temporary one in local mode."""
    root = s.conf.get("spark.checkpoint.dir", None) or s.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not s.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{(root or 'file://' + tempfile.mkdtemp(prefix='textloom-')).rstrip('/')}/textloom-scratch/{uuid.uuid4().hex}")
    fs = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration())
    atexit.register(_gone, fs, at)  # works when the session is stopped before, too
    path = fs.makeQualified(at).toString()  # a folder without a scheme is of the default file system
    return path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path


def _gone(fs: object, at: object) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and then nothing can be done
        fs.delete(at, True)


@query("tokenize_cached", _OFFSETS)
def _(s: SparkSession, d: str) -> DataFrame:
    """A cache that has half of the texts already, filled up and joined back."""
    path = scratch(s)
    tokens(docs(s, d).filter("lang <> 'en'"), "text", path, model=NATIVE).limit(0).collect()
    return tokens(docs(s, d), "text", path, model=NATIVE).select("doc_id", F.inline("text"))


@query("tokenize_cached_column", _OFFSETS)
def _(s: SparkSession, d: str) -> DataFrame:
    """A cache that batches fill and read: half of the texts first, then all, from tasks and by the join. Tasks have texts in the order of the cache."""
    path = scratch(s)

    def sorted_(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "text").repartitionByRange(content_hash("text"), "doc_id").sortWithinPartitions(content_hash("text"))

    half = sorted_(docs(s, d).filter("lang <> 'en'")).select(tokenize("text", model=NATIVE, cache=path))
    half.write.format("noop").mode("overwrite").save()
    own, others = F.col("doc_id") % 2 == 0, F.col("doc_id") % 2 == 1
    found = sorted_(docs(s, d).filter(own)).select("doc_id", tokenize("text", model=NATIVE, cache=path).alias("t"))
    found.write.format("noop").mode("overwrite").save()
    joined = tokens(docs(s, d).filter(others), "text", path, model=NATIVE, out_col="t").select("doc_id", "t")
    return found.union(joined).select("doc_id", F.inline("t"))


def _vectors(texts: str, key: str, more: str = "") -> str:
    """The hashing stand-in of 64 axes over rows (k, t): what isn't zero of the unit vectors."""
    return f"""
WITH h AS (SELECT k, CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) AS h FROM (SELECT k, unnest(regexp_extract_all(lower(t), '[^{WS}]+')) AS w FROM {texts})),
v AS (SELECT k, CAST(h % 64 AS INT) AS axis, CAST(sum(CASE WHEN h >= 9223372036854775808 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM h GROUP BY ALL),
n AS (SELECT k, sqrt(sum(v * v)) AS n FROM v GROUP BY k)
SELECT {key}, axis, round(CAST(CAST(v / n AS FLOAT) AS DOUBLE), 5) AS value FROM v JOIN n USING (k){more} WHERE v <> 0"""


def _axes(df: DataFrame, *keys: str) -> DataFrame:
    long = df.select(*keys, F.posexplode("embedding").alias("axis", "value")).filter("value <> 0")
    return long.withColumn("value", F.round(F.col("value").cast("double"), 5))


_VOCABULARY = ("the", "of", "and", "der", "de", "licensed", "under", "license", "2.0.", "mit")
_HUGGING = f"""
WITH p AS (SELECT doc_id, regexp_extract_all(lower(text), '[^{WS}]+|[{WS}]+') AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS t, unnest(generate_series(1, len(ps))) AS pos FROM p),
o AS (SELECT doc_id, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM x)
SELECT doc_id, CASE WHEN t IN ({', '.join(f"'{w}'" for w in _VOCABULARY)}) THEN t ELSE '[UNK]' END AS token, CAST(e - length(t) AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end" FROM o WHERE regexp_matches(t, '[^{WS}]')
"""


@query("tokenize_huggingface", _HUGGING)
def _(s: SparkSession, d: str) -> DataFrame:
    """A tokenizer.json of ten words, which the query writes, over all documents: tokens of it, the unknown token for other words."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.WordLevel({w: k for k, w in enumerate(["[UNK]", *_VOCABULARY])}, unk_token="[UNK]"))
    made.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    at = s.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(s) + "/tokenizer.json")
    out = at.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(made.to_str().encode()))
    out.close()
    folder = at.getParent().toUri().getPath()  # a shared mount
    return docs(s, d).select("doc_id", F.inline(tokenize("text", model=f"huggingface:{folder}")))


@query("embedding", _vectors("(SELECT doc_id AS k, text AS t FROM documents)", "k AS doc_id"))
def _(s: SparkSession, d: str) -> DataFrame:
    """The stand-in without a model, over all documents, what isn't zero of it; tests run an ONNX graph."""
    return _axes(docs(s, d).select("doc_id", embedding("text", embedder_model="hashing:64").alias("embedding")), "doc_id")


_ITEMS = "(SELECT row_number() OVER (ORDER BY doc_id, place) AS k, doc_id, place, t FROM (SELECT doc_id, unnest(generate_series(0, len(ls) - 1)) AS place, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"


@query("embedding_lists", _vectors(_ITEMS, "doc_id, CAST(place AS INT) AS place", f" JOIN {_ITEMS} USING (k)"))
def _(s: SparkSession, d: str) -> DataFrame:
    """Lists of the documents' lines, encoded item by item and put together again."""
    made = with_embedding(docs(s, d).select("doc_id", F.split("text", "\n").alias("lines")), "lines", embedder_model="hashing:64")
    return _axes(made.select("doc_id", F.posexplode("lines").alias("place", "embedding")), "doc_id", "place")


_NEAR = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 12) AS square FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT id, other, square, row_number() OVER (PARTITION BY id ORDER BY square, other) AS rank FROM p)
SELECT id, CAST(rank AS INT) AS rank, round(sqrt(square), 6) AS distance FROM r WHERE rank <= 10
"""


@query("knn_embeddings", _NEAR)
def _(s: SparkSession, d: str) -> DataFrame:
    """Each vector's ten nearest of all others, by how far they are."""
    return knn_exact(table(s, d, "embeddings"), "vec_id", "embedding", 10).select("id", "rank", F.round("distance", 6).alias("distance"))


@query("topic_modeling")
def _(s: SparkSession, d: str) -> DataFrame:
    out = topic_modeling(docs(s, d), "doc_id", "text", "topic", embedder_model="hashing:64")
    return out.select("doc_id", "topic.dominant_topic", "topic.n_topics", "topic.n_chunks")


@query("top_tokens_by_source", f"SELECT source, token, n FROM (SELECT source, token, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, token) AS k FROM ({tokens_sql(cols='source', text='text', table='documents')}) GROUP BY source, token) WHERE k <= 5")
def _(s: SparkSession, d: str) -> DataFrame:
    counts = token_frequencies(docs(s, d), "text", NATIVE, by=("source",)).withColumnRenamed("count", "n")
    return counts.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "token"))).filter("k <= 5").drop("k")
