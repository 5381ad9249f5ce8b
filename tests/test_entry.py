from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans.catalog import ORACLES, QUERIES

ROOT, DATA = Path(__file__).resolve().parents[1], Path("/root/testdata/sf0.001")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["clean_text", "word_count", "sentence_count", "tokenize_keep_punct", "token_frequencies_by_lang", "keyness_significant", "kwic_literal", "kwic_context", "dominant_topic", "cache_misses", "kwic_multiline", "kwic_index", "chunking_packed", "byte_spans", "embedding_lists", "knn_embeddings", "sql_concordance", "sql_chunks", "tokenize_cached_column", "tokenize_huggingface", "ctfidf_by_source", "model_inventory"])
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = QUERIES[name](spark, str(DATA)), con.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())


def test_the_rest_stands_alone(tmp_path):
    """Without the llm folders and the pipeline, the entry module still imports and has the other queries."""
    shutil.copytree(ROOT / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'token_frequencies' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
