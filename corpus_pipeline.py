"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, mixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, jaccard_join, mixing, quality_rules, suffix_dedup
from textloom.llm.session import deleted, read_table, recorded, staged

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules.good_documents),
    ("ngram_jaccard_join", jaccard_join.one_of_each_class),
    ("suffix_array_dedup", suffix_dedup.without_repeats),
    ("benchmark_decontamination", decontamination.without_benchmark),
    ("mixing_sources", mixing.mixed),
]
#: The first stage is iterative (expectation-maximisation) and the third cuts bytes; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``.

    Each stage reads what the one before wrote, and once its own rows are written all that they
    were made from is deleted; what the last stage reads goes when the driver ends. Stages take
    null ids and texts, shared ids, ties, repeated rows and empty tables as their functions say:
    rows are judged one by one, and rows equal in id and text are copies of which one stays.
    """
    docs, before = read_table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with recorded() as made:
            docs = staged(stage(spark, docs, sf_dir), name)
        for path in [*before, *made[:-1]]:
            deleted(spark, path)
        before = made[-1:]
    return docs
