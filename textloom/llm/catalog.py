"""Queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, jaccard_join, licenses, merkle, mixing, phrases, quality_rules, simhash, site_style, substring_dedup, suffix_dedup, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": site_style.op1_html_extraction,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_mixing_sources": mixing.op4_mixing_sources,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_chat_formatting": chat_format.op7_chat_formatting,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_warc": warc.op9_warc,
    "op10_ngram_jaccard_join": jaccard_join.op10_ngram_jaccard_join,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_phrase_mining": phrases.op12_phrase_mining,
    "op13_simhash": simhash.op13_simhash,
    # parts of results that SQL can say, of operators whose whole results it can't
    "quality_base_columns": quality_rules.quality_base_columns,
    "mixing_targets": mixing.mixing_targets,
    "license_inheritance": licenses.license_inheritance,
}
ORACLES: dict[str, str] = {
    "op1_html_extraction": site_style.ORACLE,
    "op3_benchmark_decontamination": decontamination.ORACLE,
    "op5_suffix_dedup": suffix_dedup.ORACLE,
    "op7_chat_formatting": chat_format.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
    "op9_warc": warc.ORACLE,
    "op10_ngram_jaccard_join": jaccard_join.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_phrase_mining": phrases.ORACLE,
    "quality_base_columns": quality_rules.BASE_ORACLE,
    "mixing_targets": mixing.TARGETS_ORACLE,
    "license_inheritance": licenses.INHERITANCE_ORACLE,
}
