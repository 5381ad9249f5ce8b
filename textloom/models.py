"""Which tokenizer models there are, and what this installation can do."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession

# Model ids, their languages and labels.
PREDEFINED_MODELS: dict[str, tuple[str, ...]] = {
    "native:plain_words_en": ("en",),
    "huggingface:bert-base-uncased": ("en",),
    "lindera:cc-cedict": ("zh",),
    "lindera:jieba": ("zh",),
    "lindera:ja-ipadic": ("ja",),
    "lindera:ja-ipadic-neologd": ("ja",),
    "lindera:ja-unidic": ("ja",),
    "lindera:ko-dic": ("ko",),
}
PREDEFINED_MODEL_LABELS: dict[str, str] = {
    "native:plain_words_en": "Plain words (English)",
    "huggingface:bert-base-uncased": "BERT base uncased",
    "lindera:cc-cedict": "CC-CEDICT",
    "lindera:jieba": "Jieba",
    "lindera:ja-ipadic": "IPADIC",
    "lindera:ja-ipadic-neologd": "IPADIC Neologd",
    "lindera:ja-unidic": "UniDic",
    "lindera:ko-dic": "ko-dic",
}
LINDERA_MODELS_BY_LANGUAGE: dict[str, tuple[str, ...]] = {
    language: tuple(m for m, of in PREDEFINED_MODELS.items() if m.startswith("lindera:") and language in of) for language in ("zh", "ja", "ko")
}
_NEEDS = {"cache": ("pyarrow",), "tokenization": ("tokenizers",), "embedding": ("onnxruntime", "tokenizers"), "topic-modeling": ("numpy", "onnxruntime", "tokenizers")}


def compiled_features() -> frozenset[str]:
    """Features whose libraries can be imported here."""
    return frozenset(f for f, libraries in _NEEDS.items() if all(importlib.util.find_spec(x) for x in libraries))


def require_feature(feature: str, caller: str) -> None:
    if feature not in compiled_features():
        raise RuntimeError(f"{caller} requires the '{feature}' feature; install {', '.join(_NEEDS[feature])}")


def predefined_model_records() -> list[dict[str, object]]:
    return [{"model": m, "label": PREDEFINED_MODEL_LABELS[m], "languages": list(languages)} for m, languages in PREDEFINED_MODELS.items()]


def model_inventory(spark: SparkSession) -> DataFrame:
    """The predefined models as a table (model, label, languages)."""
    return spark.createDataFrame([(r["model"], r["label"], r["languages"]) for r in predefined_model_records()], "model string, label string, languages array<string>")
