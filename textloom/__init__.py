"""Text analytics on Spark: Column functions, DataFrame operators, caches and topic models."""

from .functions.concordance import concordance
from .functions.embedding import embedding
from .functions.scalar import char_count, clean_text, sentence_count, word_count
from .functions.tokenize import list_loaded_models, prefetch_model, token_rows, token_strings, tokenize
from .models import LINDERA_MODELS_BY_LANGUAGE, PREDEFINED_MODEL_LABELS, PREDEFINED_MODELS, compiled_features, predefined_model_records
from .operators.frequencies import token_frequencies
from .operators.keyness import token_frequency_stats
from .operators.topic_model import topic_modeling
from .text import text

__version__ = "0.1.0"
__all__ = [
    "LINDERA_MODELS_BY_LANGUAGE",
    "PREDEFINED_MODELS",
    "PREDEFINED_MODEL_LABELS",
    "char_count",
    "clean_text",
    "compiled_features",
    "concordance",
    "embedding",
    "list_loaded_models",
    "predefined_model_records",
    "prefetch_model",
    "sentence_count",
    "text",
    "token_frequencies",
    "token_frequency_stats",
    "token_rows",
    "token_strings",
    "tokenize",
    "topic_modeling",
    "word_count",
]
