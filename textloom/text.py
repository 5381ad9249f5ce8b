"""``text("column")``: the functions as methods of a column."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column

from .functions.concordance import concordance
from .functions.embedding import embedding
from .functions.scalar import as_column, char_count, clean_text, sentence_count, word_count
from .functions.tokenize import token_strings, tokenize

_METHODS = {f.__name__: f for f in (clean_text, word_count, char_count, sentence_count, tokenize, token_strings, concordance, embedding)}


class Text:
    """A text column; ``topic_modeling`` needs a whole DataFrame and is a function on one."""

    def __init__(self, column: Column | str):
        self.column = as_column(column)

    def __getattr__(self, name: str) -> partial:
        if name not in _METHODS:
            raise AttributeError(name)
        return partial(_METHODS[name], self.column)

    def __dir__(self) -> list[str]:
        return sorted({*super().__dir__(), *_METHODS})


def text(column: Column | str) -> Text:
    return Text(column)
