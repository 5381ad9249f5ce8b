"""Running token counts of a stream of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import token_strings


def streaming_token_counts(texts: DataFrame, text_col: str, time_col: str | None = None, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(token, count) of all so far, for update or complete mode; with ``time_col`` by window, late rows dropped after ``late``."""
    if time_col is None:
        return texts.select(F.explode(token_strings(text_col)).alias("token")).groupBy("token").count()
    timed = texts.withWatermark(time_col, late).select(time_col, F.explode(token_strings(text_col)).alias("token"))
    return timed.groupBy(F.window(time_col, window).alias("window"), "token").count()
