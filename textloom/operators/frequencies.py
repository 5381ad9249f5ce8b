"""Token counts of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokenize import NATIVE, normalize_model, route, token_strings, tokenize
from ..models import require_feature


def token_frequencies(df: DataFrame, text_col: str, model: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``..., token, count): lower-cased tokens without punctuation; null and blank texts count for nothing.

    One hash aggregation with partial sums on the map side; the native model never leaves the JVM.
    """
    require_feature("tokenization", "token_frequencies")
    if not isinstance(df, DataFrame) or not isinstance(text_col, (str, Column)):
        raise TypeError("token_frequencies takes a DataFrame and the name of its text column")
    model = normalize_model(model)
    route(model)
    tokens = token_strings(text_col) if model == NATIVE else F.transform(tokenize(text_col, model=model), lambda t: t["token"])
    return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count(F.lit(1)).alias("count"))


def as_dict(frequencies: DataFrame) -> dict[str, int]:
    """Counts on the driver, for small corpora."""
    return {r["token"]: r["count"] for r in frequencies.collect()}
