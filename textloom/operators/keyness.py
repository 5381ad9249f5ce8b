"""Keyness: how the token counts of two corpora differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frequencies import token_frequencies

COLUMNS = (
    "token freq_corpus_0 freq_corpus_1 corpus_0_total corpus_1_total expected_0 expected_1 log_likelihood_llv bayes_factor_bic effect_size_ell significance "
    "percent_corpus_0 percent_corpus_1 percent_diff relative_risk log_ratio odds_ratio"
).split()
#: Least log likelihood and its mark (fixed values).
LEVELS = ((15.13, "****"), (10.83, "***"), (6.63, "**"), (3.84, "*"))
TINY = 1e-10


def ieee_div(a: Column, b: Column) -> Column:
    """a / b as floating-point units divide: infinite or NaN for b = 0, null for null."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.lit(float("inf"))
    by_zero = F.when(a.isNull() | b.isNull() | (b != 0), F.lit(None)).when(F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).when(a < 0, -inf).otherwise(F.lit(float("nan")))
    return F.coalesce(F.try_divide(a, b), by_zero)


def _ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x))


def token_frequency_stats(corpus_0: DataFrame, corpus_1: DataFrame) -> DataFrame:
    """Compare two tables (token, count): the 17 ``COLUMNS``, a row for each token of either, in the order of tokens.

    Totals come from one row of sums that is broadcast. Without tokens there are no rows.
    """
    f0 = corpus_0.select("token", F.col("count").cast("bigint").alias("freq_corpus_0"))
    f1 = corpus_1.select("token", F.col("count").cast("bigint").alias("freq_corpus_1"))
    both = f0.join(f1, "token", "full_outer").select("token", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("freq_corpus_0", "freq_corpus_1")))
    sums = f0.agg(F.coalesce(F.sum("freq_corpus_0"), F.lit(0)).cast("bigint").alias("corpus_0_total")).crossJoin(f1.agg(F.coalesce(F.sum("freq_corpus_1"), F.lit(0)).cast("bigint").alias("corpus_1_total")))  # one row with one row
    return _stats(both, sums).orderBy("token")


def compare_corpora(df: DataFrame, text_col: str, model: str, corpus_0: Column, corpus_1: Column) -> DataFrame:
    """``token_frequency_stats`` of the rows of ``df`` that meet either condition: one scan, one aggregation, and no order."""
    own = df.filter(corpus_0 | corpus_1).withColumn("_in_0", corpus_0.cast("bigint")).withColumn("_in_1", corpus_1.cast("bigint"))
    counts = token_frequencies(own, text_col, model, by=("_in_0", "_in_1"))
    both = counts.groupBy("token").agg(*(F.sum(F.col("count") * F.coalesce(f"_in_{k}", F.lit(0))).cast("bigint").alias(f"freq_corpus_{k}") for k in (0, 1)))
    sums = both.agg(*(F.coalesce(F.sum(f"freq_corpus_{k}"), F.lit(0)).cast("bigint").alias(f"corpus_{k}_total") for k in (0, 1)))
    return _stats(both, sums)


def _stats(both: DataFrame, sums: DataFrame) -> DataFrame:
    df = both.crossJoin(F.broadcast(sums))  # one row
    a, b, ta, tb = (F.col(c).cast("double") for c in ("freq_corpus_0", "freq_corpus_1", "corpus_0_total", "corpus_1_total"))
    n, t = ta + tb, a + b
    df = df.withColumns({"expected_0": ieee_div(t * ta, n), "expected_1": ieee_div(t * tb, n)})
    e0, e1 = F.col("expected_0"), F.col("expected_1")

    def part(x: Column, e: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / F.greatest(e, F.lit(TINY)))).otherwise(0.0)

    df = df.withColumn("log_likelihood_llv", 2 * (part(a, e0) + part(b, e1)))
    llv, least = F.col("log_likelihood_llv"), F.least(e0, e1)
    mark = F.lit("")
    for level, stars in reversed(LEVELS):
        mark = F.when(llv >= level, stars).otherwise(mark)
    rr = ieee_div(ieee_div(a, ta), ieee_div(b, tb))
    df = df.withColumns(
        {
            "bayes_factor_bic": llv - _ln(n),
            "effect_size_ell": F.when(least > 0, ieee_div(llv, n * F.ln(F.greatest(least, F.lit(TINY))))).otherwise(0.0),
            "significance": mark,
            "percent_corpus_0": ieee_div(a, ta) * 100,
            "percent_corpus_1": ieee_div(b, tb) * 100,
            "percent_diff": ieee_div(a, ta) - ieee_div(b, tb),
            "relative_risk": F.when(b > 0, rr),
            "log_ratio": F.when((a > 0) & (b > 0), F.ln(rr)),
            "odds_ratio": F.when((a > 0) & (b > 0) & (ta > a) & (tb > b), ieee_div(a * (tb - b), b * (ta - a))),
        }
    )
    return df.select(*COLUMNS)
