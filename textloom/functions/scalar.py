"""Cleaning and counting: expressions of the JVM. Null texts give '' or 0, never null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"\p{IsWhite_Space}"
ASCII_PUNCTUATION = r"!-/:-@\[-`{-~"
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
TERMINATORS = ".!?。！？۔؟।॥"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Lower case, ASCII punctuation and digits to spaces, runs of white space to one space, trimmed."""
    bare = F.regexp_replace(F.lower(as_column(c)), f"[{ASCII_PUNCTUATION}0-9]", " ")
    return F.coalesce(F.trim(F.regexp_replace(bare, f"{SPACE}+", " ")), F.lit(""))


def word_count(c: Column | str) -> Column:
    """Words between white space; a single word of CJK characters counts each of them."""
    words = F.regexp_extract_all(as_column(c), F.lit(f"[^{SPACE}]+"), F.lit(0))
    one = F.get(words, 0)
    chars = F.when((F.size(words) == 1) & one.rlike(f"^[{CJK}]+$"), F.char_length(one))
    return F.when(as_column(c).isNull(), 0).otherwise(F.coalesce(chars, F.size(words))).cast("bigint")


def char_count(c: Column | str) -> Column:
    """Code points."""
    return F.coalesce(F.char_length(as_column(c)).cast("bigint"), F.lit(0).cast("bigint"))


def sentence_count(c: Column | str) -> Column:
    """Stretches between terminators that are not blank."""
    parts = F.split(as_column(c), f"[{TERMINATORS}]", -1)
    return F.when(as_column(c).isNull(), 0).otherwise(F.size(F.filter(parts, lambda s: s.rlike(f"[^{SPACE}]")))).cast("bigint")
