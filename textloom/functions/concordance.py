"""Keyword in context."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..models import require_feature
from .dialect import translated
from .scalar import as_column
from .slices import sliced
from .tokenize import _py_piece, _py_piece_back, _py_special

HIT = "left_context string, matched_text string, right_context string, start_idx bigint, end_idx bigint, l1 string, r1 string"
HITS = f"array<struct<{HIT}>>"
_NAMES = ("left_context", "matched_text", "right_context", "start_idx", "end_idx", "l1", "r1")


def compile_search(search_word: str, is_regex: bool, case_sensitive: bool) -> regex.Pattern:
    """A literal, or a pattern of the linear-time dialect (``dialect``)."""
    try:
        source = translated(search_word, not case_sensitive) if is_regex else regex.escape(search_word, special_only=True, literal_spaces=True)
        return regex.compile(source, regex.VERSION0 | (0 if case_sensitive else regex.IGNORECASE))
    except (ValueError, regex.error) as e:
        raise ValueError(f"Concordance failed: {e}") from e


def _matches(pattern: regex.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap; an empty one right after another match is none."""
    out, at = [], -1
    for m in pattern.finditer(text):
        if m.start() == m.end() == at:
            continue
        out.append(m.span())
        at = m.end()
    return out


def _words(pieces: Iterable[regex.Match], most: int) -> list[str]:
    """The first ``most`` pieces that count."""
    out: list[str] = []
    if most:
        for m in pieces:
            if not _py_special.fullmatch(m[0]):
                out.append(m[0])
                if len(out) == most:
                    break
    return out


def hits(text: str, pattern: regex.Pattern, left: int, right: int) -> list[tuple]:
    """All hits of a text; only pieces that a context needs are looked for, and one that a hit cuts counts with what is left of it."""
    out = []
    for a, b in _matches(pattern, text):
        before, after = _words(_py_piece_back.finditer(text, 0, a), left), _words(_py_piece.finditer(text, b), right)
        l1, r1 = (before[0] if before else ""), (after[0] if after else "")
        out.append((" ".join(reversed(before)), text[a:b], " ".join(after), a, b, l1, r1))
    return out


def hit_lists(texts: list[str | None], pattern: regex.Pattern | None, left: int, right: int) -> pa.ListArray:
    """The hits of each text as a list of structs."""
    offsets, rows = [0], []
    for text in texts:
        if text and pattern is not None:
            rows += hits(text, pattern, left, right)
        offsets.append(len(rows))
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(_NAMES)
    kinds = [pa.int64() if n.endswith("_idx") else pa.string() for n in _NAMES]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], list(_NAMES)))


def concordance(c: Column | str, search_word: str, *, num_left_tokens: int = 5, num_right_tokens: int = 5, regex: bool = False, case_sensitive: bool = False) -> Column:
    """Hits with their context, as array<struct>; null texts, no hits and an empty search word give an empty array.

    Offsets are code points of the text as it is. Negative context sizes count as 0. With
    ``inline_outer`` a text without hits gives one row of nulls.
    """
    require_feature("tokenization", "concordance")
    pattern = compile_search(search_word, regex, case_sensitive) if search_word else None
    left, right = max(0, num_left_tokens), max(0, num_right_tokens)
    source = (search_word, regex, case_sensitive)

    @arrow_udf(HITS)
    def search(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = compile_search(*source) if pattern is not None else None
        for texts in parts:
            yield from (hit_lists(part.to_pylist(), own, left, right) for part in sliced(texts))

    return search(as_column(c))


def concordance_rows(df: DataFrame, text_col: str, search_word: str, *columns: str, **options: object) -> DataFrame:
    """``columns`` and the fields of a hit, a row for each hit, one row of nulls for a text without."""
    found = concordance(text_col, search_word, **options)  # type: ignore[arg-type]
    return df.select(*columns, F.inline_outer(found))
