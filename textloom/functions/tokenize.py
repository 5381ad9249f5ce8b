"""Tokens and their offsets in code points.

Three forms: ``token_strings`` (expressions of the JVM; what counting needs), ``token_rows`` (one
row a token with offsets), and ``tokenize`` (a Column of token, start and end; Arrow). Offsets refer to the lower-cased text where that is asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..models import PREDEFINED_MODELS, require_feature
from ..sources.log import shared_path
from ..sources.store import ASKED, Lookup, Store
from .lattice import Lattice
from .scalar import ASCII_PUNCTUATION, SPACE, as_column
from .slices import sliced

NATIVE = "native:plain_words_en"
TOKENS = "array<struct<token: string, start: bigint, end: bigint>>"
#: Dropped in any ASCII case, with or without brackets (fixed values).
SPECIAL = ("cls", "mask", "pad", "sep", "unk")
_PUNCTUATION = ASCII_PUNCTUATION + r"\p{P}"
_PIECE = f"[{_PUNCTUATION}]|[^{SPACE}{_PUNCTUATION}]+"
_ALPHANUMERIC = r"[\p{IsAlphabetic}\p{N}]"
_SPECIAL_JVM = "(?i)^(?:" + "|".join(SPECIAL) + ")$"

_P = "[" + ASCII_PUNCTUATION + r"\p{P}]"
_py_piece = regex.compile(rf"{_P}|[^\p{{White_Space}}{ASCII_PUNCTUATION}\p{{P}}]+")
_py_piece_back = regex.compile(_py_piece.pattern, regex.REVERSE)
_py_alphanumeric = regex.compile(r"[\p{Alphabetic}\p{N}]")
_py_special = re.compile("(?:" + "|".join(SPECIAL) + ")", re.IGNORECASE | re.ASCII)

TOKEN_CACHE = "model string, params_hash string, content_hash string, tokens array<string>, start_offsets array<bigint>, end_offsets array<bigint>"
_STORED = pa.schema([("model", pa.string()), ("params_hash", pa.string()), ("content_hash", pa.string()), ("tokens", pa.list_(pa.string())), ("start_offsets", pa.list_(pa.int64())), ("end_offsets", pa.list_(pa.int64()))])
Span = tuple[str, int, int]
#: Loaders of dictionary tokenizers by model id, for languages whose dictionaries this library doesn't bring.
_dictionaries: dict[str, Callable[[], Callable[[str], list[Span]]]] = {}
_loaded: set[str] = set()


def normalize_model(model: str | None) -> str:
    if model is None or not str(model).strip():
        raise ValueError("model must be a tokenizer id, such as " + NATIVE)
    return str(model).strip()


def route(model: str) -> tuple[str, str]:
    """Family and name of a model id."""
    family, _, name = model.partition(":")
    if family == "native":
        if model != NATIVE:
            raise ValueError(f"Unknown native tokenizer model id: {model}")
    elif family == "huggingface":
        if not name.strip():
            raise ValueError(f"Tokenizer model id must include a repository id: {model}")
    elif family == "lindera":
        if model not in PREDEFINED_MODELS:
            raise ValueError(f"Unknown Lindera tokenizer model id: {model}")
    else:
        raise ValueError(f"Unknown tokenizer model id: {model}")
    return family, name


def register_dictionary(model: str, load: Callable[[], Callable[[str], list[Span]]]) -> None:
    """Make a dictionary model usable: ``load`` returns a function from a text to its (surface, start, end)."""
    route(model)
    _dictionaries[model] = load


def dictionary_folder(model: str, folder: str) -> None:
    """Make a dictionary model usable by a folder in MeCab's source format (see ``lattice``), which all tasks must see."""
    register_dictionary(model, partial(Lattice, str(folder)))


def _file(name: str) -> Path:
    for at in (Path(name), Path(name) / "tokenizer.json"):
        if at.is_file():
            return at
    raise FileNotFoundError(f"no tokenizer.json for {name!r}: give a local file or folder; nothing is downloaded")


def native_spans(text: str, remove_punct: bool) -> list[Span]:
    out = []
    for m in _py_piece.finditer(text):
        token = m[0]
        if (remove_punct and not _py_alphanumeric.search(token)) or _py_special.fullmatch(token):
            continue
        out.append((token, m.start(), m.end()))
    return out


@lru_cache(maxsize=64)
def load(model: str) -> Callable[[str, bool, bool], list[Span]]:
    """The tokenizer of a model id, kept in this process: (text, lowercase, remove_punct) to spans."""
    family, name = route(model)
    if family == "native":
        made = lambda text, lowercase, remove: native_spans(text.lower() if lowercase else text, remove)
    elif family == "huggingface":
        from tokenizers import Tokenizer

        backend = Tokenizer.from_file(str(_file(name)))
        backend.no_truncation()
        backend.no_padding()

        def made(text: str, lowercase: bool, remove: bool) -> list[Span]:
            done = backend.encode(text.lower() if lowercase else text, add_special_tokens=False)
            return [(t, a, b) for t, (a, b) in zip(done.tokens, done.offsets, strict=True) if not remove or _py_alphanumeric.search(t)]
    else:
        if model not in _dictionaries:
            raise RuntimeError(f"{model} needs its dictionary: register_dictionary({model!r}, loader)")
        morphemes = _dictionaries[model]()
        made = lambda text, lowercase, remove: [x for x in morphemes(text) if not remove or _py_alphanumeric.search(x[0])]
    _loaded.add(model)
    return made


def _load_here(model: str, dictionary: Callable | None) -> Callable[[str, bool, bool], list[Span]]:
    """``load`` in a task, where the driver's dictionaries aren't registered yet."""
    if dictionary is not None:
        _dictionaries.setdefault(model, dictionary)
    return load(model)


def prefetch_model(model_id: str) -> None:
    """Load a tokenizer in this process; errors show here and not in a task."""
    require_feature("tokenization", "prefetch_model")
    try:
        load(normalize_model(model_id))
    except Exception as e:
        raise RuntimeError(f"failed to load tokenizer {model_id}: {e}") from e


def list_loaded_models() -> list[str]:
    return sorted(_loaded)


def params_hash(lowercase: bool, remove_punct: bool) -> str:
    flag = {True: "true", False: "false"}
    return hashlib.sha256(f'{{"lowercase":{flag[bool(lowercase)]},"remove_punct":{flag[bool(remove_punct)]}}}'.encode()).hexdigest()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: 0 white space, 1 punctuation (a piece of its own), 2 anything else; 4 more if alphanumeric."""
    every = "".join(chr(k) if not 0xD800 <= k < 0xE000 else "x" for k in range(0x110000))
    out = np.full(0x110000, 2, np.uint8)
    for pattern, value in ((r"\p{White_Space}", 0), (_P, 1)):
        out[[m.start() for m in regex.finditer(pattern, every)]] = value
    for m in regex.finditer(r"[\p{Alphabetic}\p{N}]+", every):
        out[m.start() : m.end()] |= 4
    return out


def native_tokens(texts: list[str | None], lowercase: bool, remove_punct: bool) -> pa.ListArray:
    """The native model's tokens of many texts at once: classes of code points, runs of a class, and slices of the UTF-8."""
    joined = [(t.lower() if lowercase else t) if t else "" for t in texts]
    whole = "".join(joined)
    first = np.append(0, np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined))))
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    piece, letter = kind & 3, kind & 4
    begin = np.ones(len(points), bool)
    begin[1:] = (piece[1:] != 2) | (piece[:-1] != 2)
    begin[first[:-1][first[:-1] < len(points)]] = True  # a piece ends with its text
    begin &= piece > 0
    start = np.flatnonzero(begin)
    ends = np.append(begin[1:], True) | np.append(piece[1:] == 0, True)
    end = np.flatnonzero(ends & (piece > 0)) + 1
    keep = np.ones(len(start), bool)
    if remove_punct and len(start):
        seen = np.append(0, np.cumsum(letter > 0))
        keep = seen[end] > seen[start]
    for word in SPECIAL:
        same = np.flatnonzero(keep & (end - start == len(word)))
        for k, letter_ in enumerate(word):
            same = same[(points[start[same] + k] == ord(letter_)) | (points[start[same] + k] == ord(letter_.upper()))]
        keep[same] = False
    start, end = start[keep], end[keep]
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    byte = np.append(0, np.cumsum(size))
    row = np.searchsorted(first, start, side="right") - 1
    length = byte[end] - byte[start]
    offsets = np.append(0, np.cumsum(length))
    raw = np.frombuffer(whole.encode(), np.uint8)[np.repeat(byte[start] - offsets[:-1], length) + np.arange(int(offsets[-1]))]
    token = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(raw)).cast(pa.string())
    rows = pa.StructArray.from_arrays([token, pa.array(start - first[row]), pa.array(end - first[row])], ["token", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(texts)))).astype(np.int32)), rows)


def _listed(spans: list[list[Span]]) -> pa.ListArray:
    flat = [x for own in spans for x in own]
    columns = list(zip(*flat, strict=True)) if flat else [(), (), ()]
    rows = pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["token", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in spans], dtype=np.int64)).astype(np.int32)), rows)


def tokenize(c: Column | str, *, model: str, lowercase: bool = True, remove_punct: bool = True, cache: str | None = None) -> Column:
    """array<struct<token, start, end>>; null and empty texts give an empty array.

    ``cache`` names a folder that tasks share: texts that it has are read, others are tokenized
    once and added (``sources.cache.tokens`` looks all texts up in one join). Many texts are best
    sorted by ``sources.cache.content_hash`` before: else each batch reads all of a large cache.
    """
    require_feature("tokenization", "tokenize")
    model = normalize_model(model)
    route(model)
    custom = _dictionaries.get(model)

    def listed(texts: list[str | None]) -> pa.ListArray:
        if model == NATIVE:
            return native_tokens(texts, lowercase, remove_punct)
        spans = _load_here(model, custom)
        return _listed([spans(t, lowercase, remove_punct) if t else [] for t in texts])

    def compute(texts: list[str]) -> pa.Table:
        made = pa.concat_arrays([listed(part.to_pylist()) for part in sliced(pa.array(texts, pa.string()))])
        return pa.table({name: pa.ListArray.from_arrays(made.offsets, made.values.field(field)) for name, field in (("tokens", "token"), ("start_offsets", "start"), ("end_offsets", "end"))})

    if cache is not None:
        cache = shared_path(cache)

    @arrow_udf(TOKENS)
    def tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if cache is None:
            yield from (listed(part.to_pylist()) for texts in parts for part in sliced(texts))
            return
        lookup = Lookup(Store(cache, _STORED, {"model": model, "params_hash": params_hash(lowercase, remove_punct)}), compute)
        try:
            for texts in parts:
                for part in sliced(texts, ASKED):
                    yield _zipped(lookup.rows(part.to_pylist()).combine_chunks())
        finally:  # also where a limit stops the task
            lookup.close()

    return tokens(as_column(c))


def _zipped(rows: pa.Table) -> pa.ListArray:
    """The cache's three lists as one list of structs; null rows are empty."""
    lists = {name: rows[name].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type) for name in ("tokens", "start_offsets", "end_offsets")}
    size = pc.fill_null(pc.list_value_length(lists["tokens"]), 0)
    offsets = np.append(0, np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64)).astype(np.int32)
    spans = pa.StructArray.from_arrays([x.flatten() for x in lists.values()], ["token", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), spans)


def _keep(token: Column, remove_punct: bool, lowered: bool) -> Column:
    kept = ~token.isin(*SPECIAL) if lowered else ~token.rlike(_SPECIAL_JVM)
    return kept & token.rlike(_ALPHANUMERIC) if remove_punct else kept


def token_strings(c: Column | str, *, lowercase: bool = True, remove_punct: bool = True) -> Column:
    """Tokens of the native model as array<string>, without leaving the JVM."""
    text = F.lower(as_column(c)) if lowercase else as_column(c)
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PIECE), F.lit(0))
    return F.filter(pieces, lambda t: _keep(t, remove_punct, lowercase))


def token_rows(df: DataFrame, id_col: str, text_col: str, *, lowercase: bool = True, remove_punct: bool = True) -> DataFrame:
    """(id, token, start, end), a row for each token of the native model.

    Offsets come from one vectorised pass over each batch of texts, so nothing is shuffled, and a
    text is never spread over rows to be summed up again.
    """
    found = tokenize(text_col, model=NATIVE, lowercase=lowercase, remove_punct=remove_punct)
    return df.select(F.col(id_col).alias("id"), F.inline(found))
