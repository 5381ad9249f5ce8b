"""Quality rules under weak supervision (operator 2).

Each rule votes good, bad or abstains. How often each rule says what on good and on bad
documents is estimated by expectation-maximisation over the counts of all vote patterns
(documents with one pattern are alike to the model, and 3^rules bounds the patterns), and a
document stays if its posterior probability of being good is high enough. No rule has a veto
beyond the base rules, which the contract fixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import read_table, staged
from .vectext import utf8

#: Below so many words, shares of words say little, and the rules on them abstain.
SHORT = 20
SYMBOLS = b"#*$%&|<>"
#: Words that hold sentences together (fixed values; en, fr, de, es).
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "a an and are as at be but by for from he her his in is it its not of on or she that the their they this to was we were which will with you "
        "au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
        "als am an auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht oder sich sie sind so und von war wie wir zu zum zur "
        "al como con de del el ella en es esta este la las lo los más no para pero por que se si sin sobre su sus un una y"
    ).split()
)
#: Name, measure, bounds beyond which a text is bad, bounds within which it is good; between them a rule abstains.
RULES = (
    ("symbols", "symbols", (None, 0.1), (None, 0.02)),
    ("repeats", "repeats", (None, 0.15), (None, 0.05)),
    ("duplicate_lines", "dup_lines", (None, 0.4), (None, 0.15)),
    ("capitals", "capitals", (None, 0.4), (None, 0.1)),
    ("word_length", "word_length", (3.2, 7.0), (3.8, 6.2)),
    ("function_words", "function_words", (0.04, 0.65), (0.09, 0.5)),
    ("line_ends", "line_ends", (0.5, None), (0.85, None)),
    ("bare_tokens", "bare", (None, 0.15), (None, 0.04)),
    ("digits", "digits", (None, 0.2), (None, 0.08)),
    ("variety", "variety", (0.15, None), (0.35, None)),
    ("shouting", "exclaims", (None, 0.2), (None, 0.05)),
)
_PUNCTUATION = bytes(b for b in range(128) if not chr(b).isalnum())


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text has at least twice."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key, base = code[:n], len(ids)
    if base**width < 1 << 62:
        for k in range(1, width):
            key = key * base + code[k : n + k]
    else:  # the ranks of longer and longer windows stay below the number of words
        for k in range(1, width):
            key = np.unique(key * base + code[k : n + k], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    step[at] += 1
    np.subtract.at(step, at + width, 1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def measures(text: bytes) -> tuple[list[int], dict[str, float]]:
    """The base counts of a text, and the shares that the rules look at."""
    words = text.split()
    n = len(words)
    chars = len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    symbols = sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup, repeats = len(lines) - len(set(lines)), repeated_words(words)
    if not n:
        return [0, chars, symbols, dup, repeats], {}
    lower = text.lower().split()
    shares = {
        "symbols": symbols / max(1, chars),
        "repeats": repeats / n,
        "dup_lines": dup / len(lines),
        "capitals": sum(w.isupper() and len(w) > 1 for w in words) / n,
        "word_length": chars / n,
        "function_words": sum(w.strip(_PUNCTUATION) in FUNCTION_WORDS for w in lower) / n,
        "line_ends": sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"', "。".encode(), "…".encode(), "”".encode(), "»".encode())) for x in lines) / len(lines),
        "bare": sum(not w.strip(_PUNCTUATION) for w in words) / n,
        "digits": sum(map(text.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / max(1, chars),
        "variety": len(set(lower)) / min(n, 400),
        "exclaims": (text.count(b"!") + text.count(b"?")) / n,
    }
    if n < SHORT:
        for name in ("word_length", "function_words", "digits"):
            del shares[name]
    return [n, chars, symbols, dup, repeats], shares


def votes(shares: dict[str, float]) -> int:
    """The votes of all rules in base 3: 0 abstains, 1 bad, 2 good."""
    pattern = 0
    for _, name, bad, good in RULES:
        vote, x = 0, shares.get(name)
        if x is not None:
            if (bad[0] is not None and x < bad[0]) or (bad[1] is not None and x > bad[1]):
                vote = 1
            elif (good[0] is None or x >= good[0]) and (good[1] is None or x <= good[1]):
                vote = 2
        pattern = pattern * 3 + vote
    return pattern


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = utf8(batch.column(1))
        out = []
        for i in range(batch.num_rows):
            counts, shares = measures(data[offs[i] : offs[i + 1]].tobytes())
            out.append((*counts, votes(shares)))
        columns = zip(*out, strict=True) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"])


def vote_table(patterns: list[int]) -> np.ndarray:
    """The votes (0 abstains, 1 bad, 2 good) of each pattern, a column a rule."""
    return np.array([[p // 3 ** (len(RULES) - 1 - k) % 3 for k in range(len(RULES))] for p in patterns]).reshape(-1, len(RULES))


def estimated(vote: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prior of (bad, good), and for each class and rule the share of its votes, abstentions aside, that say good; one document is added to each side."""
    said = vote > 0
    good = (weight @ (vote == 2) + 1) / (weight @ said + 2)
    prior = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
    return prior, good


def scores(vote: np.ndarray, prior: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The log likelihood of each pattern's votes with each class; a rule that abstains says nothing, as in ``estimated``."""
    return np.log(prior)[:, None] + np.log(good) @ (vote == 2).T + np.log1p(-good) @ (vote == 1).T


def likelihood(n: np.ndarray, score: np.ndarray, prior: np.ndarray, good: np.ndarray) -> float:
    """What expectation-maximisation raises: the log likelihood of all votes, and of the documents that are added."""
    return float(n @ np.logaddexp(*score) + np.log(prior).sum() + np.log(good).sum() + np.log1p(-good).sum())


def posteriors(counts: dict[int, int], rounds: int = 500, settle: float = 1e-9, trace: list[float] | None = None) -> dict[int, float]:
    """P(good) of each vote pattern, after expectation-maximisation over ``counts`` documents of each.

    The start takes 0.95 for a pattern without bad votes and 0.4 times less for each of them.
    Each rule has an estimated accuracy on good and on bad documents: the share of its votes that
    are right where it votes. A pattern without votes keeps the prior. ``trace`` gets the
    likelihood of each round.
    """
    if not counts:
        return {}
    patterns = sorted(counts)
    n, vote = np.array([counts[p] for p in patterns], float), vote_table(patterns)
    posterior = np.where((vote > 0).any(axis=1), 0.95 * 0.4 ** (vote == 1).sum(axis=1), 0.5)
    for _ in range(rounds):
        prior, good = estimated(vote, np.stack([n * (1 - posterior), n * posterior]))
        score = scores(vote, prior, good)
        if trace is not None:
            trace.append(likelihood(n, score, prior, good))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -700, 700)))
        done = float(np.abs(new - posterior).max()) < settle
        posterior = new
        if done:
            break
    return dict(zip(patterns, posterior.tolist(), strict=True))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts and vote pattern of each document, written."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(texts.mapInArrow(_measured, f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, pattern bigint"), "measures")


def model(made: DataFrame) -> dict[int, float]:
    """The posterior of each vote pattern; at most 3^11 counts reach the driver, whatever the number of documents."""
    return posteriors({r["pattern"]: r["count"] for r in made.groupBy("pattern").count().collect()})


def quality(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the base counts, base_failed, p_good, and kept (p_good >= ``least`` and not base_failed).

    Null and empty texts have no words and fail the base rules, as texts under ten words do.
    Null ids, shared ids and repeated rows are judged row by row, ties are those of equal votes
    and have one verdict. Texts may have any length; an empty table gives an empty one. Other
    columns are ignored.
    """
    made = measured(docs, id_col, text_col)
    good = docs.sparkSession.createDataFrame(list(model(made).items()) or [(-1, 0.0)], "pattern bigint, p_good double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = made.join(F.broadcast(good), "pattern", "left").withColumn("base_failed", failed)  # at most 3^11 rows
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & (F.col("p_good") >= least)).alias("kept"), "p_good")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents")).drop("p_good")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The documents that are kept, all columns as they were; rows are judged where they lie, without a join.

    Each row is judged by its own text, of any length, whether its id is null, shared or repeated;
    null and empty texts go; of an empty table nothing is left.
    """
    good = {p for p, x in model(measured(docs)).items() if x >= least}

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(batch.schema.get_field_index("text")))
            mask = []
            for i in range(batch.num_rows):
                counts, shares = measures(data[offs[i] : offs[i + 1]].tobytes())
                mask.append(counts[0] >= 10 and 100 * counts[4] <= 20 * counts[0] and votes(shares) in good)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of ``op2_quality_rules``: all but the verdict."""
    return op2_quality_rules(spark, sf_dir).drop("kept")


BASE_ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 4)) AS i, unnest(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM w WHERE len(ws) > 4),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM twice) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(n, 0) > 20 * len(ws) AS base_failed
FROM l LEFT JOIN r USING (doc_id)
"""
