"""Chat formatting from event logs (operator 7).

A log has rows (conv_id, seq, message, kind, role, text): ``message`` opens a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` replaces it too and drops every later
message of the conversation. Logs are partitioned by conversation, sorted by sequence and folded as a
stream; the result is rendered with a template whose marks cannot occur inside texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import read_table

OPEN, SEPARATE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: First characters of control strings, wherever one starts: the template's own, and those of common chat templates.
_CONTROL = re.compile(r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])|\\")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SEPARATE) + "(.*?)" + re.escape(CLOSE), re.DOTALL)
EVENTS = "conv_id, seq, message, kind, role, text"
#: Kinds in the order in which events of one seq are taken; null opens a message too.
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: str) -> str:
    r"""A backslash after the first character of each control string, and twice for itself."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) of each message of one conversation, for (message, kind, role, text) in sequence.

    Events on messages that are not open are ignored, unknown kinds too; null kinds open, null
    roles and texts are empty.
    """
    messages: dict[object, list] = {}
    for message, kind, role, text in events:
        if kind in (None, "message"):
            messages[message] = [role or "", [text or ""]]
        elif message not in messages:
            continue
        elif kind == "delta":
            messages[message][1].append(text or "")
        elif kind == "edit":
            messages[message][1] = [text or ""]
        elif kind == "regenerate":
            while next(reversed(messages)) != message:  # later messages go, each once
                messages.popitem()
            messages[message][1] = [text or ""]
    return [(role, "".join(parts)) for role, parts in messages.values()]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of what the assistant says: the loss mask."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SEPARATE}", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; inverse of ``render``."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, held, out = None, [], []

    def done() -> None:
        text, mask = render(fold(iter(held)))
        out.append((conv, text, [{"start": a, "end": b} for a, b in mask]))

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "formatted", "loss_mask"])

    begun = False
    for batch in batches:
        for c, *event in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if begun and c != conv:
                done()
                held = []
            begun, conv = True, c
            held.append(event)
        if out:
            yield made()
    if begun:
        done()
        yield made()


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of a log (conv_id, seq, message, kind, role, text).

    Rows of one seq are taken in the order of kind (``KINDS``, unknown ones last), message, role
    and text, nulls first; rows that repeat count each. Null texts and roles are empty; rows with
    null conv_id form one conversation; an empty log gives no rows. A conversation becomes one
    text, of any length, so its rows meet in one task, as a stream of sorted rows of which one
    conversation is held at a time. Other columns are ignored.
    """
    log = events.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("seq").cast("bigint").alias("seq"), F.col("message").cast("bigint").alias("message"), "kind", "role", "text")
    rank = F.when(F.col("kind").isNull(), 0)
    for k, kind in enumerate(KINDS):
        rank = rank.when(F.col("kind") == kind, k)
    log = log.withColumn("rank", rank.otherwise(len(KINDS))).repartition("conv_id").sortWithinPartitions("conv_id", "seq", "rank", "message", "role", "text")
    return log.select("conv_id", "message", "kind", "role", "text").mapInArrow(_conversations, "conv_id bigint, formatted string, loss_mask array<struct<start: bigint, end: bigint>>")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for formatted, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse(formatted)
            said = "".join(unescape(formatted[x["start"] : x["end"]]) for x in mask)
            every = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log of events that they came from.

    What an assistant says is streamed: its message opens with a draft, which is regenerated and
    goes on in two deltas. Other turns open with their text's first half, take a delta, and where
    nothing tells whether that was meant, an edit that sets the whole text. Turns that share a
    number are taken in the order of role and text, null and empty alike; rows that repeat are
    messages of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint")
    turns = turns.withColumn("message", place).withColumn("n", F.char_length("text"))
    third, half = F.ceil(F.col("n") / 3).cast("int"), F.ceil(F.col("n") / 2).cast("int")

    def part(start: Column, length: Column) -> Column:
        return F.substring("text", start + 1, length)

    def event(k: int, kind: str, text: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"))

    none = F.lit(0)
    streamed = F.array(event(0, "message", F.reverse(part(none, half))), event(1, "regenerate", part(none, third)), event(2, "delta", part(third, third)), event(3, "delta", part(third * 2, F.col("n"))))
    typed = F.array(event(0, "message", part(none, half)), event(1, "delta", part(none, half)), event(2, "edit", F.col("text")))
    events = turns.withColumn("event", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(typed)))
    return events.select("conv_id", (F.col("message") * 8 + F.col("event.k")).alias("seq"), "message", "event.kind", "role", "event.text")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return format_chats(as_events(rows)).mapInArrow(_digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '<|', ''))) / 2
    + (length(text) - length(replace(text, '<s>', ''))) / 3 + (length(text) - length(replace(text, '</s>', ''))) / 4
    + (length(text) - length(replace(text, '<<SYS>>', ''))) / 7 + (length(text) - length(replace(text, '<</SYS>>', ''))) / 8
    + (length(text) - length(replace(text, '[INST]', ''))) / 6 + (length(text) - length(replace(text, '[/INST]', ''))) / 7 AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(escaped + length(role) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
