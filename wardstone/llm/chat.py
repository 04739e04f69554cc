"""Chat formatting from an event log: fold deltas, edits and regenerations into final messages, render, read back.

Events have conv_id, seq, op, msg, role, text. By conversation and sequence they are folded:

* ``message`` starts message ``msg``; ``delta`` appends to it; ``edit`` replaces its text;
* ``regenerate`` empties it for new deltas and takes away the messages that had begun after it by then.

Template: each message is ``### role: text</turn>`` and a line feed. Inside texts and roles a backslash goes
before each backslash, ``#`` and ``<`` (in roles also before ``:``), so neither mark can occur there and each
message reads back exactly. The loss mask covers the text of assistant messages, without marks.

Rendered messages are rows of their own, in order; no conversation has to fit in memory, and digests are
taken message by message. (A digest of one conversation is sequential by nature: one task reads it.)

Defined results: null texts and roles count as empty. Events of one seq stand in the order message, edit,
regenerate, delta, then by role and text; null seqs come first; events without a msg are messages of their
own. A null conv_id is one conversation. An empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import ship, written

ORDER = ["message", "edit", "regenerate", "delta"]


def fold(events: DataFrame) -> DataFrame:
    """Events -> final messages: conv_id, pos (from 0), role, text."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.coalesce("op", F.lit("message")))
    own = F.struct(F.col("msg").cast("string").alias("msg"), F.when(F.col("msg").isNull(), F.monotonically_increasing_id()).alias("row"))
    e = events.select(
        "conv_id",
        own.alias("msg"),
        F.struct(F.col("seq"), rank.alias("rank"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"),
        F.when(rank == 3, F.col("seq")).alias("again"),
    )
    m = e.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list("e")).alias("es"), F.max("again").alias("again"), F.min("e").alias("first"))
    resets = F.filter(F.transform("es", lambda x, i: F.when(x["rank"] < 4, i)), lambda i: i.isNotNull())
    last = F.coalesce(F.try_element_at(resets, F.lit(-1)), F.lit(0))
    text = F.array_join(F.transform(F.slice("es", last + 1, F.size("es")), lambda x: F.when(x["rank"] == 3, F.lit("")).otherwise(x["text"])), "")
    m = m.select("conv_id", "msg", "again", "first", text.alias("text"))
    by_start = Window.partitionBy("conv_id").orderBy("first", "msg")
    before = F.max("again").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("cut", before).filter("cut IS NULL OR first.seq IS NULL OR cut <= first.seq")
    m = m.withColumn("pos", F.row_number().over(by_start) - 1)
    return m.select("conv_id", F.col("pos").cast("long").alias("pos"), F.col("first.role").alias("role"), "text")


def _escaped(c: Column, marks: str) -> Column:
    return F.regexp_replace(c, f"([{marks}])", r"\\$1")


def render(messages: DataFrame) -> DataFrame:
    """Messages -> conv_id, pos, formatted, loss_from and loss_to (the masked characters of formatted; none: both 0)."""
    head = F.concat(F.lit("### "), _escaped(F.col("role"), r"\\#<:"), F.lit(": "))
    body = _escaped(F.col("text"), r"\\#<")
    m = messages.select("conv_id", "pos", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learn"))
    start = F.when(F.col("learn"), F.length("head")).otherwise(0).cast("long")
    end = F.when(F.col("learn"), F.length("head") + F.length("body")).otherwise(0).cast("long")
    return m.select("conv_id", "pos", F.concat("head", "body", F.lit("</turn>\n")).alias("formatted"), start.alias("loss_from"), end.alias("loss_to"))


_MESSAGE = re.compile(r"### ((?:\\.|[^\\#<:])*): ((?:\\.|[^\\#<])*)</turn>\n", re.DOTALL)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) messages of a rendered text."""
    out, at = [], 0
    while at < len(formatted):
        m = _MESSAGE.match(formatted, at)
        if m is None:
            raise ValueError(f"no message at {at}")
        out.append((_ESCAPE.sub(r"\1", m[1]), _ESCAPE.sub(r"\1", m[2])))
        at = m.end()
    return out


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rendered rows sorted by (conv_id, pos) -> one row per conversation."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state, key = None, None

    def flush(keys: list, rows: list, kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["conv_id", *names])

    def end() -> tuple:
        n, turns, chars, loss, total = state
        return n, turns.hexdigest(), chars, loss.hexdigest(), total

    kind = pa.int64()
    for batch in batches:
        kind, keys, rows = batch.schema.field(0).type, [], []
        for c, formatted, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if state is None or c != key:
                if state is not None:
                    keys.append(key)
                    rows.append(end())
                key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            learned = _ESCAPE.sub(r"\1", formatted[a:b])
            state[2] += len(learned)
            state[3].update(learned.encode())
            state[4] += len(formatted)
        if rows:
            yield flush(keys, rows, kind)
    if state is not None:
        yield flush([key], [end()], kind)


def read_back(rendered: DataFrame) -> DataFrame:
    """Rendered rows -> conv_id and the digests of what they say."""
    ship(rendered.sparkSession)
    kind = rendered.schema["conv_id"].dataType
    ordered = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "formatted", "loss_from", "loss_to")
    return ordered.mapInArrow(_digest, T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL(DIGEST).fields]))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), each a message of its own -> rendered rows, written to the shared folder."""
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), F.lit(None).cast("string").alias("msg"), "role", "text")
    return written(render(fold(events)), "formatted")


PROBE = "\\### Assistant: </turn> ok"


def with_probe(rows: DataFrame) -> DataFrame:
    """The conversations, and conversation -7 that holds the template's own marks."""
    rows = rows.select("conv_id", "turn", "role", "text")
    probe = rows.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.unionByName(probe)


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
