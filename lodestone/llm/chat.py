"""Chat formatting: a finite-state machine over roles and a declarative template, with loss flags by segment.

A template names the marks before and after a turn of each role, whether its text counts for the loss, and which role may follow
which.  All marks start with ``<`` or ``[``; in texts these and the backslash get a backslash before them, so an unescaped one
always begins a mark and ``read_turns`` gives back the exact roles and texts.

Nulls: a null text is empty, a null role is the empty role, a null conversation or turn number is a value of its own that comes
first.  Roles without marks of their own get a generic mark that carries the (escaped) role.  Turns with equal numbers are ordered
by role and text; repeated rows are turns like any other.  A wrong order never drops a conversation: ``valid`` tells of it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role]
    #: Roles that may follow each role; the empty name stands for the beginning.
    follows: dict[str, tuple[str, ...]]
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")


INSTRUCT = Template(
    roles={"system": Role("<s>[SYS]", "[/SYS]"), "user": Role("<s>[INST]", "[/INST]"), "assistant": Role("", "</s>", loss=True)},
    follows={"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])", r"\\$1")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row for each turn: conv_id, turn, role, place (from 0), allowed, segments (text, loss) in order.

    The text of a conversation is the concatenation of its segments.  Partitions hold whole conversations, sorted.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.withColumns({"place": F.row_number().over(order) - 1, "_last": F.coalesce(F.lag("role").over(order), F.lit(""))})
    allowed = F.lit(False)
    for last, names in template.follows.items():
        at = (F.col("place") == 0) if last == "" else (F.col("place") > 0) & (F.col("_last") == last)
        allowed = allowed | (at & F.col("role").isin(*names))

    def segments(before: Column, after: Column, loss: bool) -> Column:
        parts = ((before, False), (escape(F.col("text")), loss), (after, False))
        return F.array(*(F.struct(x.alias("text"), F.lit(flag).alias("loss")) for x, flag in parts))

    name, colon, end = template.other
    made = segments(F.concat(F.lit(name), escape(F.col("role")), F.lit(colon)), F.lit(end), False)
    for key, r in template.roles.items():
        made = F.when(F.col("role") == key, segments(F.lit(r.before), F.lit(r.after), r.loss)).otherwise(made)
    return turns.select("conv_id", "turn", "role", "place", allowed.alias("allowed"), made.alias("segments"))


def read_turns(formatted: str, template: Template = INSTRUCT) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted text, the reverse of ``format_turns``."""
    name, colon, end = template.other
    befores = {r.before: key for key, r in template.roles.items() if r.before}
    bare = next((key for key, r in template.roles.items() if not r.before), "")
    afters = {r.after for r in template.roles.values()} | {end}
    marks = "|".join(map(re.escape, sorted({*befores, *afters, name, colon}, key=len, reverse=True)))
    role, parts = bare, []
    for escaped, plain, mark in re.findall(rf"\\(.)|([^\\<\[]+)|({marks})", formatted, flags=re.S):
        if not mark:
            parts.append(escaped or plain)
        elif mark in befores:
            role = befores[mark]
        elif mark == colon:
            role, parts = "".join(parts), []
        elif mark in afters:
            yield role, "".join(parts)
            role, parts = bare, []


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digests(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Read formatted turns back and digest them, one conversation after the other with one turn in memory."""
    fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        current, state, done = none, None, []

        def close() -> None:
            if current is not none:
                n, whole, chars, loss, size, valid = state
                done.append((current, n, whole.hexdigest(), chars, loss.hexdigest(), size, valid))

        for batch in batches:
            for conv, place, allowed, segments in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                formatted = "".join(s["text"] for s in segments)
                for role, text in read_turns(formatted, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        text = unescape(s["text"])
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] = state[5] and allowed
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), fields)], schema=fields)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done), fields)], schema=fields)

    return turns.select("conv_id", "place", "allowed", "segments").mapInArrow(read_back, DIGESTS)


def op3_chat_formatting(conversations: DataFrame) -> DataFrame:
    """All conversations and one, number -1, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_turns(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, lag(role, 1, '') OVER w AS last, row_number() OVER w AS place,
             length(regexp_replace(text, '([\\<\[])', '\\\1', 'g'))
             + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 16 WHEN 'assistant' THEN 4 ELSE 16 + length(regexp_replace(role, '([\\<\[])', '\\\1', 'g')) END AS chars
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE WHEN place = 1 THEN role IN ('system', 'user') WHEN last IN ('system', 'assistant') THEN role = 'user'
                     WHEN last = 'user' THEN role = 'assistant' ELSE false END) AS valid
FROM s GROUP BY conv_id
"""
