"""Chat formatting with a grammar that is read back.

A conversation is the concatenation of its turns:

    turn := "### " role ": " body NEWLINE "</turn>" NEWLINE
    role := "System" | "User" | "Assistant" | "Other " JSON-string

``### role:`` and ``</turn>`` are the control strings. One that follows a
backslash is text, and the parser removes one backslash from it. A turn is
rendered as it is, parsed, and compared with its source; as long as they
differ, its control strings get one backslash more. As every rendered turn
parses as exactly one turn, the concatenation parses as the conversation.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread

#: Roles of the tables and how the template writes them.
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
END = "\n</turn>\n"

_CONTROL = r"### (?:System|User|Assistant|Other \"(?:[^\"\\]|\\.)*\"):|</turn>"
_FOUND = re.compile(rf"(\\*)({_CONTROL})")
_HEAD = re.compile(r"### (System|User|Assistant|Other (\"(?:[^\"\\]|\\.)*\")): ")
_NAMES = {v: k for k, v in ROLES.items()}


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _FOUND.sub(r"\\\1\2", text)


def unescape(body: str) -> str:
    return _FOUND.sub(lambda m: m[0][1:] if m[1] else m[0], body)


def _other(role: str) -> str:
    """A role in quotes, without characters that could make a control string."""
    return "Other " + json.dumps(role).replace("<", "\\u003c").replace("#", "\\u0023")


def render_turn(role: str, body: str) -> str:
    return f"### {ROLES.get(role) or _other(role)}: {body}{END}"


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, body) of each turn; the body is as written. Raises GrammarError for anything else."""
    turns, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if not head:
            raise GrammarError(f"no turn begins at {at}")
        end = next((m for m in _FOUND.finditer(rendered, head.end()) if not m[1]), None)
        if not end or end[2] != "</turn>" or rendered[end.start() - 1 : end.end() + 1] != END or end.start() <= head.end() - 1:
            raise GrammarError(f"the turn at {at} does not end")
        body = rendered[head.end() : end.start() - 1] if end.start() - 1 >= head.end() else None
        if body is None:
            raise GrammarError(f"the turn at {at} does not end")
        turns.append((_NAMES[head[1]] if not head[2] else json.loads(head[2]), body))
        at = end.end() + 1
    return turns


def format_turn(role: str, text: str) -> str:
    """The rendered turn that parses as exactly this one."""
    body = text
    for _ in range(3):
        rendered = render_turn(role, body)
        try:
            back = parse(rendered)
        except GrammarError:
            back = []
        if len(back) == 1 and back[0][0] == role and unescape(back[0][1]) == text:
            return rendered
        body = escape(body)
    raise GrammarError("a turn can't be written")  # unreachable: one escape suffices


RENDERED = "conv_id bigint, turn bigint, place bigint, formatted string, loss_start int, loss_length int"


def _ordered(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def format_turns(conversations: DataFrame) -> DataFrame:
    """Render every row alone: ``(conv_id, turn, formatted, loss_start, loss_length)``, without a shuffle.

    The loss mask is a span of ``formatted`` in code points; it covers an
    assistant's body and is empty for other roles. Null roles and texts are
    empty. Rows, repeated ones too, are kept one for one; other columns aren't
    read; an empty table gives an empty result.
    """

    def render(batches):
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            out = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            start = [x.index(": ") + 2 if r == "assistant" else 0 for r, x in zip(roles, out, strict=True)]
            span = [len(x) - s - len(END) if r == "assistant" else 0 for r, x, s in zip(roles, out, start, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(out, pa.string()), pa.array(start, pa.int32()), pa.array(span, pa.int32())], ["conv_id", "turn", "formatted", "loss_start", "loss_length"])

    return _ordered(conversations).mapInArrow(render, "conv_id bigint, turn bigint, formatted string, loss_start int, loss_length int")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``(conv_id, formatted)``: each conversation as one training text, for conversations that fit in a row."""
    turns = format_turns(conversations)
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "formatted"))), lambda x: x["formatted"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from formatted turns.

    Turns stand in the order of ``turn`` (null first), then of their text.
    A task reads its conversations row by row and keeps only running hashes,
    so a conversation of any length needs no more memory than one turn.
    """

    def digest(batches):
        held: dict = {}
        now: list = []

        def close():
            held.setdefault("rows", []).append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def table():
            rows = held.pop("rows", [])
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")]
            for conv, text, start, length in zip(*cols, strict=True):
                if not now or now[0] != conv:
                    if now:
                        close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{unescape(body)}\n".encode())
                loss = unescape(text[start : start + length])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(text)
            if len(held.get("rows", ())) >= 5000:
                yield table()
        if now:
            close()
        yield table()

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: The additional conversation of the query.
PROBE = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: all conversations and the probe, formatted and read back."""
    rows = _ordered(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(format_turns(rows.unionByName(probe)))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length('### : ') + length(role) + length(regexp_replace(text, '(\\*(?:### (?:System|User|Assistant):|</turn>))', '\\\1', 'g')) + length('</turn>') + 2 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
