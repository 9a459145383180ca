"""Operator 4: chat formatting with typed content parts.

A turn holds an ordered list of parts (type, text, ref, units). The visitor turns a text part into
its escaped text and an image, audio or document part into a placeholder, and records for each
attachment its reference and how many tokens the placeholder stands for. Turns are marked
`<turn role>` ... `</turn>`; inside texts a backslash becomes `\\b` and `<` becomes `\\l` (in roles
also `>` becomes `\\g`), so a text can't hold a control string and unescaping gives it back.

The output has one row for each turn; a conversation's formatted text is its pieces in order, which
spares holding a long conversation in one task. The loss mask covers text parts of assistants.

Defined cases: null text, role and parts are empty; a null conv_id is a conversation of its own;
turns are ordered with nulls first and ties by role and text; repeated rows are turns of their own;
unknown part types get a placeholder of their type's name and no tokens; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, word_count

#: Tokens that a placeholder stands for: by unit (an image, a second of audio, a page).
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 400}
PARTS = "array<struct<type:string,text:string,ref:string,units:int>>"
ROLE_TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: str) -> str:
    return text.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\")


def body_of(piece: Column) -> Column:
    """The text in a piece, unescaped: ties are ordered by it, as escapes sort otherwise than what they stand for."""
    begin = F.locate(">", piece)
    body = F.substring(piece, begin + 1, F.char_length(piece) - begin - F.lit(len("</turn>\n")))
    return F.replace(F.replace(F.replace(body, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def visit(part: Column) -> Column:
    """A part as it stands in the formatted text."""
    kind = F.coalesce(part["type"], F.lit("text"))
    mark = F.concat(F.lit("<"), F.regexp_replace(kind, r"[^A-Za-z0-9_-]", "_"), F.lit("/>"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)


def part_tokens(part: Column) -> Column:
    """Tokens that a part stands for: words of a text, units of an attachment."""
    units = F.coalesce(part["units"], F.lit(1)).cast("long")
    out = F.when(F.coalesce(part["type"], F.lit("text")) == "text", word_count(part["text"]))
    for kind, n in UNIT_TOKENS.items():
        out = out.when(part["type"] == kind, units * n)
    return out.otherwise(F.lit(0).cast("long"))


def format_turns(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text or parts) -> conv_id, turn, role, piece, spans (of the loss mask, within the piece), attachments, n_tokens."""
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts"), F.array().cast(PARTS))
    else:
        parts = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit("<turn "), F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit(">"))
    out = turns.select("conv_id", "turn", role.alias("role"), parts.alias("parts"), head.alias("head"))
    out = out.withColumn("bodies", F.transform("parts", visit))
    ends = F.transform("bodies", lambda _, i: F.char_length("head") + F.char_length(F.array_join(F.slice("bodies", 1, i + 1), "")))
    spans = F.filter(
        F.transform("parts", lambda p, i: F.struct(
            F.coalesce(p["type"], F.lit("text")).alias("type"),
            (F.get(ends, i) - F.char_length(F.get("bodies", i))).cast("long").alias("start"),
            F.get(ends, i).cast("long").alias("end"))),
        lambda s: (s["type"] == "text") & (F.col("role") == ROLE_TRAINED))
    attachments = F.filter(
        F.transform("parts", lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))),
        lambda a: F.coalesce(a["type"], F.lit("text")) != "text")
    tokens = F.aggregate(F.transform("parts", part_tokens), F.lit(0).cast("long"), lambda a, x: a + x)
    piece = F.concat("head", F.array_join("bodies", ""), F.lit("</turn>\n"))
    return out.select("conv_id", "turn", "role", piece.alias("piece"), spans.alias("spans"), attachments.alias("attachments"), tokens.alias("n_tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Parses formatted conversations again: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through a task in order, so that a conversation of any length needs little memory.
    """
    marks = re.compile(r"<turn ([^<>]*)>(.*)</turn>\n", re.DOTALL)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: dict | None = None
        for pdf in parts:
            done = []
            for conv_id, piece, starts, ends in zip(pdf["conv_id"], pdf["piece"], pdf["starts"], pdf["ends"]):
                if now is None or now["conv_id"] != conv_id:
                    if now is not None:
                        done.append(now)
                    now = {"conv_id": conv_id, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
                role, body = marks.fullmatch(piece).groups()
                now["n_turns"] += 1
                now["turns"].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                for start, end in zip(starts, ends):
                    text = unescape(piece[start:end])
                    now["loss_chars"] += len(text)
                    now["loss"].update(text.encode())
                now["formatted_chars"] += len(piece)
            if done:
                yield rows(done)
        if now is not None:
            yield rows([now])

    def rows(done: list[dict]) -> pd.DataFrame:
        digests = {f"{k}_sha256": [x[k].hexdigest() for x in done] for k in ("turns", "loss")}
        return pd.DataFrame({k: [x[k] for x in done] for k in ("conv_id", "n_turns", "loss_chars", "formatted_chars")} | digests)

    kind = formatted.schema["conv_id"].dataType
    in_order = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", body_of(F.col("piece")))
    narrow = in_order.select(F.col("conv_id").cast("string"), "piece", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    out = narrow.mapInPandas(read, "conv_id string, n_turns long, loss_chars long, formatted_chars long, turns_sha256 string, loss_sha256 string")
    return out.withColumn("conv_id", F.col("conv_id").cast(kind))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation and a probe, read back from the formatted turns; null texts are empty, turns that tie go by role and text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    return read_back(format_turns(turns.unionByName(probe)))


#: Turns are marked <turn role>...</turn> and a newline; `\` counts twice and `<` too, in roles also `>`.
OP4_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(text) + 2 * length(text) - length(replace(text, '\', '')) - length(replace(text, '<', '')) AS body,
  length(role) + 3 * length(role) - length(replace(role, '\', '')) - length(replace(role, '<', '')) - length(replace(role, '>', '')) AS head FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(6 + head + 1 + body + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
