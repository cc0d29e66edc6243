"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor takes each turn's parts in order: text is escaped, image, audio and document parts become
placeholders, and their references and expanded token counts are recorded. A turn is written as
``<|role|>body<|end|>``. In texts and roles the characters of ``GUARDED`` are followed by a
backslash, so no control string (these, ``</s>``, ``[INST]`` and the like) can stand in a text, and
taking those backslashes away gives the text back. The loss mask has a span, in characters of the
output, for each assistant turn.

Defined cases: null texts are empty, null roles are empty, null types are text; turns that tie are
ordered by role, then content; a null turn comes first; rows with a null conv_id are one
conversation; a part of an unknown type is a document; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm import common

GUARDED = "<[\\|"
_CLASS = "[<\\[\\\\|]"
OPEN, SHUT, END = "<|", "|>", "<|end|>"
#: Expanded tokens of an attachment: a fixed part, and for each unit (image tiles, seconds of audio, pages).
TOKENS = {"image": (85, 170.0), "audio": (4, 25.0), "document": (2, 512.0)}
PART = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CLASS})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"({_CLASS})\\\\", "$1")


def text_part(text: Column) -> Column:
    """The content of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))).cast(PART)


def _kind(part: Column) -> Column:
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    return F.when(kind.isin("text", *TOKENS), kind).otherwise("document")


def _shown(part: Column) -> Column:
    return F.when(_kind(part) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit(OPEN), _kind(part), F.lit(SHUT)))


def _expanded(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (fixed, each) in TOKENS.items():
        out = F.when(_kind(part) == kind, (F.lit(fixed) + F.ceil(F.coalesce(part["units"], F.lit(0.0)) * each)).cast("long")).otherwise(out)
    return out


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_mask (a span or null for each turn), attachments and attachment_tokens of ``turns`` (conv_id, turn, role, content: PART)."""
    role = F.coalesce("role", F.lit(""))
    head = F.concat(F.lit(OPEN), escape(role), F.lit(SHUT))
    body = F.array_join(F.transform(F.coalesce("content", F.array().cast(PART)), _shown), "")
    order = Window.partitionBy("conv_id").orderBy("turn", "_role", F.to_json("content"))
    rows = turns.select("conv_id", "turn", role.alias("_role"), "content", head.alias("_head"), body.alias("_body")).withColumn("_segment", F.concat("_head", "_body", F.lit(END)))
    placed = rows.withColumn("_at", F.row_number().over(order)).withColumn("_before", F.coalesce(F.sum(F.length("_segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    span = F.when(F.col("_role") == loss_role, F.struct((F.col("_before") + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length")))
    found = F.filter(F.transform(F.coalesce("content", F.array().cast(PART)), lambda p, i: F.struct(i.alias("part"), _kind(p).alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"))), lambda x: x["type"] != "text")
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("_at", F.col("_segment").alias("segment"), span.alias("span"), found.alias("found")))).alias("_t"))
    attached = F.flatten(F.transform("_t", lambda t: F.transform(t["found"], lambda a: F.struct(t["_at"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return grouped.select(
        "conv_id",
        F.size("_t").cast("long").alias("n_turns"),
        F.array_join(F.transform("_t", lambda t: t["segment"]), "").alias("formatted"),
        F.transform("_t", lambda t: t["span"]).alias("loss_mask"),
        attached.alias("attachments"),
    ).withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: DataFrame) -> DataFrame:
    """Adds ``turns``: role, text and whether it is under the loss mask, read from ``formatted`` and ``loss_mask`` alone."""
    parts = F.split("formatted", "<\\|end\\|>", -1)
    segments = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    placeholders = "<\\|(" + "|".join(TOKENS) + ")\\|>"

    def turn(s: Column, i: Column) -> Column:
        head = F.substring_index(s, SHUT, 1)
        body = F.substr(s, F.length(head) + 3)
        return F.struct(unescape(F.substr(head, F.lit(3))).alias("role"), unescape(F.regexp_replace(body, placeholders, "")).alias("text"), F.get("loss_mask", i).isNotNull().alias("loss"))

    return formatted.withColumn("turns", F.transform(segments, turn))


def loss_text(formatted: Column, loss_mask: Column) -> Column:
    """The text under the loss mask: the spans cut out of ``formatted``, unescaped and without placeholders, nothing between."""
    placeholders = "<\\|(" + "|".join(TOKENS) + ")\\|>"
    spans = F.filter(loss_mask, lambda s: s.isNotNull())
    return F.array_join(F.transform(spans, lambda s: unescape(F.regexp_replace(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), placeholders, ""))), "")


def chat_query(spark, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("x.*")
    every = turns.unionByName(extra).select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("content"))
    back = read_turns(format_chats(every))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = loss_text(F.col("formatted"), F.col("loss_mask"))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "attachment_tokens")


ORACLE_SQL = """
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^<\\[\\\\|]', '', 'g')) + length(text) + length(regexp_replace(text, '[^<\\[\\\\|]', '', 'g')) + 11 AS n FROM every)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, 0::BIGINT AS attachment_tokens
FROM sized GROUP BY conv_id
"""
