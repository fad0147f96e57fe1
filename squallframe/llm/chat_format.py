"""Chat formatting from typed content parts, in DataFrame functions only.

A turn holds parts (text, image, audio, document). A visitor over the parts flattens them, in
order, into one text: text parts are escaped, other parts become one placeholder each whose
attachment is recorded with the tokens it will expand to.

Template, one turn after another: ``<|im_start|>`` role ``\\n`` content ``<|im_end|>\\n``.
Inside texts every ``<`` caret* ``|`` gets one caret more, so no control string survives in a
text, and taking one caret away restores it exactly. Roles also have backslash and line feed escaped.

Defined results: null text, role or parts count as empty, parts of unknown kind are written as
text; null conversation ids form one conversation; turns that tie are ordered by role, then
content; a conversation needs at least one row, so an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens an attachment expands to: image patches, audio frames, tokens of a page.
PATCH, FRAMES_PER_SECOND, TOKENS_PER_PAGE = 14, 25.0, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\^*)\|", r"<^$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\^(\^*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``; a pair of backslashes is set aside while ``\\n`` is read."""
    pieces = F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(pieces, "\\"))


def text_part(text: Column) -> Column:
    """A turn's plain text as the one part of its content."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def visit_text(part: Column) -> Column:
    """What a part writes: an escaped text, or the placeholder of its kind."""
    written = escape(F.coalesce(part["text"], F.lit("")))
    for kind, mark in PLACEHOLDERS.items():
        written = F.when(part["kind"] == kind, F.lit(mark)).otherwise(written)
    return F.coalesce(written, F.lit(""))


def visit_tokens(part: Column) -> Column:
    """Tokens a part expands to beyond its text; at least one for an attachment."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / F.lit(PATCH))
    count = (F.when(part["kind"] == "image", side("width") * side("height"))
             .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * FRAMES_PER_SECOND))
             .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * TOKENS_PER_PAGE))
    return F.when(count.isNotNull(), F.greatest(count, F.lit(1))).otherwise(0).cast("long")


def flatten_turns(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Per row: ``content`` (flat text), ``attachments`` in order and ``expanded_tokens``."""
    own = F.filter(F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    files = F.filter(own, lambda p: F.coalesce(p["kind"].isin(*PLACEHOLDERS), F.lit(False)))
    return (df.withColumn("__own", own).withColumn("__files", files)
            .withColumn("content", F.array_join(F.transform("__own", visit_text), ""))
            .withColumn("attachments", F.transform("__files", lambda p: F.struct(
                p["kind"].alias("kind"), p["ref"].alias("ref"), visit_tokens(p).alias("tokens"))))
            .withColumn("expanded_tokens", F.aggregate(
                F.transform("__files", visit_tokens), F.lit(0).cast("long"), lambda a, x: a + x))
            .drop("__own", "__files"))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 parts: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans``, ``attachments``, ``expanded_tokens``.

    ``loss_spans`` are code point ranges of ``formatted`` that hold the trained role's contents.
    A conversation becomes one string, so its own turns meet in one task, and no more than them.
    """
    names = {conv: "__conv", turn: "__turn", role: "__role", parts: "__parts"}
    flat = flatten_turns(df.select(*[F.col(c).alias(n) for c, n in names.items()]), "__parts")
    head = F.concat(F.lit(START), escape_role(F.coalesce("__role", F.lit(""))), F.lit("\n"))
    rows = flat.select(
        F.col("__conv").alias(conv),
        F.struct(F.col("__turn").alias("turn"), F.coalesce("__role", F.lit("")).alias("role"),
                 F.col("content"), F.col("attachments"), F.col("expanded_tokens"), head.alias("head")).alias("t"))
    grouped = rows.groupBy(conv).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    step = lambda a, t: F.struct(
        (a["at"] + F.length(t["head"]) + F.length(t["content"]) + len(END)).alias("at"),
        F.when(t["role"] == trained_role, F.concat(a["spans"], F.array(F.struct(
            (a["at"] + F.length(t["head"])).alias("start"),
            (a["at"] + F.length(t["head"]) + F.length(t["content"])).alias("end")))))
        .otherwise(a["spans"]).alias("spans"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return grouped.select(
        conv,
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", empty, step, lambda a: a["spans"]).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["expanded_tokens"]).alias("expanded_tokens"))


def parse_turns(formatted: Column) -> Column:
    """Read a formatted conversation back: array of (role, text), both unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    return F.transform(turns, lambda p: F.struct(
        unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape(F.regexp_replace(body(p), r"^[^\n]*\n", "")).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")

