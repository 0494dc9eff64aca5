"""Chat formatting over typed content parts.

A message holds parts ``struct(type, text, ref, units)``. A visitor turns each part, in order, into text: a text part is escaped,
an image, audio or document part becomes a numbered placeholder and an attachment record with the tokens it expands to.
Turns are marked ``<|im_start|>role`` newline content ``<|im_end|>`` newline.

Escapes are reversible: a backslash becomes ``\\b``, ``<|`` becomes ``\\l`` and, in roles, a newline becomes ``\\n``. So no marker
can come from a text. The loss mask is a list of spans (turn, start, length in characters), one for each assistant turn; starts count
inside the marked turn, so the text of a long conversation is read back in one pass.

Rows are ordered by (turn, role, text); null turns come first. Null texts, roles and parts are empty; a part of an unknown
type is kept as a text placeholder of its type. Repeated rows are repeated turns. No rows give no conversations. One formatted
conversation is one value, so its turns meet in one task; different conversations spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"
#: Tokens that one unit of an attachment expands to: image tiles, audio seconds, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 1024}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def text_parts(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units")))


def _tokens(part: Column) -> Column:
    per = F.lit(0).cast("long")
    for kind, tokens in TOKENS_PER_UNIT.items():
        per = F.when(part["type"] == kind, F.lit(tokens).cast("long")).otherwise(per)
    return per * F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(1))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit_text(parts: Column) -> Column:
    """The text that stands for the parts; placeholders are numbered inside their message."""

    def visit(part, i):
        label = F.concat(F.lit("<|"), escape_role(part["type"]), F.lit(":"), i.cast("string"), F.lit("|>"))
        return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(label)

    return F.array_join(F.transform(parts, visit), "")


def visit_attachments(parts: Column) -> Column:
    """References in the order of their placeholders: part number, kind, reference, expanded tokens."""
    numbered = F.transform(parts, lambda p, i: F.struct(
        i.cast("long").alias("part"), p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.filter(numbered, lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")


def format_conversations(messages: DataFrame, content: str = "content") -> DataFrame:
    """conv_id, formatted, loss (array of spans), n_turns, attachments (turn, part, kind, ref, tokens), attachment_tokens."""
    parts = F.coalesce(F.filter(F.col(content), lambda p: p.isNotNull()), F.lit(None).cast(PARTS), F.array().cast(PARTS))
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = messages.select(
        "conv_id", F.struct(
            F.col("turn").alias("turn"), role.alias("role"), visit_text(parts).alias("body"), visit_attachments(parts).alias("files"),
        ).alias("message"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("message")).alias("m"))
    laid = grouped.withColumn("heads", F.transform("m", lambda m: F.concat(F.lit(START), escape_role(m["role"]), F.lit("\n"))))
    spans = F.filter(F.transform("m", lambda m, i: F.struct(
        i.cast("long").alias("turn"), F.length(F.element_at("heads", i + 1)).cast("long").alias("start"),
        F.length(m["body"]).cast("long").alias("length"), m["role"].alias("role"))), lambda s: s["role"] == "assistant")
    files = F.flatten(F.transform("m", lambda m, i: F.transform(m["files"], lambda f: F.struct(
        i.cast("long").alias("turn"), f["part"].alias("part"), f["kind"].alias("kind"), f["ref"].alias("ref"), f["tokens"].alias("tokens")))))
    return laid.select(
        "conv_id",
        F.array_join(F.transform("m", lambda m, i: F.concat(F.element_at("heads", i + 1), m["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        F.size("m").cast("long").alias("n_turns"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"]).alias("attachment_tokens"),
    )


def turn_pieces(formatted: Column) -> Column:
    """The marked turns of a formatted conversation, in order. Markers can't come from texts, so cutting at them is exact."""
    return F.transform(F.filter(F.split(formatted, "<\\|im_start\\|>"), lambda _, i: i > 0), lambda p: F.concat(F.lit(START), p))


def read_turns(pieces: Column) -> Column:
    """Turns (role, text) read back from the pieces of a formatted conversation."""

    def turn(piece):
        at = F.locate("\n", piece)
        head = len(START)
        body = F.substring(piece, at + F.lit(1), F.length(piece) - at - F.lit(len(END)))
        return F.struct(unescape_role(F.substring(piece, F.lit(head + 1), at - F.lit(head + 1))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(pieces: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(
        F.element_at(pieces, (s["turn"] + 1).cast("int")), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_digest(formatted: DataFrame) -> DataFrame:
    back = formatted.withColumn("_pieces", turn_pieces(F.col("formatted")))
    back = back.withColumn("_turns", read_turns(F.col("_pieces"))).withColumn("_loss", loss_text(F.col("_pieces"), F.col("loss")))
    lines = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "attachment_tokens")
