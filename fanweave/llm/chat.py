"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn is a list of typed parts (text, image, audio, document). ``visit`` walks the parts in order:
text is escaped, every other part becomes a placeholder, its reference is recorded, and its expanded
token count (what a model will put in the placeholder's place) is added up. A turn is written as
``<s>role\\ntext</s>``; a conversation is its turns put together in order. The loss mask is a list
of code-point spans over that text: one span for each assistant turn.

Escapes are reversible: a backslash becomes ``\\b`` and ``\\e`` breaks every control string after
its first character, so no control string of a text survives in the output.

Defined results: null text or role is empty; null reference is empty; parts of another type are
written as their text; turns with one number are ordered by role, then text; null turns come first;
rows of null conversation id are one conversation; repeated rows are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanweave.llm.common import materialize

TRAINED_ROLE = "assistant"
OPEN, CLOSE = "<s>", "</s>"
# Control strings that must not occur inside a text: first character, rest as a pattern.
CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|\|(?:image|audio|document)\|>)"
IMAGE_PATCH = 28                 # pixels: one token per started square of this side
AUDIO_TOKENS_PER_SECOND = 25
DOCUMENT_TOKENS_PER_PAGE = 512

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\b")), CONTROL, r"$1\\e$2")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\e"), F.lit("")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """One text part, as an array of parts."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))


def _field(part: Column, name: str, fields: set[str], default) -> Column:
    return F.coalesce(part[name], F.lit(default)) if name in fields else F.lit(default)


def visit(parts: Column, fields: set[str]) -> Column:
    """Visit an array of parts: struct(content, refs, expanded_tokens).

    ``fields`` names the fields that the part struct has; absent ones count as null."""
    other = ("image", "audio", "document")

    def content(p: Column) -> Column:
        kind = p["type"]
        return F.when(kind.isin(*other), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(
            escape(_field(p, "text", fields, "")))

    def tokens(p: Column) -> Column:
        squares = lambda n: F.ceil(_field(p, n, fields, 0) / F.lit(IMAGE_PATCH))
        return (F.when(p["type"] == "image", squares("width") * squares("height"))
                .when(p["type"] == "audio",
                      F.ceil(_field(p, "seconds", fields, 0.0) * AUDIO_TOKENS_PER_SECOND))
                .when(p["type"] == "document",
                      _field(p, "pages", fields, 0) * DOCUMENT_TOKENS_PER_PAGE)
                .otherwise(0).cast("long"))

    attached = F.filter(parts, lambda p: p["type"].isin(*other))
    return F.struct(
        F.coalesce(F.array_join(F.transform(parts, content), ""), F.lit("")).alias("content"),
        F.coalesce(F.transform(attached, lambda p: F.struct(
            p["type"].alias("type"), _field(p, "ref", fields, "").alias("ref"),
            tokens(p).alias("tokens"))),
            F.expr("cast(array() as array<struct<type:string,ref:string,tokens:bigint>>)"))
        .alias("attachments"))


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> one row per conversation: formatted text, loss mask,
    attachments in order, expanded tokens.

    One shuffle by conversation; offsets come from a running sum over the sorted turns."""
    fields = set(turns.schema["parts"].dataType.elementType.fieldNames())
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit("\\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"),
                        visit(F.col("parts"), fields).alias("v"))
    rows = rows.select("conv_id", "turn", "role", F.col("v.content").alias("content"),
                       F.col("v.attachments").alias("attachments"))
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn(
        "piece", F.concat("head", "content", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.sum(F.length("piece").cast("long")).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    rows = (rows.withColumn("nth", F.row_number().over(order))
            .withColumn("start", F.coalesce(before, F.lit(0)) + F.length("head")))
    span = F.when(F.col("role") == TRAINED_ROLE, F.struct(
        F.col("start"), F.length("content").cast("long").alias("length")))
    grouped = rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "piece", span.alias("span"), "attachments")))
        .alias("turns"))
    attachments = F.flatten(F.transform("turns", lambda t: t["attachments"]))
    return grouped.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull())
        .alias("loss_mask"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
        .alias("expanded_tokens"))


def parse(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p.startswith(OPEN))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.replace(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), "\n", 1),
                           F.lit("\\n"), F.lit("\n"))).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")))


def masked_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, in order, unescaped."""
    return F.transform(loss_mask, lambda s: unescape(
        F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def formatted_conversations(conversations: DataFrame, name: str = "chat") -> DataFrame:
    """Format text conversations (conv_id, turn, role, text), write the result, read it back."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        text_part(F.col("text").cast("string")).alias("parts"))
    return materialize(format_turns(turns), name)
