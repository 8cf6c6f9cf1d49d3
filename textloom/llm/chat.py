r"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is a role and an ordered list of parts of type text, image, audio or document.  A visitor flattens the parts:
text is escaped, each other part becomes a placeholder with its number in the turn, its reference goes to a list of
attachments, and the tokens that the placeholder stands for are counted.  Turns stay rows, with their place
in the formatted conversation and the span of the loss mask, so that a long conversation is one value nowhere but
where its digest needs that.

Template: ``<|turn|>`` role ``<|text|>`` body ``<|end|>``.  Inside roles and texts a backslash is put after each
backslash and after the first character of each control string (``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``),
so no control string is left; ``unescape`` takes exactly those backslashes out again.

A conversation's turns meet in one task when they are numbered and when they are digested: its texts must fit there, and in one value
of 2 GB.  No text is joined to a longer value before that.

Edge cases: null role or text is empty; turns with equal numbers are ordered by role and text; a null conversation id
is a conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
#: Tokens that a placeholder stands for: an image tile of 28 x 28 pixels, a second of audio, a page of a document.
TILE, PER_SECOND, PER_PAGE = 28, 25, 768
_ESCAPE = r"\\|<(?=\||/?s>)|\[(?=/?INST\])"
_UNESCAPE = r"([<\[\\])\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    null = F.lit(None)
    fields = {"width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            null.cast("string").alias("ref"),
            *[null.cast(k).alias(c) for c, k in fields.items()],
        )
    )


def part_tokens(part: Column) -> Column:
    """Tokens that a part other than text is expanded to."""
    n = lambda c: F.coalesce(part[c], F.lit(0))
    tiles = F.ceil(n("width") / TILE) * F.ceil(n("height") / TILE)
    return (
        F.when(part["type"] == "image", tiles)
        .when(part["type"] == "audio", F.ceil(n("seconds") * PER_SECOND))
        .when(part["type"] == "document", n("pages") * PER_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def body(parts: Column) -> Column:
    """The flattened parts in order: escaped texts and numbered placeholders."""
    visit = lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), escape(p["type"]), F.lit(":"), i.cast("string"), F.lit("|>"))
    )
    return F.array_join(F.transform(parts, visit), "")


def attachments(parts: Column) -> Column:
    """``array<struct<part, type, ref, tokens>>`` of the parts other than text."""
    number = F.transform(
        parts,
        lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")),
    )
    return F.filter(number, lambda a: F.coalesce(a["type"], F.lit("text")) != "text")


def format_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """The formatted turns: ``conv_id, turn_ix, segment, start, loss_start, loss_chars, attachments, attachment_tokens``.

    ``segment`` are the turn's characters and ``start`` their place in the conversation (code points); the loss mask of
    an assistant turn is its body, as a place in the conversation and a length (null and 0 for others).
    """
    content = rows[parts].cast(PART) if parts else text_parts(rows[text])
    flat = rows.select(
        rows[conv].alias("conv_id"),
        rows[turn].alias("tl_turn"),
        F.coalesce(rows[role], F.lit("")).alias("tl_role"),
        F.coalesce(content, F.array().cast(PART)).alias("tl_parts"),
    )
    flat = flat.withColumns(
        {"tl_body": body(F.col("tl_parts")), "tl_head": F.concat(F.lit(TURN), escape(F.col("tl_role")), F.lit(TEXT)), "attachments": attachments(F.col("tl_parts"))}
    )
    flat = flat.withColumn("segment", F.concat("tl_head", "tl_body", F.lit(END)))
    plain = F.array_join(F.transform("tl_parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = Window.partitionBy("conv_id").orderBy("tl_turn", "tl_role", plain, "tl_body")
    start = F.coalesce(F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mine = F.col("tl_role") == "assistant"
    return flat.withColumns({"turn_ix": F.row_number().over(order).cast("long"), "start": start}).select(
        "conv_id",
        "turn_ix",
        "segment",
        "start",
        F.when(mine, F.col("start") + F.length("tl_head")).alias("loss_start"),
        F.when(mine, F.length("tl_body")).otherwise(0).cast("long").alias("loss_chars"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, turn_ix, role, text, loss_text`` parsed back from the segments and the loss mask."""
    inner = F.col("segment").substr(F.lit(len(TURN) + 1), F.length("segment") - len(TURN) - len(END))
    at = F.instr(F.col("tl_inner"), TEXT)
    loss = F.col("segment").substr((F.col("loss_start") - F.col("start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    return formatted.withColumn("tl_inner", inner).select(
        "conv_id",
        "turn_ix",
        unescape(F.col("tl_inner").substr(F.lit(1), at - 1)).alias("role"),
        unescape(F.col("tl_inner").substr(at + len(TEXT), F.length("tl_inner"))).alias("text"),
        F.coalesce(unescape(loss), F.lit("")).alias("loss_text"),
        F.length("segment").cast("long").alias("chars"),
    )


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from the formatted turns."""
    turns = read_turns(formatted)
    piece = F.struct("turn_ix", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("whole"), "loss_text")
    joined = lambda c: F.array_join(F.transform("tl_turns", lambda t: t[c]), "")
    grouped = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(piece)).alias("tl_turns"), F.sum("chars").alias("formatted_chars")
    )
    read = grouped.withColumns({"tl_whole": joined("whole"), "tl_loss": joined("loss_text")})
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("tl_whole", 256).alias("turns_sha256"),
        F.length("tl_loss").cast("long").alias("loss_chars"),
        F.sha2("tl_loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def flatten_conversation(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask, attachments, attachment_tokens``: each conversation as one string."""
    piece = F.struct("turn_ix", "segment", "loss_start", "loss_chars", "attachments")
    grouped = formatted.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("tl_turns"), F.sum("attachment_tokens").alias("attachment_tokens"))
    spans = F.filter(F.transform("tl_turns", lambda t: F.struct(t["loss_start"].alias("start"), t["loss_chars"].alias("chars"))), lambda s: s["start"].isNotNull())
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("tl_turns", lambda t: t["segment"]), "").alias("formatted"),
        spans.alias("loss_mask"),
        F.flatten(F.transform("tl_turns", lambda t: t["attachments"])).alias("attachments"),
        "attachment_tokens",
    )
