"""The access gate: which reads of images and documents pass, and which are answered with redacted text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.tokens import extension
from textloom.sources.files import EXTENSIONS

#: Pages above which a document is read as it is, seconds an allowance lasts.
MANY_PAGES, ALLOWED_SECONDS = 20, 300


def alternative(path: Column) -> Column:
    """The path without a leading ``/private``, which names the same file."""
    return F.regexp_replace(path, F.lit("^/private(?=/)"), F.lit(""))


def session_name(session: Column) -> Column:
    """A session id fit for a file name."""
    return F.regexp_replace(F.coalesce(session, F.lit("nosession")), F.lit(r"[^A-Za-z0-9._\n-]"), F.lit("_"))


def read_event(event: Column) -> dict[str, Column]:
    """Path, pages and session of a hook's JSON event."""
    get = lambda p: F.get_json_object(event, p)
    return {"path": get("$.tool_input.file_path"), "pages": get("$.tool_input.pages"), "session_id": session_name(get("$.session_id"))}


def gated(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*EXTENSIONS), F.lit(False))


def consume(reads: DataFrame, allow: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Reads (``seq, path``) with ``allowed``, and the allowances left (``expiry, path, seq``).

    Expired allowances are dropped.  In order of ``seq`` a read uses up the first live one for its path; a read with
    ``/private`` in front also uses one without it, but not the other way round.  Only one file's reads and allowances meet in a task.
    """
    live = allow.filter(F.col("expiry") >= now)
    name = lambda df: df.groupBy(F.coalesce(alternative(F.col("path")), F.lit("")))
    used = name(reads.select("seq", "path")).cogroup(name(live.select("path", F.col("seq").alias("of")))).applyInPandas(_matched, "seq long, of long")
    by_read = used.select(F.col("seq").alias("tl_seq"))
    out = reads.join(by_read, reads["seq"] == by_read["tl_seq"], "left").withColumn("allowed", F.col("tl_seq").isNotNull()).drop("tl_seq")
    left = live.join(used.select(F.col("of").alias("tl_of")), live["seq"] == F.col("tl_of"), "left_anti")
    return out, left.select("expiry", "path", "seq")


def _matched(reads: pd.DataFrame, live: pd.DataFrame) -> pd.DataFrame:
    """Reads of a file with the allowances that they use up."""
    rest = list(live.sort_values("of").itertuples(index=False))
    out = []
    for r in reads.sort_values("seq").itertuples(index=False):
        names = {r.path, r.path.removeprefix("/private") if r.path and r.path.startswith("/private/") else r.path}
        hit = next((a for a in rest if a.path in names), None)
        if hit is not None:
            rest.remove(hit)
            out.append((r.seq, hit.of))
    return pd.DataFrame(out, columns=["seq", "of"])


def decide(reads: DataFrame) -> DataFrame:
    """Adds ``decision`` and ``message`` to reads.

    Reads are ``path, pages, passthrough, available, allowed, page_count, exit_code, text, image_tokens, text_tokens``;
    ``page_count`` null means that it couldn't be told, ``exit_code`` null that the output couldn't be read.
    """
    path, pdf = F.col("path"), extension(F.col("path")) == "pdf"
    unasked = pdf & (F.coalesce("pages", F.lit("")) == "")
    tokens = F.format_string("%d image tokens -> %d text tokens. For the pixels, allow %s and read again.", "image_tokens", "text_tokens", path)
    rules: list[tuple[Column, str, Column]] = [
        (path.isNull() | (path == "") | ~gated(path), "pass", F.lit(None).cast("string")),
        (F.coalesce("passthrough", F.lit(False)), "pass", F.lit(None).cast("string")),
        (~F.col("available"), "pass", F.concat(F.lit("recogniser not found, reading as pixels: "), path)),
        (F.col("allowed"), "pass", F.lit(None).cast("string")),
        (unasked & F.col("page_count").isNull(), "pass", F.lit(None).cast("string")),
        (unasked & (F.col("page_count") > MANY_PAGES), "pass", F.format_string("%s has %d pages, reading it as it is", path, F.col("page_count").cast("int"))),
        (F.col("exit_code").isNull(), "pass", F.concat(F.lit("unreadable output, reading as pixels: "), path)),
        (F.col("exit_code") != 0, "pass", F.format_string("could not read %s (exit %d), reading it as pixels", path, "exit_code")),
        (F.coalesce("text", F.lit("")) == "", "pass", F.concat(F.lit("no text, reading as pixels: "), path)),
    ]
    decision, message = F, F
    for condition, word, said in rules:
        decision, message = decision.when(condition, word), message.when(condition, said)
    return reads.withColumns({"decision": decision.otherwise("deny"), "message": message.otherwise(tokens)})


def refuse_long(documents: DataFrame, most: int = MANY_PAGES) -> DataFrame:
    """``path, page_count, error`` of documents with too many pages for one answer."""
    many = F.format_string("%s has %d pages; ask for a range of at most %d", F.col("path"), F.col("page_count").cast("int"), F.lit(most))
    return documents.filter(F.col("page_count") > most).select("path", "page_count", many.alias("error"))


def hints(reads: DataFrame) -> DataFrame:
    """One missing-recogniser hint a session: that of its first read."""
    first = Window.partitionBy("session_id").orderBy("seq")
    return reads.filter(~F.col("available")).withColumn("tl_k", F.row_number().over(first)).filter("tl_k = 1").drop("tl_k")
