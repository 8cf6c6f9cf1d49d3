"""Result envelopes: line arrays, JSON, plain text and the statistics line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import base_name, percent, saved_tokens
from textloom.operators.geometry import corners
from textloom.operators.redact import redacted_state
from textloom.operators.rules import BUILTIN, Rule

VERSION = "1.0"


def line_array(lines: DataFrame, key: str | Sequence[str] = "doc_id", rules: Sequence[Rule] | None = BUILTIN, more: Sequence[Column] = ()) -> DataFrame:
    """``key, lines``: numbered lines with redacted text, integer box and confidence; ``more`` are named aggregates of the same lines.

    Lines are redacted joined and split again; where a rule ate a line end and the numbers differ, one by one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    item = F.struct("n", "text", corners(*[F.col(c) for c in ("x", "y", "w", "h")]).alias("bbox"), F.col("confidence").cast("double").alias("confidence"))
    docs = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("lines"), *more)
    if rules is None:
        return docs
    whole = F.array_join(F.transform("lines", lambda i: i["text"]), "\n")
    docs = docs.withColumn("tl_joined", F.split(redacted_state(whole, rules)["t"], "\n", -1))
    each = F.transform("lines", lambda i: redacted_state(i["text"], rules)["t"])
    docs = docs.withColumn("tl_joined", F.when(F.size("tl_joined") == F.size("lines"), F.col("tl_joined")).otherwise(each))
    merged = F.zip_with("lines", "tl_joined", lambda i, t: F.struct(i["n"].alias("n"), t.alias("text"), i["bbox"].alias("bbox"), i["confidence"].alias("confidence")))
    return docs.withColumn("lines", merged).drop("tl_joined")


def envelope(results: DataFrame, order: str | None = None) -> DataFrame:
    """One row, ``payload``: JSON with sorted keys of all results and their token totals."""
    fields = sorted(c for c in results.columns if c != order)
    item = F.struct(*([F.col(order).alias("tl_order")] if order else []), F.struct(*fields).alias("r"))
    token = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) if c in fields else F.lit(0).cast("long").alias(c)
    place = lambda r: r["tl_order"]  # noqa: E731  maps in results have no order
    before = lambda x, y: F.when(place(x) < place(y), -1).when(place(x) > place(y), 1).otherwise(0)
    all_rows = F.array_sort(F.collect_list(item), before) if order else F.collect_list(item)
    one = results.agg(token("image_tokens"), F.transform(all_rows, lambda i: i["r"]).alias("results"), token("text_tokens"))
    return one.select(F.to_json(F.struct("image_tokens", "results", "text_tokens", F.lit(VERSION).alias("version")), {"pretty": "true"}).alias("payload"))


def plain_output(results: DataFrame, many: bool) -> DataFrame:
    """``file, output``: the text, under a line with the file's name if there are several."""
    head = F.concat(F.lit("== "), base_name(F.col("file")), F.lit("\n")) if many else F.lit("")
    return results.filter(F.col("text").isNotNull()).select("file", F.concat(head, "text", F.lit("\n")).alias("output"))


def stats_line(totals: DataFrame, noun: str) -> DataFrame:
    """``line`` of run totals (``inputs, image_tokens, text_tokens``)."""
    saved = saved_tokens(F.col("image_tokens"), F.col("text_tokens"))
    return totals.select(
        F.format_string(
            f"%d {noun}  %d image tokens -> %d text tokens  (saved %d, %d%%)",
            F.col("inputs"), F.col("image_tokens"), F.col("text_tokens"), saved, percent(saved, F.col("image_tokens")),
        ).alias("line")
    )


def with_errors(asked: DataFrame, read: DataFrame, key: str = "file", message: str = "no such file") -> DataFrame:
    """All that was asked for: rows read, and an error row for each of the others."""
    gone = asked.join(read, key, "left_anti").select(key, F.lit(message).alias("error"))
    return read.unionByName(gone, allowMissingColumns=True)
