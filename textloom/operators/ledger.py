"""The savings ledger: an append-only fact table, its summaries, reports and the import of old files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.tokens import pad, percent, saved_tokens

#: Alphabetical, as the JSON lines are written.
COUNTERS = ("image_tokens", "inputs", "redactions", "saved", "text_tokens")
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType() if c in ("mode", "ts") else T.LongType()) for c in sorted([*COUNTERS, "mode", "ts"])]
)
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
#: Widths of the report by mode.
WIDTHS = (8, 7, 9, 14, 13, 14, 5, 11)
HEADS = ("mode", "runs", "inputs", "image tokens", "text tokens", "saved", "%", "redactions")


def entry(ts: Column, mode: Column, inputs: Column, image: Column, text: Column, redactions: Column) -> list[Column]:
    """Ledger columns of a run; what is saved is never negative."""
    values = {"ts": ts, "mode": mode, "inputs": inputs, "image_tokens": image, "text_tokens": text, "redactions": redactions, "saved": saved_tokens(image, text)}
    return [values[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA]


def append(entries: DataFrame, path: str) -> None:
    """Adds entries as JSON lines with sorted keys; Spark's commit keeps concurrent runs apart (new files, never shared ones)."""
    entries.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA]).write.mode("append").option("ignoreNullFields", "false").json(path)


def in_window(entries: DataFrame, days: int | None, now: Column | None = None) -> DataFrame:
    """Entries of the last ``days`` days; without a number all, with one those with a readable time only."""
    if days is None:
        return entries
    now = F.current_timestamp() if now is None else now
    at = F.try_to_timestamp(F.col("ts"), F.lit(TIME_FORMAT))
    return entries.filter(F.unix_micros(at) >= F.unix_micros(now) - days * 86_400 * 1_000_000)


def _sums() -> list[Column]:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return [F.count(F.lit(1)).alias("runs"), *[total(c) for c in ("inputs", "image_tokens", "text_tokens", "saved", "redactions")]]


def summary(entries: DataFrame, days: int | None = None, now: Column | None = None) -> DataFrame:
    """One row: days, runs, inputs, image_tokens, text_tokens, saved, redactions, percent."""
    day = F.count_distinct(F.substring("ts", 1, 10)).alias("days")
    return in_window(entries, days, now).agg(day, *_sums()).withColumn("percent", percent(F.col("saved"), F.col("image_tokens")))


def by_mode(entries: DataFrame, days: int | None = None, now: Column | None = None) -> DataFrame:
    """A row a mode, largest saving first, ties by mode."""
    grouped = in_window(entries, days, now).groupBy("mode").agg(*_sums())
    return grouped.withColumn("percent", percent(F.col("saved"), F.col("image_tokens"))).orderBy(F.desc("saved"), "mode")


def run_totals(inputs: DataFrame) -> DataFrame:
    """A row a kind of input that succeeded (``kind, image_tokens, text_tokens, redactions``; ``error`` null), pdf first."""
    fine = inputs.filter(F.col("error").isNull())
    sums = [F.sum(c).cast("long").alias(c) for c in ("image_tokens", "text_tokens", "redactions")]
    totals = fine.groupBy(F.col("kind").alias("mode")).agg(F.count(F.lit(1)).alias("inputs"), *sums)
    return totals.orderBy(F.when(F.col("mode") == "pdf", 0).otherwise(1), "mode")


def _cells() -> list[Column]:
    return [F.col(c).cast("string") for c in ("mode", "runs", "inputs", "image_tokens", "text_tokens", "saved", "percent", "redactions")]


def _line(cells: list[Column]) -> Column:
    return F.concat(F.lit("  "), F.concat_ws(" ", *[pad(c, w, right=i > 0) for i, (c, w) in enumerate(zip(cells, WIDTHS, strict=True))]))


def report_rows(entries: DataFrame, days: int | None = None, now: Column | None = None) -> DataFrame:
    """``place, line`` of the report by mode: a title, heads, a line a mode, the total."""
    total = summary(entries, days, now)
    modes = by_mode(entries, days, now)
    title = total.select(
        F.lit(0).cast("long").alias("place"),
        F.concat(F.lit("ledger  ("), F.col("days").cast("string"), F.when(F.col("days") == 1, " day").otherwise(" days"), F.lit(", by mode)")).alias("line"),
    )
    heads = total.select(F.lit(1).cast("long").alias("place"), _line([F.lit(h) for h in HEADS]).alias("line"))
    ranked = modes.withColumn("place", F.row_number().over(_all().orderBy(F.desc("saved"), "mode")) + 1)
    body = ranked.select(F.col("place").cast("long").alias("place"), _line(_cells()).alias("line"))
    foot = total.withColumn("mode", F.lit("TOTAL")).select(F.lit(2**31).cast("long").alias("place"), _line(_cells()).alias("line"))
    return title.unionByName(heads).unionByName(body).unionByName(foot)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # a row a mode


def report(entries: DataFrame, days: int | None = None, now: Column | None = None) -> DataFrame:
    """One row, ``report``: the flat text report."""
    s = summary(entries, days, now)
    plural = F.when(F.col("days") == 1, "").otherwise("s")
    return s.select(
        F.format_string(
            "ledger  (%s day%s)\n  runs           %s\n  inputs         %s\n  image tokens   %s\n  text tokens    %s\n"
            "  saved          %s  (%s%%)\n  redactions     %s\n",
            F.col("days"), plural, *[F.col(c) for c in ("runs", "inputs", "image_tokens", "text_tokens", "saved", "percent", "redactions")],
        ).alias("report")
    )


def from_tsv(lines: DataFrame, value: str = "value") -> DataFrame:
    """Ledger rows of old tab-separated lines; lines with too few fields or other than whole numbers are left out.

    The stored saving is ignored and computed again.
    """
    c = F.split(F.col(value), "\t", -1)
    whole = lambda i: F.when(F.rlike(F.get(c, F.lit(i)), F.lit(r"^[+-]?[0-9]+$")), F.get(c, F.lit(i)).try_cast("bigint"))
    cells = lines.select(
        F.get(c, F.lit(0)).alias("ts"), F.get(c, F.lit(1)).alias("mode"), whole(2).alias("inputs"), whole(3).alias("image"), whole(4).alias("text"),
        whole(6).alias("red"), F.size(c).alias("fields"),
    )
    good = cells.filter((F.col("fields") >= 7) & F.col("inputs").isNotNull() & F.col("image").isNotNull() & F.col("text").isNotNull() & F.col("red").isNotNull())
    return good.select(*entry(*[F.col(x) for x in ("ts", "mode", "inputs", "image", "text", "red")]))
