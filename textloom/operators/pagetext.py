"""Pages: is a text layer faithful to what recognition read, lane choice, page text.

The check compares pairs of neighbouring words.  Pairs of a line that the layer lacks are found by an equi join, so it
scales with the number of pairs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.tokens import SPACE, finite, rstrip

# Pairs a line needs to count, share of missing pairs above which it is missed, characters a layer needs.
LINE_PAIRS, MISSING_SHARE, LAYER_CHARS = 3, 0.5, 20


@F.pandas_udf(T.StringType())
def _decomposed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


def decomposed(text: Column) -> Column:
    """Compatibility decomposition (NFKD); plain ASCII doesn't leave the JVM's projection."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, text).otherwise(_decomposed(F.when(~ascii_only, text)))


def words(tokens: Column) -> Column:
    """Word-like tokens of an array of lower-case, decomposed tokens, letters only.

    A token counts with two letters or more that are at least half of its characters; marks go with their letter.
    """
    letters = F.transform(tokens, lambda t: F.struct(F.regexp_replace(t, F.lit(r"[^\p{L}\p{M}]"), F.lit("")).alias("l"), t.alias("t")))
    many = lambda s: F.regexp_count(s, F.lit(r"\p{L}"))
    size = lambda s: F.length(F.regexp_replace(s, F.lit(r"\p{M}"), F.lit("")))
    good = F.filter(letters, lambda w: (many(w["l"]) >= 2) & (many(w["l"]) * 2 >= size(w["t"])))
    return F.transform(good, lambda w: w["l"])


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pairs(words_: Column) -> Column:
    """Pairs of neighbours of an array."""
    n = F.greatest(F.size(words_) - 1, F.lit(0))
    return F.zip_with(F.slice(words_, F.lit(1), n), F.slice(words_, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _with_pairs(df: DataFrame, text_col: str) -> DataFrame:
    """Adds ``tl_pairs``, the pairs of neighbouring words of a text column, in one expression that is evaluated once."""
    df = df.withColumn("tl_low", F.lower(decomposed(F.col(text_col))))
    tokens = F.filter(F.split("tl_low", rf"{SPACE}+", -1), lambda t: t != "")
    return df.withColumn("tl_pairs", _bind(_bind(tokens, words), pairs)).drop("tl_low")


def _exploded(df: DataFrame, keys: list[str], pairs_: Column) -> DataFrame:
    # An inner explode would make the optimizer copy the whole expression into a filter on its size.
    return df.select(*keys, F.explode_outer(pairs_).alias("pair")).filter(F.col("pair").isNotNull())


def line_pairs(lines: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, pair`` of each line's pairs, with repeats; lines too short to count are left out."""
    df = _with_pairs(lines.select(*keys, text_col), text_col)
    return _exploded(df, keys, _bind(F.col("tl_pairs"), lambda p: F.when(F.size(p) >= LINE_PAIRS, p)))


def layer_pairs(pages: DataFrame, keys: list[str], text_col: str = "layer_text") -> DataFrame:
    """``keys, pair``: the distinct pairs of a page's layer; they run across line ends."""
    return _exploded(_with_pairs(pages.select(*keys, text_col), text_col), keys, F.array_distinct("tl_pairs"))


def line_shares(lines: DataFrame, pages: DataFrame, page_keys: list[str], line_keys: list[str]) -> DataFrame:
    """``page_keys, line_keys, n_pairs, n_missing`` of lines that count."""
    read = line_pairs(lines, [*page_keys, *line_keys])
    # Layers of pages without lines have nothing to answer for.
    known = layer_pairs(pages.join(lines.select(*page_keys).distinct(), page_keys, "left_semi"), page_keys).select(*[F.col(k).alias(f"tl_{k}") for k in page_keys], F.col("pair").alias("tl_pair"))
    on = [read[k] == known[f"tl_{k}"] for k in page_keys] + [read["pair"] == known["tl_pair"]]
    joined = read.join(known, on, "left")
    missing = F.count_if(F.col("tl_pair").isNull())
    return joined.groupBy(*page_keys, *line_keys).agg(F.count(F.lit(1)).alias("n_pairs"), missing.alias("n_missing"))


def missing_pairs(lines: DataFrame, pages: DataFrame, page_keys: list[str]) -> DataFrame:
    """Distinct pairs of lines that their page's layer lacks."""
    read = line_pairs(lines, page_keys)
    return read.join(layer_pairs(pages, page_keys), [*page_keys, "pair"], "left_anti").distinct()


def layer_misses(lines: DataFrame, pages: DataFrame, page_keys: list[str], line_keys: list[str]) -> DataFrame:
    """``page_keys, misses``: lines of which more than half of the pairs are missing; pages without any have 0."""
    shares = line_shares(lines, pages, page_keys, line_keys)
    missed = shares.filter(F.col("n_missing") / F.col("n_pairs") > MISSING_SHARE).groupBy(*page_keys).agg(F.count(F.lit(1)).alias("misses"))
    return pages.select(*page_keys).join(missed, page_keys, "left").withColumn("misses", F.coalesce("misses", F.lit(0)))


def choose_lanes(pages: DataFrame, lines: DataFrame, page_keys: list[str], line_keys: list[str], force: bool = False) -> DataFrame:
    """Adds ``misses`` and ``lane``: ``text`` if the layer is long enough and accounts for every line, else ``scan``."""
    misses = layer_misses(lines, pages, page_keys, line_keys)
    solid = F.regexp_count(F.coalesce("layer_text", F.lit("")), F.lit(SPACE.replace(r"\s", r"\S")))
    scan = F.lit(force) | (solid < LAYER_CHARS) | (F.col("misses") > 0)
    return pages.join(misses, page_keys, "left").withColumn("lane", F.when(scan, "scan").otherwise("text"))


def layer_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Rendered lines of a text layer (``layer_text``, ``fixed_pitch`` an array of line numbers from 0, or null): blanks dropped, numbered."""
    from pyspark.sql import Window

    each = pages.select(*keys, F.posexplode(F.split("layer_text", "\n", -1)).alias("raw_ix", "raw"), *[c for c in ("fixed_pitch",) if c in pages.columns])
    kept = each.withColumn("text", rstrip(F.col("raw"))).filter(F.col("text") != "")
    fenced = F.coalesce(F.array_contains("fixed_pitch", F.col("raw_ix")), F.lit(False)) if "fixed_pitch" in pages.columns else F.lit(False)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("raw_ix")).cast("long")
    return kept.select(*keys, n.alias("n"), "text", F.lit(1.0).cast("float").alias("confidence"), fenced.alias("fenced"))


def top_left(y_max: Column, box_y: Column, box_h: Column) -> Column:
    """The top of a box of a page measured from the bottom, measured from the top."""
    return F.when(finite(box_y) & finite(box_h), y_max - (box_y + box_h))


def page_text(pages: DataFrame, doc: str = "doc_id", n: str = "n", text: str = "text") -> DataFrame:
    """``doc_id, text``: the pages in order, each under a line with its number."""
    piece = F.concat(F.lit("--- page "), F.col(n).cast("string"), F.lit(" ---\n"), F.col(text))
    grouped = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), piece.alias("piece")))).alias("all"))
    return grouped.select(doc, F.array_join(F.transform("all", lambda p: p["piece"]), "\n\n").alias("text"))


def select_pages(pages: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Pages of the range, with ``error`` for documents that can't be read so: locked, without pages, range outside."""
    size = pages.groupBy(F.col("doc_id").alias("d")).agg(F.max("n").alias("page_count"), F.max(F.coalesce("locked", F.lit(False))).alias("shut"))
    df = pages.join(size, pages["doc_id"] == size["d"]).drop("d")
    outside = F.lit(False) if low is None else (F.lit(low) < 1) | (F.lit(high) > F.col("page_count"))
    text = F.lit("") if low is None else F.concat(F.lit(f"pages {low}-{high} are outside 1-"), F.col("page_count").cast("string"))
    error = F.when(F.col("shut"), "password-protected").when(F.col("page_count") < 1, "no pages").when(outside, text)
    df = df.withColumn("error", error).drop("shut")
    inside = F.lit(True) if low is None else F.col("n").between(low, high)
    return df.filter(F.col("error").isNotNull() | inside)
