"""Boxes: coordinate transforms, word-cell statistics, unions.  Boxes are ``x, y, w, h`` with a top-left origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import finite

#: Characters a measured word has at least, share of the line it may span, words a line needs.
WORD_CHARS, WORD_SHARE, LINE_WORDS = 3, 0.9, 3
CONFIDENCE, UNION_PAD = 0.3, 4


def to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """Pixels from the top left, of a normalised box from the bottom left."""
    return {"x": x * width, "y": (1 - (y + h)) * height, "w": w * width, "h": h * height}


def to_normalised(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """The inverse of ``to_pixels``."""
    return {"x": x / width, "y": (height - (y + h)) / height, "w": w / width, "h": h / height}


def from_region(x: Column, y: Column, w: Column, h: Column, rx: Column, ry: Column, rw: Column, rh: Column) -> dict[str, Column]:
    """A normalised box inside a region, as a normalised box of the whole."""
    return {"x": rx + x * rw, "y": ry + y * rh, "w": w * rw, "h": h * rh}


def usable_lines(lines: DataFrame, least: float = CONFIDENCE) -> DataFrame:
    """Lines of enough confidence whose box is finite."""
    box = finite(F.col("x")) & finite(F.col("y")) & finite(F.col("w")) & finite(F.col("h"))
    return lines.filter((F.col("confidence") >= F.lit(least).cast("float")) & box)


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Rounded ``[left, top, right, bottom]``."""
    return F.array(*[F.round(c).cast("int") for c in (x, y, x + w, y + h)])


def cell_statistics(words: DataFrame, keys: list[str]) -> DataFrame:
    """Per line: ``cell_width`` (median) and ``cell_variation`` (deviation over mean) of words' widths a character.

    ``words`` has ``width, chars, line_width``; lines with too few usable words are left out.
    """
    good = (F.col("chars") >= WORD_CHARS) & finite(F.col("width")) & (F.col("width") > 0) & (F.col("width") <= WORD_SHARE * F.col("line_width"))
    cells = words.filter(good).withColumn("cell", F.col("width") / F.col("chars"))
    stats = cells.groupBy(*keys).agg(
        F.median("cell").alias("cell_width"), (F.stddev_pop("cell") / F.avg("cell")).alias("cell_variation"), F.count(F.lit(1)).alias("n")
    )
    return stats.filter(F.col("n") >= LINE_WORDS).drop("n")


def union_boxes(lines: DataFrame, keys: list[str], pad: float = UNION_PAD) -> DataFrame:
    """Per group: the box round all boxes, padded and clipped to ``width`` and ``height``; empty ones are left out."""
    box = lines.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in ("x", "y")],
        F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"), F.max("width").alias("width"), F.max("height").alias("height"),
    )
    low = lambda c: F.greatest(F.lit(0.0), F.col(c) - pad)
    cut = box.select(*keys, low("x").alias("x"), low("y").alias("y"), F.least("width", F.col("r") + pad).alias("r"), F.least("height", F.col("b") + pad).alias("b"))
    sized = cut.select(*keys, "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))
    return sized.filter((F.col("w") > 0) & (F.col("h") > 0))


def page_pixels(width: Column, height: Column, rotation: Column, scale: float = 2.0) -> tuple[Column, Column]:
    """A page's size as rendered; a quarter turn swaps the sides."""
    turned = F.pmod(F.pmod(rotation, F.lit(360)), F.lit(180)) == 90
    w, h = F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)
    return F.round(w * scale).cast("int"), F.round(h * scale).cast("int")
