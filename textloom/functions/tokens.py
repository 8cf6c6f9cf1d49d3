"""Token estimates and small text and number functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The long edge an image is scaled to, pixels a token, characters a token.
LONG_EDGE, PIXELS_PER_TOKEN, CHARS_PER_TOKEN = 1568, 750, 4
SPACE = r"(?U)\s"


def long(x: Column) -> Column:
    return x.cast("long")


def graphemes(text: Column) -> Column:
    """User-perceived characters; plain ASCII without carriage returns is counted by length."""
    plain = (F.length(text) == F.octet_length(text)) & ~F.contains(text, F.lit("\r"))
    return F.when(plain, F.length(text)).otherwise(F.regexp_count(text, F.lit(r"\X")))


def text_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded half up, one at least."""
    return long(F.greatest(F.lit(1), F.round(graphemes(text) / CHARS_PER_TOKEN)))


def image_tokens(width: Column, height: Column) -> Column:
    """What an image costs after its long edge is scaled down to the limit; 0 for empty images."""
    w, h = width.cast("double"), height.cast("double")
    scale = F.least(F.lit(1.0), F.lit(float(LONG_EDGE)) / F.greatest(w, h))
    return F.when((w <= 0) | (h <= 0), F.lit(0)).otherwise(F.round((w * scale) * (h * scale) / PIXELS_PER_TOKEN)).cast("long")


def saved_tokens(image: Column, text: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), long(image) - long(text))


def percent(saved: Column, image: Column) -> Column:
    """Truncated share of the image cost; the division comes first."""
    return F.when(image > 0, long(saved.cast("double") / image.cast("double") * 100)).otherwise(F.lit(0).cast("long"))


def stamp(seconds: Column) -> Column:
    """``mm:ss`` of rounded seconds; minutes aren't bounded."""
    t = long(F.round(seconds))
    return F.format_string("%02d:%02d", F.floor(t / 60), t % 60)


def parse_timestamp(text: Column) -> Column:
    """Seconds of ``SS[.s]``, ``MM:SS[.s]`` or ``HH:MM:SS[.s]``; null if it isn't one.

    Only the last field may have a fraction; of several fields each is below 60.
    """
    parts = F.split(text, ":", -1)
    n = F.size(parts)
    last = F.element_at(parts, -1)
    whole = F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0)))
    number = lambda c: c.try_cast("double")
    fine_last = F.rlike(last, F.lit(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")) & (number(last) < float("inf"))
    fine_whole = F.forall(whole, lambda p: F.coalesce(F.rlike(p, F.lit(r"^\+?\d+(\.0*)?$")) & (number(p) < 60), F.lit(False)))
    total = F.aggregate(F.transform(parts, lambda p: number(p)), F.lit(0.0), lambda acc, p: acc * 60 + p)
    fine = (n <= 3) & fine_last & fine_whole & ((n == 1) | (number(last) < 60))
    return F.when(fine, total)


def short_number(n: Column) -> Column:
    """``999``, ``41.2k``, ``1.5M``; ties go to the even digit, as printf does for exact binary ties."""
    part = lambda unit: F.bround(n / unit, 1).cast("decimal(20,1)").cast("string")
    return (
        F.when(n >= 1_000_000, F.concat(part(1_000_000), F.lit("M")))
        .when(n >= 1000, F.concat(part(1000), F.lit("k")))
        .otherwise(n.cast("string"))
    )


def pad(text: Column, width: int, right: bool = True) -> Column:
    """Blanks before (or after) the text up to the width; longer texts stay whole."""
    fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length(text)))
    return F.concat(fill, text) if right else F.concat(text, fill)


def strip(text: Column) -> Column:
    """Without white space at both ends (Unicode white space, line ends included)."""
    return F.regexp_replace(text, F.lit(rf"{SPACE}+\z|\A{SPACE.replace('(?U)', '')}+"), F.lit(""))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"{SPACE}+\z"), F.lit(""))


def token_set(text: Column) -> Column:
    """Distinct white-space separated tokens."""
    return F.array_distinct(F.filter(F.split(text, rf"{SPACE}+", -1), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two token sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(both / F.size(F.array_union(a, b)))
    )


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^./]+)$", 1))
