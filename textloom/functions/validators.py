"""Checks that can veto a rule's match, as column expressions over the matched string."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of a card number, and the bits a character from which a string counts as a secret.
CARD_DIGITS, SECRET_BITS = (13, 19), 4.4


@cache
def _decimals() -> tuple[str, str]:
    """Decimal digits of all scripts but ASCII, and their values as ASCII digits."""
    signs = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(signs), "".join(str(unicodedata.decimal(c)) for c in signs)


def digits(s: Column) -> Column:
    """The decimal digits of a string, of any script, as numbers in order."""
    plain = F.when(F.length(s) == F.octet_length(s), s).otherwise(F.translate(s, *_decimals()))
    return F.transform(F.regexp_extract_all(plain, F.lit(r"([0-9])"), F.lit(1)), lambda d: d.cast("int"))


def luhn(s: Column) -> Column:
    """A card number: 13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(s))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * 2 - F.when(x > 4, 9).otherwise(0)))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.size(d).between(*CARD_DIGITS) & (total % 10 == 0)


def aba(s: Column) -> Column:
    """A routing number: nine digits, weights 3, 7, 1 in turn, sum a multiple of ten."""
    d = digits(s)
    weight = lambda i: F.when(i % 3 == 0, 3).when(i % 3 == 1, 7).otherwise(1)
    total = F.aggregate(F.transform(d, lambda x, i: x * weight(i)), F.lit(0), lambda a, x: a + x)
    return (F.size(d) == 9) & (total % 10 == 0)


def entropy(s: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty string."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars).cast("double")

    def bits(c: Column) -> Column:
        p = F.size(F.filter(chars, lambda x: x == c)) / n
        return p * F.log2(p)

    return F.when(n == 0, F.lit(0.0)).otherwise(-F.aggregate(F.transform(F.array_distinct(chars), bits), F.lit(0.0), lambda a, x: a + x))


def looks_like_secret(s: Column) -> Column:
    """High entropy, and neither a URL nor an absolute path."""
    return ~F.contains(s, F.lit("://")) & ~F.startswith(s, F.lit("/")) & (entropy(s) >= SECRET_BITS)


def more_than_four_digits(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?U)\d")) > 4
