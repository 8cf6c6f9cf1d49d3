"""Rule-based redaction of a text column, rule by rule, in JVM expressions only.

Rules run in order and see what earlier ones wrote.  A match that its validator refuses stays, and the search goes on
behind it.  The whole chain is one expression: each rule is a lambda over the state that the one before left (the text
so far and the counts), so that the expression grows with the number of rules and the optimizer, which may repeat it to
push down a filter, never multiplies it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.rules import BUILTIN, Rule


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _step(rule: Rule):
    mark, regex = F.lit(f"[{rule.name}]"), F.lit(rule.regex)

    def state(text: Column, counts: Column, n: Column) -> Column:
        return F.struct(text.alias("t"), F.concat(counts, F.array(n.cast("long"))).alias("n"))

    def plain(s: Column) -> Column:
        text = s["t"]
        may = F.coalesce(rule.hint(text), F.lit(False)) if rule.hint else text.isNotNull()
        hit = state(F.regexp_replace(text, regex, mark), s["n"], F.regexp_count(text, regex))
        return F.when(may, hit).otherwise(state(text, s["n"], F.lit(0)))

    def vetoed(s: Column) -> Column:
        text = s["t"]
        may = F.coalesce(rule.hint(text), F.lit(False)) if rule.hint else text.isNotNull()
        hits = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), lambda h: F.struct(h.alias("was"), rule.validator(h).alias("yes")))

        def replaced(found: Column) -> Column:
            said = F.transform(found, lambda h: F.when(h["yes"], mark).otherwise(h["was"]))
            pieces = F.zip_with(F.split(text, rule.regex, -1), said, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
            some = F.exists(found, lambda h: h["yes"])
            return state(F.when(some, F.array_join(pieces, "")).otherwise(text), s["n"], F.size(F.filter(found, lambda h: h["yes"])))

        return F.when(may, _bind(hits, replaced)).otherwise(state(text, s["n"], F.lit(0)))

    return vetoed if rule.validator else plain


def redacted_state(text: Column, rules: Sequence[Rule] = BUILTIN) -> Column:
    """``struct<t, n>``: the redacted text and the number of replacements of each rule."""
    state = F.struct(text.alias("t"), F.array().cast("array<bigint>").alias("n"))
    for rule in rules:
        state = _bind(state, _step(rule))
    return state


def _named(numbers: Column, rules: Sequence[Rule]) -> Column:
    """A map of names to replacements; rules of one name are summed, names without any left out."""
    entries = []
    for name in dict.fromkeys(r.name for r in rules):
        n = sum((F.get(numbers, F.lit(i)) for i, r in enumerate(rules) if r.name == name), F.lit(0).cast("long"))
        entries.append(F.struct(F.lit(name).alias("key"), n.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"] > 0))


def redact(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = BUILTIN, out: str = "redacted", counts: str = "redactions") -> DataFrame:
    """Adds the redacted text and a map of rule names to numbers of replacements (names without any are left out).

    Null texts stay null and have an empty map.
    """
    if not rules:
        return df.withColumns({out: F.col(text_col), counts: F.create_map().cast("map<string,bigint>")})
    df = df.withColumn("tl_state", redacted_state(F.col(text_col), rules))
    return df.withColumns({out: F.col("tl_state.t"), counts: _bind(F.col("tl_state.n"), lambda n: _named(n, rules))}).drop("tl_state")


def total(counts: Column) -> Column:
    """All replacements of a map of counts."""
    return F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, n: a + n)


def merge_counts(df: DataFrame, keys: Sequence[str], counts: str = "redactions") -> DataFrame:
    """One map a group: the sums of the groups' counts."""
    each = df.select(*keys, F.explode(counts).alias("rule", "n")).groupBy(*keys, "rule").agg(F.sum("n").alias("n"))
    return each.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule", "n")))).alias(counts))
