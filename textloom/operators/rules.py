"""Redaction rules: the built-in list, and rule files."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom.functions import validators as V


class RuleError(ValueError):
    """A rule or rule file that can't be used."""


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches become ``[name]``, unless the validator says no.

    ``hint`` is a cheap test that every text with a match passes; texts that fail it skip the pattern.
    """

    name: str
    pattern: str
    ignore_case: bool = True
    validator: Callable[[Column], Column] | None = None
    hint: Callable[[Column], Column] | None = None

    @property
    def regex(self) -> str:
        """The pattern with Unicode character classes, as the JVM reads it."""
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern


def _has(*parts: str) -> Callable[[Column], Column]:
    def test(text: Column) -> Column:
        found = F.contains(text, F.lit(parts[0]))
        for p in parts[1:]:
            found = found | F.contains(text, F.lit(p))
        return found

    return test


def _like(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.rlike(text, F.lit(pattern))


# Names, order, patterns, case and validators of the built-in rules.
BUILTIN: tuple[Rule, ...] = (
    Rule("AWS_KEY", r"\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[0-9A-Z]{16}\b", False, None, _has("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA")),
    Rule("GITHUB_PAT", r"\b(?:ghp|gho|ghu|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}\b", False, None, _has("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_")),
    Rule("OPENAI_KEY", r"\bsk-(?:proj-|ant-|live-)?[A-Za-z0-9_\-]{20,}\b", False, None, _has("sk-")),
    Rule("SLACK_TOKEN", r"\bxox[abposr]-[A-Za-z0-9\-]{10,}\b", False, None, _has("xox")),
    Rule("JWT", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b", False, None, _has("eyJ")),
    Rule("PRIVATE_KEY", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", False, None, _has("-----BEGIN ")),
    Rule("BEARER", r"\bBearer[ \t]+[A-Za-z0-9._\-]{16,}", True, None, _like(r"(?iU)bearer[ \t]")),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+\-]+@(?!\d+(?:\.\d+)?x\.(?:png|jpe?g|gif|webp|heic|tiff?)\b)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", True, None, _has("@")),
    Rule("SSN", r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b", False, None, _like(r"(?U)\d{3}-\d{2}-\d")),
    Rule("ROUTING", r"\b\d{4}[ \-]?\d{4}[ \-]?\d\b", False, V.aba, _like(r"(?U)\d{4}[ \-]?\d{4}")),
    Rule("CARD", r"\b\d(?:[ \-]?\d){12,18}\b", False, V.luhn, _like(r"(?U)\d(?:[ \-]?\d){12}")),
    Rule("BANK_ACCT", r"(?<=(?:\b(?:acct|account|a/c|micr)\b|\[ROUTING\])[^\n\d]{0,20})\d{8,17}(?![\w\-/])", True, None, _like(r"(?U)\d{8}")),
    Rule("PHONE", r"(?<!\d)(?:\+?1[ \-.])?\(?\d{3}\)?[ \-.]\d{3}[ \-.]\d{4}(?!\d)", False, None, _like(r"(?U)\d{3}[ \-.]\d{4}")),
    Rule("TOKEN", r"(?<![A-Za-z0-9_\-+/=.])(?=[A-Za-z0-9_\-+/=.]*[a-z])(?=[A-Za-z0-9_\-+/=.]*[A-Z])[A-Za-z0-9_\-+/=.]{20,}", False, V.looks_like_secret, _like(r"[A-Za-z0-9_\-+/=.]{20}")),
    Rule("IPV4", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", False, None, _like(r"(?U)\d\.\d")),
    Rule("IPV4", "(?<![\\d.])(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)[ ·]){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?![\\d.])", False, V.more_than_four_digits, _like("(?U)\\d[ ·]\\d")),
)


def compile_failures(spark: SparkSession, rules: Sequence[Rule]) -> list[Rule]:
    """The rules whose patterns the JVM doesn't accept."""
    pattern = spark._jvm.java.util.regex.Pattern
    failed = []
    for rule in rules:
        try:
            pattern.compile(rule.regex)
        except Exception:  # the gateway wraps the JVM's PatternSyntaxException
            failed.append(rule)
    return failed


def checked(spark: SparkSession, rules: Sequence[Rule]) -> list[Rule]:
    """The rules, or an error that names every one that doesn't compile."""
    if failed := compile_failures(spark, rules):
        raise RuleError("rules do not compile: " + ", ".join(r.name for r in failed))
    return list(rules)


def usable(spark: SparkSession, rules: Sequence[Rule]) -> tuple[list[Rule], list[Rule]]:
    """The rules that compile, and those that don't."""
    failed = compile_failures(spark, rules)
    return [r for r in rules if r not in failed], failed


def parse_rules(spark: SparkSession, text: str) -> list[Rule]:
    """The rules of a JSON array of ``{name, pattern, caseInsensitive}``."""
    try:
        entries = json.loads(text)
        listed = [(e["name"], e["pattern"], e.get("caseInsensitive")) for e in entries] if isinstance(entries, list) else None
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise RuleError(f"a rule file is a JSON array of {{name, pattern, caseInsensitive}}: {e}") from None
    if listed is None or not all(isinstance(n, str) and isinstance(p, str) and isinstance(c, bool | None) for n, p, c in listed):
        raise RuleError("a rule file is a JSON array of {name, pattern, caseInsensitive}")
    rules: dict[str, Rule] = {}
    for name, pattern, ignore_case in listed:
        upper = name.upper()
        if not re.fullmatch(r"[A-Za-z0-9_-]+", upper):
            raise RuleError(f'rule name "{name}" must be letters, digits, _ or - only')
        if upper in rules:
            raise RuleError(f"duplicate rule name {upper}")
        rules[upper] = Rule(upper, pattern, True if ignore_case is None else ignore_case)
        if compile_failures(spark, [rules[upper]]):
            raise RuleError(f"rule {upper}: invalid pattern {pattern}")
    return list(rules.values())


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    try:
        text = Path(path).read_text(encoding="utf-8")
    except OSError as e:
        raise RuleError(f"cannot read rules file {path}: {e}") from None
    return parse_rules(spark, text)


def with_custom(custom: Sequence[Rule]) -> list[Rule]:
    """Custom rules come before the built-in ones."""
    return [*custom, *BUILTIN]
