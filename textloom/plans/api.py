"""Options with their defaults and checks, and the three entry functions that a tool server or script calls."""

from __future__ import annotations

import math
import os
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.tokens import text_tokens
from textloom.operators import ledger, payload
from textloom.operators.frames import MAX_FRAMES, SCENE
from textloom.operators.gate import refuse_long
from textloom.operators.geometry import CONFIDENCE
from textloom.operators.redact import redact
from textloom.operators.rules import BUILTIN, Rule, load_rules, with_custom
from textloom.operators.transcript import DEDUPE, ledger_rows, transcribe
from textloom.session import checkpointed
from textloom.sources import files


class UsageError(ValueError):
    """Options that can't be used together or have no such value."""


COMMANDS = ("files", "text", "video", "newest", "captures", "ledger", "allow")


@dataclass
class Options:
    """What to do and how; checked on creation."""

    command: str = "files"
    paths: list[str] = field(default_factory=list)
    redact: bool = True
    json: bool = False
    stats: bool = False
    no_ledger: bool = False
    force_ocr: bool = False
    min_confidence: float = CONFIDENCE
    scene: float = SCENE
    max_frames: int = MAX_FRAMES
    dedupe: float = DEDUPE
    rules_path: str | None = None
    pages: tuple[int, int] | None = None
    frame_times: list[float] | None = None
    days: int | None = None
    by_mode: bool = False
    migrate: bool = False
    count: int = 1

    def __post_init__(self) -> None:
        if self.command not in COMMANDS:
            raise UsageError(f"no such command {self.command}")
        for name in ("min_confidence", "scene", "dedupe"):
            unit_number(name, getattr(self, name))
        for name in ("max_frames", "count", *(["days"] if self.days is not None else [])):
            positive(name, getattr(self, name))
        if self.command != "ledger" and (self.days is not None or self.by_mode or self.migrate):
            raise UsageError("days, by_mode and migrate need the ledger command")
        if self.command != "video" and self.frame_times is not None:
            raise UsageError("frame times need a video")
        if self.frame_times is not None:
            if not self.frame_times:
                raise UsageError("no frame times")
            self.frame_times = sorted(set(self.frame_times))
        if self.command == "allow" and len(self.paths) != 1:
            raise UsageError("allow takes exactly one path")
        if self.pages is not None:
            if not 1 <= self.pages[0] <= self.pages[1]:
                raise UsageError("pages: N or N-M with N >= 1")
            if other := [p for p in self.paths if not p.lower().endswith(".pdf")]:
                raise UsageError(f"pages apply to PDF input only, not {other[0]}")


def unit_number(name: str, value) -> float:
    """A finite number from 0 to 1."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        raise UsageError(f"{name}: not a number: {value}") from None
    if not math.isfinite(number) or not 0 <= number <= 1:
        raise UsageError(f"{name}: must be between 0 and 1: {value}")
    return number


def positive(name: str, value) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise UsageError(f"{name}: not a number: {value}")
    if value < 1:
        raise UsageError(f"{name}: must be >= 1: {value}")
    return value


def parse_pages(text: str) -> tuple[int, int]:
    """``N`` or ``N-M`` with 1 <= N <= M."""
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", text)
    low, high = (int(m[1]), int(m[2] or m[1])) if m else (0, 0)
    if not 1 <= low <= high:
        raise UsageError(f"pages: expected N or N-M with N >= 1, got {text}")
    return low, high


def ledger_path(environment: dict[str, str] | None = None, home: str | None = None) -> str:
    """Where the ledger is: a folder named by ``TEXTLOOM_HOME``, else one in the user's home."""
    environment = dict(os.environ) if environment is None else environment
    root = environment.get("TEXTLOOM_HOME") or os.path.join(home or os.path.expanduser("~"), ".textloom")
    return os.path.join(root, "ledger")


def rules_of(spark: SparkSession, options: Options) -> list[Rule] | None:
    """The rules to use: none if redaction is off, custom ones first."""
    if not options.redact:
        return None
    return with_custom(load_rules(spark, options.rules_path)) if options.rules_path else list(BUILTIN)


def redact_texts(texts: DataFrame, rules: Sequence[Rule] | None = BUILTIN) -> DataFrame:
    """``file, text, redactions, image_tokens, text_tokens, error`` of texts (``file, text, error``); error rows stay."""
    if rules is None:
        df = texts.withColumns({"redacted": F.col("text"), "redactions": F.create_map().cast("map<string,bigint>")})
    else:
        df = redact(texts, "text", rules)
    fine = F.col("error").isNull()
    return df.select(
        "file", F.col("redacted").alias("text"), F.when(fine, F.col("redactions")).alias("redactions"),
        F.when(fine, F.lit(0).cast("long")).alias("image_tokens"), F.when(fine, text_tokens(F.col("redacted"))).alias("text_tokens"), "error",
    )


def text_tool(spark: SparkSession, options: Options) -> DataFrame:
    """Text files, redacted; nothing is written to the ledger."""
    return redact_texts(files.read_texts(spark, options.paths), rules_of(spark, options))


def video_tool(spark: SparkSession, frames: DataFrame, options: Options, path: str | None = None) -> DataFrame:
    """Transcripts of recognised frames; unless told otherwise each is noted in the ledger (at ``path`` if given)."""
    done = checkpointed(transcribe(frames, rules_of(spark, options), options.dedupe))
    if not options.no_ledger:
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), ledger.TIME_FORMAT)
        ledger.append(ledger_rows(done, now), path or ledger_path())
    return done


def ledger_tool(spark: SparkSession, options: Options, path: str, tsv_folder: str | None = None) -> DataFrame:
    """The ledger's summary, or its rows by mode."""
    if options.migrate and tsv_folder:
        files.migrate_tsv(spark, tsv_folder, path)
    entries = files.read_ledger(spark, path)
    return ledger.by_mode(entries, options.days) if options.by_mode else ledger.summary(entries, options.days)


def page_tool(documents: DataFrame, options: Options) -> DataFrame:
    """Documents that have too many pages for an answer without a range, as error rows."""
    return refuse_long(documents) if options.pages is None else documents.filter(F.lit(False))


def status_segment(entries: DataFrame, now=None) -> DataFrame:
    """``segment``: what the last seven days saved, in short form."""
    from textloom.functions.tokens import short_number

    return ledger.summary(entries, 7, now).select(F.concat(short_number(F.col("saved")), F.lit(" saved")).alias("segment"))


def json_result(results: DataFrame) -> DataFrame:
    return payload.envelope(results)
