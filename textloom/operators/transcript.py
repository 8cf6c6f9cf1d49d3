"""Transcripts of screen recordings: recognised frames, redacted, without screens that repeat the last kept one.

Frames are ``video_id, frame_ix, time, width, height, text, error``.  What is kept depends on what was kept before, so a
video is one fold over its frames in order of time, in JVM expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.tokens import image_tokens, jaccard, saved_tokens, stamp, strip, text_tokens, token_set
from textloom.operators.redact import merge_counts, redact, total
from textloom.operators.rules import BUILTIN, Rule

DEDUPE = 0.90


def screens(frames: DataFrame, rules: Sequence[Rule] | None = BUILTIN) -> DataFrame:
    """Frames that were read, with the redacted, stripped ``screen`` and its ``redactions``; ``rules`` None leaves texts raw."""
    fine = frames.filter(F.col("error").isNull())
    if rules is None:
        read = fine.withColumns({"redacted": F.col("text"), "redactions": F.create_map().cast("map<string,bigint>")})
    else:
        read = redact(fine, "text", rules)
    return read.withColumn("screen", strip(F.coalesce("redacted", F.lit(""))))


def kept_screens(read: DataFrame, dedupe: float = DEDUPE) -> DataFrame:
    """``video_id, time, stamp, text, redactions`` of screens less similar than ``dedupe`` to the last kept one.

    Empty screens are skipped.  The first screen is compared with an empty one.
    """
    rows = read.filter(F.col("screen") != "").withColumn("tokens", token_set(F.col("screen")))
    frame = F.struct("time", "frame_ix", F.col("screen").alias("text"), "redactions", "tokens")
    # Maps have no order, so frames are sorted by time and number alone.
    grouped = rows.groupBy("video_id").agg(F.collect_list(frame).alias("frames"))
    ordered = F.array_sort("frames", lambda a, b: F.when(_key(a) < _key(b), -1).when(_key(a) > _key(b), 1).otherwise(0))
    grouped = grouped.withColumn("frames", ordered)
    # The fold carries the last kept tokens and a string of one mark a frame, not the frames kept so far.
    start = F.struct(F.array().cast("array<string>").alias("last"), F.lit("").alias("marks"))

    def step(state, f):
        same = jaccard(f["tokens"], state["last"]) >= dedupe
        return F.struct(F.when(same, state["last"]).otherwise(f["tokens"]).alias("last"), F.concat(state["marks"], F.when(same, "0").otherwise("1")).alias("marks"))

    marked = grouped.select("video_id", "frames", F.aggregate("frames", start, step)["marks"].alias("marks"))
    each = marked.select("video_id", "marks", F.posexplode("frames").alias("at", "k")).filter(F.substring("marks", F.col("at") + 1, F.lit(1)) == "1")
    return each.select("video_id", "k.time", stamp(F.col("k.time")).alias("stamp"), "k.text", "k.redactions", F.col("k.frame_ix").alias("frame_ix"))


def _key(frame):
    return F.struct(frame["time"], frame["frame_ix"])


def body(kept: DataFrame) -> DataFrame:
    """``video_id, body``: stamped screens, each followed by an empty line."""
    piece = F.concat(F.lit("["), "stamp", F.lit("]\n"), "text", F.lit("\n\n"))
    grouped = kept.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("time", "frame_ix", piece.alias("piece")))).alias("all"))
    return grouped.select("video_id", F.array_join(F.transform("all", lambda p: p["piece"]), "").alias("body"))


def transcribe(frames: DataFrame, rules: Sequence[Rule] | None = BUILTIN, dedupe: float = DEDUPE) -> DataFrame:
    """One row a video: text, segments, frames, failed_frames, redactions, image and text tokens, error.

    Costs count frames that were read, redactions kept screens only; a video of which no frame was read has an error.
    """
    counts = frames.groupBy("video_id").agg(
        F.count_if(F.col("error").isNull()).alias("frames"), F.count_if(F.col("error").isNotNull()).alias("failed_frames"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), image_tokens(F.col("width"), F.col("height")))), F.lit(0)).alias("image_tokens"),
        F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("time", "frame_ix"))).alias("last"),
    )
    kept = kept_screens(screens(frames, rules), dedupe)
    texts = body(kept)
    segments = kept.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("time", "stamp", "text"))).alias("segments"))
    found = merge_counts(kept, ["video_id"])
    df = counts
    for extra in (texts, segments, found):
        df = df.join(extra, "video_id", "left")
    whole = F.coalesce("body", F.lit(""))
    failed = F.when(
        (F.col("frames") == 0) & (F.col("failed_frames") > 0),
        F.concat(F.lit("recognition failed on all "), F.col("failed_frames").cast("string"), F.lit(" frame(s); last error: "), F.col("last")),
    ).when(F.col("frames") == 0, "no frames extracted")
    return df.select(
        "video_id", strip(whole).alias("text"), "segments", "frames", "failed_frames",
        F.coalesce("redactions", F.create_map().cast("map<string,bigint>")).alias("redactions"),
        "image_tokens", text_tokens(whole).alias("text_tokens"), failed.alias("error"),
    )


def ledger_rows(transcripts: DataFrame, ts) -> DataFrame:
    """Ledger entries of transcripts without error: inputs are the frames that were read."""
    from textloom.operators.ledger import entry

    fine = transcripts.filter(F.col("error").isNull())
    return fine.select(*entry(ts, F.lit("video"), F.col("frames"), F.col("image_tokens"), F.col("text_tokens"), total(F.col("redactions"))))


def stats_line(transcripts: DataFrame) -> DataFrame:
    """``video_id, line``: frames, distinct screens and savings in one line."""
    saved = saved_tokens(F.col("image_tokens"), F.col("text_tokens"))
    share = F.when(F.col("image_tokens") > 0, (saved / F.col("image_tokens") * 100).cast("long")).otherwise(F.lit(0))
    failed = F.when(F.col("failed_frames") > 0, F.format_string(", %d failed", "failed_frames")).otherwise("")
    distinct = F.coalesce(F.size("segments"), F.lit(0))
    line = F.format_string(
        "%d scene frames%s, %d distinct screens  %d image tokens -> %d text tokens  (saved %d, %d%%)",
        F.col("frames"), failed, distinct, F.col("image_tokens"), F.col("text_tokens"), saved, share,
    )
    return transcripts.select("video_id", line.alias("line"))
