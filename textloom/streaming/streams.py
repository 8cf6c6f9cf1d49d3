"""Streaming forms: ledger aggregates, transcripts with keyed state, allowances that expire, hints once a session."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators import ledger
from textloom.operators.transcript import DEDUPE, screens


def ledger_stream(spark, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Entries of a growing ledger folder."""
    reader = spark.readStream.schema(ledger.SCHEMA).option("mode", "DROPMALFORMED")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.json(path)
    for f in ledger.SCHEMA:
        rows = rows.filter(F.col(f.name).isNotNull())
    return rows


def by_mode(entries: DataFrame) -> DataFrame:
    """Running totals a mode (output mode complete or update)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inputs", "image_tokens", "text_tokens", "saved", "redactions")]
    grouped = entries.groupBy("mode").agg(F.count(F.lit(1)).alias("runs"), *sums)
    return grouped.withColumn("percent", ledger.percent(F.col("saved"), F.col("image_tokens")))


def by_day(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """Totals a day and mode; a day is closed when the watermark has passed it."""
    timed = entries.withColumn("at", F.try_to_timestamp(F.col("ts"), F.lit(ledger.TIME_FORMAT))).withWatermark("at", late)
    return timed.groupBy(F.window("at", "1 day").alias("day"), "mode").agg(F.count(F.lit(1)).alias("runs"), F.sum("saved").alias("saved"))


def _similar(a: set, b: set) -> float:
    if not a and not b:
        return 1.0
    return len(a & b) / len(a | b) if a and b else 0.0


KEPT = T.StructType([T.StructField("time", T.DoubleType()), T.StructField("frame_ix", T.LongType()), T.StructField("text", T.StringType())])
STATE = T.StructType([T.StructField("last", T.StringType()), T.StructField("frames", T.LongType())])


def _timeout(idle_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout


def kept_screens(frames: DataFrame, dedupe: float = DEDUPE, rules=None, idle_ms: int | None = None) -> DataFrame:
    """``video_id, time, frame_ix, text`` of kept screens; frames come in order of time from batch to batch.

    A continuous query gives up a video's state after ``idle_ms`` without frames (with a trigger that ends, such a timeout never does).
    Within a batch they are sorted; the state is the last kept screen's tokens and the number of frames seen.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        rows = pd.concat(list(parts)).sort_values(["time", "frame_ix"])
        last, seen = state.get if state.exists else ("", 0)
        kept, tokens = [], set(last.split())
        for r in rows.itertuples():
            mine = set(r.screen.split())
            if r.screen and _similar(mine, tokens) < dedupe:
                kept.append((key[0], r.time, r.frame_ix, r.screen))
                tokens = mine
        state.update((" ".join(sorted(tokens)), seen + len(rows)))
        yield pd.DataFrame(kept, columns=schema.fieldNames())

    read = screens(frames, rules).select("video_id", "time", "frame_ix", "screen")
    schema = T.StructType([T.StructField("video_id", frames.schema["video_id"].dataType), *KEPT.fields])
    return read.groupBy("video_id").applyInPandasWithState(step, schema, STATE, "append", _timeout(idle_ms))


ANSWER = T.StructType([T.StructField("path", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("allowed", T.BooleanType())])
ALLOWED = T.StructType([T.StructField("expiries", T.ArrayType(T.LongType()))])


def gate_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Answers to reads in a stream of ``path, kind ('allow' or 'read'), at, expiry, seq``: an allowance serves one read, until it expires.

    A continuous query gives up a path's state after ``idle_ms`` without events.
    """

    def step(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        live = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(parts)).sort_values("seq").itertuples():
            live = [e for e in live if e >= r.at]
            if r.kind == "allow":
                live.append(int(r.expiry))
            else:
                out.append((key[0], r.seq, bool(live)))
                live = live[1:]
        state.update((live,))
        yield pd.DataFrame(out, columns=ANSWER.fieldNames())

    return events.groupBy("path").applyInPandasWithState(step, ANSWER, ALLOWED, "append", _timeout(idle_ms))


def hints_once(reads: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first read of each session within the watermark."""
    return reads.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session_id"])


def run_available(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs what is there into memory and gives the result (for tests and small answers)."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def append_ledger(entries: DataFrame, path: str, checkpoint: str):
    """Continuously appends entries to a ledger folder."""
    return entries.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
