"""Choosing frames of a recording: decimation, scene changes, caps, given times, chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.tokens import parse_timestamp

#: Frames a second after decimation, scene threshold, most frames, seconds of a last chapter of unknown length.
RATE, SCENE, MAX_FRAMES, LAST_CHAPTER = 4, 0.25, 200, 60


def decimate(frames: DataFrame, rate: float = RATE) -> DataFrame:
    """The first frame of each interval of ``1 / rate`` seconds, per video."""
    bucket = Window.partitionBy("video_id", F.floor(F.col("time") * rate)).orderBy("time", "frame_ix")
    return frames.withColumn("tl_k", F.row_number().over(bucket)).filter(F.col("tl_k") == 1).drop("tl_k")


def cap(frames: DataFrame, most: int = MAX_FRAMES) -> DataFrame:
    """The first ``most`` frames of each video."""
    order = Window.partitionBy("video_id").orderBy("time", "frame_ix")
    return frames.withColumn("tl_k", F.row_number().over(order)).filter(F.col("tl_k") <= most).drop("tl_k")


def scenes(frames: DataFrame, threshold: float = SCENE, most: int = MAX_FRAMES) -> DataFrame:
    """After decimation: the first frame and those whose ``score`` is above the threshold, at most ``most``."""
    order = Window.partitionBy("video_id").orderBy("time", "frame_ix")
    kept = decimate(frames).withColumn("tl_first", F.row_number().over(order) == 1)
    return cap(kept.filter(F.col("tl_first") | (F.col("score") > threshold)).drop("tl_first"), most)


def with_times(frames: DataFrame, times: DataFrame) -> DataFrame:
    """Frames (``video_id, ordinal``) with the time printed for their ordinal; without one the ordinal stands for seconds.

    ``guessed`` tells which.
    """
    t = times.select(F.col("video_id").alias("v"), F.col("ordinal").alias("o"), F.col("time").alias("t"))
    joined = frames.join(t, (frames["video_id"] == t["v"]) & (frames["ordinal"] == t["o"]), "left")
    return joined.withColumns({"time": F.coalesce("t", F.col("ordinal").cast("double")), "guessed": F.col("t").isNull()}).drop("v", "o", "t")


def at_times(frames: DataFrame, times: DataFrame) -> DataFrame:
    """For each distinct requested time (``video_id, at``) the last frame at or before it; times past the end are dropped.

    An as-of join without a range join: requests and frames are one sorted stream per video.
    """
    fields = [c for c in frames.columns if c != "video_id"]
    frame = frames.select("video_id", F.col("time").alias("tl_t"), F.lit(0).alias("tl_ask"), F.struct(*fields).alias("tl_frame"))
    ask = times.distinct().select("video_id", F.col("at").alias("tl_t"), F.lit(1).alias("tl_ask"), F.lit(None).cast(frame.schema["tl_frame"].dataType).alias("tl_frame"))
    both = frame.unionByName(ask)
    order = Window.partitionBy("video_id").orderBy("tl_t", "tl_ask", F.col("tl_frame.frame_ix"))
    last = F.last("tl_frame", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    end = F.max(F.when(F.col("tl_ask") == 0, F.col("tl_t"))).over(Window.partitionBy("video_id"))
    seen = both.withColumns({"tl_seen": last, "tl_end": end})
    found = seen.filter((F.col("tl_ask") == 1) & F.col("tl_seen").isNotNull() & (F.col("tl_t") <= F.col("tl_end")))
    return found.select("video_id", F.col("tl_t").alias("at"), *[F.col(f"tl_seen.{c}").alias(c) for c in fields])


def chapter_midpoints(chapters: DataFrame) -> DataFrame:
    """``video_id, pos, at`` of chapters (``video_id, pos, t, duration``, the last a text or null) in document order.

    The last chapter ends at the duration if that lies behind its start, else a minute on.
    """
    order = Window.partitionBy("video_id").orderBy("pos")
    end = parse_timestamp(F.col("duration"))
    close = F.when(end > F.col("t"), end).otherwise(F.col("t") + LAST_CHAPTER)
    following = F.coalesce(F.lead("t").over(order), close)
    return chapters.filter(F.col("t").isNotNull()).select("video_id", "pos", ((F.col("t") + following) / 2).alias("at"))


def read_chapters(spark, path: str) -> DataFrame:
    """``video_id, pos, t, duration`` of a chapters file (JSON with ``chapters`` and ``duration_string``)."""
    schema = "chapters array<struct<t:double,title:string>>, duration_string string"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.lit(path).alias("video_id"), F.posexplode("chapters").alias("pos", "c"), F.col("duration_string").alias("duration")).select(
        "video_id", F.col("pos").cast("long").alias("pos"), "c.t", "duration"
    )


def distinct_times(times: Column) -> Column:
    return F.array_sort(F.array_distinct(times))
