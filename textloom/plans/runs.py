"""Whole runs, composed of the operators: images, paged documents, recordings and the newest files of a folder.

Recognition happens before (`files.run_recogniser`): a run gets its rows.  Results have one row an input in the order asked for,
``file, place, text, lines, redactions, image_tokens, text_tokens, error``; unless told otherwise a run appends its totals to the ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.tokens import extension, image_tokens, text_tokens
from textloom.operators import frames as video
from textloom.operators import layout, ledger, pagetext, payload
from textloom.operators.geometry import usable_lines
from textloom.operators.redact import redact, total
from textloom.plans.api import Options, ledger_path, rules_of, video_tool
from textloom.session import checkpointed
from textloom.sources import files

RESULT = ["file", "place", "text", "lines", "redactions", "image_tokens", "text_tokens", "error"]


def laid_out(lines: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """Lines in reading order with ``n``, indented ``text`` and ``fenced``, and their document key.

    Fixed-width runs are found once.  Lines of a second pass (``doc_id, run_id, n, ...``) take the place of a run's lines if there are as
    many, and are rendered with the runs of the first.
    """
    ordered = layout.reading_order(lines, keyed=True)
    runs = layout.monospace_runs(ordered)
    if second is not None:
        ordered = layout.replace_runs(ordered, runs, second)
    return layout.render(ordered, runs)


def _redacted(df: DataFrame, rules) -> DataFrame:
    """``text`` redacted, with ``redactions`` and ``text_tokens``; null texts stay null."""
    done = redact(df, "text", rules or [])
    fine = F.col("text").isNotNull()
    return done.withColumns(
        {"text": F.col("redacted"), "redactions": F.when(fine, F.col("redactions")), "text_tokens": F.when(fine, text_tokens(F.col("redacted")))}
    ).drop("redacted")


def _noted(results: DataFrame, mode: str, options: Options, path: str | None) -> DataFrame:
    """The results, with the run's totals in the ledger unless the options or a run without any success say otherwise."""
    done = checkpointed(results.select(*RESULT))
    if options.no_ledger:
        return done
    kinds = done.select(F.lit(mode).alias("kind"), "image_tokens", "text_tokens", total(F.col("redactions")).alias("redactions"), "error")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), ledger.TIME_FORMAT)
    columns = [F.col(c) for c in ("mode", "inputs", "image_tokens", "text_tokens", "redactions")]
    ledger.append(ledger.run_totals(kinds).select(*ledger.entry(now, *columns)), path or ledger_path())
    return done


def image_run(spark: SparkSession, images: DataFrame, lines: DataFrame, options: Options, path: str | None = None, second: DataFrame | None = None) -> DataFrame:
    """Images (``file, place, width, height, error``) with their lines (``doc_id`` is the file): usable lines, laid out, redacted, counted.

    An image without lines has an empty text; one with an error has nothing else.
    """
    rules = rules_of(spark, options)
    rendered = laid_out(usable_lines(lines, options.min_confidence), second)
    read = payload.line_array(layout.fence_pieces(rendered), layout.document_key(rendered), rules, [layout.joined_pieces().alias("text")])
    fine = F.col("error").isNull()
    df = images.join(read.select(F.col("doc_id").alias("file"), "text", "lines"), "file", "left")
    df = df.withColumns({"text": F.when(fine, F.coalesce("text", F.lit(""))), "image_tokens": F.when(fine, image_tokens(F.col("width"), F.col("height")))})
    return _noted(_redacted(df, rules), "image", options, path)


def document_run(spark: SparkSession, pages: DataFrame, lines: DataFrame, options: Options, path: str | None = None) -> DataFrame:
    """Paged documents: ``doc_id, place, n, locked, width, height, layer_text`` and recognised lines with ``doc_id`` and ``page``.

    A page whose layer accounts for what was read gives its layer, any other its recognised lines, laid out; pages are joined under their
    numbers and the whole is redacted.  ``options.pages`` selects pages, ``options.force_ocr`` leaves layers out.
    """
    chosen = pagetext.select_pages(pages, *(options.pages or (None, None)))
    bad = chosen.filter(F.col("error").isNotNull()).groupBy(F.col("doc_id").alias("file"), "place").agg(F.max("error").alias("error"))
    good = chosen.filter(F.col("error").isNull())
    read = usable_lines(lines, options.min_confidence).withColumnRenamed("page", "n")
    lanes = pagetext.choose_lanes(good.select("doc_id", "n", "layer_text"), read.select("doc_id", "n", "line_ix", "text"), ["doc_id", "n"], ["line_ix"], options.force_ocr)
    page = F.struct("doc_id", "n")
    scanned = read.join(lanes.filter("lane = 'scan'").select("doc_id", "n"), ["doc_id", "n"], "left_semi")
    rendered = laid_out(scanned.withColumn("doc_id", F.to_json(page)).drop("n"))
    scans = layout.fenced_text(rendered).select(F.col("doc_id").alias("tl_page"), F.col("text").alias("tl_scan"))
    layers = pagetext.layer_lines(lanes.filter("lane = 'text'").select("doc_id", "n", "layer_text").withColumnRenamed("n", "page"), ["doc_id", "page"])
    layer_texts = layout.fenced_text(layers.select(F.to_json(F.struct("doc_id", F.col("page").alias("n"))).alias("doc_id"), "n", "text", "fenced"))
    layer_texts = layer_texts.select(F.col("doc_id").alias("tl_of"), F.col("text").alias("tl_layer"))
    each = lanes.select("doc_id", "n", "lane").withColumn("tl_key", F.to_json(page))
    each = each.join(scans, F.col("tl_key") == F.col("tl_page"), "left").join(layer_texts, F.col("tl_key") == F.col("tl_of"), "left")
    each = each.withColumn("text", F.coalesce(F.when(F.col("lane") == "text", F.col("tl_layer")).otherwise(F.col("tl_scan")), F.lit("")))
    whole = pagetext.page_text(each.select("doc_id", "n", "text")).withColumnRenamed("doc_id", "file")
    tokens = good.groupBy(F.col("doc_id").alias("file"), "place").agg(F.sum(image_tokens(F.col("width"), F.col("height"))).alias("image_tokens"))
    done = tokens.join(whole, "file", "left").unionByName(bad, allowMissingColumns=True)
    done = _redacted(done, rules_of(spark, options)).withColumn("lines", F.lit(None).cast("string"))
    return _noted(done, "pdf", options, path)


def recording_run(spark: SparkSession, frames: DataFrame, lines: DataFrame, options: Options, path: str | None = None) -> DataFrame:
    """Transcripts of frames (``video_id, frame_ix, time, width, height, error, score``) whose lines (``video_id, frame_ix``) are laid out first.

    Frames are those nearest before ``options.frame_times`` if given, else scene changes; ``options.max_frames`` at most.
    """
    if options.frame_times is not None:
        asked = spark.createDataFrame([(t,) for t in options.frame_times], "at double")
        times = frames.select("video_id").distinct().join(F.broadcast(asked))  # a row a video and time asked for
        chosen = video.cap(video.at_times(frames, times).drop("at").distinct(), options.max_frames)
    else:
        chosen = video.scenes(frames, options.scene, options.max_frames)
    key = F.to_json(F.struct("video_id", "frame_ix"))
    rendered = laid_out(usable_lines(lines, options.min_confidence).withColumn("doc_id", key).drop("video_id", "frame_ix"))
    texts = layout.fenced_text(rendered).select(F.col("doc_id").alias("tl_of"), "text")
    read = chosen.withColumn("tl_key", key).join(texts, F.col("tl_key") == F.col("tl_of"), "left").drop("tl_key", "tl_of")
    return video_tool(spark, read.withColumn("text", F.when(F.col("error").isNull(), F.coalesce("text", F.lit("")))), options, path)


def newest_inputs(spark: SparkSession, folder: str, options: Options) -> tuple[DataFrame, DataFrame]:
    """The newest ``options.count`` inputs of a folder (``file, place``): images and paged documents, for ``image_run`` and ``document_run``."""
    found = files.newest_files(spark, folder, options.count)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("modificationTime"), "path")  # options.count rows
    placed = found.select(F.col("path").alias("file"), (F.row_number().over(order) - 1).cast("long").alias("place"))
    paged = extension(F.col("file")) == "pdf"
    return placed.filter(~paged), placed.filter(paged)


def envelope(results: DataFrame) -> DataFrame:
    """One JSON value of a run's results, in the order asked for, error rows included."""
    return payload.envelope(results, "place")
