"""Token ids as Parquet list columns: dictionary or delta encoded, with controlled row groups, pages and page indexes.

Files hold ``doc_id, part, row, n_tokens, token_ids`` in ascending id order (null first), one file (``part``) a range of ids.
``row`` is the row's number in its file and settles the order of equal ids.  Metadata reads touch the first four columns only;
reads by id use the sorted ids' statistics and page indexes.

Edge cases: a null text has the end id alone; equal ids are separate rows, ordered by text; an empty table gives an
empty store and result; further columns aren't stored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.exchange import partitions
from textloom.llm.hashing import release
from textloom.llm.tokens import ChunkEncoder, sliced, with_end

ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 1 << 20, 2000
LAYOUT = "doc_id {kind}, part int, row long, n_tokens long, token_ids array<int>"


def encode_rows(path: str, end: int):
    """Batches of ``(doc_id, text)`` in order to batches of the store's layout."""

    def encode(batches):
        encoder, row, part = ChunkEncoder.of(path), 0, TaskContext.get().partitionId()
        for batch in sliced(batches, "text"):
            ids, offs = with_end(*encoder.encode(batch["text"]), end)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    pa.array(np.full(n, part), pa.int32()),
                    pa.array(np.arange(row, row + n), pa.int64()),
                    pa.array(np.diff(offs), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.view(np.int32))),
                ],
                names=["doc_id", "part", "row", "n_tokens", "token_ids"],
            )
            row += n
        release()

    return encode


def write_tokens(
    docs: DataFrame,
    out: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int = 2,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
) -> None:
    """Tokenise every whole text with the vocabulary file ``tokenizer`` and write the store at ``out``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = rows.mapInArrow(encode_rows(tokenizer, end), LAYOUT.format(kind=kind))
    writer = coded.write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes)
    writer = writer.option("parquet.page.row.count.limit", PAGE_ROWS).option("compression", "zstd")
    writer = writer.option("parquet.enable.dictionary#token_ids.list.element", str(encoding == "dictionary").lower())
    if encoding == "delta":
        writer = writer.option("parquet.writer.version", "PARQUET_2_0")
    writer.parquet(out)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, n_tokens, start, file`` without reading any token."""
    rows = spark.read.parquet(path).select("doc_id", "part", "row", "n_tokens", F.col("_metadata.file_name").alias("file"))
    return _starts(rows, rows).drop("part", "row")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, token_ids`` of the ids from ``low`` to ``high``; row groups and pages outside aren't read."""
    rows = spark.read.parquet(path).select("doc_id", "token_ids")
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    return rows if high is None else rows.filter(F.col("doc_id") <= high)


def _starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of earlier files (one row a file is summed) and of earlier rows of the file."""
    files = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tl_sum"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(F.col("part").alias("tl_part"), F.coalesce(F.sum("tl_sum").over(earlier), F.lit(0)).alias("tl_base"))
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("tl_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    joined = placed.join(files, placed["part"] == files["tl_part"])
    return joined.withColumn("start", F.col("tl_base") + F.col("tl_before")).drop("tl_base", "tl_before", "tl_part")


def _digest(batches):
    for batch in batches:
        lists = batch["token_ids"]
        flat, offs = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
        crcs = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["part"], batch["row"], pa.array(np.diff(offs), pa.int64()), pa.array(crcs, pa.int64())],
            names=["doc_id", "part", "row", "n_tokens", "ids_crc32"],
        )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` computed from the tokens that the store holds."""
    stored = spark.read.parquet(path).select("doc_id", "part", "row", "token_ids")
    kind = stored.schema["doc_id"].dataType.simpleString()
    read = stored.mapInArrow(_digest, f"doc_id {kind}, part int, row long, n_tokens long, ids_crc32 long")
    sizes = spark.read.parquet(path).select("n_tokens", "part")
    return _starts(read, sizes).select("doc_id", "start", "n_tokens", "ids_crc32")
