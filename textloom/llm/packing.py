"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Texts are tokenised where they are read and never moved: only one small row a piece (id, place, length, checksum) is
dealt to shards of a bounded number of pieces.  In a shard each piece goes where the sum over residual gaps of
the squared number of open sequences with that gap becomes smallest: into an open sequence, or a new one.  Ties go to
the smallest gap.  Pieces come longest first.

Only documents longer than a sequence are cut, from their end, so the first piece may be shorter.  Shards add at
most their last open sequences to the total.

Edge cases: a null or empty text is its end id alone; equal ids are separate documents; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import release
from textloom.llm.tokens import ChunkEncoder, sliced, with_end

CAPACITY, END = 2048, 0
SHARD_DOCS = 16_384
PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def cut_pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def to_pieces(path: str, capacity: int, end: int):
    def tokenise(batches):
        encoder = ChunkEncoder.of(path)
        for batch in sliced(batches, "text"):
            ids, offs = with_end(*encoder.encode(batch["text"]), end)
            ids = ids.astype("<u4", copy=False)
            rows, piece, start, length, crc = [], [], [], [], []
            for row, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                for k, (s, n) in enumerate(cut_pieces(b - a, capacity)):
                    rows.append(row)
                    piece.append(k)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(ids[a + s : a + s + n].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        release()

    return tokenise


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For lengths in the order they come: each one's sequence, its offset there, and the number of sequences."""
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    made = 0
    for i, n in enumerate(lengths.tolist()):
        if n == capacity:
            where[i], offset[i] = made, 0
            made += 1
            continue
        # Moving a sequence from gap g to g - n changes the sum by 2 (count[g - n] - count[g] + 1); a filled one leaves it.
        there = count[n:capacity]
        change = 2 * (count[: capacity - n] - there + 1)
        change[0] = 1 - 2 * there[0]
        change[there == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] <= 2 * count[capacity - n] + 1:
            gap = best + n
            at = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, made
            made += 1
        where[i], offset[i] = at, capacity - gap
        if gap > n:
            open_at[gap - n].append(at)
            count[gap - n] += 1
    return where, offset, made


def _pack(capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        shard = table["tl_shard"][0].as_py()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        where, offset, _ = sum_of_squares(table["length"].to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array(where + (shard << 40), pa.int64()))
        return table.append_column("offset", pa.array(offset, pa.int64())).drop_columns(["tl_shard"])

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard_docs))
    pieces = rows.mapInArrow(to_pieces(tokenizer, capacity, end), PIECES.format(kind=kind))
    dealt = pieces.withColumn("tl_shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("tl_shard").applyInArrow(_pack(capacity), PACKED.format(kind=kind))
