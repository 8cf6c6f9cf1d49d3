"""Presence exchange: which of a block's keys also occur in other blocks.

Documents are dealt into blocks of a bounded number of bytes by a hash.  A block sends its sorted distinct keys, cut into
messages by ranges of the key; a range's node answers with one byte a key, in the same order.  A key crosses the network
at most once a block however often it occurs, so a key that a third of all rows hold is no heavier than any other, and
no pair of rows is ever made.  Blocks recompute their keys from their texts, so the answers need no row references, and
any lost task can be run again with the same result.

*Levels.*  Messages have to grow in proportion to the text, not to blocks times ranges.  So a node takes messages of at most
``FAN`` senders and there are at most ``FAN`` ranges a step: beyond that the ranges are narrowed level by level.  A node of
an upper level merges the keys of its senders (equal ones become one, with a weight) and passes them on in narrower
ranges; answers go back the same way and are dealt out again.  A block sends at most ``FAN`` messages, whatever the size of the
table and whatever ``spark.sql.shuffle.partitions`` says, and there are as many levels as ``log(blocks) / log(FAN)``.

A message may carry a note, which comes back with its answer: what a block has learnt in one round and needs in the next.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.hashing import release

U = np.uint64
MESSAGE = "tl_path long, tl_from long, tl_keys binary, tl_note binary"
REPLY = "tl_from long, tl_path long, tl_marks binary, tl_note binary"
#: Bytes of text in a block and behind the keys of a last range; senders and ranges of a node.
BLOCK_BYTES, RANGE_BYTES, FAN = 4 << 20, 16 << 20, 512
#: Bits of a shortened key beyond the number of its last range.
SPARE_BITS = 32


@dataclass(frozen=True)
class Shape:
    """How many blocks there are, how many ranges a level divides each range into, and how many levels."""

    blocks: int
    ranges: int
    levels: int
    fan: int = FAN

    @classmethod
    def of(cls, size: int, least: int, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES, fan: int = FAN) -> Shape:
        """For ``size`` bytes of text; ``least`` blocks at least, so that all tasks have work."""
        blocks, last = max(least, -(-size // block_bytes)), max(1, -(-size // range_bytes))
        levels = 1
        while fan**levels < max(blocks, last):
            levels += 1
        ranges = 1
        while ranges**levels < last:
            ranges += 1
        return cls(blocks, ranges, levels, fan)

    @property
    def last(self) -> int:
        """Ranges of the last level."""
        return self.ranges**self.levels

    @property
    def bits(self) -> int:
        return min(64, SPARE_BITS + (self.last - 1).bit_length())


def partitions(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(name: str, taken) -> str:
    """``name``, or the first variant of it that no column of ``taken`` has (names compare without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def block_of(key, text, blocks: int):
    """A row's block; it depends on id and text, so rows that share a null id are spread as well."""
    return F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("long")


def shape_of(docs: DataFrame, text_col: str, **options) -> Shape:
    """The shape for a table's texts, by their bytes."""
    size = docs.agg(F.sum(F.octet_length(docs[text_col]).cast("long"))).first()[0] or 0
    return Shape.of(size, partitions(docs.sparkSession), **options)


def blocked(docs: DataFrame, id_col: str, text_col: str, shape: Shape, carry: list[str] | None = None) -> DataFrame:
    """``(tl_block, tl_id, tl_text, tl_carry)`` dealt by block.

    The texts are shuffled once, and every round reads that shuffle.
    """
    key, text = docs[id_col], docs[text_col]
    extra = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(
        block_of(key, text, shape.blocks).alias("tl_block"),
        key.alias("tl_id"),
        text.alias("tl_text"),
        extra.alias("tl_carry"),
    )
    return rows.repartition(partitions(docs.sparkSession), "tl_block")


def ordered(table: pa.Table) -> pa.Table:
    """The rows of a block in an order that doesn't depend on how the shuffle delivered them."""
    return table.sort_by([("tl_id", "ascending"), ("tl_text", "ascending")]) if table.num_rows > 1 else table


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers: lower bytes as they are, the rest as a bit vector of steps (Elias-Fano)."""
    n = len(values)
    if not n:
        return b""
    base = values[0]
    steps = values - base
    span = int(steps[-1])
    low = min(range(8), key=lambda k: 8 * k + (span >> (8 * k)) / n)
    ones = np.zeros((span >> (8 * low)) + n, dtype=np.uint8)
    ones[(steps >> U(8 * low)).astype(np.int64) + np.arange(n)] = 1
    lows = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]
    return bytes([low]) + int(n).to_bytes(8, "little") + int(base).to_bytes(8, "little") + lows.tobytes() + np.packbits(ones).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    low, n, base = blob[0], int.from_bytes(blob[1:9], "little"), int.from_bytes(blob[9:17], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :low] = np.frombuffer(blob, np.uint8, n * low, 17).reshape(n, low)
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=17 + n * low)))[:n] - np.arange(n)
    return (out.reshape(-1).view("<u8") | (high.astype(U) << U(8 * low))) + U(base)


def code_of(counts: np.ndarray) -> np.ndarray:
    """Counts as one byte: themselves up to 128, then eight steps an octave (up to 7 million); larger counts never have smaller codes."""
    large = np.floor(8 * np.log2(np.maximum(counts, 128) / 128.0))
    return np.where(counts <= 128, counts, np.minimum(255, 128 + large)).astype(np.uint8)


def count_of(codes: np.ndarray) -> np.ndarray:
    """The least count that a code stands for."""
    codes = codes.astype(np.int64)
    return np.where(codes <= 128, codes, np.ceil(128 * 2.0 ** ((codes - 128) / 8))).astype(np.int64)


class Short:
    """Keys of one lane, shortened to ``Shape.bits``; a key's mark says in about how many blocks it occurs."""

    @staticmethod
    def sent(keys: list[np.ndarray], shape: Shape) -> list[np.ndarray]:
        short = keys[0] >> U(64 - shape.bits)
        return [short[np.append(True, short[1:] != short[:-1])] if len(short) else short]

    @staticmethod
    def place(keys: list[np.ndarray], sent: list[np.ndarray], shape: Shape) -> np.ndarray:
        return np.searchsorted(sent[0], keys[0] >> U(64 - shape.bits))

    @staticmethod
    def head(keys: list[np.ndarray], shape: Shape) -> np.ndarray:
        return keys[0] >> U(shape.bits - 32)

    @staticmethod
    def pack(keys: list[np.ndarray]) -> bytes:
        return pack_sorted(keys[0])

    @staticmethod
    def unpack(blob: bytes) -> list[np.ndarray]:
        return [unpack_sorted(blob)]

    @staticmethod
    def answer(batches: list[list[np.ndarray]], weights: list[np.ndarray]) -> list[np.ndarray]:
        merged, counts, places = merge(batches, weights)
        marks = code_of(counts)
        return [marks[p] for p in places]


class Pairs(Short):
    """Keys of two lanes, 128 bits; marks as those of ``Short``."""

    @staticmethod
    def sent(keys, shape):
        return keys

    @staticmethod
    def place(keys, sent, shape):
        return np.arange(len(keys[0]))

    @staticmethod
    def head(keys, shape):
        return keys[0] >> U(32)

    @staticmethod
    def pack(keys):
        return b"".join(k.astype("<u8").tobytes() for k in keys)

    @staticmethod
    def unpack(blob):
        return list(np.frombuffer(blob, "<u8").reshape(2, -1))


def merge(batches: list[list[np.ndarray]], weights: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of all batches, the sum of their weights, and each batch's places among them."""
    lanes = [np.concatenate(x) for x in zip(*batches, strict=True)]
    order = np.argsort(lanes[0], kind="stable") if len(lanes) == 1 else np.lexsort(lanes[::-1])
    lanes = [x[order] for x in lanes]
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for x in lanes:
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    counts = np.add.reduceat(np.concatenate(weights)[order], at) if len(at) else np.zeros(0, np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return [x[at] for x in lanes], counts, np.split(place, np.cumsum([len(b[0]) for b in batches])[:-1])


def _path(head: np.ndarray, shape: Shape, level: int) -> np.ndarray:
    """The range of a level that the upper 32 bits of a key fall in."""
    return (head * U(shape.ranges**level)) >> U(32)


def _pack(kind, keys: list[np.ndarray], weights: np.ndarray | None) -> bytes:
    if weights is None:
        return b"\0" + kind.pack(keys)
    return b"\1" + len(weights).to_bytes(8, "little") + code_of(weights).tobytes() + kind.pack(keys)


def _unpack(kind, blob: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    if blob[:1] == b"\0":
        keys = kind.unpack(blob[1:])
        return keys, np.ones(len(keys[0]), dtype=np.int64)
    n = int.from_bytes(blob[1:9], "little")
    return kind.unpack(blob[9 + n :]), count_of(np.frombuffer(blob, np.uint8, n, 9))


def _table(schema: str, *columns) -> pa.Table:
    names, kinds = zip(*(f.split() for f in schema.split(", ")), strict=True)
    return pa.table([pa.array(c, pa.int64() if k == "long" else pa.binary()) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def _cut(kind, keys: list[np.ndarray], shape: Shape, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall in, and where each begins."""
    path = _path(kind.head(keys, shape), shape, level)
    at = np.flatnonzero(np.append(True, path[1:] != path[:-1])) if len(path) else np.zeros(0, np.int64)
    return path[at].astype(np.int64), np.append(at, len(path))


def messages(kind, block: int, keys: list[np.ndarray], shape: Shape, note: bytes | None = None) -> pa.Table:
    """A block's messages; ``keys`` are parallel arrays, sorted and distinct.  A note goes with the first one."""
    keys = kind.sent(keys, shape)
    paths, at = _cut(kind, keys, shape, 1)
    blobs = [_pack(kind, [k[a:b] for k in keys], None) for a, b in zip(at[:-1], at[1:])]
    if note is not None and not len(paths):
        paths, blobs = np.array([block % shape.ranges]), [_pack(kind, [k[:0] for k in keys], None)]
    notes = [note] + [None] * (len(paths) - 1) if len(paths) else []
    return _table(MESSAGE, paths, [block] * len(paths), blobs, notes)


def marks(kind, replies: pa.Table, keys: list[np.ndarray], shape: Shape) -> np.ndarray:
    """The marks of a block's sorted keys, from the answers to ``messages``."""
    sent = kind.sent(keys, shape)
    paths, at = _cut(kind, sent, shape, 1)
    where = dict(zip(paths.tolist(), range(len(paths)), strict=True))
    out = np.zeros(len(sent[0]), dtype=np.uint8)
    for path, found in zip(replies["tl_path"].to_pylist(), replies["tl_marks"].to_pylist(), strict=True):
        if found:
            k = where[path]
            out[at[k] : at[k + 1]] = np.frombuffer(found, np.uint8)
    return out[kind.place(keys, sent, shape)]


def note(replies: pa.Table) -> bytes | None:
    """The note that came back."""
    return next((n for n in replies["tl_note"].to_pylist() if n is not None), None)


def _answer(kind):
    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("tl_from")
        batches, weights = zip(*(_unpack(kind, b) for b in table["tl_keys"].to_pylist()), strict=True)
        found = kind.answer(list(batches), list(weights))
        return _table(REPLY, table["tl_from"].to_pylist(), table["tl_path"].to_pylist(), [f.tobytes() for f in found], table["tl_note"].to_pylist())

    return answer


def _forward(kind, shape: Shape, level: int):
    """A node's messages to the next level: the keys of its senders as one batch."""

    def forward(table: pa.Table) -> pa.Table:
        node = table["tl_node"][0].as_py()
        batches, weights = zip(*(_unpack(kind, b) for b in table["tl_keys"].to_pylist()), strict=True)
        keys, counts, _ = merge(list(batches), list(weights))
        paths, at = _cut(kind, keys, shape, level + 1)
        blobs = [_pack(kind, [k[a:b] for k in keys], counts[a:b]) for a, b in zip(at[:-1], at[1:])]
        return _table(MESSAGE, paths, [node] * len(paths), blobs, [None] * len(paths))

    return forward


def _backward(kind, shape: Shape, level: int):
    """The next level's answers dealt out to a node's senders."""

    def backward(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(REPLY, [], [], [], [])
        table = table.sort_by("tl_from")
        batches, weights = zip(*(_unpack(kind, b) for b in table["tl_keys"].to_pylist()), strict=True)
        keys, _, places = merge(list(batches), list(weights))
        paths, at = _cut(kind, keys, shape, level + 1)
        where = dict(zip(paths.tolist(), range(len(paths)), strict=True))
        out = np.zeros(len(keys[0]), dtype=np.uint8)
        for path, found in zip(replies["tl_path"].to_pylist(), replies["tl_marks"].to_pylist(), strict=True):
            k = where[path]
            out[at[k] : at[k + 1]] = np.frombuffer(found, np.uint8)
        return _table(REPLY, table["tl_from"].to_pylist(), table["tl_path"].to_pylist(), [out[p].tobytes() for p in places], table["tl_note"].to_pylist())

    return backward


def lean(fn: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``fn``, which gives its memory back after each group."""

    def one(table: pa.Table) -> pa.Table:
        out = fn(table)
        release()
        return out

    return one


def lean_pair(fn: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left, right)
        release()
        return out

    return two


def send(rows: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """The messages that ``fn`` makes of each block."""
    return rows.groupBy("tl_block").applyInArrow(lean(fn), MESSAGE)


def resolve(sent: DataFrame, kind, shape: Shape, level: int = 1) -> DataFrame:
    """The answers to all messages."""
    if level == shape.levels:
        return sent.groupBy("tl_path").applyInArrow(lean(_answer(kind)), REPLY)
    met = sent.withColumn("tl_node", F.floor(F.col("tl_from") / shape.fan).cast("long"))
    nodes = met.groupBy("tl_path", "tl_node")
    up = nodes.applyInArrow(lean(_forward(kind, shape, level)), MESSAGE)
    down = resolve(up, kind, shape, level + 1).withColumn("tl_over", F.floor(F.col("tl_path") / shape.ranges).cast("long"))
    return nodes.cogroup(down.groupBy("tl_over", "tl_from")).applyInArrow(lean_pair(_backward(kind, shape, level)), REPLY)


def with_replies(rows: DataFrame, answers: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn(block rows, their replies)`` for each block."""
    return rows.groupBy("tl_block").cogroup(answers.groupBy("tl_from")).applyInArrow(lean_pair(fn), schema)


def distinct_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ``(first, second)``, how often each occurs, and for each input its place among them."""
    (f, s), times, places = merge([[first, second]], [np.ones(len(first), dtype=np.int64)])
    return f, s, times, places[0]
