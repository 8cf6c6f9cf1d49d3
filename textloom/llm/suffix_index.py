"""Byte-level substring deduplication with a logarithmic family of suffix arrays.

Every ``length``-byte string that starts at two places is found exactly, and each byte that it covers is removed.

* *Sampled suffixes.* Each start ``i`` owns the minimizer ``m(i)``: the leftmost smallest hashed ``GRAM``-gram among
  the ``REACH`` next ones.  Equal strings have equal minimizers at equal distance, so only suffixes at minimizers are
  indexed, each standing for the run of starts that own it.
* *Suffix arrays.* A suffix is kept under a 16-byte name: the fingerprint of the prefix that all its starts share,
  then that of its whole extent.  Sorted names are a suffix array in which suffixes with a long common prefix
  are neighbours; a common prefix of 8 bytes of names means a long match, of 16 a full one.
* *Logarithmic family.* A bucket of names takes one batch (a block of documents) after the other: the batch is
  merge-scanned against every level, matches are marked on both sides, and levels of equal order are merged, so
  that a name is moved as often as the logarithm of the number of batches.
* Starts whose suffix matches only in part, at the edges of matches, are decided one by one under 128-bit names of
  the whole string, in one more exchange.

Edge cases: null counts as empty; shorter texts are kept whole; repeated rows and ids are separate rows; an empty
table gives an empty result.  Removal works on UTF-8 bytes and may cut a character, so kept text is binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.llm import exchange as X
from textloom.llm.hashing import U, byte_prefix, mix, text_buffer, window
from textloom.llm.substring_dedup import to_arrow

LENGTH = 400
REACH, GRAM = 128, 12
SEGMENT = 1 << 18
#: Marks: the prefix occurs in another batch; so does the whole extent; so does the prefix with another extent.
PREFIX, EXTENT, MIXED = 1, 2, 4


class LogarithmicFamily:
    """Suffix arrays (sorted 16-byte names) of orders 0, 1, 2, ...; two of equal order merge into one of the next."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # order, names, marks' places
        self.marks = np.zeros(0, dtype=np.uint8)

    @staticmethod
    def _ranges(names: np.ndarray, batch: np.ndarray):
        head = batch.view("S8").reshape(-1, 2)[:, 0]
        low, high = np.zeros((2, len(batch), 2), dtype="S8")
        low[:, 0], high[:, 0], high[:, 1] = head, head, b"\xff" * 8
        low, high = low.reshape(-1).view("S16"), high.reshape(-1).view("S16")
        return (
            np.searchsorted(names, low, "left"),
            np.searchsorted(names, high, "right"),
            np.searchsorted(names, batch, "left"),
            np.searchsorted(names, batch, "right"),
        )

    def add(self, batch: np.ndarray) -> None:
        """Scan a sorted batch against every level, then take it in."""
        base = len(self.marks)
        own = np.zeros(len(batch), dtype=np.uint8)
        for _, names, places in self.levels:
            a, b, c, d = self._ranges(names, batch)
            own |= np.where(b > a, PREFIX, 0).astype(np.uint8)
            own |= np.where(d > c, EXTENT, 0).astype(np.uint8)
            own |= np.where(b - a > d - c, MIXED, 0).astype(np.uint8)
            wide, same = np.zeros((2, len(names) + 1), dtype=np.int64)
            np.add.at(wide, a, 1)
            np.add.at(wide, b, -1)
            np.add.at(same, c, 1)
            np.add.at(same, d, -1)
            wide, same = np.cumsum(wide[:-1]), np.cumsum(same[:-1])
            found = np.where(wide > 0, PREFIX, 0) | np.where(same > 0, EXTENT, 0) | np.where(wide > same, MIXED, 0)
            self.marks[places] |= found.astype(np.uint8)
        self.marks = np.concatenate([self.marks, own])
        self.levels.append((0, batch, np.arange(base, base + len(batch))))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            order, new, at = self.levels.pop()
            _, old, was = self.levels.pop()
            self.levels.append((order + 1, *self._merge(old, was, new, at)))

    @staticmethod
    def _merge(old, was, new, at):
        to = np.searchsorted(old, new, "right") + np.arange(len(new))
        stay = np.ones(len(old) + len(new), dtype=bool)
        stay[to] = False
        names, places = np.empty(len(stay), dtype="S16"), np.empty(len(stay), dtype=np.int64)
        names[to], names[stay], places[to], places[stay] = new, old, at, was
        return names, places


def names_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.stack([first, second], axis=1).astype(">u8").reshape(-1).view("S16")


class Names(X.Pairs):
    """Names as keys; a key's mark says whether its prefix and its extent occur in other batches."""

    @staticmethod
    def answer(batches, weights):
        family = LogarithmicFamily()
        own = []
        for (k, f), w in zip(batches, weights, strict=True):
            family.add(names_of(k, f))
            twin = np.zeros(len(k) + 1, dtype=bool)
            twin[1:-1] = k[1:] == k[:-1]
            # A batch that was merged from several blocks has met some of its names there.
            own.append(np.where(w > 1, EXTENT, 0) | np.where(twin[1:] | twin[:-1], MIXED, 0))
        marks = family.marks | np.concatenate(own).astype(np.uint8)
        return np.split(marks, np.cumsum([len(w) for w in weights])[:-1])


class _Block:
    """A block's bytes and sampled suffixes, the same on every pass."""

    def __init__(self, table: pa.Table, length: int) -> None:
        self.table, self.length = X.ordered(table), length
        self.buf, self.offs = text_buffer(self.table["tl_text"])
        self.valid = np.zeros(len(self.buf), dtype=bool)
        for at, to in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True):
            if to - at >= length:
                self.valid[at : to - length + 1] = True
        parts = [self._suffixes(a) for a in range(0, len(self.buf), SEGMENT)]
        self.low, self.high, k, f = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U))
        self.prefix, self.extent, self.times, self.place = X.distinct_pairs(k, f)

    def _suffixes(self, a: int):
        length = self.length
        start = np.flatnonzero(self.valid[a : a + SEGMENT])
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        data = self.buf[a : a + int(start[-1]) + length]
        sums = byte_prefix(data, 0)
        at = np.arange(len(data) - GRAM + 1)
        grams = mix(window(sums, at, at + GRAM, 0))
        least = (grams & ~U(0xFFFFFF)) | at.astype(U)
        step = 1
        while step < REACH:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        owner = (least[start] & U(0xFFFFFF)).astype(np.int64)
        new = np.ones(len(start), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        low, high, at = start[first], start[np.append(first[1:], len(start)) - 1], owner[first]
        k = mix(window(sums, at, at + length - REACH + 1, 0))
        f = mix(window(byte_prefix(data, 1), low, high + length, 1))
        f = mix(f ^ ((at - low).astype(U) << U(32)) ^ (high - low).astype(U))
        return low + a, high + a, k, f

    def status(self, replies: pa.Table, shape: X.Shape) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct suffix: does its whole extent occur again; must its starts be looked at one by one."""
        marks = X.marks(Names, replies, [self.prefix, self.extent], shape)
        twin = np.zeros(len(marks) + 1, dtype=bool)
        twin[1:-1] = self.prefix[1:] == self.prefix[:-1]
        return (self.times > 1) | (marks & EXTENT > 0), twin[1:] | twin[:-1] | (marks & MIXED > 0)

    def strings(self, mixed: np.ndarray):
        """The starts of one suffix of each kind in ``mixed``, and the distinct 128-bit names of their strings."""
        rep = np.zeros(len(self.prefix), dtype=np.int64)
        rep[self.place[::-1]] = np.arange(len(self.place))[::-1]
        rep = np.sort(rep[mixed])
        low, n = self.low[rep], self.high[rep] - self.low[rep] + 1
        start = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        a, b = np.empty((2, len(start)), dtype=U)
        for at in range(0, len(self.buf), SEGMENT):
            i, j = np.searchsorted(start, [at, at + SEGMENT])
            if j > i:
                to = int(start[j - 1]) + self.length
                s = start[i:j]
                base = int(s[0])
                for out, lane in ((a, 0), (b, 1)):
                    out[i:j] = mix(window(byte_prefix(self.buf[base:to], lane), s - base, s - base + self.length, lane))
        return start, X.distinct_pairs(a, b)


def _send_suffixes(length: int, shape: X.Shape):
    def send(table: pa.Table) -> pa.Table:
        block = _Block(table, length)
        return X.messages(Names, table["tl_block"][0].as_py(), [block.prefix, block.extent], shape)

    return send


def _send_strings(length: int, shape: X.Shape):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, length)
        full, mixed = block.status(right, shape)
        _, (a, b, _, _) = block.strings(mixed)
        note = np.packbits(np.concatenate([full, mixed])).tobytes()
        return X.messages(X.Pairs, left["tl_block"][0].as_py(), [a, b], shape, note)

    return send


def _finish(length: int, shape: X.Shape, schema: pa.Schema, texts: bool):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, length)
        n = len(block.prefix)
        full, mixed = np.unpackbits(np.frombuffer(X.note(right), np.uint8), count=2 * n).astype(bool).reshape(2, n)
        start, (a, b, times, place) = block.strings(mixed)
        again = ((X.marks(X.Pairs, right, [a, b], shape) > 1) | (times > 1))[place]
        edge = np.zeros(len(block.buf) + 1, dtype=np.int32)
        whole = full[block.place]
        for at, to in ((block.low[whole], block.high[whole] + length), (start[again], start[again] + length)):
            np.add.at(edge, at, 1)
            np.add.at(edge, to, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        offs = block.offs
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = offs[:-1][np.diff(offs) > 0]
        opens[inner] = gone[inner]
        count = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int32)])[offs])
        removed, spans = count(gone), count(opens)
        kept = block.buf[~gone].tobytes()
        to = np.cumsum(np.diff(offs) - removed)
        at = np.concatenate([[0], to[:-1]]) if len(to) else to
        pieces = [kept[i:j] for i, j in zip(at.tolist(), to.tolist(), strict=True)]
        out = {
            "tl_id": block.table["tl_id"],
            "n_bytes": pa.array(np.diff(offs), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in pieces], pa.string()),
        }
        if texts:
            out |= {"kept": pa.array(pieces, pa.binary()), "tl_carry": block.table["tl_carry"]}
        return pa.table(out).cast(schema)

    return finish


def remove_long_matches(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    keep_bytes: bool = False,
    carry: list[str] | None = None,
    shape: X.Shape | None = None,
) -> DataFrame:
    """One row a document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256``.

    With ``keep_bytes`` also ``kept`` (binary) and ``tl_carry``, a struct of the columns in ``carry``.
    """
    if length < 2 * REACH + GRAM:
        raise ValueError(f"length must be at least {2 * REACH + GRAM} bytes")
    shape = shape or X.shape_of(docs, text_col)
    rows = X.blocked(docs, id_col, text_col, shape, carry)
    found = X.resolve(X.send(rows, _send_suffixes(length, shape)), Names, shape)
    exact = X.resolve(X.with_replies(rows, found, _send_strings(length, shape), X.MESSAGE), X.Pairs, shape)
    fields = [rows.schema["tl_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    if keep_bytes:
        fields += [T.StructField("kept", T.BinaryType()), rows.schema["tl_carry"]]
    schema = T.StructType(fields)
    done = X.with_replies(rows, exact, _finish(length, shape, to_arrow(schema), keep_bytes), schema)
    return done.withColumnRenamed("tl_id", id_col)
