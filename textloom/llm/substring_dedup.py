"""Substring deduplication over words with difference-cover anchors.

Every window of ``window`` words that occurs at least twice is found exactly, and each word that such a window
covers is removed:

1. *Anchors.* A perfect difference set modulo ``period`` fixes cover positions: for any two offsets there is one
   shift below ``period`` that puts both on a cover position.  Hashing ``window - period + 1`` words at cover
   positions alone (5 of 21) therefore makes two copies of a window share an aligned anchor, wherever they start.
   Anchors are exchanged between blocks by a 32-bit remainder of their hash: a chance hit costs work, not results.
2. *Extension.* Only windows around an anchor that occurs again are candidates.  They are extended to the full
   window and exchanged under a 128-bit hash, which decides.

Rows and edge cases: a null text has no words; a text shorter than the window is kept whole; repeated rows and
repeated ids are separate rows; an empty table gives an empty result; columns named like the internal ones are
carried untouched.  ``kept_text`` is the text itself (null for null) where nothing is removed; elsewhere the words that stay,
each with the white space before it.  Rows equal in id and text are dealt to the same block.
"""

from __future__ import annotations

import hashlib
import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.llm import exchange as X
from textloom.llm.hashing import Words, windows

WINDOW = 35
#: The perfect difference set of order 4, and its period.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def anchor_places(words: Words, size: int, period: int, cover) -> np.ndarray:
    """Word positions (in the block) of the anchors whose ``size`` words lie within one row."""
    first = words.first
    n = int(first[-1])
    place = np.arange(n, dtype=np.int64) - np.repeat(first[:-1], np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    on = np.zeros(period, dtype=bool)
    on[list(cover)] = True
    return np.flatnonzero(on[place % period] & (left >= size))


class _Block:
    """A block's words, anchors and candidate windows, the same on every pass."""

    def __init__(self, table: pa.Table, window: int, lanes: int) -> None:
        self.table = X.ordered(table)
        self.window = window
        self.words = Words(self.table["tl_text"], lanes)
        self.size = window - PERIOD + 1
        self.at = anchor_places(self.words, self.size, PERIOD, COVER)
        hashed = windows(self.words.hashes[0], self.at, self.size, 0)
        self.anchors, self.back, self.times = np.unique(hashed, return_inverse=True, return_counts=True)

    def hot(self, replies: pa.Table, shape: X.Shape) -> np.ndarray:
        """For each distinct anchor: does it occur again."""
        return (X.marks(X.Short, replies, [self.anchors], shape) > 1) | (self.times > 1)

    def candidates(self, hot: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold an anchor which occurs again."""
        first = self.words.first
        n = int(first[-1])
        seen = np.zeros(n + 1, dtype=np.int32)
        seen[self.at[hot[self.back]] + 1] = 1
        np.cumsum(seen, out=seen)
        start = np.flatnonzero(np.repeat(first[1:], np.diff(first)) - np.arange(n) >= self.window)
        return start[seen[start + PERIOD] > seen[start]]

    def keys(self, start: np.ndarray):
        a, b = (windows(self.words.hashes[i], start, self.window, i) for i in (0, 1))
        return X.distinct_pairs(a, b)


def _send_anchors(window: int, shape: X.Shape):
    def send(table: pa.Table) -> pa.Table:
        block = _Block(table, window, 1)
        return X.messages(X.Short, table["tl_block"][0].as_py(), [block.anchors], shape)

    return send


def _send_windows(window: int, shape: X.Shape):
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, window, 2)
        hot = block.hot(right, shape)
        a, b, _, _ = block.keys(block.candidates(hot))
        return X.messages(X.Pairs, left["tl_block"][0].as_py(), [a, b], shape, np.packbits(hot).tobytes())

    return send


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def without(text: bytes, gone: np.ndarray) -> bytes:
    """The text less the words in ``gone``, each with the white space before it; what stays keeps its white space."""
    out, end = [], 0
    for word, dropped in zip(_WORD.finditer(text), gone.tolist(), strict=True):
        if not dropped:
            out.append(text[end : word.end()] if out else word.group())
        end = word.end()
    return b"".join(out)


def _finish(window: int, shape: X.Shape, schema: pa.Schema, texts: bool):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left, window, 2)
        hot = np.unpackbits(np.frombuffer(X.note(right), np.uint8), count=len(block.anchors)).astype(bool)
        start = block.candidates(hot)
        a, b, times, place = block.keys(start)
        again = ((X.marks(X.Pairs, right, [a, b], shape) > 1) | (times > 1))[place]
        first = block.words.first
        edge = np.zeros(int(first[-1]) + 1, dtype=np.int32)
        np.add.at(edge, start[again], 1)
        np.add.at(edge, start[again] + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        removed = np.concatenate([[0], np.cumsum(gone)])[first]
        removed = np.diff(removed)
        digests, kept_texts = [], []
        for row, text in enumerate(block.table["tl_text"]):
            text = text.as_py()
            raw = (text or "").encode()
            kept = raw.split()
            if removed[row]:
                kept = compress(kept, ~gone[first[row] : first[row + 1]])
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            if texts:
                kept_texts.append(without(raw, gone[first[row] : first[row + 1]]).decode() if removed[row] else text)
        out = {
            "tl_id": block.table["tl_id"],
            "n_words": pa.array(np.diff(first), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if texts:
            out |= {"kept_text": pa.array(kept_texts, pa.string()), "tl_carry": block.table["tl_carry"]}
        return pa.table(out).cast(schema)

    return finish


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    keep_text: bool = False,
    carry: list[str] | None = None,
    shape: X.Shape | None = None,
) -> DataFrame:
    """One row a document: ``id_col, n_words, n_removed, kept_sha256``.

    With ``keep_text`` also ``kept_text`` and ``tl_carry``, a struct of the columns in ``carry``.
    """
    if window < PERIOD:
        raise ValueError(f"window must be at least {PERIOD} words")
    shape = shape or X.shape_of(docs, text_col)
    rows = X.blocked(docs, id_col, text_col, shape, carry)
    anchors = X.resolve(X.send(rows, _send_anchors(window, shape)), X.Short, shape)
    full = X.resolve(X.with_replies(rows, anchors, _send_windows(window, shape), X.MESSAGE), X.Pairs, shape)
    fields = [rows.schema["tl_id"], *(T.StructField(c, k) for c, k in (("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType())))]
    if keep_text:
        fields += [T.StructField("kept_text", T.StringType()), rows.schema["tl_carry"]]
    schema = T.StructType(fields)
    done = X.with_replies(rows, full, _finish(window, shape, to_arrow(schema), keep_text), schema)
    return done.withColumnRenamed("tl_id", id_col)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
