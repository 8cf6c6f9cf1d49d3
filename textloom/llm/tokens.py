"""Batch tokenisation through the tokenizers library, each distinct chunk of text encoded once.

A text is cut before white space that follows a printable ASCII character or a Latin-1 letter.  Neither vocabulary has
a pre-token that holds a character of that kind followed by white space, so encoding the chunks apart gives the ids
of the whole text.  Chunks are counted once per slice by Arrow's dictionary encoding and looked up in a store that a
Python worker keeps, under 128 bits of hash; what is new is encoded in one call, joined by a special token.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm.hashing import _SPACE, U, byte_prefix, mix, release, text_buffer, window

SLICE_BYTES = 4 << 20
STORE_CHUNKS = 1_300_000
BATCH_BYTES, KEPT_BATCHES = 4 << 20, 4
JOINED, GROUP = 2000, 32_000
HASH_BYTES = 1 << 18

_SAFE = np.zeros(256, dtype=bool)
_SAFE[0x21:0x7F] = True


def tokenizer_path(name: str) -> str:
    """Where the named public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def chunk_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the chunks begin, rows' starts included."""
    at = np.flatnonzero(_SPACE[buf[1:]]) + 1
    before = buf[at - 1]
    safe = _SAFE[before]
    accented = (before >= 0x80) & (at >= 2) & (buf[np.maximum(at - 2, 0)] == 0xC3)
    begins = np.zeros(len(buf), dtype=bool)
    begins[at[safe | accented]] = True
    begins[offs[:-1][np.diff(offs) > 0]] = True
    return np.flatnonzero(begins)


def sliced(batches, column: str):
    """Batches of a bounded number of bytes of text; freed memory goes back to the system now and then."""
    for n, batch in enumerate(_cut(batches, column), 1):
        yield batch
        if n % KEPT_BATCHES == 0:
            release()


def _cut(batches, column: str):
    for batch in batches:
        a = size = 0
        lengths = pc.binary_length(batch[column]).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            size += n
            if size >= BATCH_BYTES:
                yield batch.slice(a, i + 1 - a)
                a, size = i + 1, 0
        if a < len(lengths):
            yield batch.slice(a)


def ragged(values: np.ndarray, offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``rows`` of a ragged array, and their offsets."""
    sizes = np.diff(offs)[rows]
    to = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(to[-1]) + np.repeat(offs[rows] - to[:-1], sizes)
    return values[place], to


def chunk_hashes(buf: np.ndarray, offs: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the rows of a ragged byte array, in segments of a bounded number of bytes."""
    out = np.empty(len(offs) - 1, dtype=U)
    a = 0
    while a < len(out):
        b = min(len(out), max(a + 1, int(np.searchsorted(offs, offs[a] + HASH_BYTES, "right")) - 1))
        at = offs[a : b + 1] - offs[a]
        out[a:b] = window(byte_prefix(buf[offs[a] : offs[b]], lane), at[:-1], at[1:], lane)
        a = b
    return out


class ChunkEncoder:
    """Ids of text columns, as the library's ``encode(text, add_special_tokens=False)`` gives them."""

    _held: dict[str, ChunkEncoder] = {}

    @classmethod
    def of(cls, path: str, store_chunks: int = STORE_CHUNKS, slice_bytes: int = SLICE_BYTES) -> ChunkEncoder:
        """The worker's encoder for a vocabulary file; a smaller store and smaller slices need less memory and more time."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        held = cls._held[path]
        held.store_chunks, held.slice_bytes = store_chunks, slice_bytes
        return held

    def __init__(self, path: str) -> None:
        self.store_chunks, self.slice_bytes = STORE_CHUNKS, SLICE_BYTES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark_id = max(added)
        self.mark = added[self.mark_id].content
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((2, 0), dtype=U)
        self.place = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.offs = np.zeros(1, dtype=np.int64)

    def _encode_new(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of distinct chunks, encoded in groups, as the library's own results are large."""
        groups = [self._encode_group([c.decode("utf-8", "replace") for c in values[i : i + GROUP].to_pylist()]) for i in range(0, len(values), GROUP)]
        return np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])

    def _encode_group(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        odd = [i for i, c in enumerate(chunks) if self.mark in c]
        plain = [c if self.mark not in c else "" for c in chunks]
        lists = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        parts, sizes = [], []
        for enc, one in zip(self.tokenizer.encode_batch_fast([self.mark.join(x) for x in lists], add_special_tokens=False), lists, strict=True):
            ids = np.array(enc.ids, dtype=np.uint32)
            cut = np.flatnonzero(ids == self.mark_id)
            if len(cut) != len(one) - 1:
                raise ValueError("a chunk's ids hold the joining token")
            sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
            parts.append(np.delete(ids, cut))
        ids, size = np.concatenate(parts), np.concatenate(sizes)
        if odd:
            at = np.concatenate([[0], np.cumsum(size)])
            each = [ids[at[i] : at[i + 1]] for i in range(len(size))]
            for i in odd:
                each[i] = np.array(self.tokenizer.encode(chunks[i], add_special_tokens=False).ids, dtype=np.uint32)
            ids, size = np.concatenate(each), np.array([len(e) for e in each])
        return ids, size

    def _look_up(self, values: pa.Array) -> np.ndarray:
        """Places in the store of distinct chunks; new ones are encoded and taken in."""
        _, offsets, data = values.buffers()
        offs = np.frombuffer(offsets, np.int64, len(values) + 1)
        buf = np.frombuffer(data, np.uint8)
        size = mix(np.diff(offs).astype(U))
        a, b = (mix(chunk_hashes(buf, offs, lane) + size) for lane in (0, 1))
        if self.keys.shape[1] + len(values) > self.store_chunks:
            self._clear()
        order = np.argsort(a)  # sorted needles are found several times faster
        at = np.empty(len(a), dtype=np.int64)
        at[order] = np.searchsorted(self.keys[0], a[order])
        near = np.minimum(at, max(0, self.keys.shape[1] - 1))
        hit = (self.keys[0][near] == a) & (self.keys[1][near] == b) if self.keys.shape[1] else np.zeros(len(a), dtype=bool)
        found = np.empty(len(a), dtype=np.int64)
        found[hit] = self.place[near[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            ids, sizes = self._encode_new(values.take(pa.array(new)))
            base = len(self.offs) - 1
            found[new] = base + np.arange(len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.offs = np.concatenate([self.offs, self.offs[-1] + np.cumsum(sizes)])
            keys = np.concatenate([self.keys, np.stack([a[new], b[new]])], axis=1)
            place = np.concatenate([self.place, found[new]])
            order = np.argsort(keys[0], kind="stable")
            self.keys, self.place = keys[:, order], place[order]
        return found

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a text column and the ``n + 1`` offsets of its rows."""
        buf, offs = text_buffer(column)
        parts, sizes = [], []
        row = 0
        while row < len(offs) - 1:
            to = max(row + 1, int(np.searchsorted(offs, offs[row] + self.slice_bytes, "right")) - 1)
            part, rows = buf[offs[row] : offs[to]], offs[row : to + 1] - offs[row]
            row = to
            if not len(part):
                sizes.append(np.zeros(len(rows) - 1, dtype=np.int64))
                continue
            starts = chunk_starts(part, rows)
            bounds = np.append(starts, len(part))
            chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(part))])
            coded = chunks.dictionary_encode()
            place = self._look_up(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
            ids, ends = ragged(self.ids, self.offs, place)
            parts.append(ids)
            sizes.append(np.diff(ends[np.searchsorted(starts, rows)]))
        flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)
        return flat, np.concatenate([[0], *([np.cumsum(np.concatenate(sizes))] if sizes else [])]).astype(np.int64)


def with_end(ids: np.ndarray, offs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` appended to each row."""
    return np.insert(ids, offs[1:], end).astype(np.uint32), offs + np.arange(len(offs))
