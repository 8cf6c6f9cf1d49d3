"""Vectorised 64-bit polynomial hashes of byte and word windows.

A prefix sum of ``value[i] * base**i`` (modulo 2**64) gives the hash of any window as a difference of two
entries, shifted back by the inverse power of its start.  Two independent bases give 128 bits where equality
of hashes has to stand for equality of contents.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LANES = 2
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), so that all bits of a hash can serve as bucket numbers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _lane(lane: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(7919 + lane)
    table = rng.integers(0, 2**64, 256, dtype=U)
    base = int(rng.integers(2**62, 2**64, dtype=U)) | 5
    return table, base


_TABLES, _BASES = zip(*(_lane(i) for i in range(LANES)))
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(lane: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of a lane's base (or of its inverse)."""
    key = (lane, inverse)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        step = np.full(size, _INVERSES[lane] if inverse else _BASES[lane], dtype=U)
        step[0] = 1
        have = np.cumprod(step, dtype=U)
        if size <= 1 << 20:
            _POWERS[key] = have
    return have[:n]


def prefix(values: np.ndarray, lane: int) -> np.ndarray:
    """``n + 1`` prefix sums of ``values * base**i``; ``values`` are 64-bit."""
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(lane, len(values)), dtype=U, out=out[1:])
    return out


def window(sums: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the windows ``[start, end)`` of what ``prefix`` summed."""
    back = powers(lane, len(sums), inverse=True)
    return (sums[end] - sums[start]) * back[start]


def byte_prefix(data: np.ndarray, lane: int) -> np.ndarray:
    return prefix(_TABLES[lane][data], lane)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an Arrow string column and the ``n + 1`` offsets of its rows; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def release() -> None:
    """Gives a worker's freed memory back to the system: workers stay alive beside the JVM long after their task."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


class Words:
    """The words (runs of bytes other than white space) of the rows of a text column, as flat arrays.

    ``first[r] .. first[r + 1]`` are the words of row ``r``; ``hashes[lane]`` are mixed 64-bit word hashes.
    Bytes are hashed in segments, so that a very long text needs no more working memory than a short one.
    """

    SEGMENT = 1 << 18

    def __init__(self, column, lanes: int = 1, lower: bool = False) -> None:
        buf, offs = text_buffer(column)
        n = len(buf)
        solid = ~_SPACE[buf]
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        inner = offs[1:-1]
        before[inner[inner < n]] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        after[inner[(inner > 0)] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        del solid, before, after
        self.first = np.searchsorted(starts, offs)
        self.hashes = [np.empty(len(starts), dtype=U) for _ in range(lanes)]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            buf = table[buf]
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + self.SEGMENT)))
            at, to = int(starts[a]), int(ends[b - 1])
            s, e = starts[a:b] - at, ends[a:b] - at
            for lane in range(lanes):
                h = window(byte_prefix(buf[at:to], lane), s, e, lane)
                self.hashes[lane][a:b] = mix(h + U(0x9E3779B97F4A7C15) * (e - s).astype(U))
            a = b

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, start: np.ndarray, size: int, lane: int) -> np.ndarray:
    """Mixed hashes of ``size`` consecutive words from each of ``start``, in segments."""
    out = np.empty(len(start), dtype=U)
    step = 1 << 17
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + step)))
        at, to = int(start[a]), int(start[b - 1]) + size
        s = start[a:b] - at
        out[a:b] = mix(window(prefix(hashes[at:to], lane), s, s + size, lane))
        a = b
    return out
