"""MPEG audio as a media column: a lossless carrier for bytes, and a scanner of any MPEG audio stream.

The carrier is a legal MPEG-1 Layer III stream (mono, 32 kHz): an ID3v2 tag with the payload's length, a frame with the
Xing table of a variable-bitrate stream, then silent frames that hold the payload as ancillary data, each protected by
its CRC.  Full frames have the highest bitrate and the last one the lowest that the rest fits in.

The scanner skips and reads tags (ID3v2, ID3v1), resynchronises on frame headers (a header counts if the next one is
in place or the stream ends there), reads Xing, Info and VBRI tables, verifies Layer III checksums, and gives the exact
duration as samples over rate and the offset of every frame.

Edge cases: a null or empty text is 64 zero bytes; broken frames are counted and skipped; bytes that aren't MPEG audio
give no frames; equal payloads give equal streams; repeated ids are separate rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.tokens import sliced
from textloom.session import scratch

ALIGN = 64
#: Fixed values of the MPEG audio standard: kbit/s by (version 1, layer) and (version 2 and 2.5, layer), index 1 to 14.
KBITS = {
    (1, 1): [32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
#: Samples a second of version 1 (halved in version 2, quartered in 2.5), CRC polynomial and start.
RATES = [44100, 48000, 32000]
CRC_POLY, CRC_START = 0x8005, 0xFFFF
#: The carrier's choices: version 1, layer III, 32 kHz, mono.
_RATE_INDEX, _MONO = 2, 3
_SIDE = 17


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ CRC_POLY if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = CRC_START
    for byte in data:
        c = (c << 8 & 0xFF00) ^ _CRC[c >> 8 ^ byte]
    return c


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    mono: bool
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


def _parse_header(word: int) -> Header | None:
    """A header of four bytes, or None if they can't be one (free-format streams aren't supported)."""
    version = {3: 1, 2: 2, 0: 2.5}.get(word >> 19 & 3)
    layer = 4 - (word >> 17 & 3)
    bits, rate = word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version is None or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    kbits = KBITS[(1 if version == 1 else 2, layer)][bits - 1]
    hertz = RATES[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    pad = word >> 9 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    return Header(version, layer, not word >> 16 & 1, kbits, hertz, word >> 6 & 3 == 3, length, samples)


_HEADERS: dict[int, Header | None] = {}


def header_at(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data):
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if word >> 21 != 0x7FF:
        return None
    key = word & 0xFFFFFEC0
    if key not in _HEADERS:
        _HEADERS[key] = _parse_header(word)
    return _HEADERS[key]


def _header_bytes(bits: int, protected: bool) -> bytes:
    return struct.pack(">I", 0x7FF << 21 | 3 << 19 | 1 << 17 | (not protected) << 16 | bits << 12 | _RATE_INDEX << 10 | _MONO << 6)


def _front(bits: int) -> bytes:
    """Header, checksum and empty side information of a carrier frame."""
    head = _header_bytes(bits, True)
    return head + struct.pack(">H", crc16(head[2:] + bytes(_SIDE))) + bytes(_SIDE)


_FRONTS = [_front(b) for b in range(1, 15)]
_ROOM = [144 * k * 1000 // RATES[_RATE_INDEX] - len(_FRONTS[0]) for k in KBITS[1, 3]]


def encode(payload: bytes) -> bytes:
    """The carrier stream of a payload."""
    room = _ROOM[-1]
    whole, rest = divmod(len(payload), room)
    frames = np.zeros((whole, room + len(_FRONTS[0])), dtype=np.uint8)
    frames[:, : len(_FRONTS[0])] = np.frombuffer(_FRONTS[-1], np.uint8)
    frames[:, len(_FRONTS[0]) :] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
    last = b""
    if rest:
        size = next(i for i, r in enumerate(_ROOM) if r >= rest)
        last = _FRONTS[size] + payload[whole * room :].ljust(_ROOM[size], b"\0")
    note = b"\x03payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(note)) + b"\0\0" + note
    tag = b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame
    head = _header_bytes(3, False) + bytes(_SIDE)
    size = 144 * KBITS[1, 3][2] * 1000 // RATES[_RATE_INDEX]
    total = size + frames.size + len(last)
    count = whole + bool(last)
    step = frames.shape[1]
    toc = bytes(min(255, 256 * (size + min(i * count // 100, whole) * step) // total) for i in range(100))
    table = head + b"Xing" + struct.pack(">III", 0xF, count, total) + toc + struct.pack(">I", 0)
    return tag + table.ljust(size, b"\0") + frames.tobytes() + last


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _unsync(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


@dataclass
class Scan:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    resyncs: int = 0
    bad_checksums: int = 0
    checked: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0


def _read_id3(data: bytes, scan: Scan) -> int:
    """Reads an ID3v2 tag at the start; where the audio begins."""
    if data[:3] != b"ID3" or len(data) < 10 or data[3] not in (3, 4):
        return 0
    end = min(len(data), 10 + _unsync(data[6:10]))
    at = 10
    while at + 10 <= end and data[at] != 0:
        size = _unsync(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        kind, value = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        at += 10 + size
        if kind[:1] == "T" and value:
            text = value[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8"), "replace").rstrip("\0")
            name, _, rest = text.partition("\0")
            scan.tags[f"TXXX:{name}" if kind == "TXXX" else kind] = rest if kind == "TXXX" else text
    return end


def _read_table(data: bytes, at: int, h: Header) -> dict | None:
    """The variable-bitrate table that a first frame may hold instead of sound."""
    x = at + 4 + 2 * h.protected + h.side
    kind = data[x : x + 4]
    if kind in (b"Xing", b"Info") and x + 8 <= at + h.length:
        flags, x, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": kind.decode()}
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                out[name] = list(data[x : x + size]) if bit == 4 else int.from_bytes(data[x : x + size], "big")
                x += size
        return out
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 58:
        total, frames = struct.unpack(">II", data[at + 46 : at + 54])
        return {"kind": "VBRI", "frames": frames, "bytes": total}
    return None


def scan_stream(data: bytes) -> Scan:
    """Tags, table, frame offsets and checks of a stream; frames with wrong checksums are left out."""
    scan = Scan()
    at, end = _read_id3(data, scan), len(data)
    # What looks like an ID3v1 tag is one if no frame covers its place: sound and ancillary data may hold any bytes.
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    covered = known = lost = False
    while at + 4 <= end and (at < tag or covered):
        h = header_at(data, at)
        fits = h is not None and at + h.length <= end
        if fits and (not known or at < tag < at + h.length):  # nothing vouches for this header or its end yet
            after = at + h.length
            following = header_at(data, after) if after + 4 <= end else None
            fits = after in (tag, end) or (following is not None and (following.version, following.layer, following.rate) == (h.version, h.layer, h.rate))
        if not fits:
            scan.resyncs += not lost
            known, lost = False, True
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        known, lost = True, False
        covered |= at < tag < at + h.length
        if not scan.offsets and scan.table is None and (table := _read_table(data, at, h)):
            scan.table = table
            at += h.length
            continue
        good = True
        if h.protected and h.layer == 3:
            scan.checked += 1
            stored = data[at + 4 : at + 6]
            good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == int.from_bytes(stored, "big") if any(data[at + 6 : at + 6 + h.side]) else stored == _quiet(data[at + 2 : at + 4], h.side)
            scan.bad_checksums += not good
        if good:
            scan.offsets.append(at)
            scan.headers.append(h)
        at += h.length
    if tag < end and not covered:
        fields = {"title": (3, 33), "artist": (33, 63), "album": (63, 93), "year": (93, 97)}
        scan.tags |= {f"ID3v1:{k}": data[tag + a : tag + b].split(b"\0")[0].decode("latin-1").strip() for k, (a, b) in fields.items()}
    return scan


_QUIET: dict[tuple[bytes, int], bytes] = {}


def _quiet(head: bytes, side: int) -> bytes:
    """The checksum of a frame whose side information is all zero."""
    if (head, side) not in _QUIET:
        _QUIET[head, side] = struct.pack(">H", crc16(head + bytes(side)))
    return _QUIET[head, side]


def payload_of(data: bytes, scan: Scan) -> bytes:
    """The payload that a carrier stream holds; an error if part of it is missing."""
    front = len(_FRONTS[0])
    held = b"".join([data[a + front : a + h.length] for a, h in zip(scan.offsets, scan.headers, strict=True)])
    size = int(scan.tags.get("TXXX:payload", len(held)))
    if size > len(held):
        raise ValueError(f"{len(held)} of {size} payload bytes left")
    return held[:size]


def feature(scan: Scan) -> str:
    """Exact duration, frames and a digest of the seek table, as JSON with sorted keys."""
    seek = np.array(scan.offsets, "<u8").tobytes()
    kinds = sorted({h.kbits for h in scan.headers})
    return json.dumps(
        {
            "frames": len(scan.offsets), "samples": scan.samples, "rate": scan.rate, "kbits": kinds, "table_frames": (scan.table or {}).get("frames"),
            "checked": scan.checked, "bad": scan.bad_checksums, "resyncs": scan.resyncs, "first": scan.offsets[0] if scan.offsets else None, "seek_crc32": zlib.crc32(seek),
        },
        sort_keys=True, separators=(",", ":"),
    )


STORE = "doc_id {kind}, n_bytes long, media binary"
SCANNED = "doc_id {kind}, samples long, rate int, seconds double, frames long, resyncs long, bad_checksums long, tags map<string,string>, seek array<long>"
DIGEST = "doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _store(batches):
    for batch in sliced(batches, "text"):
        sizes, media = [], []
        for text in batch["text"].to_pylist():
            raw = (text or "").encode()
            sizes.append(len(raw))
            media.append(encode(raw.ljust(max(1, -(-len(raw) // ALIGN)) * ALIGN, b"\0")))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str | None = None) -> DataFrame:
    """Writes ``doc_id, n_bytes, media`` at ``out`` (the shared folder if not given) and gives the stored table."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = out or scratch(docs.sparkSession, "audio")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows.mapInArrow(_store, STORE.format(kind=kind)).write.option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.parquet(out)


def _scan(batches):
    for batch in batches:
        scans = [scan_stream(m or b"") for m in batch["media"].to_pylist()]
        columns = [
            batch["doc_id"], pa.array([s.samples for s in scans], pa.int64()), pa.array([s.rate for s in scans], pa.int32()),
            pa.array([s.samples / s.rate if s.rate else 0.0 for s in scans], pa.float64()), pa.array([len(s.offsets) for s in scans], pa.int64()),
            pa.array([s.resyncs for s in scans], pa.int64()), pa.array([s.bad_checksums for s in scans], pa.int64()),
            pa.array([list(s.tags.items()) for s in scans], pa.map_(pa.string(), pa.string())), pa.array([s.offsets for s in scans], pa.list_(pa.int64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "samples", "rate", "seconds", "frames", "resyncs", "bad_checksums", "tags", "seek"])


def scan_media(stored: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Durations, checks, tags and seek offsets of any MPEG audio column."""
    rows = stored.select(stored[id_col].alias("doc_id"), stored[media_col].alias("media"))
    return rows.mapInArrow(_scan, SCANNED.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def _digests(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for data in batch["media"].to_pylist():
            scan = scan_stream(data)
            payload = payload_of(data, scan)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(scan))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["n_bytes"], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def digests(stored: DataFrame) -> DataFrame:
    """Digests of the payloads read back from stored streams, and the streams' features."""
    return stored.mapInArrow(_digests, DIGEST.format(kind=stored.schema["doc_id"].dataType.simpleString()))
