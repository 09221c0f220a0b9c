"""MPEG audio media columns: write and read frame streams, exactly and without a codec.

``probe`` reads a stream as a player would: it skips an ID3v2 tag, takes off an ID3v1 tag after the frames, finds frame
headers (resynchronising where a header isn't followed by another or by the end), reads the variable-bitrate table of
a Xing, Info or VBRI frame, verifies the CRC-16 of protected frames of all three layers, and gives exact durations as a
count of samples with the offset of every frame. Frames of free format get their length from the next frame header. ``store`` carries bytes in the main-data area of silent, CRC-protected MPEG-1
Layer III frames of 48 kHz mono at a variable bitrate (each frame lasts 24 ms); ``load`` reads them back.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import python_path

# Fixed values of ISO 11172-3 and 13818-3: bitrates in kbit/s by (version 1?, layer), sampling rates by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> tuple[int, ...]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return tuple(table)


_CRC = _crc_table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


# Fixed values of ISO 11172-3 (tables 3-B.2a to d) and 13818-3: bits of each subband's allocation in Layer II.
ALLOCATION = {
    "high": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "low": (4,) * 2 + (3,) * 10,
    "half": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _bits_protected(h: Header, data: bytes) -> int | None:
    """Bits behind the checksum that it covers in Layers I and II, from a frame's bytes behind the checksum."""
    channels = 1 if h.mono else 2
    if h.layer == 1:
        return 128 if channels == 1 else 4 * (32 + h.bound)
    each = h.bitrate // 1000 // channels
    if h.version != 3:
        table = ALLOCATION["half"]
    elif each in (32, 48):
        table = ALLOCATION["low"][: 12 if h.rate == 32000 else 8]
    else:
        table = ALLOCATION["high"][: 30 if h.rate != 48000 and each >= 96 else 27]
    bits, at, picked = int.from_bytes(data[:64], "big"), 0, 0
    total = 8 * len(data[:64])
    for band, n in enumerate(table):
        for channel in range(channels):
            if channel and band >= h.bound:  # one allocation for both channels, a selection for each
                picked += bool(value)
                continue
            if at + n > total:
                return None
            value = bits >> total - at - n & (1 << n) - 1
            at += n
            picked += bool(value)
    return at + 2 * picked


def crc16_bits(data: bytes, count: int, start: int = 0xFFFF) -> int:
    """The checksum over the first ``count`` bits."""
    c = start
    for b in data[: count // 8]:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    for i in range(count % 8):
        bit = data[count // 8] >> 7 - i & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    length: int  # 0 in free format
    samples: int
    pad: int = 0
    bound: int = 32  # the first subband that the channels of joint stereo share

    @property
    def side(self) -> int:
        """Bytes of side information in Layer III."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@functools.lru_cache(4096)
def header(four: bytes) -> Header | None:
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or index == 15 or rate == 3 or four[3] & 3 == 2:
        return None
    bitrate, hertz, pad = BITRATES[version == 3, layer][index] * 1000, RATES[version][rate], four[2] >> 1 & 1
    if layer == 1:
        length, samples = (12 * bitrate // hertz + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * bitrate // hertz + pad
    bound = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 and layer != 3 else 32
    slot = pad * 4 if layer == 1 else pad
    return Header(version, layer, not four[1] & 1, bitrate, hertz, four[3] >> 6 == 3, length if index else 0, samples, slot, bound)


def _free_length(data: bytes, at: int, h: Header, end: int) -> int:
    """The length of a frame of free format without its padding: up to the next header of the same stream."""
    nxt = data.find(data[at : at + 2], at + 24, end)
    while 0 <= nxt < at + 8192:
        other = header(data[nxt : nxt + 4])
        if other and not other.length and (other.rate, other.mono) == (h.rate, h.mono):
            return nxt - at - h.pad
        nxt = data.find(data[at : at + 2], nxt + 1, end)
    return 0


def _checked(data: bytes, at: int, h: Header) -> bool:
    """Whether a protected frame's checksum is right."""
    if h.layer == 3:
        own = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side])
    else:
        body = data[at + 6 : at + 134]
        count = _bits_protected(h, body)
        if count is None or count > 8 * len(body):
            return False
        own = crc16_bits(data[at + 2 : at + 4] + body, 16 + count)
    return own == int.from_bytes(data[at + 4 : at + 6], "big")

@dataclass
class Stream:
    """What ``probe`` finds. ``offsets`` are those of audio frames; ``table`` is the variable-bitrate header, if any."""

    samples: int = 0
    rate: int = 0
    offsets: list[int] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    bodies: list[int] = field(default_factory=list)
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: dict | None = None

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as a fraction."""
        return self.samples, self.rate or 1

    def seek_by_table(self, sample: int) -> int | None:
        """The offset that a player without the frame offsets goes to: the Xing table's hundredth of the stream."""
        toc = (self.table or {}).get("toc")
        if not toc or not 0 <= sample < self.samples or "bytes" not in self.table:
            return None
        return self.table["at"] + toc[sample * 100 // self.samples] * self.table["bytes"] // 256

    def seek(self, sample: int) -> int | None:
        """The offset of the frame that holds a sample (all frames of one length in samples)."""
        if not self.offsets or not 0 <= sample < self.samples:
            return None
        return self.offsets[sample * len(self.offsets) // self.samples]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    end, at, tags = min(len(data), 10 + _syncsafe(data[6:10])), 10, {}
    while at + 10 <= end and data[at]:
        size = _syncsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, body = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0), tags


def _table(data: bytes, at: int, h: Header) -> dict | None:
    x = at + 4 + 2 * h.protected + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, x = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        out: dict = {"kind": "xing", "at": at}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[x : x + 4], "big")
                x += 4
        if flags & 4:
            out["toc"] = data[x : x + 100]
        return out
    if data[at + 36 : at + 40] == b"VBRI":
        return {"kind": "vbri", "bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
    return None


def probe(data: bytes) -> Stream:
    """Read a stream; empty or foreign bytes give a stream without frames, their bytes counted as skipped."""
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if data[-128:-125] == b"TAG" and end - at >= 128:
        end -= 128
    locked, free = False, 0
    while at < end:
        h = header(data[at : at + 4])
        if h and not h.length:
            free = free if locked and free else _free_length(data, at, h, end)
            h = replace(h, length=free + h.pad) if free else None
        after = at + h.length if h else 0
        # A frame that reaches over the tag's start, up to the end or another frame, holds these bytes: there's no tag.
        if end < after <= len(data) and (after == len(data) or header(data[after : after + 4])):
            end = len(data)
        if not h or after > end or not (locked or after == end or header(data[after : after + 4])):
            nxt = data.find(b"\xff", at + 1, end)
            out.skipped += (nxt if nxt >= 0 else end) - at
            at, locked = (nxt if nxt >= 0 else end), False
            continue
        locked = True
        body = at + 4
        if h.protected:
            good = _checked(data, at, h)
            out.crc_good += good
            out.crc_bad += not good
            body += 2
        if not out.offsets and out.table is None and (table := _table(data, at, h)):
            out.table = table
        else:
            out.offsets.append(at)
            out.lengths.append(h.length)
            out.bodies.append(body + h.side)
            out.samples += h.samples
            out.rate = out.rate or h.rate
        at = after
    if end < len(data):
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    return out


_SIDE = 17
_ROOM = {index: kbits * 3 - 6 - _SIDE for index, kbits in enumerate(BITRATES[True, 3]) if kbits}


@functools.cache
def _frame_start(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    return head + crc16(head[2:] + bytes(_SIDE)).to_bytes(2, "big") + bytes(_SIDE)


def store(payload: bytes) -> bytes:
    """``payload`` as a tagged variable-bitrate stream; its length stands in a tag."""
    text = b"\3payload_bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\0\0" + text
    tag = b"ID3\4\0\0" + bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0)) + tag
    full, start = _ROOM[14], _frame_start(14)
    cut = len(payload) // full * full
    frames = [start + payload[i : i + full] for i in range(0, cut, full)]
    if rest := payload[cut:]:
        index = next(i for i, room in _ROOM.items() if room >= len(rest))
        frames.append((_frame_start(index) + rest).ljust(BITRATES[True, 3][index] * 3, b"\0"))
    lengths = [len(f) for f in frames]
    first, total = 192, 192 + sum(lengths)
    toc, seen = bytearray(100), first
    bounds = [seen := seen + n for n in [0, *lengths]] if lengths else [first]
    for i in range(100):
        toc[i] = min(255, bounds[i * len(lengths) // 100] * 256 // total)
    xing = (_frame_start(5) + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)).ljust(first, b"\0")
    return b"".join([tag, xing, *frames])


def load(media: bytes) -> tuple[bytes, Stream]:
    stream = probe(media)
    body = b"".join([media[b : o + n] for b, o, n in zip(stream.bodies, stream.offsets, stream.lengths, strict=True)])
    return body[: int(stream.tags.get("payload_bytes", len(body)))], stream


def feature(stream: Stream) -> str:
    samples, rate = stream.seconds
    seeks = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    table = stream.table or {}
    return f"frames={len(stream.offsets)};duration={samples}/{rate};crc_good={stream.crc_good};crc_bad={stream.crc_bad};skipped={stream.skipped};vbr_frames={table.get('frames')};vbr_bytes={table.get('bytes')};seek_crc32={seeks}"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)), len(raw)


def _per_row(df: DataFrame, id_col: str, value, schema: str, types: list[pa.DataType], row) -> DataFrame:
    python_path(df.sparkSession)
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = zip(*map(row, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[id_col, *names])

    return df.select(id_col, value).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {schema}")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_bytes long, media binary): each text in UTF-8, padded by zero bytes to a positive multiple of 64,
    as a stream. A null text counts as empty; null ids, repeated rows and ties pass through; no rows give no rows."""

    def row(text: str) -> tuple:
        payload, n = padded(text)
        return n, store(payload)

    return _per_row(docs, id_col, F.coalesce(F.col(text_col), F.lit("")), "n_bytes bigint, media binary", [pa.int64(), pa.binary()], row)


def inspect(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Read a media column: (``id_col``, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, samples,
    sample_rate, seek_offsets array<long>, feature). A null stream counts as empty; bytes that aren't MPEG audio give
    no frames and are counted as skipped in ``feature``."""

    def row(data: bytes) -> tuple:
        payload, stream = load(bytes(data))
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), *stream.seconds, stream.offsets, feature(stream)

    schema = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, samples bigint, sample_rate bigint, seek_offsets array<bigint>, feature string"
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
    return _per_row(media, id_col, F.coalesce(F.col(media_col), F.lit(b"")), schema, types, row)


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text and read the stored bytes back in the same pass; the rules are those of ``store_texts``."""

    def row(text: str) -> tuple:
        payload, n = padded(text)
        media = store(payload)
        back, stream = load(media)
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream)

    schema = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _per_row(docs, id_col, F.coalesce(F.col(text_col), F.lit("")), schema, types, row)
