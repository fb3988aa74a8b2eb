"""Lossless sample storage in Ogg: page checksums, lacing values, logical streams, granule positions.

A payload of 8-bit samples is cut into packets of ``BLOCK`` samples that go to
``STREAMS`` logical streams in turn. Each stream starts with a header packet on
a page of its own; data pages interleave. A page's granule position is the
number of samples of its stream that are complete with that page.

The reader is general: it verifies each page's checksum, reassembles packets
from lacing values over page borders, keeps the streams apart by serial number,
finds lost pages by their sequence numbers and dates each packet from the
granule positions.

Defined results: null text is empty; its payload is 192 blanks. Equal texts
give equal files: serial numbers come from the payload's digest.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from codelathe.llm.common import buffers, opened, table, with_struct

UNIT = 192
BLOCK = 21 * UNIT
STREAMS = 2
RATE = 8000
MAGIC = b"PCM8\0\1"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_POSITION = (1 << 64) - 1
_HEAD = struct.Struct("<4sBBQIIIB")
_IDENT = struct.Struct("<6sHHII")
#: Each byte with its bits in reverse order: turns the mirrored CRC of zlib into the format's.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))

RESULT = T.StructType(
    [T.StructField(n, t) for n, t in (("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()))]
)


class OggError(ValueError):
    """A file that breaks the format."""


def page_crc(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, not mirrored, zero start, of a page whose checksum field is zero."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def page(serial: int, number: int, position: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, position, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


@dataclass
class StreamWriter:
    """Packs packets of one logical stream into pages."""

    serial: int
    number: int = 0
    position: int = 0
    lacing: bytearray = field(default_factory=bytearray)
    body: list[bytes] = field(default_factory=list)
    continued: bool = False
    complete: bool = False

    def add(self, packet: bytes, samples: int) -> list[bytes]:
        """Pages that the packet fills."""
        out, values, at = [], bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255]), 0
        while values:
            room = 255 - len(self.lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            self.lacing += now
            self.body.append(packet[at : at + size])
            at += size
            if not values:
                self.position += samples
                self.complete = True
            if len(self.lacing) == 255:
                out.append(self.flush())
                self.continued = bool(values)
        return out

    def flush(self, flags: int = 0) -> bytes:
        at = self.position if self.complete else NO_POSITION
        out = page(self.serial, self.number, at, flags | (CONTINUED if self.continued else 0), bytes(self.lacing), b"".join(self.body))
        self.number += 1
        self.lacing, self.body, self.continued, self.complete = bytearray(), [], False, False
        return out


def store(payload: bytes, streams: int = STREAMS, block: int = BLOCK) -> bytes:
    """The Ogg file of a payload."""
    seed = hashlib.sha256(payload).digest()
    first = int.from_bytes(seed[:4], "little")
    writers = [StreamWriter((first + c) & 0xFFFFFFFF) for c in range(streams)]
    out = []
    for c, w in enumerate(writers):
        out += w.add(_IDENT.pack(MAGIC, c, streams, block, RATE), 0)
        out.append(w.flush(FIRST))
    for n, at in enumerate(range(0, len(payload), block)):
        out += writers[n % streams].add(payload[at : at + block], min(block, len(payload) - at))
    out += [w.flush(LAST) for w in writers]
    return b"".join(out)


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int | None] = field(default_factory=list)  # granule positions, where the page tells them
    open: list[bytes] | None = None
    number: int = 0
    pages: int = 0
    closed: bool = False


def demultiplex(media: bytes) -> dict[int, Stream]:
    """Logical streams by serial number, in order of their first pages; raises OggError on any damage."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < _HEAD.size:
            raise OggError("cut page header")
        mark, version, flags, position, serial, number, crc, count = _HEAD.unpack_from(media, at)
        if mark != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        lacing = media[at + _HEAD.size : at + _HEAD.size + count]
        begin = at + _HEAD.size + count
        end = begin + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise OggError("cut page body")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError("second first page")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.closed or number != s.number:
            raise OggError("page out of sequence")
        if bool(flags & CONTINUED) != (s.open is not None):
            raise OggError("packet without its start or end")
        parts, s.open, at, done = s.open or [], None, end, len(s.packets)
        size, from_ = 0, begin
        for n, value in enumerate(lacing):
            size += value
            if value < 255 or n == count - 1:
                parts.append(media[from_ : from_ + size])
                from_, size = from_ + size, 0
                if value < 255:
                    s.packets.append(b"".join(parts))
                    s.ends.append(None)
                    parts = []
                else:
                    s.open = parts
        if len(s.packets) > done:
            s.ends[-1] = position
        elif position != NO_POSITION and lacing:
            raise OggError("position without a complete packet")
        s.number, s.pages, s.closed = number + 1, s.pages + 1, bool(flags & LAST)
    if any(not s.closed or s.open is not None for s in streams.values()):
        raise OggError("stream without its last page")
    return streams


def dated(stream: Stream) -> list[tuple[int, bytes]]:
    """(first sample, packet) of the data packets; positions count back from each page's granule position."""
    out: list[tuple[int, bytes]] = []
    end: int | None = None
    for packet, told in zip(reversed(stream.packets[1:]), reversed(stream.ends[1:]), strict=True):
        if told is not None:
            if end is not None and told != end:
                raise OggError("granule positions don't fit the packets")
            end = told
        end -= len(packet)
        out.append((end, packet))
    if end not in (None, 0):
        raise OggError("stream doesn't start at zero")
    return out[::-1]


@dataclass
class Restored:
    payload: bytes
    pages: int
    packets: int
    seconds: float


def restore(media: bytes) -> Restored:
    """The payload of a file that :func:`store` wrote, with its structure's figures."""
    streams = demultiplex(media)
    placed: list[tuple[int, bytes]] = []
    for s in streams.values():
        magic, channel, count, block, rate = _IDENT.unpack(s.packets[0])
        if magic != MAGIC or count != len(streams):
            raise OggError("unknown header packet")
        placed += [((start // block * count + channel) * block, packet) for start, packet in dated(s)]
    placed.sort(key=lambda x: x[0])
    end = 0
    for start, packet in placed:
        if start != end:
            raise OggError("gap between packets")
        end += len(packet)
    return Restored(b"".join([p for _, p in placed]), sum(s.pages for s in streams.values()), len(placed), end / RATE)


def padded(text: bytes) -> bytes:
    """The text with blanks up to a positive multiple of ``UNIT``."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def feature(found: Restored) -> str:
    """Duration, level, energy and zero crossings about the level of the samples read back."""
    x = np.frombuffer(found.payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    level = int((counts * np.arange(256)).sum()) / len(x)
    over = x > level
    crossings = int(np.count_nonzero(over[1:] != over[:-1]))
    spread = float((counts * (np.arange(256) - level) ** 2).sum() / len(x)) ** 0.5
    return f"seconds={found.seconds:.3f};pages={found.pages};packets={found.packets};mean={level:.3f};rms={spread:.3f};crossings={crossings}"


def described(text: bytes) -> tuple[int, int, str, int, int, str, str]:
    media = store(padded(text))
    found = restore(media)
    p = found.payload
    return len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(found)


def media(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` plus a struct with the stored file itself (``media``)."""
    kind = T.StructType([T.StructField("media", T.BinaryType())])

    def step(array: pa.Array) -> pa.StructArray:
        data, at = buffers(array)
        raw = data.tobytes()
        return pa.StructArray.from_arrays([pa.array([store(padded(raw[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())], ["media"])

    return with_struct(df, text, kind, lambda: step, "ogg")


def features(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` plus a struct of figures of the stored and re-read media."""

    def step(array: pa.Array) -> pa.StructArray:
        data, at = buffers(array)
        raw = data.tobytes()
        rows = [described(raw[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for i, f in enumerate(RESULT)], RESULT.names)

    return with_struct(df, text, RESULT, lambda: step, "ogg")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = features(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return opened(df, ["doc_id"], out)
