"""WARC archives in seekable Zstandard bundles.

Records are grouped in frames that decompress on their own. A bundle is its
frames, a skippable frame with the record map (record id to frame, offset and
length inside the decompressed frame) and a skippable frame with the seek table
of the Zstandard seekable format. A record is found by one look at the map and
one frame.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the
smallest page id is a response and the others revisit it. Bundles are rows of a
table (name and bytes) of bounded size; :func:`write_files` puts them into a
folder as files.

Defined results: null html is an empty payload. Rows with the same page id and
payload are responses both. A null id never is the smallest unless all are null;
then each is a response. A null url leaves the target header out.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.llm.common import shared_path, slices, table, tidied

LEAST = 100
#: Uncompressed bytes after which a frame ends, and after which a bundle ends.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Fixed values of the formats.
SKIPPABLE_MAP = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1
MAP_MAGIC = b"WMAP"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


class WarcError(ValueError):
    """An archive that breaks the format."""


@dataclass
class Record:
    page_id: int | None
    url: str | None
    payload: bytes
    digest: str
    size: int
    refers_to: int | None = None
    revisit: bool = False
    number: int = 0  # among records of a bundle with equal id and payload

    @property
    def record_id(self) -> str:
        return name_of(self.page_id, self.digest) + (f":{self.number}" if self.number else "")


def name_of(page_id: int | None, digest: str) -> str:
    """A record's identifier: pages may share an id, and then their payloads part them."""
    return f"urn:page:{'none' if page_id is None else page_id}:{digest}"


def page_of(name: str) -> int | None:
    tail = name.removeprefix("urn:page:").split(":")[0]
    return None if tail == "none" else int(tail)


def record_bytes(r: Record) -> bytes:
    block = HTTP_HEAD + (b"" if r.revisit else r.payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if r.revisit else 'response'}", f"WARC-Record-ID: <{r.record_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{r.digest}", f"WARC-Payload-Length: {r.size}"]
    if r.url is not None:
        head.append(f"WARC-Target-URI: {quote(r.url, safe=_URL_SAFE)}")
    if r.revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{name_of(r.refers_to, r.digest)}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and where the next one starts; payload and digest are held against each other."""
    split = data.find(b"\r\n\r\n", at)
    if split < 0 or not data.startswith(b"WARC/1.1\r\n", at):
        raise WarcError(f"no record at byte {at}")
    head = dict(line.split(": ", 1) for line in data[at:split].decode().split("\r\n")[1:])
    begin = split + 4
    end = begin + int(head["Content-Length"])
    block = data[begin:end]
    if len(block) != end - begin or data[end : end + 4] != b"\r\n\r\n":
        raise WarcError("cut record")
    http = block.find(b"\r\n\r\n")
    payload, revisit = block[http + 4 :], head["WARC-Type"] == "revisit"
    digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["WARC-Payload-Length"])
    if not revisit and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise WarcError("payload and digest differ")
    url = head.get("WARC-Target-URI")
    refers = page_of(head["WARC-Refers-To"][1:-1]) if revisit else None
    return Record(page_of(head["WARC-Record-ID"][1:-1]), None if url is None else unquote(url), payload, digest, size, refers, revisit), end + 4


class BundleWriter:
    """Collects records into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.frame_bytes = frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open = bytearray()
        self.total = 0
        self.seen: dict[str, int] = {}

    def add(self, r: Record) -> None:
        """Append a record; one with the identifier of an earlier one gets a number behind it."""
        name = name_of(r.page_id, r.digest)
        r.number = self.seen[name] = self.seen.get(name, -1) + 1
        data = record_bytes(r)
        self.index.append((r.record_id, len(self.frames), len(self.open), len(data)))
        self.open += data
        self.total += len(data)
        if len(self.open) >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            frame = self.pack.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.open = bytearray()

    def close(self) -> bytes:
        self.end_frame()
        names = MAP_MAGIC + zstandard.ZstdCompressor(level=3).compress(json.dumps(self.index).encode())
        held = struct.pack("<II", SKIPPABLE_MAP, len(names)) + names
        entries = [*self.sizes, (len(held), 0)]
        seek = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
        return b"".join(self.frames) + held + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


class BundleReader:
    """Random access to a bundle's records."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 17:
            raise WarcError("no seek table")
        count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEK_MAGIC or flags & 0x7C:
            raise WarcError("no seek table")
        width = 12 if flags & 0x80 else 8
        begin = len(data) - 9 - width * count
        if begin < 8 or struct.unpack_from("<II", data, begin - 8) != (SKIPPABLE_SEEK, 9 + width * count):
            raise WarcError("cut seek table")
        self.frames: list[tuple[int, int, int]] = []
        at = 0
        for n in range(count):
            packed, size = struct.unpack_from("<II", data, begin + width * n)
            self.frames.append((at, packed, size))
            at += packed
        if at != begin - 8:
            raise WarcError("seek table doesn't fit the frames")
        self.unpack = zstandard.ZstdDecompressor()

    def index(self) -> dict[str, tuple[int, int, int]]:
        """Record ids to (frame, offset, length)."""
        at, packed, _ = self.frames[-1]
        magic, size = struct.unpack_from("<II", self.data, at)
        body = self.data[at + 8 : at + 8 + size]
        if magic != SKIPPABLE_MAP or not body.startswith(MAP_MAGIC):
            raise WarcError("no record map")
        return {r: (f, o, n) for r, f, o, n in json.loads(self.unpack.decompress(body[4:]))}

    def frame(self, n: int) -> bytes:
        at, packed, size = self.frames[n]
        if not size:
            return b""
        out = self.unpack.decompress(self.data[at : at + packed])
        if len(out) != size:
            raise WarcError("frame size")
        return out

    def record(self, record_id: str) -> Record:
        frame, offset, size = self.index()[record_id]
        return self._mapped(self.frame(frame), record_id, offset, size)

    def mapped(self) -> Iterator[Record]:
        """Every record by its place in the record map; a frame is unpacked once."""
        number, data = None, b""
        for name, (frame, offset, size) in sorted(self.index().items(), key=lambda x: x[1]):
            if frame != number:
                number, data = frame, self.frame(frame)
            yield self._mapped(data, name, offset, size)

    def _mapped(self, data: bytes, name: str, offset: int, size: int) -> Record:
        found, end = parse_record(data, offset)
        if end != offset + size or not (found.digest in name and page_of(name) == found.page_id):
            raise WarcError("record map")
        return found

    def __iter__(self) -> Iterator[Record]:
        for n in range(len(self.frames)):
            data, at = self.frame(n), 0
            while at < len(data):
                r, at = parse_record(data, at)
                yield r


def planned(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to is the response of each revisit, else null."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # Only payloads that occur more than once go to the join, one row for each.
    repeated = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first")
    joined = rows.join(repeated, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", "size", refers.alias("refers_to"))


def bundles(plan: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(name, n_records, content): bundles of about ``bundle_bytes`` of records each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, writer = TaskContext.get().partitionId(), 0, BundleWriter(frame_bytes)

        def row() -> pa.RecordBatch:
            content = writer.close()
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:06d}.warc.zst"]), pa.array([len(writer.index)], pa.int64()), pa.array([content], pa.binary())], ["name", "n_records", "content"])

        for whole in batches:
            for batch in slices(whole, "payload"):
                for p, u, b, d, n, r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "size", "refers_to"))):
                    writer.add(Record(p, u, b, d, n, r, r is not None))
                    if writer.total >= bundle_bytes:
                        yield row()
                        number, writer = number + 1, BundleWriter(frame_bytes)
        if writer.index:
            yield row()

    return plan.mapInArrow(tidied(run), "name string, n_records long, content binary")


def read(stored: DataFrame) -> DataFrame:
    """One row for each record of the bundles in ``content``, found through their record maps; every payload is held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = [(r.page_id, r.url, r.size, r.digest, "revisit" if r.revisit else "response", r.refers_to) for r in BundleReader(content.as_py()).mapped()]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return stored.select("content").mapInArrow(tidied(run), ROW)


def archive(pages: DataFrame, path: str, **names: str) -> DataFrame:
    """Write the pages' bundles to the table at ``path`` and give them back as read from there."""
    bundles(planned(pages, **names)).write.mode("overwrite").option("compression", "uncompressed").parquet(path)
    return pages.sparkSession.read.schema("name string, n_records long, content binary").parquet(path)


def write_files(stored: DataFrame, folder: str) -> None:
    """Each bundle as a file of a folder that all executors share; a repeated task replaces its file in one step."""

    def put(rows: Iterator) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            draft = os.path.join(folder, f".{r.name}.{os.getpid()}")
            with open(draft, "wb") as f:
                f.write(r.content)
            os.replace(draft, os.path.join(folder, r.name))

    stored.select("name", "content").foreachPartition(put)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(archive(table(spark, sf_dir, "pages"), shared_path(spark, "warc")))
