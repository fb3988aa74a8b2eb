"""Removal of long repeated byte strings with a run-length index.

A string of ``length`` bytes is repeated if it starts anywhere else as well.
Every such string picks the same anchor from its own bytes: the k-byte string
with the smallest hash in it. So equal strings meet under one anchor hash, and
the bytes that an anchor stands for, its segment, are all that has to travel;
anchors that occur once never do.

Under the anchor hashes, segments are gathered into texts of bounded size, and
each text gets a run-length index: its suffix order, the runs of its
Burrows-Wheeler transform, and for each run's first and last row the text
position and the match with the neighbouring row. Between these samples the
match lengths fall by one for each position, so one pass over the text streams
the matching statistics of every position against all others. Positions whose
match reaches ``length`` are marked. Equal segments are held once with their
count. Anchors that occur more than ``MOST`` times are dealt out by the windows
themselves: fingerprints of 128 bits, from two independent multipliers, are
counted before the shuffle and joined back.

A run of strings that pick equal anchors is one segment, so texts that repeat a
short period give few. Anchors are counted first; the tasks that cut segments
know the repeated ones by a filter of fixed size, so nearly all others stay where
they are, and what passes by chance finds no match.

Documents are known by a digest of their text, so repeated rows and null ids need
no care; exact copies are one text with their number before segments are cut.

Defined results: null text is empty; texts shorter than ``length`` lose nothing.
In a cleaned text, the rest of a character that a removed string cuts is left
out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelathe.llm.common import BYTE_CODE, buffers, cut, fresh, mixed, powers, prefix_hash, range_hash, slices, small_batches, table, tidied
from codelathe.llm.components import joined

LENGTH = 200
ANCHOR = 40
#: Most occurrences of an anchor that go through one index.
MOST = 20_000
#: Bytes of segments that one index holds; an anchor's segments stay together.
INDEX_BYTES = 128 << 10
#: Bits of the filter of repeated anchors, and most hashes of hot ones: what a task knows of them has a bound.
FILTER_BITS = 27
HOT_KEYS = 2_000_000
_END, _DIGIT, _DIGITS = 0xC0, 0xF8, 8
_PIECE = 1 << 20
#: Most strings of one segment, and bytes of segments in one batch.
_RUN = 1 << 14
_BATCH = 4 << 20
#: Odd multiplier of the second fingerprint.
_SECOND = np.uint64(0xD1342543DE82EF95)
_PLACE = np.uint64((1 << 24) - 1)

SPANS = T.ArrayType(T.StructType([T.StructField("b", T.IntegerType()), T.StructField("e", T.IntegerType())]))
RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
FULL = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_removed", T.LongType())])


def digest(text: str):
    """128-bit key of a text's content."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def anchors(data: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, begin, end, times) of every anchor and its segment: the strings that pick it, from the first's start to the last's end, and at how many places they do."""
    out: list[tuple[np.ndarray, ...]] = []
    last_start = np.repeat(at[1:] - length, np.diff(at))  # of strings within the text of each byte
    for low in range(0, len(data), _PIECE):
        piece = data[low : low + _PIECE + length - 1]
        starts = len(piece) - length + 1
        if starts <= 0:
            break
        good = np.arange(low, low + starts) <= last_start[low : low + starts]
        if not good.any():
            continue
        n = len(piece) - k + 1
        prefix = prefix_hash(piece)
        hashes = mixed((prefix[k:] - prefix[:-k]) * powers(n, True))
        w = length - k + 1
        key = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
        key[:n] = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
        rows = key.reshape(-1, w)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        picked = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & _PLACE).astype(np.int64)
        where = np.flatnonzero(good)
        picked = picked[where]
        held = hashes[picked]
        new = np.ones(len(where), bool)
        new[1:] = (held[1:] != held[:-1]) | (where[1:] != where[:-1] + 1)
        rank = np.arange(len(where))
        new |= (rank - np.maximum.accumulate(np.where(new, rank, 0))) % _RUN == 0
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(where)) - 1
        other = np.ones(len(where), np.int64)
        other[1:] = picked[1:] != picked[:-1]
        out.append((held[first], where[first] + low, where[last] + low + length, np.add.reduceat(other, first) + (other[first] == 0)))
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 4
    hashes, begin, end, times = (np.concatenate(x) for x in zip(*out))
    text = np.searchsorted(at, begin, "right") - 1
    return hashes, text, begin - at[text], end - at[text], times


class RunLengthIndex:
    """Run-compressed transform of a text with samples at the ends of its runs."""

    def __init__(self, text: np.ndarray):
        self.text = text
        n = len(text)
        self.levels: list[tuple[int, np.ndarray]] = []
        order = self._suffixes()
        before = text[order - 1].astype(np.int16)
        before[order == 0] = -1  # the first position has no byte before it
        edge = np.flatnonzero(before[1:] != before[:-1])  # last row of each run but the last
        # Of a run's first row the match with the row above, of its last row that with the row below.
        match = self._match(order[edge], order[edge + 1])
        self.runs = len(edge) + 1
        self.heads, self.tails = (order[edge + 1], match), (order[edge], match)
        self.n = n

    def _suffixes(self) -> np.ndarray:
        text = self.text
        n = len(text)
        wide = np.zeros(n + 8, np.uint8)
        wide[:n] = text
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | wide[j : j + n]
        self.first = key
        order = np.argsort(key)
        held = key[order]
        start = np.ones(n, bool)
        start[1:] = held[1:] != held[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        k = 8
        while True:
            self.levels.append((k, rank.astype(np.int32)))
            more = np.ones(n, bool)
            more[:-1] = start[1:]
            rows = np.flatnonzero(~(start & more))  # rows of suffixes with equal first k bytes
            if not len(rows) or k >= n:
                return order
            suffixes = order[rows]
            follow = suffixes + k
            second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
            group = rank[suffixes]
            placed = np.lexsort((second, group)) if n >= 1 << 31 else np.argsort(group * (n + 1) + second)
            order[rows] = suffixes[placed]
            group, second = group[placed], second[placed]
            start[rows[1:]] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
            start[rows[0]] = True
            rank = rank.copy()
            rank[order[rows]] = np.maximum.accumulate(np.where(start, np.arange(n), 0))[rows]
            k *= 2

    def _match(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes."""
        a, b = a.copy(), b.copy()
        n, begin = len(self.text), a.copy()
        for k, rank in reversed(self.levels):
            while True:
                there = (a < n) & (b < n)
                same = np.zeros(len(a), bool)
                same[there] = rank[a[there]] == rank[b[there]]
                same &= (a + k <= n) & (b + k <= n)
                if not same.any():
                    break
                a[same] += k
                b[same] += k
        there = (a < n) & (b < n)
        differ = np.zeros(len(a), np.uint64)
        differ[there] = self.first[a[there]] ^ self.first[b[there]]
        more = np.zeros(len(a), np.int64)
        for j in range(1, 8):
            more += (differ >> np.uint64(64 - 8 * j)) == 0
        return a - begin + np.where(there, np.minimum(more, np.minimum(n - a, n - b)), 0)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match of what starts there with what starts anywhere else, streamed from the samples."""
        at = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for place, match in (self.heads, self.tails):
            reach = np.zeros(self.n, np.int64)
            reach[place] = match + place
            np.maximum(out, np.maximum.accumulate(reach) - at, out=out)
        return out


def marked(segments: list[bytes], counts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """The spans of each distinct segment that repeated strings cover."""
    size = np.array([len(s) for s in segments], np.int64)
    # Bytes that no UTF-8 text holds end each segment and spell its number in octal, so no match goes over an end or starts before a segment.
    text = np.frombuffer(b"".join(s + bytes([_END, *(_DIGIT + (n >> 3 * j & 7) for j in range(_DIGITS))]) for n, s in enumerate(segments)), np.uint8)
    after = _DIGITS + 1
    begin = np.cumsum(size + after) - size - after
    end = np.repeat(begin + size, size + after)
    reach = np.minimum(RunLengthIndex(text).matching_statistics(), end - np.arange(len(text)))
    hit = reach >= length
    again = np.repeat(np.array(counts) > 1, size + after)
    hit |= again & (end - np.arange(len(text)) >= length)
    change = np.zeros(len(text) + length + 1, np.int64)
    where = np.flatnonzero(hit)
    change[where] += 1
    change[where + length] -= 1
    covered = np.zeros(len(text) + 2, bool)
    covered[1:-1] = np.cumsum(change)[: len(text)] > 0
    first, last = np.flatnonzero(covered[1:] & ~covered[:-1]), np.flatnonzero(covered[:-1] & ~covered[1:])
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    owner = np.searchsorted(begin, first, "right") - 1
    for s, b, e in zip(owner.tolist(), (first - begin[owner]).tolist(), (last - begin[owner]).tolist()):
        out[s].append((b, e))
    return out


def _counts(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(h, k, times) of all anchors of (t, text): its segments, and the places that pick it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, _, _, _, times = anchors(*buffers(batch.column("text")), length, k)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], ["h", "times"])

    # Map-side sums first: an anchor of all documents is one row from each task.
    return docs.select("text").mapInArrow(tidied(run), "h long, times long").groupBy("h").agg(F.count("*").alias("k"), F.sum("times").alias("times"))


@dataclass
class Known:
    """What a task knows of repeated anchors, of a size that has nothing to do with the documents'.

    ``bits`` has the bit of every repeated anchor; anchors that share a bit with
    one pass too, and find no match later. ``hot`` are the sorted hashes of the
    most frequent ones.
    """

    bits: np.ndarray
    hot: np.ndarray

    @staticmethod
    def of(repeated: DataFrame, most: int) -> Known:
        # Anchors have the smallest hashes, so only the low bits are spread evenly.
        word = F.shiftright(F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)), 6)
        words = repeated.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("x"))
        bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        for batch in words.toArrow().to_batches():  # at most 2 ** (FILTER_BITS - 6) rows
            bits[batch.column("w").to_numpy()] = batch.column("x").to_numpy().view(np.uint64)
        hot = repeated.where(F.col("k") > most).select("h").toArrow().column("h").to_numpy()  # at most HOT_KEYS rows
        return Known(bits, np.sort(hot))

    def repeated(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64((1 << FILTER_BITS) - 1)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def often(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(h), bool)
        h = h.view(np.int64)
        return self.hot[np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)] == h


def _segments(docs: DataFrame, known: Broadcast, hot: bool, length: int, k: int) -> DataFrame:
    """(h, t, b, n, seg): the segments of likely repeated anchors of (t, text, n), of the hot ones or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = buffers(batch.column("text"))
                h, text, b, e, _ = anchors(data, at, length, k)
                good = known.value.repeated(h) & (known.value.often(h) == hot)
                h, text, b, e = (x[good] for x in (h, text, b, e))
                raw, begin, ends = data.tobytes(), at[text] + b, np.cumsum(e - b)
                row = 0
                while row < len(h):  # segments overlap, so those of a long text are more than the text
                    stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + _BATCH, "right")))
                    q = slice(row, stop)
                    parts = [raw[x : x + y] for x, y in zip(begin[q].tolist(), (e[q] - b[q]).tolist())]
                    own = pa.array(text[q])
                    yield pa.RecordBatch.from_arrays([pa.array(h[q].view(np.int64)), batch.column("t").take(own), pa.array(b[q], pa.int32()), batch.column("n").take(own), pa.array(parts, pa.binary())], ["h", "t", "b", "n", "seg"])
                    row = stop

    return docs.select("t", "text", "n").mapInArrow(tidied(run), "h long, t binary, b int, n long, seg binary")


def _indexed(segments: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(t, b, e): covered spans, by run-length indexes over anchors' segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        rows: list[tuple[bytes, int, int]] = []  # text, begin, segment number
        counts: list[int] = []
        total, last = 0, None

        def spans() -> pa.RecordBatch:
            found = marked(list(held), counts, length) if held else []
            out = [(t, b + x, b + y) for t, b, s in rows for x, y in found[s]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int32())], ["t", "b", "e"])

        for batch in batches:
            for h, t, b, n, seg in zip(*(batch.column(c).to_pylist() for c in ("h", "t", "b", "n", "seg"))):
                if total >= index_bytes and h != last:
                    yield spans()
                    held, rows, counts, total = {}, [], [], 0
                last = h
                s = held.setdefault(seg, len(held))
                if s == len(counts):
                    counts.append(0)
                    total += len(seg)
                counts[s] += n
                rows.append((t, b, s))
        yield spans()

    placed = segments.repartition("h").sortWithinPartitions("h")
    return placed.mapInArrow(tidied(run), "t binary, b int, e int")


def _windowed(segments: DataFrame, length: int) -> DataFrame:
    """(t, b, e): covered strings of anchors too frequent for one index, by counting fingerprints of all their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "seg", 1 << 18):
                data, at = buffers(batch.column("seg"))
                each = np.diff(at) - length + 1
                of = np.repeat(np.arange(batch.num_rows), each)
                offset = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
                start = at[of] + offset
                one = range_hash(prefix_hash(data), start, start + length)
                two = _second_hash(data, start, length)
                b = np.repeat(batch.column("b").to_numpy(), each) + offset
                yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(of)), batch.column("n").take(pa.array(of)), pa.array(b, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["t", "n", "b", "f", "g"])

    rows = segments.select("t", "n", "b", "seg").mapInArrow(tidied(run), "t binary, n long, b int, f long, g long")
    twice = cut(rows.groupBy("f", "g").agg(F.sum("n").alias("times"), F.count("*").alias("k")).where("times > 1").select("f", "g", "k"))
    total = twice.agg(F.sum("k")).first()[0] or 0
    return joined(rows.select("t", "b", "f", "g"), twice, ["f", "g"], "k", total).select("t", "b", (F.col("b") + length).alias("e"))


def _second_hash(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings at ``start`` by another multiplier and other byte codes."""
    power = np.full(len(data), _SECOND, np.uint64)
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[::-1][data] * power, out=prefix[1:])
    back = np.full(len(data), np.uint64(pow(int(_SECOND), -1, 1 << 64)), np.uint64)
    back[:1] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((prefix[start + length] - prefix[start]) * back[start])


def spans(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(t, spans): the digest of each text that holds repeated strings, and what they cover, in no order."""
    small_batches(docs.sparkSession)
    keyed = docs.select(digest(text).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    repeated = cut(_counts(keyed, length, anchor).where("times > 1").select("h", "k"))
    total = repeated.agg(F.sum("k")).first()[0] or 0
    known = docs.sparkSession.sparkContext.broadcast(Known.of(repeated, max(most, total // HOT_KEYS)))
    # Equal texts are one with their number before any segment is cut.
    once = keyed.groupBy("t").agg(F.any_value("text").alias("text"), F.count("*").alias("n"))
    covered = _indexed(_segments(once, known, False, length, anchor), length, index_bytes)
    if len(known.value.hot):
        covered = covered.union(_windowed(_segments(once, known, True, length, anchor), length))
    return covered.groupBy("t").agg(F.collect_list(F.struct("b", "e")).alias("spans"))


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    if not spans:
        return raw
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[b:e] for b, e in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, text: str, result: T.StructType, row, **how) -> tuple[DataFrame, str]:
    """``docs`` plus a struct that ``row(bytes, spans)`` gives for each text."""
    from pyspark.sql.pandas.types import to_arrow_type

    key, places, out = fresh(docs, "repeat_key"), fresh(docs, "repeat_spans"), fresh(docs, "repeats")
    found = spans(docs, text, **how).select(F.col("t").alias(key), F.col("spans").alias(places))
    joined = docs.withColumn(key, digest(text)).join(found, key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), places)
    kind, columns = to_arrow_type(result), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                data, at = buffers(batch.column(text))
                raw, column = data.tobytes(), batch.column(places)
                flat, offsets = column.flatten(), np.array(column.offsets)
                b, e = flat.field("b").to_numpy(), flat.field("e").to_numpy()
                low = offsets[0] if len(offsets) else 0
                rows = []
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    p, q = offsets[i] - low, offsets[i + 1] - low
                    some = union(list(zip(b[p:q].tolist(), e[p:q].tolist()))) if column[i].is_valid else []
                    rows.append(row(raw[x:y], some))
                struct = pa.StructArray.from_arrays([pa.array([r[n] for r in rows], f.type) for n, f in enumerate(kind)], result.names)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), struct], [*columns, out])

    return joined.mapInArrow(tidied(run), T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField(out, result)])), out


def removed(docs: DataFrame, text: str = "text", **how) -> tuple[DataFrame, str]:
    """``docs`` plus a struct of bytes, bytes removed, removed runs and the digest of the bytes kept."""

    def row(raw: bytes, some: list[tuple[int, int]]) -> tuple[int, int, int, str]:
        return len(raw), sum(e - b for b, e in some), len(some), hashlib.sha256(_kept(raw, some)).hexdigest()

    return _with_spans(docs, text, RESULT, row, **how)


def cleaned(docs: DataFrame, text: str = "text", **how) -> tuple[DataFrame, str]:
    """``docs`` plus a struct of the text without its repeated strings and the bytes removed."""

    def row(raw: bytes, some: list[tuple[int, int]]) -> tuple[str, int]:
        return _kept(raw, some).decode("utf-8", "ignore"), sum(e - b for b, e in some)

    return _with_spans(docs, text, FULL, row, **how)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", f"{out}.*")
