"""What the corpus operators share: Arrow columns in and out, shared folders, stable row keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python step holds at once; longer single texts form a block of their own.
BLOCK_BYTES = 1 << 20


#: Most rows and bytes of an Arrow batch between Spark and Python, so that long texts take little memory on either side.
BATCH_ROWS = 1000
BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and an error on a cluster."""
    sc = spark.sparkContext
    held = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not held:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="codelathe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(held)
    return held


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices whose ``column`` holds about ``limit`` bytes; a single row is never split."""
    ends = np.cumsum(np.diff(buffers(batch.column(column))[1]))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.large_binary()
    if array.type != wide:
        array = (array.cast(pa.large_string()) if pa.types.is_string(array.type) else array).cast(wide)
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if offsets is not None else np.zeros(len(array) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def with_struct(df: DataFrame, column: str, result: T.StructType, make: Callable[[], Callable[[pa.Array], pa.StructArray]], name: str = "out", limit: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``df`` plus one struct column that a Python step computes from the text in ``column``.

    ``make`` runs once in each task and gives the function of one text array. All
    other columns pass through untouched, whatever their names. Returns the
    frame and the struct's name, which no column of ``df`` has.
    """
    small_batches(df.sparkSession)
    name = fresh(df, name)
    kind = _arrow(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for whole in batches:
                for batch in slices(whole, column, limit):
                    yield pa.RecordBatch.from_arrays([*batch.columns, step(batch.column(column)).cast(kind)], [*batch.schema.names, name])
        finally:
            getattr(step, "close", int)()
            del step
            tidy()

    return df.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in df.schema), T.StructField(name, result)])), name


def tidy() -> None:
    """Drop the kept powers and give memory that a task has freed back to the system, as Python workers outlive their tasks."""
    _POWERS.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only some C libraries have it
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with :func:`tidy` at its end."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return around


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def opened(df: DataFrame, keep: list[str], struct: str) -> DataFrame:
    """Columns ``keep`` and the fields of ``struct``."""
    return df.select(*(F.col(f"`{c}`") for c in keep), f"{struct}.*")


def text_key(text: str = "text"):
    """128-bit digest of a text as two numbers: the key of a document's content, so repeated or null ids do no harm."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.md5(t.cast("binary"))


# --- hashing of byte ranges ---------------------------------------------------------------

#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: A random 64-bit number for each byte value.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** (0 .. n-1), or its inverse's; up to two million are kept until the task ends."""
    held = _POWERS.get(inverse)
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 0)
        held = np.full(size, BASE_INVERSE if inverse else BASE, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 1 << 21:
            _POWERS[inverse] = held
    return held[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] the weighted code sum of bytes s to e."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal bytes give equal hashes wherever they stand."""
    return mixed((prefix[end] - prefix[begin]) * powers(len(prefix), True)[begin])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the high bits over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


# --- words --------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Digits, letters and all bytes of characters beyond ASCII, after lower-casing A-Z.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: All but space, tab, line feed, vertical tab, form feed and carriage return.
_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False


def word_ranges(data: np.ndarray, at: np.ndarray, inside: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix hashes of the lower-cased bytes, begin and end of each word of the bytes ``inside``, and each text's first word number (one entry more than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(1, np.uint64), none, none, np.zeros(len(at), np.int64)
    data = _LOWER[data]
    inside = inside[data]
    border = np.zeros(n + 1, bool)
    border[at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | border[:-1]))
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    return prefix_hash(data), begin, end, np.searchsorted(begin, at)


def words_of(data: np.ndarray, at: np.ndarray, inside: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the bytes ``inside`` in order, and each text's first word number (one entry more than texts)."""
    prefix, begin, end, first = word_ranges(data, at, inside)
    return range_hash(prefix, begin, end), first


def blank_words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`words_of`, for words between ASCII white space."""
    return words_of(data, at, _NOT_BLANK)
