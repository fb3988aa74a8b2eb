"""Benchmark decontamination by training suffix arrays.

Each block of training documents is a shard with a sparse suffix array: the
suffixes that begin with a word pair of the benchmark, in lexicographic order
of their first eight words. Every test suffix is found in every shard by binary
search over that order. Matches give the covered words, the items and the
longest verbatim stretch of each document. Documents never leave their task, so
nothing is shuffled; the benchmark goes out in blocks of bounded size, one pass
of the shards for each block.

Words compare by 64-bit hashes of their bytes; a false match needs as many equal
pairs in a row as the window has words, so one pair for an item of one word. The
tables of a block take about 21 times its bytes, in the driver and in each
worker.

Defined results: null or wordless text has no words and no hits; items without
an id or without words match nothing; equal item ids are one item.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelathe.llm.common import buffers, fresh, mixed, table, with_struct, words_of

WINDOW = 8
#: Documents with windows of at least so many items are affected.
MIN_ITEMS = 2
#: Bytes of benchmark text that one pass holds; a larger benchmark takes more passes.
BENCH_BYTES = 4 << 20
_FILTER_BITS = 22

SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())])
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType())])


def keys(words: np.ndarray, ends: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Big-endian byte strings of the WINDOW words from each position, zero beyond the text's end: memory order is suffix order."""
    out = np.zeros((len(positions), WINDOW), ">u8")
    for j in range(WINDOW):
        there = positions + j < ends
        out[there, j] = words[positions[there] + j]
    return out.view(f"S{8 * WINDOW}").ravel()


def pair_bits(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (mixed(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


@dataclass
class Tests:
    """The distinct windows of some items, by length, with their places in the items."""

    items: list[str]
    patterns: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # length, low and high keys, first place of each, items, offsets
    pairs: np.ndarray  # bit table of first word pairs
    singles: np.ndarray  # one-word items' words

    @staticmethod
    def of(items: list[tuple[str, bytes]]) -> Tests:
        names = sorted({i for i, _ in items})
        number = {x: n for n, x in enumerate(names)}
        at = np.concatenate([[0], np.cumsum([len(t) for _, t in items], dtype=np.int64)]).astype(np.int64)
        words, first = words_of(np.frombuffer(b"".join(t for _, t in items), np.uint8), at)
        size = np.diff(first)
        pairs, patterns, singles = np.zeros(1 << _FILTER_BITS, bool), [], np.zeros(0, np.uint64)
        owner = np.array([number[i] for i, _ in items], np.int64)
        for length in range(1, WINDOW + 1):
            some = np.flatnonzero(size == length) if length < WINDOW else np.flatnonzero(size >= WINDOW)
            if not len(some):
                continue
            each = size[some] - length + 1
            of = np.repeat(some, each)
            offset = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            where = first[of] + offset
            low = keys(words, where + length, where)
            order = np.argsort(low, kind="stable")
            low, of, offset, where = low[order], of[order], offset[order], where[order]
            new = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.zeros(0, bool)
            place = np.append(np.flatnonzero(new), len(low))
            high = low[new].copy()
            raw = high.view(np.uint8).reshape(len(high), 8 * WINDOW)
            raw[:, 8 * length :] = 255
            patterns.append((length, low[new], high, place, owner[of], offset))
            if length == 1:
                singles = np.unique(words[where])
            else:
                pairs[pair_bits(words[where], words[where + 1])] = True
        return Tests(names, patterns, pairs, singles)


def search(tests: Tests, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]], np.ndarray]:
    """For each text: words, covered spans of words, matched items, longest verbatim stretch."""
    words, first = words_of(data, at)
    texts, size = len(at) - 1, np.diff(first)
    doc = np.repeat(np.arange(texts), size)
    ends = first[1:][doc]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(texts)]
    items: list[list[str]] = [[] for _ in range(texts)]
    longest = np.zeros(texts, np.int64)
    likely = np.zeros(len(words), bool)
    if len(words) > 1:
        likely[:-1] = tests.pairs[pair_bits(words[:-1], words[1:])]
    if len(tests.singles):
        likely |= np.isin(words, tests.singles)
    suffixes = np.flatnonzero(likely)
    if not len(suffixes):
        return size, spans, items, longest
    key = keys(words, ends[suffixes], suffixes)
    order = np.argsort(key, kind="stable")
    array, key = suffixes[order], key[order]
    change = np.zeros(len(words) + 1, np.int64)
    owners: list[np.ndarray] = []
    for length, low, high, place, owner, offset in tests.patterns:
        begin, end = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
        many = end - begin
        hit = np.flatnonzero(many)
        if not len(hit):
            continue
        many = many[hit]
        pattern = np.repeat(hit, many)
        where = array[np.repeat(begin[hit] - np.cumsum(many) + many, many) + np.arange(len(pattern))]
        np.add.at(change, where, 1)
        np.add.at(change, where + length, -1)
        uses = place[pattern + 1] - place[pattern]
        use = np.repeat(place[pattern] - np.cumsum(uses) + uses, uses) + np.arange(int(uses.sum()))
        place_in, where = offset[use], np.repeat(where, uses)
        owners.append(np.stack([doc[where], owner[use], where - place_in, where, np.full(len(where), length)]))
    if not owners:
        return size, spans, items, longest
    covered = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(words) + 1, bool)
    edge[first] = True
    before = np.concatenate([[False], covered[:-1]])
    after = np.concatenate([covered[1:], [False]])
    for b, e in zip(np.flatnonzero(covered & (~before | edge[:-1])).tolist(), (np.flatnonzero(covered & (~after | edge[1:])) + 1).tolist()):
        d = int(doc[b])
        spans[d].append((b - int(first[d]), e - int(first[d])))
    found = np.unique(np.concatenate(owners, axis=1), axis=1)  # by document, item, diagonal, position
    for d, i in np.unique(found[:2], axis=1).T.tolist():
        items[d].append(tests.items[i])
    same = (found[0, 1:] == found[0, :-1]) & (found[1, 1:] == found[1, :-1]) & (found[2, 1:] == found[2, :-1]) & (found[3, 1:] == found[3, :-1] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    run = np.diff(np.append(head, found.shape[1])) - 1 + found[4, head]
    np.maximum.at(longest, found[0, head], run)
    return size, spans, items, longest


def matches(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", bench_bytes: int = BENCH_BYTES) -> tuple[DataFrame, str]:
    """``df`` plus a struct of n_words, covered spans (in words), matched items and the longest verbatim stretch."""
    spark = df.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // bench_bytes))
    structs = []
    for n in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n)
        tests = spark.sparkContext.broadcast(Tests.of([(r.i, r.t.encode()) for r in part.toLocalIterator()]))

        def make(tests=tests):
            def step(array: pa.Array) -> pa.StructArray:
                size, spans, items, longest = search(tests.value, *buffers(array))
                flat = [s for x in spans for s in x]
                pair = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32())], ["begin", "end"])
                each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]), pa.int32()), pair)
                return pa.StructArray.from_arrays([pa.array(size, pa.int64()), each, pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], RESULT.names)

            return step

        df, name = with_struct(df, text, RESULT, make, "bench", 2 << 20)
        structs.append(name)
    if blocks == 1:
        return df, structs[0]
    name = fresh(df, "bench_all")
    union = F.array_sort(F.concat(*(F.col(f"{s}.spans") for s in structs)))
    merged = F.aggregate(union, F.array().cast(RESULT["spans"].dataType), _joined)
    items = F.array_sort(F.array_distinct(F.concat(*(F.col(f"{s}.items") for s in structs))))
    df = df.withColumn(name, F.struct(F.col(f"{structs[0]}.n_words").alias("n_words"), merged.alias("spans"), items.alias("items"), F.greatest(*(F.col(f"{s}.longest") for s in structs)).alias("longest")))
    return df.drop(*structs), name


def _joined(held: Column, span: Column) -> Column:
    """Spans in order, with one more that overlaps or follows the last."""
    last = F.element_at(held, -1)
    touches = (F.size(held) > 0) & (F.coalesce(F.try_element_at(held, F.lit(-1))["end"], F.lit(-1)) > span["begin"])
    wider = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
    return F.when(touches, F.concat(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(held, F.array(span)))


def judged(df: DataFrame, out: str, min_items: int = MIN_ITEMS) -> dict[str, Column]:
    """The columns n_words, n_hit, n_items, items_sha256, contaminated and longest of a frame from :func:`matches`."""
    items = F.col(f"{out}.items")
    hit = F.aggregate(F.col(f"{out}.spans"), F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    count = F.size(items).cast("long")
    return {
        "n_words": F.col(f"{out}.n_words"),
        "n_hit": hit,
        "n_items": count,
        "items_sha256": F.sha2(F.array_join(F.array_sort(items), ","), 256),
        "contaminated": count >= min_items,
        "longest": F.col(f"{out}.longest"),
    }


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text", min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of ``df`` that are not affected, with their own columns.

    A document is affected if it holds a verbatim stretch of a whole window, or
    windows of at least ``min_items`` items; one item of fewer words does no harm.
    """
    marked, out = matches(df, benchmark, text)
    found = judged(marked, out, min_items)
    return marked.where(~found["contaminated"] & (found["longest"] < WINDOW)).drop(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, out = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return df.select("doc_id", *(c.alias(n) for n, c in judged(df, out).items()))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
