"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, in order of
frequency. A document gets the same list; its distance to a language is the sum
of how far each of its n-grams stands out of place there, and the full length of
the profile for one that is missing. The nearest language wins, ties by name.

Learning counts over all given documents: each task adds up its n-grams by
language before the shuffle, and only the profiles reach the driver.

Defined results: null text and text without a letter are ``und`` with score 0,
as is all text when there is nothing to learn from. The score is one less the
ratio of the least distance to the next, 1 where only one language is known.
A row without an id is not held out, and nothing is learnt from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelathe.llm.common import opened, slices, table, tidied, with_struct

UNKNOWN = "und"
#: Length of a profile and longest n-gram.
PROFILE = 400
LONGEST = 3
#: Bits of a code point in an n-gram, and the code of a word's border, which no letter has.
_POINT_BITS = 21
_BORDER = 0x110000

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """The lower-case code point of each letter, by code point; 0 for all else."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def grams(texts: list[str | None], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of every n-gram within a word and its two borders, in no order; up to three code points."""
    raw = "\0".join(["\0" + (t or "") for t in texts]).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(raw, np.uint32)
    codes = letter_codes()[points]
    size = np.array([len(t or "") + 2 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), size)[: len(codes)]
    keep = (codes > 0) | np.concatenate([[True], codes[:-1] > 0])  # one border between words
    codes, owner = codes[keep].astype(np.int64), owner[keep]
    letter = codes > 0
    out, who = [codes[letter]], [owner[letter]]
    codes[~letter] = _BORDER
    for n in range(2, longest + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        whole = letter[:m] | letter[1 : 1 + m] if n == 2 else np.ones(m, bool)
        key = np.zeros(m, np.int64)
        for j in range(n):
            key = (key << _POINT_BITS) | codes[j : j + m]
            if 0 < j < n - 1:
                whole &= letter[j : j + m]
        out.append(key[whole])
        who.append(owner[: len(codes)][n - 1 :][:m][whole])
    return np.concatenate(who), np.concatenate(out)


def ranked(texts: list[str | None], length: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, rank from 0) of the ``length`` most frequent n-grams of each text, ties by n-gram."""
    who, key = grams(texts, longest)
    if not len(key):
        return (np.zeros(0, np.int64),) * 3
    names, place = np.unique(key, return_inverse=True)
    both = np.sort((who << 32) | place)
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    both, count = both[at], np.diff(np.append(at, len(both)))
    who, key = both >> 32, names[both & 0xFFFFFFFF]
    order = np.lexsort((-count, who))  # stable: n-grams ascend already
    who, key = who[order], key[order]
    begin = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    rank = np.arange(len(who)) - np.repeat(begin, np.diff(np.append(begin, len(who))))
    top = rank < length
    return who[top], key[top], rank[top]


def counts(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST) -> DataFrame:
    """(lang, gram, n) over all rows that have both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for batch in slices(whole, "t"):
                langs, texts = batch.column("l").to_pylist(), batch.column("t").to_pylist()
                for name in sorted(set(langs)):
                    key, n = np.unique(grams([t for t, x in zip(texts, langs) if x == name], longest)[1], return_counts=True)
                    if name in held:
                        key, where = np.unique(np.concatenate([held[name][0], key]), return_inverse=True)
                        n = np.bincount(where, np.concatenate([held[name][1], n]), len(key)).astype(np.int64)
                    held[name] = key, n
        for name, (key, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    rows = df.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t is not null and l is not null")
    return rows.mapInArrow(tidied(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", length: int = PROFILE, longest: int = LONGEST) -> dict[str, list[int]]:
    """Profiles by language; only ``length`` n-grams of each language reach the driver."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts(df, text, lang, longest).withColumn("r", F.row_number().over(order)).where(F.col("r") <= length)
    out: dict[str, list[tuple[int, int]]] = {}
    for row in top.select("lang", "r", "gram").toLocalIterator():
        out.setdefault(row.lang, []).append((row.r, row.gram))
    return {k: [g for _, g in sorted(v)] for k, v in out.items()}


def judge(texts: list[str | None], profiles: dict[str, list[int]], length: int, longest: int = LONGEST) -> tuple[list[str], list[float]]:
    names = sorted(profiles)
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    who, key, rank = ranked(texts, length, longest)
    if not names or not len(who):
        return langs, scores
    vocabulary = np.unique(np.concatenate([np.array(profiles[x], np.int64) for x in names]))
    place = np.full((len(names), len(vocabulary) + 1), -1)
    for n, x in enumerate(names):
        place[n, np.searchsorted(vocabulary, profiles[x])] = np.arange(len(profiles[x]))
    at = np.searchsorted(vocabulary, key)
    at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] != key)] = len(vocabulary)
    far = np.zeros((len(names), len(texts)))
    for n in range(len(names)):
        there = place[n, at]
        far[n] = np.bincount(who, np.where(there >= 0, np.abs(there - rank), length), len(texts))
    best, least = far.argmin(0), far.min(0)
    next_ = np.partition(far, 1, 0)[1] if len(names) > 1 else np.full(len(texts), np.inf)
    for t in np.unique(who).tolist():
        langs[t] = names[best[t]]
        scores[t] = 1.0 - least[t] / next_[t] if next_[t] > 0 else 0.0
    return langs, scores


def identify(df: DataFrame, profiles: dict[str, list[int]], text: str = "text", length: int = PROFILE, longest: int = LONGEST) -> tuple[DataFrame, str]:
    """``df`` plus a struct of the nearest language and its score."""
    held = df.sparkSession.sparkContext.broadcast(profiles)  # ``length`` numbers for each language

    def step(array: pa.Array) -> pa.StructArray:
        langs, scores = judge(array.to_pylist(), held.value, length, longest)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], RESULT.names)

    return with_struct(df, text, RESULT, lambda: step, "lang_id")


def part_of(doc_id: str, parts: int) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = fit(docs.where((part_of("doc_id", 4) != 2)))
    df, out = identify(docs.select("doc_id", "text"), profiles)
    return opened(df.withColumn("held_out", F.coalesce(part_of("doc_id", 4) == 2, F.lit(False))), ["doc_id", "held_out"], out)
