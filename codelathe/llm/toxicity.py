"""Toxicity by classifier chains.

Categories are predicted one after the other. Each has a linear model over
hashed words and word beginnings; the probabilities of the categories before it are further inputs.
When a later model is trained, these are out-of-fold predictions, so it sees the
same kind of error as it will on new texts.

The labels give two categories of their own: ``low_quality`` (``quality`` is 0)
comes first, and ``toxic`` last. Without a column ``quality`` the chain has the
last one only. Other categories can be given to :func:`fit` as columns of the
labels, and other label lists to :func:`fit_chain`.

Fitting uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id; repeated rows count once. Defined results: null text is empty text; empty text gets the models'
bias. Without labels of both classes all probabilities are the base rate and no
text is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelathe.llm.common import buffers, mixed, opened, range_hash, slices, table, text_key, tidied, with_struct, word_ranges

#: Most labelled rows that a fit uses.
SAMPLE = 10_000
BUCKETS = 22
#: Word beginnings of so many bytes are features beside whole words, as inflected forms share them.
STEMS = (4, 5, 6)
FEATURES = 500
#: Features that are chosen for the categories before the last, each.
EARLY = 150
#: A text of less than this probability is never rejected, however few labels put the threshold lower.
LEAST = 0.25
FOLDS = 5
STEPS = 150
RIDGE = 1e-4
LASSO = 3e-4


def buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct hashed words and word beginnings of each text."""
    prefix, begin, end, first = word_ranges(data, at)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int64), np.diff(first))
    who, words = [owner], [range_hash(prefix, begin, end)]
    for n in STEMS:
        longer = end - begin > n
        who.append(owner[longer])
        words.append(mixed(range_hash(prefix, begin[longer], begin[longer] + n) + np.uint64(n)))
    owner, words = np.concatenate(who), np.concatenate(words)
    both = np.unique((owner << BUCKETS) | (words >> np.uint64(64 - BUCKETS)).astype(np.int64))
    return both >> BUCKETS, both & ((1 << BUCKETS) - 1)


@dataclass
class Linear:
    weights: np.ndarray  # of the features, then of the earlier categories' log-odds
    bias: float

    def margin(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return x @ self.weights[: x.shape[1]] + before @ self.weights[x.shape[1] :] + self.bias


@dataclass
class Chain:
    """Chosen buckets and one linear model for each category."""

    categories: list[str]
    features: np.ndarray
    models: list[Linear]
    threshold: float = 0.5  # probability of the last category from which a text is rejected

    def place(self) -> np.ndarray:
        out = np.full(1 << BUCKETS, -1, np.int32)
        out[self.features] = np.arange(len(self.features))
        return out

    def probabilities(self, who: np.ndarray, bucket: np.ndarray, rows: int, place: np.ndarray) -> np.ndarray:
        """(rows, categories), each category fed to the next."""
        k = place[bucket]
        who, k = who[k >= 0], k[k >= 0]
        out = np.zeros((rows, len(self.models)))
        odds = np.zeros((rows, 0))
        for n, model in enumerate(self.models):
            margin = np.bincount(who, model.weights[k], rows) + odds @ model.weights[len(self.features) :] + model.bias
            out[:, n] = sigmoid(margin)
            odds = np.column_stack([odds, np.clip(margin, -6, 6)])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, before: np.ndarray, y: np.ndarray, steps: int = STEPS) -> Linear:
    """Logistic regression with small ridge and lasso terms by accelerated proximal gradient."""
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Linear(np.zeros(x.shape[1] + before.shape[1]), bias)
    z = np.column_stack([x, before.astype(np.float32)]).astype(np.float32)
    rows = z[:: max(1, len(z) // 1500)]
    rate = 4.0 / max(1.0, float(np.linalg.norm(rows, 2) ** 2 / len(rows)) + 1)
    w, last, momentum = np.zeros(z.shape[1]), np.zeros(z.shape[1]), 1.0
    ahead, b, b_ahead, b_last = w.copy(), bias, bias, bias
    for _ in range(steps):
        error = (sigmoid(z @ ahead.astype(np.float32) + b_ahead) - y) / len(y)
        w = ahead - rate * (z.T @ error.astype(np.float32) + RIDGE * ahead)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * LASSO, 0)
        b = b_ahead - rate * float(error.sum())
        next_ = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead, b_ahead = w + (momentum - 1) / next_ * (w - last), b + (momentum - 1) / next_ * (b - b_last)
        last, b_last, momentum = w, b, next_
    return Linear(w, b)


def chosen_features(rows: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Buckets with the largest z-scores of the difference of their shares, strongest for label 1 first.

    ``rows`` has each text's distinct buckets.
    """
    total, ones = np.zeros(1 << BUCKETS, np.int32), np.zeros(1 << BUCKETS, np.int32)
    for row, label in zip(rows, y):
        total[row] += 1
        if label:
            ones[row] += 1
    some = np.flatnonzero(total >= 3)
    total, ones = total[some].astype(float), ones[some].astype(float)
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float(len(y) - y.sum()))
    share = total / (n1 + n0)
    z = (ones / n1 - (total - ones) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    order = np.argsort(-np.abs(z), kind="stable")[:most]
    order = order[np.argsort(-z[order], kind="stable")]
    return some[order]


def matrix(rows: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """Which of ``features`` each text has."""
    place = np.full(1 << BUCKETS, -1, np.int32)
    place[features] = np.arange(len(features))
    x = np.zeros((len(rows), len(features)), np.float32)
    for n, row in enumerate(rows):
        k = place[row]
        x[n, k[k >= 0]] = 1
    return x


def fit_chain(x: np.ndarray, features: np.ndarray, labels: dict[str, np.ndarray], folds: int = FOLDS) -> Chain:
    """A chain over ``labels`` in their order, from a matrix of features."""
    fold = np.arange(len(x)) % folds
    odds, models, outside = np.zeros((len(x), 0)), [], np.zeros(len(x))
    for y in labels.values():
        models.append(fit_linear(x, odds, y))
        outside = np.zeros(len(x))
        for f in range(folds):
            here = fold == f
            if here.any():
                outside[here] = fit_linear(x[~here], odds[~here], y[~here]).margin(x[here], odds[here])
        odds = np.column_stack([odds, np.clip(outside, -6, 6)])
    return Chain(list(labels), features, models, max(LEAST, best_threshold(outside, y)))


def best_threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts out-of-fold margins with the best F1, half way to the nearest rejected row."""
    if not y.any():
        return 1.0
    order = np.argsort(-margin, kind="stable")
    margin, hits = margin[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][margin[1:] == margin[:-1]] = 0
    n = int(f1.argmax())
    return float(sigmoid((margin[n] + margin[n + 1]) / 2 if n + 1 < len(y) else margin[n]))


def categories_of(labels: DataFrame, label: str = "toxic") -> dict[str, Column]:
    """The chain's categories as columns of the labels, in order."""
    early = {"low_quality": (F.col("quality") == 0)} if "quality" in labels.columns and label != "quality" else {}
    return {**early, label: F.col(label).cast("double") > 0.5}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, categories: dict[str, Column] | None = None) -> Chain:
    """The chain from the labelled rows with the ``sample`` smallest hashes of their ids."""
    categories = categories or categories_of(labels, label)
    names = list(categories)
    # A category that is unknown for a row counts as absent, but for the last one, which must be known.
    values = F.array(*(F.coalesce(c.cast("float"), F.lit(0.0).cast("float")) for c in categories.values()))
    chosen = labels.where(F.col(doc_id).isNotNull() & categories[names[-1]].isNotNull()).select(F.col(doc_id).alias("i"), values.alias("y")).distinct()
    chosen = chosen.orderBy(F.xxhash64("i"), "i", "y").limit(sample)  # at most ``sample`` rows of numbers, so small enough to broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t"):
                who, bucket = buckets(*buffers(batch.column("t")))
                at = np.searchsorted(who, np.arange(batch.num_rows + 1))
                each = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(bucket, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("y"), batch.column("d"), each], ["i", "y", "d", "b"])

    rows = docs.select(F.col(doc_id).alias("o"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("o") == F.col("i")).select("i", "y", F.unhex(text_key("t")).alias("d"), "t")
    kind = T.StructType([*(rows.schema[x] for x in ("i", "y", "d")), T.StructField("b", T.ArrayType(T.IntegerType()))])
    once = rows.mapInArrow(tidied(run), kind).groupBy("i", "y", "d").agg(F.any_value("b").alias("b"))
    held = once.orderBy(F.xxhash64("i"), "i", "y", "d").limit(sample).select("i", "y", "b").toArrow()
    if not held.num_rows:
        return Chain(names, np.zeros(0, np.int64), [Linear(np.zeros(n), -40.0) for n in range(len(names))])
    order = sorted(range(held.num_rows), key=lambda n, i=held["i"].to_pylist(): i[n])
    y = np.array(held["y"].to_pylist(), float)[order]
    lists = held["b"].combine_chunks()
    at, flat = np.array(lists.offsets), lists.values.to_numpy()
    rows = [flat[at[n] : at[n + 1]] for n in order]
    features = chosen_features(rows, y[:, -1], FEATURES)
    for n in range(len(names) - 1):
        more = chosen_features(rows, y[:, n], EARLY)
        features = np.concatenate([features, more[~np.isin(more, features)]])
    x = matrix(rows, features)
    del rows, flat, lists, held
    return fit_chain(x, features, {c: y[:, n] for n, c in enumerate(names)})


def predict(df: DataFrame, chain: Chain, text: str = "text", threshold: float | None = None) -> tuple[DataFrame, str]:
    """``df`` plus a struct of each category's probability (``p_``name) and the decision ``is_toxic``."""
    kind = T.StructType([*(T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories), T.StructField("is_toxic", T.BooleanType())])
    least = chain.threshold if threshold is None else threshold
    held = df.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights for each category

    def make():
        place = held.value.place()

        def step(array: pa.Array) -> pa.StructArray:
            p = held.value.probabilities(*buckets(*buffers(array)), len(array), place)
            return pa.StructArray.from_arrays([*(pa.array(p[:, n]) for n in range(p.shape[1])), pa.array(p[:, -1] >= least)], kind.names)

        return step

    return with_struct(df, text, kind, make, "toxicity")


def clean(df: DataFrame, chain: Chain, text: str = "text", threshold: float | None = None) -> DataFrame:
    """The rows that are not rejected, with their own columns."""
    marked, out = predict(df, chain, text, threshold)
    return marked.where(~marked[f"{out}.is_toxic"]).drop(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df, out = predict(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return opened(df, ["doc_id"], out)
