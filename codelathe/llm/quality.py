"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark columns. Shallow trees on resampled rows give rules: each
path from a root is a conjunction of bounds on statistics. A lasso logistic
regression keeps few rules and weighs them; the kept rules compile into one
Spark column, so scoring is a projection with no Python and no shuffle.

Fitting uses at most ``SAMPLE`` labelled rows, those with the smallest hash of
their id, so equal tables give equal models.

Defined results: null text has the statistics of empty text and gets a score
too. A row without an id is not held out, and no label is its own. Without labelled rows of both classes the score is the share of label 1
(0.5 without any).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.llm.common import fresh, table, text_key

#: Most labelled rows that a fit uses.
SAMPLE = 12_000
TREES = 40
DEPTH = 3
BINS = 24
LASSO = 0.0015
STEPS = 250
THRESHOLD = 0.3


def statistics(text: str) -> dict[str, Column]:
    """Language-free statistics of a text column; all are 0 for empty text."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(x) > 0)
    left = lambda gone: F.length(F.regexp_replace(t, gone, "")).cast("double")
    size = F.length(t).cast("double")
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "chars": size,
        "words": n.cast("double"),
        "word_chars": share(size, n),
        "distinct_words": share(distinct, n),
        "repeats": n / (F.sqrt(n.cast("double")) * distinct),
        "lines": F.size(lines).cast("double"),
        "line_chars": share(size, F.size(lines)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "upper": share(left(r"[^\p{Lu}]+"), size),
        "digits": share(left(r"[^0-9]+"), size),
        "symbols": share(left(r"[\p{L}\p{N}\s.,]+"), size),
        "stops": share(left(r"[^.!?]+"), n),
        "commas": share(left(r"[^,]+"), n),
        "short_words": share(F.size(F.filter(words, lambda w: F.length(w) <= 3)), n),
    }


@dataclass
class Rules:
    """Conjunctions of (statistic, above, bound) with their weights."""

    names: list[str]
    bias: float
    weights: list[float] = field(default_factory=list)
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        """The compiled score in terms of columns of statistics."""
        total = F.lit(self.bias)
        for weight, rule in zip(self.weights, self.rules):
            test = None
            for k, above, bound in rule:
                part = stats[self.names[k]] > bound if above else stats[self.names[k]] <= bound
                test = part if test is None else test & part
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in zip(self.weights, self.rules):
            total += weight * holds(x, rule)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, rule: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, bound in rule:
        out &= x[:, k] > bound if above else x[:, k] <= bound
    return out


def tree_rules(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], target: np.ndarray, rows: np.ndarray, features: np.ndarray, depth: int, least: int) -> tuple[list[tuple[tuple[int, bool, float], ...]], np.ndarray]:
    """Paths of one regression tree on ``target`` over ``rows``, and its prediction for all rows."""
    found: list[tuple[tuple[int, bool, float], ...]] = []
    fitted = np.zeros(len(x))

    def grow(here: np.ndarray, sampled: np.ndarray, path: tuple) -> None:
        best = None
        if len(path) < depth and len(sampled) >= 2 * least:
            y = target[sampled]
            total, count = y.sum(), len(y)
            for k in features.tolist():
                if not len(cuts[k]):
                    continue
                b = bins[sampled, k]
                n = np.cumsum(np.bincount(b, minlength=len(cuts[k]) + 1))[:-1]
                s = np.cumsum(np.bincount(b, y, len(cuts[k]) + 1))[:-1]
                good = (n >= least) & (count - n >= least)
                if not good.any():
                    continue
                gain = np.where(good, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(count - n, 1), -np.inf)
                j = int(gain.argmax())
                if best is None or gain[j] > best[0]:
                    best = (float(gain[j]), k, j)
            if best is not None and best[0] <= total**2 / count + 1e-9:
                best = None
        if best is None:
            fitted[here] = target[sampled].mean() if len(sampled) else 0.0
            return
        _, k, j = best
        for above in (False, True):
            rule = (*path, (k, above, float(cuts[k][j])))
            found.append(rule)
            grow(here[(bins[here, k] > j) == above], sampled[(bins[sampled, k] > j) == above], rule)

    grow(np.arange(len(x)), rows, ())
    return found, fitted


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, steps: int = STEPS, seed: int = 7) -> Rules:
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Rules(names, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    bins = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    least, rules = max(5, len(y) // 1000), {}
    for _ in range(trees):
        rows = rng.choice(len(y), max(1, len(y) // 2), replace=False)
        features = rng.choice(x.shape[1], max(1, (2 * x.shape[1]) // 3), replace=False)
        residual = y - 1 / (1 + np.exp(-margin))
        found, fitted = tree_rules(x, bins, cuts, residual, rows, features, depth, least)
        margin += 0.8 * fitted / max(1e-9, float((y * (1 - y)).mean() or 0.15))
        margin = np.clip(margin, -6, 6)
        rules.update(dict.fromkeys(found))
    kept, columns, seen = [], [], set()
    for rule in rules:
        held = holds(x, rule)
        share, key = held.mean(), np.packbits(held).tobytes()
        if 0 < share < 1 and key not in seen:
            seen.add(key)
            kept.append(rule)
            columns.append(held)
    if not kept:
        return Rules(names, float(np.log(y.mean() / (1 - y.mean()))))
    weights, bias = lasso_logistic(np.stack(columns, 1), y, lasso, steps)
    some = np.flatnonzero(np.abs(weights) > 1e-4)
    return Rules(names, bias, [float(weights[k]) for k in some], [kept[k] for k in some])


def lasso_logistic(held: np.ndarray, y: np.ndarray, lasso: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient on rules scaled to unit spread; weights come back in plain units."""
    mean = held.mean(0)
    spread = np.maximum(np.sqrt(mean * (1 - mean)), 0.05)
    z = ((held - mean) / spread).astype(np.float32)
    rate = 4.0 / max(1.0, float(np.linalg.norm(z[:: max(1, len(z) // 2000)], 2) ** 2 / len(z[:: max(1, len(z) // 2000)])))
    w, b, last, momentum = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(z.shape[1]), 1.0
    ahead = w.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ ahead.astype(np.float32) + b)))
        error = (p - y) / len(y)
        w = ahead - rate * (z.T @ error.astype(np.float32))
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        b -= rate * float(error.sum())
        next_ = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = w + (momentum - 1) / next_ * (w - last)
        last, momentum = w, next_
    plain = w / spread
    return plain, b - float(plain @ mean)


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Rules:
    """Rules from the labelled rows with the ``sample`` smallest hashes of their ids."""
    chosen = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("double").alias("y")).where("i is not null and y is not null")
    chosen = chosen.orderBy(F.xxhash64("i"), "i", "y").limit(sample)  # at most ``sample`` pairs of numbers, so small enough to broadcast
    stats = statistics("t")
    rows = docs.select(F.col(doc_id).alias("o"), F.col(text).alias("t")).join(F.broadcast(chosen), F.col("o") == F.col("i")).select("i", "y", F.unhex(text_key("t")).alias("d"), *(c.alias(f"s_{n}") for n, c in stats.items()))
    # A repeated row counts once; of an id's texts, those with the smallest digests come first, so equal tables give equal rules.
    rows = rows.groupBy("i", "y", "d").agg(*(F.any_value(f"s_{n}").alias(f"s_{n}") for n in stats))
    held = rows.orderBy(F.xxhash64("i"), "i", "y", "d").limit(sample).drop("d").toPandas()
    x, y = held[[f"s_{n}" for n in stats]].to_numpy(np.float64), held["y"].to_numpy(np.float64)
    return fit_rules(x, (y > 0.5).astype(float), list(stats))


def score(df: DataFrame, rules: Rules, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` plus the score of the texts."""
    held = fresh(df, "quality_statistics")
    out = fresh(df, "quality_score")
    df = df.withColumn(held, F.struct(*(c.alias(n) for n, c in statistics(text).items())))
    return df.withColumn(out, rules.column({n: F.col(f"{held}.{n}") for n in rules.names})).drop(held), out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rules = fit(docs, labels.where(part != 0), "quality")
    df, out = score(docs.select("doc_id", "text"), rules)
    return df.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), F.col(out).alias("score"), (F.col(out) >= THRESHOLD).cast("int").alias("predicted"))
