"""Exact nearest neighbours of many query vectors: blocks of rows meet blocks of queries in matrix products."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelathe.operators.javagraph import _cut

#: Rows of a task, and the number of tasks from which on tasks grow up to the larger one, as each task sends ``k`` rows for each query.
TASK_ROWS, TASKS, LARGE_TASK_ROWS = 8192, 64, 65_536
#: Rows and queries of one matrix product.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 512
#: Numbers that exact similarities hold at once.
EXACT_NUMBERS = 1 << 20
#: Bytes of query vectors that are broadcast at once; more queries go part by part.
PART_BYTES = 32 << 20
#: More than a matrix product's cosines differ from sums in order.
SLACK = 1e-9
FOUND = "qid long, id long, similarity double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, key: str = "id", vector: str = "vector", part_bytes: int = PART_BYTES) -> DataFrame:
    """(qid, id, similarity, rank): the ``k`` rows of ``vectors`` nearest to each row of ``queries``, rows of its own id left out.

    Similarity is :func:`codelathe.functions.vector.cosine` rounded to ``digits``; nulls come last, equal ones by id. Ids are whole
    numbers. Every pair is met; matrix products only tell which pairs can't be among the best, the others' cosines are summed in order.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    count = rows.count()
    numbers = asked.agg(F.sum(F.coalesce(F.greatest(F.size("v"), F.lit(0)), F.lit(0)) + 1)).first()[0] or 0
    parts = max(1, -(-numbers * 8 // part_bytes))
    rows = rows.repartition(max(1, min(-(-count // TASK_ROWS), max(TASKS, -(-count // LARGE_TASK_ROWS)))), "id")
    if parts > 1:
        rows = _cut(rows)
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    found = None
    for n in range(parts):
        part = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n)
        best = rows.mapInArrow(_search(part, k, digits), FOUND).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
        best = best if parts == 1 else _cut(best)
        found = best if found is None else found.unionAll(best)
    return found


def _search(queries: DataFrame, k: int, digits: int):
    table = queries.toArrow().combine_chunks()
    chunks = [_by_length(b.column("id"), b.column("v")) for b in table.to_batches()]
    joined = {d: tuple(np.concatenate([c[d][i] for c in chunks if d in c]) for i in (0, 1)) for d in {d for c in chunks for d in c}}
    held = queries.sparkSession.sparkContext.broadcast(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: _Best(*q, k, digits) for d, q in held.value.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                met = _by_length(batch.column("id"), batch.column("v"))
                for d, b in best.items():
                    if d >= 0 and d in met:
                        b.meet(*met[d])
                    b.miss([ids for other, (ids, _) in met.items() if other != d or d < 0])
        for b in best.values():
            yield from b.rows()

    return run


def _by_length(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices by the vectors' length, which is -1 for null; nulls inside become NaN."""
    ids = ids.to_numpy(zero_copy_only=False)
    length = np.array(pc.fill_null(pc.list_value_length(vectors), -1), np.int64)
    out = {}
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        held = vectors if len(at) == len(length) else vectors.take(pa.array(at))
        out[d] = ids[at], (held.flatten().to_numpy(zero_copy_only=False).reshape(len(at), d) if d >= 0 else np.zeros((len(at), 0)))
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums of rows in order, as a fold gives them."""
    return np.add.accumulate(x, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _norms(x: np.ndarray) -> np.ndarray:
    step = max(1, EXACT_NUMBERS // max(1, x.shape[1]))
    parts = [np.sqrt(_sums(np.square(x[i : i + step].astype(np.float64)))) for i in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _unit(x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (0 where the norm is 0), and which ones aren't of use for bounds; those are 0, too."""
    odd = ~((norms == 0) | (norms > 1e-100) & (norms < 1e100))
    good = ~odd & (norms > 0)
    out = np.zeros(x.shape)
    out[good] = x[good] / norms[good, None]
    return out, odd


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round``: half up, by the decimal digits that a number is written with."""
    scaled = np.abs(x) * 10.0**digits
    whole = np.floor(scaled)
    out = np.copysign(np.floor(scaled + 0.5) / 10.0**digits, x) + 0.0
    for i in np.flatnonzero(np.abs(scaled - whole - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


class _Best:
    """The best ``k`` rows so far for each query of one length."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, digits: int):
        self.qid, self.q, self.k, self.digits = qid, q, k, digits
        self.norm = _norms(q)
        self.value = np.full((len(qid), k), -np.inf)
        self.id = np.full((len(qid), k), np.iinfo(np.int64).max)
        self.missed = np.zeros(0, np.int64)

    def meet(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows of the queries' length."""
        rows = rows.astype(np.float64)
        norm = _norms(rows)
        unit, odd = _unit(rows, norm)
        unit = np.ascontiguousarray(unit.T)
        for begin in range(0, len(self.qid), BLOCK_QUERIES):
            s = slice(begin, begin + BLOCK_QUERIES)
            self._block(s, ids, rows, norm, unit, odd)

    def _block(self, s: slice, ids: np.ndarray, rows: np.ndarray, norm: np.ndarray, unit: np.ndarray, odd: np.ndarray) -> None:
        qid, k, n = self.qid[s], self.k, len(ids)
        mine, odd_mine = _unit(self.q[s].astype(np.float64), self.norm[s])
        near = mine @ unit
        own = np.flatnonzero(np.isin(ids, qid))
        i, j = np.nonzero(qid[:, None] == ids[own])
        near[i, own[j]] = -np.inf
        near[:, odd] = -np.inf
        last = self.value[s, k - 1]
        bound = last
        if n >= k and np.isneginf(last).any():
            bound = np.maximum(last, np.partition(near, n - k, axis=1)[:, n - k])
        # Two values of one rounding differ by a unit at most; vectors without a bound meet everything.
        unit_place = 10.0**-self.digits
        bound = np.maximum(bound - unit_place - 2 * SLACK, -5.0)
        near[:, odd] = np.inf
        near[odd_mine] = np.inf
        near[i, own[j]] = -np.inf
        qi, ri = np.nonzero(near >= bound[:, None])
        better = (near[qi, ri] > last[qi] + unit_place / 2 - 2 * SLACK) | (ids[ri] < self.id[s, k - 1][qi])
        qi, ri = qi[better], ri[better]
        if not len(qi):
            return
        value = self._exact(qi + s.start, ri, rows, norm)
        hit = np.unique(qi)
        of = np.concatenate([np.repeat(hit, k), qi])
        values = np.concatenate([self.value[s][hit].ravel(), value])
        found = np.concatenate([self.id[s][hit].ravel(), ids[ri]])
        order = np.lexsort((found, -values, of))
        first = np.searchsorted(of[order], hit)
        top = order[first[:, None] + np.arange(k)]
        self.value[hit + s.start], self.id[hit + s.start] = values[top], found[top]

    def _exact(self, qi: np.ndarray, ri: np.ndarray, rows: np.ndarray, norm: np.ndarray) -> np.ndarray:
        out = np.empty(len(qi))
        step = max(1, EXACT_NUMBERS // max(1, rows.shape[1]))
        with np.errstate(all="ignore"):
            for at in range(0, len(qi), step):
                q, r = qi[at : at + step], ri[at : at + step]
                length = norm[r] * self.norm[q]
                x = _sums(rows[r] * self.q[q].astype(np.float64)) / length
                # As cosine's bounds do with NaN and null.
                out[at : at + step] = np.where(length == 0, 0.0, np.clip(np.where(np.isnan(x), 1.0, x), -1.0, 1.0))
        return rounded(out, self.digits)

    def miss(self, ids: list[np.ndarray]) -> None:
        """Rows of other lengths, whose similarity is null: the least ids, enough of them without any one id."""
        if ids:
            held = np.sort(np.concatenate([self.missed, *ids]))
            place = np.arange(len(held)) - np.searchsorted(held, held)
            self.missed = held[place < self.k][: 2 * self.k]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for begin in range(0, len(self.qid), 10_000):
            s = slice(begin, begin + 10_000)
            value, found = self.value[s], self.id[s]
            there = ~np.isneginf(value)
            qid, ids, values = [np.repeat(self.qid[s], there.sum(axis=1))], [found[there]], [value[there]]
            short = np.flatnonzero(there.sum(axis=1) < self.k) if len(self.missed) else []
            for i in short:
                more = self.missed[self.missed != self.qid[begin + i]][: self.k - int(there[i].sum())]
                qid.append(np.full(len(more), self.qid[begin + i]))
                ids.append(more)
                values.append(np.full(len(more), np.nan))
            values = np.concatenate(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qid), pa.int64()), pa.array(np.concatenate(ids), pa.int64()), pa.array(values, pa.float64(), mask=np.isnan(values))], ["qid", "id", "similarity"])
