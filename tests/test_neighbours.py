"""Nearest neighbours of many queries against every pair's cosine."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from codelathe.functions.vector import cosine
from codelathe.operators import neighbours
from codelathe.plans import catalog, queries  # noqa: F401
from tests.conftest import SF

NAN = float("nan")
COLUMNS = "id long, vector array<float>"


def every_pair(v, q, k):
    pairs = v.join(q.select(F.col("id").alias("qid"), F.col("vector").alias("b")), F.col("id") != F.col("qid"))
    s = pairs.select("qid", "id", F.round(cosine(F.col("vector"), F.col("b")), 6).alias("similarity"))
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    return s.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def rows(df):
    return sorted(map(tuple, df.collect()))


def agree(spark, held, k=5, **more):
    v = spark.createDataFrame(held, COLUMNS).repartition(3)
    q = v.where("id % 50 = 0")
    got, want = rows(neighbours.nearest(v, q, k, **more)), rows(every_pair(v, q, k))
    assert got == want
    return got


def odd():
    return [
        (0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (50, [0.0, 0.0]), (3, [1.0, 1.0, 1.0]), (4, [1.0, None]), (100, None), (150, [2.0, None]),
        (6, [1.0, 0.5]), (-50, [3.0, 0.0]), (None, [1.0, 0.0]), (200, [1.0, 2.0, 3.0]), (7, []), (250, []), (8, [float("inf"), 1.0]), (9, [NAN, 1.0]), (300, [1.0, NAN]), (10, [-1.0, -0.5]),
    ]


def test_odd_vectors(spark):
    assert {r[0] for r in agree(spark, odd())} == {0, 50, 100, 150, -50, 200, 250, 300}
    agree(spark, odd(), 1)
    agree(spark, odd(), 30)
    agree(spark, odd()[:1])
    agree(spark, odd()[1:2])


def test_null_vectors_follow_by_id_without_the_query(spark):
    got = agree(spark, [(0, [1.0]), (1, None), (2, [2.0]), (3, None), (1, None), (4, [1.0, 1.0])], 4)
    assert got == [(0, 1, None, 2), (0, 1, None, 3), (0, 2, 1.0, 1), (0, 3, None, 4)]
    agree(spark, [(0, [1.0]), (0, None), (0, None), (0, None), (1, None), (2, None)], 2)


@pytest.mark.parametrize("blocks", [(2048, 512, 8192), (7, 3, 40)])
def test_copies_and_ties(spark, monkeypatch, blocks):
    for name, value in zip(("BLOCK_ROWS", "BLOCK_QUERIES", "TASK_ROWS"), blocks):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(3)
    few = r.integers(-1, 2, (600, 3)).astype(float)
    many = np.concatenate([few, np.tile(r.normal(size=3), (300, 1)), r.normal(size=(300, 3)), few[:100] * 3 + r.normal(size=(100, 3)) * 1e-7])
    ids = r.permutation(len(many)) * 5
    agree(spark, [(int(i), list(map(float, x))) for i, x in zip(ids, many)])


def test_queries_part_by_part(spark):
    r = np.random.default_rng(4)
    held = [(int(i), list(map(float, x))) for i, x in enumerate(r.normal(size=(400, 8)).round(1))]
    agree(spark, held + odd(), part_bytes=256)


def test_rounding_is_sparks(spark):
    x = np.concatenate([np.arange(-40, 41) / 64, [0.1234565, -0.1234565, 0.0000005, -0.0000005, 1e-9, -1e-9, 0.9999995, 1.0, -1.0, 0.1234575, 2.5e-7]])
    want = [a[0] for a in spark.createDataFrame([(float(a),) for a in x], "x double").select(F.round("x", 6)).collect()]
    assert list(neighbours.rounded(x, 6)) == want


def test_many_queries_make_no_row_of_each_pair(spark):
    plan = catalog.QUERIES["nearest_of_queries"](spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in plan and "Cartesian" not in plan
