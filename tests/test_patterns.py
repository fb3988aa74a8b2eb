from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from codelathe.operators import javagraph as j
from codelathe.operators import patterns as p

FILES = {
    "r/CarFactory.java": "package a;\npublic class CarFactory {\n  public static Car createCar(int n) {\n    return null;\n  }\n  public int getCount() {\n    return 1;\n  }\n}\n",
    "r/Plan.java": "package a;\npublic class Plan {\n  public Plan width(int n) {\n    return this;\n  }\n  public Object build() {\n    return null;\n  }\n}\n",
    "r/Shop.java": "package a;\npublic class Shop {\n  @Autowired private StockService stock;\n  private int n;\n  public void sell() {\n    CarFactory.createCar(1);\n    Plan.width(2);\n    stock.take();\n  }\n}\n",
    "r/MainStockService.java": "package a;\npublic class MainStockService {\n  public void other() {\n  }\n}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    return j.facts(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()


def test_implied_steps(found):
    assert [(r.owner, r.method, r["product"]) for r in p.factories(found).collect()] == [("a.CarFactory", "createCar", "Car")]
    assert [r.owner for r in p.builders(found).collect()] == ["a.Plan"]
    rows = {(r.source, r.target, r.pattern, r.confidence) for r in p.implied_steps(found).collect()}
    assert rows == {("a.Shop", "Car", "factory", 0.8), ("a.Shop", "a.Plan", "builder", 0.7), ("a.Shop", "StockService", "injection", 0.9)}


def test_framework_calls(found):
    calls = j.resolved(found, j.steps(found))
    assert [(r.owner, r.target_class, r.target_full) for r in p.framework_calls(found, calls).collect()] == [("a.Shop", "StockService", "a.MainStockService")]


def test_tree_marks_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("b", "c")], "source string, target string")
    rows = {("".join(r.path), r.depth, r.is_cycle) for r in p.tree(edges, "a", 4).collect()}
    assert rows == {("a", 0, False), ("ab", 1, False), ("aba", 2, True), ("abc", 2, False)}
    assert [r.path for r in p.tree(edges.limit(0), "a", 2).collect()] == [["a"]]


def test_excerpts(spark):
    text = "".join(chr(97 + n % 26) for n in range(30_000))
    df = spark.createDataFrame([("ab", 0, 1), (text, 10_000, 10_010), (text, None, None), (None, None, None)], "t string, b int, e int")
    got = [r[0] for r in df.select(p.excerpt(F.col("t"), F.col("b"), F.col("e"))).collect()]
    assert got == ["ab", text[5_000:15_010], text[:15_000], None]


def test_bands_and_empty_scores(spark):
    steps = spark.createDataFrame([("f", 0.9), ("f", 0.8), ("f", 0.5), ("f", None)], "source string, confidence double")
    assert tuple(p.evidence_bands(steps).first()) == ("f", 1, 1, 2, 0.9)
    assert tuple(p.threshold_counts(steps.where("false"), 0.7, score="confidence").first()) == (0, 0, None)
