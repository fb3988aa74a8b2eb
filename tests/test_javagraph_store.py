from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from codelathe.operators import javagraph as j
from codelathe.operators import store

FILES = {
    "r1/Store.java": "package a;\npublic interface Store {\n  void save(String x) throws BadError;\n}\n",
    "r1/DiskStore.java": "package a;\nimport b.Util;\nabstract class Base {\n}\nfinal class DiskStore extends Base implements Store, java.io.Closeable {\n  public void save(String x) throws BadError {\n    Util.check(x);\n    helper();\n  }\n  private void helper() { }\n}\n",
    "r2/Util.java": "package b;\n/* class Not { */\npublic class Util {\n  public static void check(String s) {\n    int n = 1;\n  }\n}\n",
    "r1/App.java": 'package a;\n@RestController\npublic class App {\n  @Autowired private Store store;\n  public void run() {\n    try {\n      store.save("x, y");\n    } catch (BadError | RuntimeException e) {\n    }\n  }\n  public void go() {\n    run();\n  }\n}\n',
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "path string, content string")


@pytest.fixture(scope="module")
def found(files):
    return j.facts(files).cache()


def test_nodes_and_edges(found):
    ids = {(r.id, r.type) for r in j.nodes(found).collect()}
    assert {("java:a.Store", "interface"), ("java:a.DiskStore", "class"), ("java:a.Base", "class"), ("java:b.Util", "class"), ("java:a.DiskStore.save", "method")} <= ids
    edges = {(r.source, r.target, r.type) for r in j.edges(found).collect()}
    assert {("java:a.DiskStore", "java:a.Base", "EXTENDS"), ("java:a.DiskStore", "java:a.Store", "IMPLEMENTS"), ("java:a.DiskStore", "java:java.io.Closeable", "IMPLEMENTS"), ("java:a.App", "java:a.App.run", "CONTAINS")} <= edges


def test_resolution(found, files):
    calls = j.resolved(found, j.steps(found)).cache()
    rows = {(r.owner, r.method, r.target_method): (r.target_full, r.target_path, r.confidence) for r in calls.collect()}
    assert rows["a.App", "run", "save"] == ("a.DiskStore", "r1/DiskStore.java", 0.8)
    assert rows["a.DiskStore", "save", "check"] == ("b.Util", "r2/Util.java", 1.0)
    assert rows["a.DiskStore", "save", "helper"] == ("a.DiskStore", "r1/DiskStore.java", 1.0)
    assert j.totals(calls).first().cross_repository == 1
    assert {r.name for r in j.entry_points(found, files).collect()} == {"run", "go"}
    assert {r.interface: r.implementations for r in j.implementations(found).collect()}["a.Store"] == ["a.DiskStore"]
    roles = {(r.owner, r.name): (r.role, r.depth) for r in j.propagation(found, calls, "x.BadError", 3).collect()}
    assert roles == {("a.Store", "save"): ("THROWS", 0), ("a.DiskStore", "save"): ("THROWS", 0), ("a.App", "run"): ("CATCHES", 1)}


def test_dependents_and_numbers(spark):
    refs = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("z", "y")], "source string, target string")
    assert {r.name for r in j.dependents(refs, spark.createDataFrame([("a",)], "name string")).collect()} == {"b", "c"}
    assert [(r["index"], r.id) for r in j.node_link(refs).orderBy("index").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "y"), (4, "z")]


def test_dependents_at_any_distance(spark):
    refs = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(20)] + [("n15", "n20"), ("n0", "n3")], "source string, target string")
    assert sorted(r.name for r in j.dependents(refs, spark.createDataFrame([("n0",)], "name string")).collect()) == sorted(f"n{i}" for i in range(1, 21))
    assert j.dependents(refs, spark.createDataFrame([], "name string")).count() == 0


def test_store(spark):
    row = spark.createDataFrame([("d", None, ["x", "y"], "code")], "a string, b string, c array<string>, e string")
    assert row.select(store.combined_text(*map(F.col, "abce")).alias("t")).first().t == "Description: d\n\nCapabilities:\n- x\n- y\n\nCode:\ncode"
    items = spark.createDataFrame([(1, "ab"), (2, " "), (3, "abc")], "id long, text string")
    held = store.embed(items, "text", lambda texts: [[float(len(t))] for t in texts])
    assert {r.id: r.vector for r in held.collect()} == {1: [2.0], 3: [3.0]}
    assert [r.id for r in store.missing(items, held).collect()] == [2]
    tries = spark.createDataFrame([("t", 1, "e1"), ("t", 2, "e2"), ("u", 1, None)], "text string, ts long, error string")
    assert [(r.failures, r.last_error) for r in store.failures(tries).collect()] == [(2, "e2")]
    lat = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 20.0), ("k", 3, 30.0)], "k string, ts long, value double")
    assert store.smoothed_latency(lat, "k").first().latency == pytest.approx(0.2 * (0.2 * 10 + 0.8 * 20) + 0.8 * 30)


def test_answers(spark):
    body = json.dumps({"result": True, "data": {"usage": {"prompt_tokens": 2, "completion_tokens": 3}, "choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}]}})
    df = spark.createDataFrame([(body,), ('{"result": false, "error": "no"}',), ("junk",)], "b string")
    rows = [r.a for r in df.select(store.chat_answer(F.col("b")).alias("a")).collect()]
    assert (rows[0]["content"], rows[0]["total_tokens"]) == ("hi", 5) and rows[1]["error"] == "no" and rows[2]["content"] is None
    shapes = ['{"data":[{"embedding":[1,2]}]}', '{"data":{"embedding":[1,2]}}', '{"embedding":[1,2]}', '{"data":[1,2]}']
    assert all(r.v == [1.0, 2.0] for r in spark.createDataFrame([(s,) for s in shapes], "b string").select(store.vector_answer(F.col("b")).alias("v")).collect())


def test_binary_and_passages(spark):
    df = spark.createDataFrame([("a.txt", bytearray("é".encode())), ("b.txt", bytearray(b"a\0b")), ("c.png", bytearray(b"x")), ("d.txt", bytearray(b"\xff\xfe\xfd"))], "path string, content binary")
    assert {r.path: r.binary for r in store.is_binary(df).collect()} == {"a.txt": False, "b.txt": True, "c.png": True, "d.txt": True}
    assert store.criteria_passages("aa bb Needle cc dd", ["needle"], 2) == ["bb Needle cc"]
    assert store.criteria_passages(None, ["x"]) == []
    pages = spark.createDataFrame([(1, "has x here"), (2, "none")], "page_id long, text string")
    assert [r.page_id for r in store.filtered_pages(pages, ["x"]).collect()] == [1]


def test_tickets_and_feedback(spark):
    t = spark.createDataFrame([("T", None)], "ticketId string, conversation array<struct<messageId: string>>")
    assert store.with_message(t, "T", F.struct(F.lit("m").alias("messageId"))).first().conversation[0].messageId == "m"
    audit = spark.createDataFrame([("r1", None), ("r2", 3)], "request_id string, rating int")
    fb = spark.createDataFrame([("r1", 2, 1), ("r1", 5, 2)], "request_id string, rating int, ts int")
    assert {r.request_id: r.rating for r in store.with_feedback(audit, fb).collect()} == {"r1": 5, "r2": 3}
