from __future__ import annotations

import json

from pyspark.sql import functions as F

from codelathe.sources import readers
from codelathe.streaming import events
from tests.conftest import SF


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_readers(spark, tmp_path):
    put(tmp_path / "logs/a.log", '{"timestamp":"2024-01-01T00:00:00Z","level":"ERROR","service":"s","message":"m"}\nnot json\n')
    assert readers.logs(spark, str(tmp_path / "logs")).count() == 1
    for n in (1, 2):
        put(tmp_path / f"kb/{n}.json", json.dumps({"articleId": "k", "title": f"t{n}", "tags": ["A"]}))
    assert [r.title for r in readers.articles(spark, str(tmp_path / "kb")).collect()] == ["t2"]
    put(tmp_path / "t/1.json", json.dumps({"ticketId": "T", "conversation": [{"messageId": "a"}, {"messageId": "b"}]}, indent=1))
    assert [r.messageId for r in readers.ticket_messages(readers.tickets(spark, str(tmp_path / "t"))).orderBy("position").collect()] == ["a", "b"]
    put(tmp_path / "v/ns/1.json", json.dumps({"id": "1", "vector": [1.0, 2.0]}))
    held = readers.vectors(spark, str(tmp_path / "v"))
    assert [(r.id, r.namespace) for r in held.collect()] == [("1", "ns")]
    put(tmp_path / "m.json", json.dumps([{"id": "1", "source": "s"}, {"id": "2", "source": "s"}, {"id": "1", "source": None}]))
    assert readers.metadata(spark, str(tmp_path / "m.json"), held).count() == 1
    for name in ("src/A.java", "node_modules/x.js", "src/b.bin", "src/.hid.java"):
        put(tmp_path / "code" / name, "x")
    assert [r.path.rsplit("/", 1)[-1] for r in readers.code(spark, str(tmp_path / "code")).collect()] == ["A.java"]
    put(tmp_path / "p/a.properties", "# c\na.b = 1=2\n\n")
    assert [(r.key, r.value) for r in readers.properties(spark, str(tmp_path / "p")).collect()] == [("a.b", "1=2")]


def test_partition_overwrite(spark, tmp_path):
    out = str(tmp_path / "o")
    readers.write_by(spark.createDataFrame([(1, "a"), (2, "b")], "x int, ns string"), out, "ns")
    readers.write_by(spark.createDataFrame([(3, "b")], "x int, ns string"), out, "ns")
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [1, 3]


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.orderBy("ts").coalesce(1).write.parquet(folder)
    events.run_once(events.window_counts(events.read(spark, folder), "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.begin, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.begin, r.event_type): r.n for r in table.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("begin"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items())
    assert len(got) >= len(want) - 20  # windows that the watermark has not closed stay open


def test_stateful_limit(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet(f"{SF}/events.parquet").coalesce(1).write.parquet(folder)
    events.run_once(events.limited(events.read(spark, folder), 1, 3600), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == spark.read.parquet(folder).count() and got.where("allowed").count() > 0
