from __future__ import annotations

import pytest

from codelathe.operators import javagraph as j
from codelathe.operators import lookups, web
from codelathe.operators import sourcefiles as s
from codelathe.plans import planner

IMPORTS = {
    "a/Use.java": "package a;\nimport b.*;\nimport c.Exact;\npublic class Use {\n  private Exact exact;\n  public void go() {\n    Star.run(1);\n    exact.run(1);\n    Near.run(1);\n  }\n}\n",
    "b/Star.java": "package b;\npublic class Star {\n  public static void run(int n) {\n  }\n}\n",
    "b/Near.java": "package b;\npublic class Near {\n  public static void run(int n) {\n  }\n}\n",
    "a/Near.java": "package a;\npublic class Near {\n  public static void run(int n) {\n  }\n}\n",
    "c/Exact.java": "package c;\npublic class Exact {\n  public void run(int n) {\n  }\n}\n",
    "z/Star.java": "package z;\npublic class Star {\n  public static void run(int n) {\n  }\n}\n",
}


def test_wildcard_imports(spark):
    found = j.facts(spark.createDataFrame(list(IMPORTS.items()), "path string, content string")).cache()
    rows = {(r.target_class, r.target_full, r.confidence) for r in j.resolved(found, j.steps(found)).collect()}
    assert rows == {("Star", "b.Star", 1.0), ("Exact", "c.Exact", 1.0), ("Near", "b.Near", 1.0)}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<title>t</title><body><p>one</p>two &amp; <b>th</b>ree<script>no()</script></body>", "one two & three"),
        ("<body>out<article>in <p>deep</article><article>more</article></body>", "in deep more"),
        ("<body><div id=content>c</div><main>m<main>n</main></main></body>", "m n"),
        ("<div class='x content'>k</div><div id='main'>no</div>", "k"),
        ("<div id=main>a<noscript>b</noscript><img src=x>c</div>", "a c"),
    ],
)
def test_main_text(html, text):
    assert web.main_text(html) == text


def test_main_texts(spark):
    pages = spark.createDataFrame([(1, "<main>x</main>"), (2, None)], "page_id long, html string")
    assert {(r.page_id, r.text) for r in web.main_texts(pages).collect()} == {(1, "x"), (2, "")}
    assert web.main_texts(pages.where("false")).collect() == []


def test_errors_and_retries():
    waits, calls = [], []

    def fails(error):
        def run():
            calls.append(1)
            raise error

        return run

    with pytest.raises(RuntimeError):
        planner.retried(fails(RuntimeError()), retries=2, wait=1.0, factor=2.0, sleep=waits.append)
    assert len(calls) == 3 and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        planner.retried(fails(ValueError()), sleep=waits.append)
    assert len(calls) == 4
    assert planner.error_category(TimeoutError()) == "EXECUTION_TIMEOUT" and not planner.is_retryable(MemoryError())
    assert planner.retried(lambda: 7) == 7


def test_static_fallback(spark):
    tools = planner.Registry()
    tools.register("vector_search", lambda query: 1 / 0)
    plan = planner.make_plan("q", "STATIC", (), tools)
    out = planner.answer(plan, tools, lambda q: spark.createDataFrame([(q,)], "q string"))
    assert out.failed and out.answers["static"].first().q == "q"


def test_odd_inputs(spark):
    none = spark.createDataFrame([], "repository string, path string, content string")
    assert s.repositories(none).collect() == [] and s.log_calls(none).collect() == []
    assert s.default_value(none, "a").first().value is None
    files = spark.createDataFrame([("r", "a.yml", None), ("r", "B.java", "\x01log.info(\x01);\nlog.info(2);")], "repository string, path string, content string")
    assert s.property_sources(files, ["a"]).collect() == []
    assert [(r.line, r.message) for r in s.log_calls(files).orderBy("line").collect()] == [(1, ""), (2, "2")]
    names = spark.createDataFrame([(None,), ("",), ("r/x",)], "p string").select(lookups.namespace_of("p").alias("n"))
    assert [r.n for r in names.collect()] == ["default", "default", "r"]
