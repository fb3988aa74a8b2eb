from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codelathe.functions import scoring, text
from codelathe.functions.vector import cosine, guarded_cosine
from codelathe.operators import chunks, code, graph, limits, logs, retrieval
from codelathe.plans import planner


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def lits(*xs):
    return F.array(*(F.lit(float(x)).cast("float") for x in xs))


def test_cosine(spark):
    assert value(spark, cosine(lits(1, 0), lits(1, 0))) == pytest.approx(1)
    assert value(spark, cosine(lits(1, 2), lits(-1, -2))) == pytest.approx(-1)
    assert value(spark, cosine(lits(0, 0), lits(1, 0))) == 0
    assert value(spark, cosine(lits(1), lits(1, 0))) is None
    assert value(spark, guarded_cosine(lits(1, 0), lits(1, 0))) == 0
    assert value(spark, guarded_cosine(lits(1, 0), lits(1, 0), 2)) == pytest.approx(1)


@pytest.mark.parametrize(("query", "kind"), [("What is the design", "CONCEPTUAL"), ("where is the method", "IMPLEMENTATION"), ("explain the class", "MIXED"), ("hello", "MIXED"), ("", "MIXED"), (None, "MIXED")])
def test_query_type(spark, query, kind):
    assert value(spark, text.query_type(F.lit(query).cast("string"))) == kind


def test_terms_and_counts(spark):
    assert value(spark, text.search_terms(F.lit("How the Cache cache-key of X1?"))) == ["cache", "cache", "key"]
    assert value(spark, text.rerank_terms(F.lit("the key key_of map"))) == ["key", "map"]
    assert value(spark, text.keyword_set(F.lit("Foo foo BAR ab"))) == ["foo", "bar"]
    assert value(spark, text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2
    assert value(spark, text.occurrences(F.lit("aaaa"), F.lit(""))) == 0


def test_subject_and_expansion(spark):
    assert value(spark, text.subject(F.lit("what is the UserStore for"))) == "UserStore"
    assert value(spark, text.subject(F.lit("what is the cache"))) == "cache"
    assert "cache purpose" in value(spark, text.expanded(F.lit("what is the cache")))
    assert value(spark, text.expanded(F.lit("list cache"))) == "list cache"


def test_template_masks_in_order(spark):
    t = lambda s: value(spark, text.template(F.lit(s)))
    assert t("job 12 at /a/b.txt") == "job <NUM> at <PATH>"
    assert t("id 0123456789abcdef0123456789abcdef") == "id <ID>"
    assert t("id 1234abcd-aaaa-bbbb-cccc-1234567890ab") == "id <ID>"
    # Numbers are masked before ids, so an id with a group of digits alone stays.
    assert t("id 1234abcd-1111-bbbb-cccc-1234567890ab") == "id 1234abcd-<NUM>-bbbb-cccc-1234567890ab"
    assert t(r"at C:\x\y") == "at C:<PATH>"


def test_languages_and_domains(spark):
    assert value(spark, text.language(F.lit("a/b/C.java"))) == "java"
    assert value(spark, text.language(F.lit("Makefile"))) == "unknown"
    assert value(spark, text.code_type(F.lit("x/MyException.java"))) == "exception"
    assert value(spark, text.domain(F.lit("HTTPS://A.Example.com:80/x?y"))) == "a.example.com:80"
    assert value(spark, text.trusted(F.lit("a.example.com"), ["example.com"]))
    assert not value(spark, text.trusted(F.lit("badexample.com"), ["example.com"]))
    assert value(spark, text.truncated(F.lit("abcdef"), 4)) == "abcd... [2 more chars]"


def test_confidence(spark):
    zero = scoring.components(F.lit(0.0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.0))
    assert value(spark, scoring.score(zero)) == pytest.approx(0.3 * 0.5 + 0.2 * 0.3)
    big = scoring.components(F.lit(9.0), F.lit(2), F.lit(2), F.lit(1), F.lit(1), F.lit(1.0), F.lit(9.0))
    assert value(spark, scoring.score(big)) == pytest.approx(1)
    assert value(spark, scoring.rating(F.lit(0.9))) == "Very High"
    assert value(spark, scoring.rating(F.lit(0.1))) == "Very Low"
    assert value(spark, scoring.score(zero | {"vector": F.lit(None).cast("double")})) == 0.1
    assert value(spark, scoring.clarity(F.lit("  "))) == 0.1
    assert value(spark, scoring.explanation(zero))["tool"]["percent"] == 71
    assert "weak vector" in value(spark, scoring.key_factors(zero))


def test_fusion_with_full_weight_is_the_single_list(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.8)], "id long, score double")
    b = spark.createDataFrame([(9, 5.0)], "id long, score double")
    assert [r.id for r in retrieval.fuse(a, b, 3, 1.0).collect()] == [1, 2, 3]


def test_knn_is_a_prefix_of_the_full_order(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0], f"n{i % 2}") for i in range(12)], "id long, vector array<float>, namespace string")
    q = spark.createDataFrame([([1.0, 1.0],)], "query_vector array<float>")
    full = [r.id for r in retrieval.knn(v, q, 100).collect()]
    assert [r.id for r in retrieval.knn(v, q, 4).collect()] == full[:4]
    assert retrieval.knn_by_namespace(v, q, 2, 10).count() == 4
    assert retrieval.knn_by_namespace(v, q, 2, 10, ["n0"]).count() == 2
    assert retrieval.valid_vectors(v, 3).count() == 0


def test_error_patterns(spark):
    rows = [(1, "ERROR", "job 1 failed"), (2, "ERROR", "job 2 failed"), (3, "ERROR", "once"), (4, "INFO", "job 3 failed"), (5, "FATAL", "job 4 failed"), (6, "ERROR", None), (7, "ERROR", "job 9 failed")]
    found = logs.error_patterns(spark.createDataFrame(rows, "ord long, level string, message string")).collect()
    assert [(r.template, r.frequency, r.examples) for r in found] == [("job <NUM> failed", 4, ["job 1 failed", "job 2 failed", "job 4 failed"])]


def test_windows_restore_the_text(spark):
    size, overlap, tail = 50, 10, 15
    for n in (0, 1, 50, 51, 95, 130, 171):
        t = "".join(chr(97 + i % 26) for i in range(n))
        rows = sorted(chunks.windows(spark.createDataFrame([(1, t)], "id long, text string"), size=size, overlap=overlap, tail=tail).collect(), key=lambda r: r.n)
        out = rows[0].content[:size]
        for r in rows[1:]:
            out += r.content[overlap:size]
        last = rows[-1].content
        if len(last) > size:
            out = out + last[size + overlap :]
        assert out == t


def test_context_of_chunks(spark):
    found = chunks.with_context(spark.createDataFrame([(1, 0, "a" * 20), (1, 1, "b" * 20)], "id long, n int, content string"))
    assert [(r.context_before, r.context_after) for r in sorted(found.collect(), key=lambda r: r.n)] == [("", "bbb"), ("aaa", "")]


JAVA = """package a.b;
import java.util.List;
public class Box {
  private int n; // {
  public int getN() { return n; }
  void put(String s) {
    if (s == null) { return; }
    log.info("put {}", s);
  }
  interface Inner { int size(); }
}
"""


def test_code_chunks(spark):
    files = [("x/Box.java", JAVA), ("y.py", "class A:\n  def f(self):\n    pass\n\ndef g():\n  return 1\n"), ("z.js", "function a() {\n  return {}\n}\nclass B {\n}\n"), ("m.go", "type T struct {\n}\nfunc (t T) F() {\n}\n"), ("e.txt", None)]
    found = chunks.code_chunks(spark.createDataFrame(files, "path string, content string")).collect()
    ids = {r.id: (r.type, r.start_line, r.end_line) for r in found}
    assert ids["x/Box.java#Box"] == ("class", 3, 11)
    assert ids["x/Box.java#Box.put"] == ("method", 6, 9)
    assert ids["x/Box.java#Box.Inner"] == ("interface", 10, 10)
    assert ids["y.py#A.f"] == ("function", 2, 3) and ids["y.py#g"] == ("function", 5, 6)
    assert ids["z.js#a"] == ("function", 1, 3) and ids["z.js#B"] == ("class", 4, 5)
    assert ids["m.go#T"] == ("class", 1, 2) and ids["m.go#F"] == ("function", 3, 4)
    assert ids["e.txt"][0] == "file"


def test_graph_walks(spark):
    edges = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "c", "t"), ("c", "d", "t")], "source string, target string, type string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in graph.reach(edges, start, 5).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r.node for r in graph.reach(edges, start, 1).collect()} <= {r.node for r in graph.reach(edges, start, 2).collect()}
    assert [r.path for r in graph.paths(edges, start, 5).collect()] == [["a", "b", "c", "d"]]
    assert graph.related(edges, "unknown", 3).count() == 0
    assert {(r.target, r.direction) for r in graph.neighbours(edges, "c").collect()} == {("a", "out"), ("c", "out"), ("d", "out"), ("b", "in"), ("c", "in")}


def test_property_impact(spark):
    files = spark.createDataFrame([("A.java", 'package p; @Service public class AuthService { @Value("${app.url:x}") String u; }'), ("B.java", 'package p; class B { String s = env.getProperty("app.url"); }'), ("C.java", "class C {}")], "path string, content string")
    rows = {r.path: r for r in code.property_references(files, "app.url").collect()}
    assert set(rows) == {"A.java", "B.java"}
    assert rows["A.java"].is_critical and rows["A.java"].access == "fallback" and rows["A.java"].component == "Service" and rows["A.java"].class_name == "p.AuthService"
    assert value(spark, code.severity(F.lit(0), F.lit(0), F.lit(0), F.lit(0))) == "UNKNOWN"
    assert value(spark, code.db_technology(F.lit("jdbc:postgresql://h/d"))) == "PostgreSQL"
    assert value(spark, code.db_property_type(F.lit("spring.datasource.password"))) == "authentication"
    assert value(spark, code.is_db_property(F.lit("spring.jpa.x"))) and not value(spark, code.is_db_property(F.lit("app.name")))


def test_each_property_use_counts(spark):
    uses = "".join(f'@Value("${{app.url}}") String u{i}; ' for i in range(5)) + '@Value("${app.url:x}") String v; String s = env.getProperty("app.port");'
    files = spark.createDataFrame([("A.java", f"package p; class A {{ {uses} }}"), ("C.java", "class C {}")], "path string, content string")
    found = code.property_references(files, "app.url")
    assert sorted(r.access for r in found.collect()) == ["direct"] * 5 + ["fallback"]
    row = code.impact(found.withColumn("property", F.lit("app.url"))).first()
    assert (row.n_references, row.n_classes, row.severity) == (6, 1, "MEDIUM")
    for name in ("app.*", "app*"):
        assert sorted((r.kind, r.access) for r in code.property_references(files, name).collect()) == [("environment", "direct"), *[("value", "direct")] * 5, ("value", "fallback")]


def test_exception_patterns(spark):
    files = {
        "empty": "try {} catch (IOException e) { }",
        "generic": "catch (Exception e) { throw new MyError(e); }",
        "print": "catch (IOException e) { e.printStackTrace(); }",
        "log": 'catch (IOException e) { log.error("x", e); }',
        "sleep": "catch (IOException e) { Thread.sleep(1); }",
        "swallow": "catch (IOException e) { count++; }",
        "answer": "catch (IOException e) { return null; }",
        "other": "catch (SQLException e) { }",
        "clean": "catch (IOException e) { throw new IllegalStateException(e); }",
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    found = {(r.path, r.pattern) for r in code.anti_patterns(df, "java.io.IOException").collect()}
    assert found == {("empty", "empty_catch"), ("generic", "generic_catch"), ("print", "print_stack_trace"), ("log", "log_only"), ("sleep", "sleep_in_catch"), *((x, "swallowed") for x in ("empty", "print", "sleep", "swallow"))}
    assert {r.path for r in code.exception_uses(df, "java.lang.IllegalStateException").collect()} == {"clean"}


def test_boilerplate_and_logs(spark):
    assert value(spark, code.boilerplate(F.lit("public int getN() { return n; }")))
    assert not value(spark, code.boilerplate(F.lit("public int sum() { return a + b; }")))
    assert [tuple(x) for x in value(spark, code.log_statements(F.lit('log.info("a"); logger.error("b", e);')))] == [("info", "a"), ("error", "b")]


def test_limits_from_first_request(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("d", 1, at(50)), ("d", 2, at(60)), ("d", 3, at(109)), ("d", 4, at(110)), ("e", 5, at(0))]
    found = limits.limited_from_first(spark.createDataFrame(rows, "domain string, id long, ts timestamp"), 2)
    assert {r.id: r.allowed for r in found.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}


def test_cache_keeps_the_newest(spark):
    rows = [("http://A/x/", dt.datetime(2024, 1, 1, 1), 1), ("http://a/x", dt.datetime(2024, 1, 1, 2), 2), ("http://b", dt.datetime(2023, 12, 1), 3)]
    df = spark.createDataFrame(rows, "url string, ts timestamp_ntz, n int")
    assert [r.n for r in limits.cached(df, "2024-01-01 12:00:00").collect()] == [2]


def test_planner(spark):
    registry = planner.Registry()
    registry.register("vector_search", lambda query: spark.range(1))
    registry.register("cross_repo_tracer", lambda query, search_term: spark.range(2))
    for bad in ("", " ", "vector_search"):
        with pytest.raises(ValueError):
            registry.register(bad, lambda: None)
    assert planner.parse_category("cross_repo|0.9|cross_repo_tracer") == ("CROSS_REPO", 0.9, ("cross_repo_tracer",))
    assert planner.parse_category("junk") == ("STATIC", 0.5, ("vector_search",))
    plan = planner.make_plan("q", "CROSS_REPO", ("cross_repo_tracer", "unknown"), registry, {"cross_repo_tracer": {"search_term": "x"}})
    assert [s.tool for s in plan.steps] == ["vector_search", "cross_repo_tracer"]
    assert set(planner.execute(plan, registry).answers) == {"vector_search", "cross_repo_tracer"}
    broken = planner.make_plan("q", "CROSS_REPO", ("cross_repo_tracer",), registry)
    assert "cross_repo_tracer" in planner.execute(broken, registry).errors
    assert [planner.status(2, n) for n in (0, 1, 2)] == ["success", "partial_success", "error"]
    assert registry.remove("vector_search") and not registry.remove("vector_search") and len(registry) == 1
