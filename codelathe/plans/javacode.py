"""Queries over facts of Java sources, each beside SQL that reads the same lines.

The sources are the rows of ``SOURCES``: a declaration for each line, one type
for each file, so that SQL can find them by patterns of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.operators import chunks, javagraph, patterns
from codelathe.plans.catalog import query
from codelathe.plans.lookups import _values

SOURCES = [
    ("pay/Gate.java", "package pay;\npublic interface Gate {\n}"),
    ("pay/CardGate.java", "package pay;\npublic class CardGate extends BaseGate implements Gate, Audited {\n    public Receipt charge(int amount) throws PayException {\n        return audit(amount);\n    }\n}"),
    ("pay/BaseGate.java", "package pay;\nabstract class BaseGate implements Audited {\n    public Receipt audit(int amount) {\n        return null;\n    }\n}"),
    ("pay/GateFactory.java", "package pay;\npublic class GateFactory {\n    public CardGate createGate(String kind) {\n        return null;\n    }\n    public int getCount() {\n        return 1;\n    }\n}"),
    ("web/Desk.java", "package web;\n@RestController\npublic class Desk {\n    public String show(int id) throws PayException {\n        return null;\n    }\n    private String hide(int id) {\n        return null;\n    }\n}"),
    ("web/Order.java", "package web;\npublic final class Order<T> extends Base<T> implements Gate {\n    public Order<T> add(int n) {\n        return this;\n    }\n    public String build() {\n        return null;\n    }\n}"),
    ("web/notes.txt", "package web;\npublic class Never {\n}"),
    ("web/Empty.java", None),
]

_LINES = f"WITH f AS (SELECT * FROM {_values(SOURCES, 'path, content')} WHERE path LIKE '%.java' AND content IS NOT NULL), t AS (SELECT path, content, regexp_extract(content, 'package\\s+([\\w.]+)\\s*;', 1) AS pkg, regexp_extract(content, '\\b(class|interface)\\s+\\w+', 1) AS kind, regexp_extract(content, '\\b(?:class|interface)\\s+(\\w+)', 1) AS cls FROM f), l AS (SELECT path, pkg, cls, pkg || '.' || cls AS owner, unnest(string_split(content, chr(10))) AS line FROM t), m AS (SELECT *, regexp_extract(line, '^\\s+(public|private)\\s', 1) AS access, regexp_extract(line, '^\\s+(?:public|private)\\s+([\\w<>]+)\\s+\\w+\\(', 1) AS result, regexp_extract(line, '(\\w+)\\(', 1) AS name FROM l WHERE regexp_matches(line, '^\\s+(public|private)\\s+[\\w<>]+\\s+\\w+\\('))"
_PARENT = "h AS (SELECT owner, pkg, regexp_replace(line, '<[^<>]*>', '', 'g') AS line FROM l WHERE regexp_matches(line, '\\b(class|interface)\\s')), p AS (SELECT owner, pkg, 'EXTENDS' AS type, regexp_extract(line, 'extends\\s+(\\w+)', 1) AS parent FROM h UNION ALL SELECT owner, pkg, 'IMPLEMENTS', trim(unnest(string_split(regexp_extract(line, 'implements\\s+([\\w, ]+)', 1), ','))) FROM h)"


def _facts(spark: SparkSession) -> DataFrame:
    return javagraph.facts(_sources(spark))


def _sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "path string, content string")


@query("java_nodes", f"{_LINES} SELECT 'java:' || pkg || '.' || cls AS id, kind AS type, cls AS name, path FROM t UNION ALL SELECT 'java:' || owner || '.' || name, 'method', name, path FROM m")
def java_nodes(spark: SparkSession, d: str) -> DataFrame:
    return javagraph.nodes(_facts(spark)).select("id", "type", "name", "path")


@query("java_edges", f"{_LINES}, {_PARENT} SELECT 'java:' || owner AS source, 'java:' || pkg || '.' || parent AS target, type FROM p WHERE parent <> '' UNION ALL SELECT 'java:' || owner, 'java:' || owner || '.' || name, 'CONTAINS' FROM m")
def java_edges(spark: SparkSession, d: str) -> DataFrame:
    return javagraph.edges(_facts(spark))


@query("java_implementations", f"{_LINES}, {_PARENT} SELECT pkg || '.' || parent AS interface, string_agg(DISTINCT owner, ',' ORDER BY owner) AS implementations FROM p WHERE parent <> '' AND type = 'IMPLEMENTS' GROUP BY 1")
def java_implementations(spark: SparkSession, d: str) -> DataFrame:
    return javagraph.implementations(_facts(spark)).select("interface", F.array_join("implementations", ",").alias("implementations"))


@query("java_throwing_methods", f"{_LINES} SELECT DISTINCT owner, name FROM m WHERE regexp_matches(line, 'throws\\s[^{{]*\\bPayException\\b')")
def java_throwing_methods(spark: SparkSession, d: str) -> DataFrame:
    return javagraph.thrown(_facts(spark), "pay.PayException")


@query("java_entry_points", f"{_LINES} SELECT path, owner, name FROM m WHERE access = 'public' AND path IN (SELECT path FROM f WHERE regexp_matches(content, '\\bmain\\s*\\(|@(Rest)?Controller\\b|@(Get|Post|Put|Delete|Patch|Request)Mapping\\b'))")
def java_entry_points(spark: SparkSession, d: str) -> DataFrame:
    return javagraph.entry_points(_facts(spark), _sources(spark))


@query("java_factories", f"{_LINES} SELECT DISTINCT owner, cls AS simple, name AS method, result AS product FROM m WHERE contains(cls, 'Factory') AND regexp_matches(name, '^(create|new|get)') AND result NOT IN ('void', 'int', 'long', 'short', 'byte', 'char', 'boolean', 'float', 'double')")
def java_factories(spark: SparkSession, d: str) -> DataFrame:
    return patterns.factories(_facts(spark))


@query("java_builders", f"{_LINES} SELECT owner, any_value(cls) AS simple FROM m GROUP BY owner HAVING bool_or(regexp_replace(result, '<.*$', '') = cls) AND bool_or(name = 'build')")
def java_builders(spark: SparkSession, d: str) -> DataFrame:
    return patterns.builders(_facts(spark))


@query("java_chunk_counts")
def java_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """Structural chunks by file and type; a parser's rows, tested by unit tests."""
    return chunks.code_chunks(_sources(spark)).groupBy("path", "type").agg(F.count("*").alias("n"))


@query("java_calls")
def java_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls with their resolved targets; a parser's rows, tested by unit tests."""
    found = _facts(spark)
    return javagraph.resolved(found, javagraph.steps(found)).select("owner", "method", "target_method", "target_full", "confidence")
