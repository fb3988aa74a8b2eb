"""Queries over repositories, property files and single source files, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.operators import code, lookups, web
from codelathe.operators import sourcefiles as s
from codelathe.plans.catalog import query
from codelathe.plans.lookups import _values
from codelathe.sources.readers import table

ROWS = [
    ("shop", "README.md", "# Shop\n\n short\n  Sells things to people.  \nMore text follows here."),
    ("shop", "pom.xml", "<project><description> From the pom </description></project>"),
    ("shop", "src/App.properties", "# app.name=no\napp.name = Shop=One\n  app.timeout: 5\napp.name=Two\nother=1\napp.=x"),
    ("shop", "src/conf.yml", "app:\n  name: Yaml\n  timeout:   9\napp.name: flat"),
    ("shop", "src/A.java", 'package x.y;\n\npublic class A {\n  @Value("${app.mode:fast}") String mode;\n  public void run(int a) {\n    log.info("started " + a);\n    call();\n  }\n  void stop() {\n    logger.error(\n      "stopped");\n  }\n}'),
    ("shop", "src/B.java", 'package x.y;\nclass B { A a; }\ninterface I { }\n// catalog.info("no");\n.log(LoggingLevel.WARN, "route done");'),
    ("shop", "src/C.java", "package x.security.z;\npublic class C { A a; B b; AA no; }"),
    ("tool", "README", "# Tool\nShort one"),
    ("tool", "pom.xml", "<description>Pom words</description>"),
    ("tool", ".git/config", None),
    ("tool", "SettingsRepository.java", "package t;\ninterface SettingsRepository extends CrudRepository { String findByKey(String k); }"),
    ("tool", "UserRepository.java", "package t;\ninterface UserRepository extends CrudRepository { String findByName(String k); }"),
    ("docs", "notes.txt", "nothing to build"),
    ("docs", "README.txt", "A folder without any sources"),
    ("void", "X.JAVA", ""),
]
FRAGMENTS = [
    ("public String getName() { return name; }", "java"),
    ("public String getName() { return name; } public void setName(String n) { this.name = n; }", "Java"),
    ("public String getName() { return calculate; }", "java"),
    ("public int run() { int a = 1; return a + 2; }", "java"),
    ("export default x", "javascript"),
    ("import a from 'a';", "python"),
    ("import some.very.long.module.name.that.takes.more.than.fifty as x", "python"),
    ("//a a a a a a a a\n" * 11 + "x = 1", "python"),
    ("x = 1 + 2 + 3 + 4 + 5 + 6 + 7\ny = 2 + 3 + 4 + 5 + 6 + 7 + 8\nz = 1", "python"),
    ("   ", "java"),
    (None, "java"),
]
LINES = ["public class Foo_1 extends Bar {", "class  Two{", "no kind here", "  public void run(int a) {", "x = call()", "class ", "interface Täg<T>", None]
NODES = [("IOException", "x.AController", "CATCHES"), ("IOException", "x.AController", "CATCHES"), ("IOException", "x.BDao", "CATCHES"), ("IOException", "x.CService", "THROWS"), ("SQLException", "x.CService", "CATCHES")]
THROWING = [("IOException", f"x.M{i}.go") for i in (7, 1, 3, 2, 9, 8, 1)] + [("SQLException", "x.N.go"), ("SQLException", "x.N.go")]
SIGNATURES = ["E(String)", "E(java.lang.String, java.lang.Throwable)", "E(Throwable)", "E()", None]

_R, _F = _values(ROWS, "repository, path, content"), _values(FRAGMENTS, "content, language")


def _rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "repository string, path string, content string")


def _one(spark: SparkSession, values: list, name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


@query(
    "repositories",
    f"WITH f AS {_R}, t AS (SELECT repository, path, CASE WHEN path = 'pom.xml' THEN (CASE WHEN contains(content, '<description>') THEN trim(regexp_extract(content, '<description>(.*?)</description>', 1)) END) WHEN starts_with(path, 'README') THEN list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10 AND NOT starts_with(x, '#'))[1] END AS said, "
    "CASE path WHEN 'README.md' THEN 0 WHEN 'README.txt' THEN 1 WHEN 'README' THEN 2 ELSE 3 END AS r FROM f) "
    "SELECT f.repository, count(*) AS n_files, (SELECT arg_min(said, r) FROM t WHERE t.repository = f.repository AND said IS NOT NULL) AS description FROM f GROUP BY f.repository HAVING bool_or(starts_with(path, '.git/') OR starts_with(path, 'src/') OR regexp_matches(lower(path), '\\.(java|kt|xml|gradle|properties)$'))",
)
def repositories(spark: SparkSession, d: str) -> DataFrame:
    return s.repositories(_rows(spark))


@query("page_repositories", "SELECT page_id, split_part(url, '/', 3) AS repository FROM pages WHERE split_part(url, '/', 3) <> ''")
def page_repositories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", s.repository_of(F.col("url"), "://").alias("repository")).where("repository is not null")


_PROPERTY_LINES = f"(SELECT path, g.i AS line, string_split(content, chr(10))[g.i] AS t FROM {_R} f, range(1, 10) g(i) WHERE regexp_matches(path, '\\.(properties|ya?ml)$') AND g.i <= len(string_split(content, chr(10))))"


@query(
    "property_sources",
    f"WITH k AS (SELECT path, line, regexp_extract(t, '^\\s*([^\\s=:]+)\\s*[=:]', 1) AS key, trim(CASE WHEN contains(t, '=') THEN regexp_replace(t, '^[^=]*=', '') ELSE regexp_replace(t, '^[^:]*:', '') END) AS value FROM {_PROPERTY_LINES} WHERE regexp_matches(t, '^\\s*[^\\s=:]+\\s*[=:]')) "
    "SELECT 'app.*' AS requested, key, value, path, line FROM k WHERE starts_with(key, 'app.') AND length(key) > 4 UNION ALL SELECT 'app.name', key, value, path, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM k WHERE key = 'app.name') WHERE r = 1 UNION ALL SELECT 'timeout', key, value, path, line FROM k WHERE key = 'timeout'",
)
def property_sources(spark: SparkSession, d: str) -> DataFrame:
    return s.property_sources(_rows(spark), ["app.*", "app.name", "timeout", "none"]).withColumn("line", F.col("line").cast("long"))


@query("default_values", "SELECT * FROM (VALUES ('app.name', 'Shop=One'), ('app.timeout', '9'), ('app.mode', 'fast'), ('app.none', NULL)) AS v(name, value)")
def default_values(spark: SparkSession, d: str) -> DataFrame:
    parts = [s.default_value(_rows(spark), n).select(F.lit(n).alias("name"), "value") for n in ("app.name", "app.timeout", "app.mode", "app.none")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_CLS = "regexp_extract(content, 'package\\s+([\\w.]+)\\s*;', 1) || '.' || regexp_extract(content, '\\b(class|interface|enum|record)\\s+(\\w+)', 2)"


@query("indirect_references", f"WITH f AS (SELECT {_CLS} AS class_name, content FROM {_R} WHERE contains(content, 'package')) SELECT class_name, target FROM f, (VALUES ('x.y.A', 'A'), ('x.y.B', 'B')) AS t(target, word) WHERE regexp_matches(content, '\\b' || word || '\\b') AND class_name NOT IN ('x.y.A', 'x.y.B')")
def indirect_references(spark: SparkSession, d: str) -> DataFrame:
    return s.indirect_references(_rows(spark), _one(spark, ["x.y.A", "x.y.B"], "class_name"))


@query("stored_configuration", f"SELECT path, {_CLS} AS class_name FROM {_R} WHERE contains(path, 'Repository') AND contains(path, '.java') AND contains(content, 'interface') AND regexp_matches(content, '(extends|implements)\\s+.*Repository') AND contains(content, 'findBy') AND regexp_matches(content, 'Name|Key|timeout') AND regexp_matches({_CLS}, 'SettingsRepository|Config|Setting|Option')")
def stored_configuration(spark: SparkSession, d: str) -> DataFrame:
    return s.stored_configuration(_rows(spark), "app.timeout")


@query("content_components", f"SELECT path, CASE WHEN content IS NULL THEN 'Other' WHEN regexp_matches(content, 'class') AND contains(content, 'Repository') THEN 'Repository' ELSE 'Other' END AS component, regexp_matches(content, 'Security|Auth|JWT|Login|Permission') OR contains(regexp_extract(content, 'package\\s([^;]*);', 1), '.security.') AS critical FROM {_R}")
def content_components(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark).select("path", s.content_component(F.col("content")).alias("component"), s.content_critical(F.col("content")).alias("critical"))


@query("throwing_notes", f"WITH m AS (SELECT DISTINCT * FROM {_values(THROWING, 'exception, method')}) SELECT exception, count(*) AS n_methods, array_to_string(list_sort(list(method))[1:5], ', ') AS examples FROM m GROUP BY exception")
def throwing_notes(spark: SparkSession, d: str) -> DataFrame:
    return s.throwing_notes(spark.createDataFrame(THROWING, "exception string, method string")).withColumn("examples", F.array_join("examples", ", "))


@query("handling_strategies", f"SELECT DISTINCT exception, component, CASE WHEN regexp_matches(component, 'Controller|Advice') THEN 'High' WHEN regexp_matches(component, 'Repository|Dao') THEN 'Low' ELSE 'Medium' END AS effectiveness FROM {_values(NODES, 'exception, component, action')} WHERE action = 'CATCHES'")
def handling_strategies(spark: SparkSession, d: str) -> DataFrame:
    return s.handling_strategies(spark.createDataFrame(NODES, "exception string, component string, action string"))


@query("chain_summaries", "SELECT conv_id, 'Turns: ' || string_agg(role || ' SAYS', ' → ' ORDER BY turn, role) AS summary FROM conversations GROUP BY conv_id")
def chain_summaries(spark: SparkSession, d: str) -> DataFrame:
    nodes = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: F.struct(t["role"].alias("component"), F.lit("SAYS").alias("action")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(nodes.alias("nodes")).select("conv_id", s.chain_summary(F.lit("Turns"), F.col("nodes")).alias("summary"))


@query("message_hints", f"SELECT signature, CASE WHEN signature LIKE '%(String)%' OR signature LIKE '%(java.lang.String)%' THEN '[Custom message]' WHEN signature LIKE '%String, %Throwable)%' THEN '[Custom message with cause]' WHEN signature LIKE '%(Throwable)%' THEN '[Exception cause only]' END AS hint FROM {_values(SIGNATURES, 'signature')}")
def message_hints(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, SIGNATURES, "signature").select("signature", s.message_hint(F.col("signature")).alias("hint"))


_L = "list_transform(string_split(content, chr(10)), lambda x: trim(x))"


@query("file_summaries", f"SELECT path, CASE WHEN contains(content, 'package') THEN regexp_extract(content, 'package ([\\w.]+);', 1) END AS package, coalesce(len(list_filter({_L}, lambda x: contains(x, 'public class '))), 0) AS public_classes, coalesce(len(list_filter({_L}, lambda x: contains(x, 'class ') AND NOT contains(x, 'public class '))), 0) AS other_classes, coalesce(len(list_filter({_L}, lambda x: contains(x, 'interface '))), 0) AS interfaces FROM {_R}")
def file_summaries(spark: SparkSession, d: str) -> DataFrame:
    n = ("public_classes", "other_classes", "interfaces")
    return _rows(spark).select("path", s.file_summary(F.col("content")).alias("f")).select("path", "f.package", *(F.coalesce(f"f.{c}", F.lit(0)).cast("long").alias(c) for c in n))


@query("entity_ids", f"SELECT path, CASE WHEN path LIKE '%.java' THEN 'java:' || regexp_extract(coalesce(content, ''), 'package\\s+([\\w.]+);', 1) || CASE WHEN contains(content, 'package') THEN '.' ELSE '' END || regexp_extract(path, '([^/]*)\\.java$', 1) ELSE replace(path, '/', '.') END AS id, CASE WHEN path LIKE '%.java' AND contains(content, 'package') THEN 'java:' || regexp_extract(content, 'package ([\\w.]+);', 1) || '.' || regexp_extract(path, '([^/]*)\\.java$', 1) END AS strict_id FROM {_R}")
def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    p, c = F.col("path"), F.col("content")
    return _rows(spark).select("path", s.entity_id(p, c).alias("id"), s.entity_id(p, c, strict=True).alias("strict_id"))


@query("declared_names", f"SELECT line, nullif(regexp_extract(line, 'class \\s*([\\p{{L}}\\p{{Nd}}_]+)', 1), '') AS class, nullif(regexp_extract(line, 'interface \\s*([\\p{{L}}\\p{{Nd}}_]+)', 1), '') AS interface, CASE WHEN contains(line, '(') THEN regexp_extract(trim(split_part(line, '(', 1)), '(\\S*)$', 1) END AS method FROM {_values(LINES, 'line')}")
def declared_names(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("line")
    return _one(spark, LINES, "line").select("line", s.declared_name(c, "class").alias("class"), s.declared_name(c, "interface").alias("interface"), s.token_before_bracket(c).alias("method"))


_JAVA_TAKEN = " + ".join(f"coalesce(list_sum(list_transform(regexp_extract_all(content, '{x}'), lambda m: length(m))), 0)" for x in s.JAVA_BOILERPLATE)
_COMMENTS = f"len(list_filter({_L}, lambda x: starts_with(x, '//') OR starts_with(x, '*') OR starts_with(x, '/*')))"
_PLAIN = f"length(trim(content)) < 50 OR (regexp_matches(content, '^\\s*(import|include|require|using)\\s') AND length(trim(content)) < 150) OR (len({_L}) > 10 AND {_COMMENTS} / len({_L}) > 0.7)"


@query("ratio_boilerplate", f"SELECT content, language, CASE WHEN content IS NULL OR trim(content) = '' OR regexp_matches(lower(content), '{'|'.join(s.LOGIC_WORDS)}') THEN false WHEN lower(language) = 'java' THEN ({_JAVA_TAKEN}) / length(content) > 0.7 WHEN language = 'javascript' THEN (regexp_matches(content, 'export\\s+') AND length(trim(content)) < 200) OR {_PLAIN} ELSE {_PLAIN} END AS boilerplate FROM {_F}")
def ratio_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    f = spark.createDataFrame(FRAGMENTS, "content string, language string")
    return f.select("content", "language", s.ratio_boilerplate(F.col("content"), F.col("language")).alias("boilerplate"))


_CONTEXTS = [
    ("src/A.java", "INFO", '"started " + a', 6, "run", '     @Value("${app.mode:fast}") String mode;\n     public void run(int a) {\n->     log.info("started " + a);\n       call();\n     }'),
    ("src/A.java", "ERROR", '"stopped"', 10, "stop", '     }\n     void stop() {\n->     logger.error(\n         "stopped");\n     }'),
    ("src/B.java", "WARN", '"route done"', 5, None, '   interface I { }\n   // catalog.info("no");\n-> .log(LoggingLevel.WARN, "route done");'),
]


@query("log_calls", f"SELECT * FROM {_values(_CONTEXTS, 'path, level, message, line, method, context')}")
def log_calls(spark: SparkSession, d: str) -> DataFrame:
    return s.log_calls(_rows(spark))


@query("impact_notes", "SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 40 OR p_partkey % 2 > 0 OR p_partkey % 5 > 3 THEN 'critical contexts' END, CASE WHEN p_partkey % 9 > 5 THEN 'wide scope' END], lambda x: x IS NOT NULL), '|') AS notes, array_to_string(list_filter([CASE WHEN p_partkey % 2 > 0 THEN 'Add Default Value' END, CASE WHEN p_partkey % 3 > 0 THEN 'Consider Immutability' END, CASE WHEN contains(p_name, 'a') THEN 'Secure Database Configuration' END, 'Configuration Documentation', CASE WHEN p_partkey % 9 > 3 THEN 'Configuration Centralization' END], lambda x: x IS NOT NULL), '|') AS recommendations FROM part")
def impact_notes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    notes = code.impact_notes((F.col("p_size") > 40).cast("int"), k % 2, F.when(k % 5 > 3, 1).otherwise(0), k % 9)
    return table(spark, d, "part").select("p_partkey", F.array_join(notes, "|").alias("notes"), F.array_join(code.impact_recommendations(k % 2, k % 3, F.col("p_name").contains("a"), k % 9), "|").alias("recommendations"))


@query(
    "enhanced_confidence",
    "WITH x AS (SELECT user_id, (event_id % 11 - 3) / 8.0 AS r, 's' AS k FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, (event_id % 10) / 10.0 * 0.8, 'a' FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 0.7, 'e' FROM events WHERE event_type = 'error'), "
    "g AS (SELECT user_id, avg(r) FILTER (WHERE k = 's' AND r > 0) AS positive, count(*) FILTER (WHERE k = 's') AS n_s, count(*) AS n, count(*) FILTER (WHERE k <> 's' OR r >= 0.5) AS n_r, avg(r) FILTER (WHERE k <> 's' OR r >= 0.5) AS q FROM x GROUP BY user_id), "
    "u AS (SELECT c_custkey AS user_id, 'how does code ' || c_custkey AS question FROM customer), "
    "p AS (SELECT u.user_id, CASE WHEN coalesce(n_s, 0) = 0 THEN 0.0 ELSE least(1.0, coalesce(positive, 0.3)) END AS v, CASE WHEN u.user_id % 3 > 0 THEN (u.user_id % 2) / (u.user_id % 3) ELSE 0.5 END AS t, CASE WHEN n > 0 THEN 0.6 * n_r / n + 0.4 * coalesce(q, 0) ELSE 0.3 END AS e, greatest(0.1, least(1.0, 0.4 * least(1.0, length(question) / 50.0) + 0.3)) AS c FROM u LEFT JOIN g ON u.user_id = g.user_id), "
    "s AS (SELECT *, greatest(0.0, least(1.0, 0.4 * v + 0.3 * t + 0.2 * e + 0.1 * c)) AS score FROM p) SELECT user_id, round(score, 6)::DOUBLE AS score, CASE WHEN score >= 0.9 THEN 'Very High' WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' WHEN score >= 0.25 THEN 'Low' ELSE 'Very Low' END AS rating FROM s",
)
def enhanced_confidence(spark: SparkSession, d: str) -> DataFrame:
    e, u = table(spark, d, "events"), table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    of = lambda kind, r: e.where(F.col("event_type") == kind).select("user_id", r.cast("double").alias("relevance"))
    questions = u.select("user_id", F.concat(F.lit("how does code "), F.col("user_id").cast("string")).alias("question"))
    tools = u.select("user_id", (F.col("user_id") % 3).alias("n_used"), (F.col("user_id") % 2).alias("n_succeeded"))
    found = lookups.enhanced_confidence(of("view", (F.col("event_id") % 11 - 3) / 8.0), of("click", (F.col("event_id") % 10) / 10.0), of("error", F.lit(1.0)), tools, questions, "user_id")
    return found.select("user_id", F.round("score", 6).alias("score"), "rating")


@query("embedding_run_totals", "SELECT namespace AS repository, count(*) FILTER (WHERE k = 0) AS n_success, count(*) FILTER (WHERE k = 1) AS n_failed, count(*) FILTER (WHERE k = 2) AS n_skipped, CASE WHEN count(*) FILTER (WHERE k = 1) = 0 THEN 'success' WHEN count(*) FILTER (WHERE k = 0) > 0 THEN 'partial_success' ELSE 'error' END AS status FROM (SELECT coalesce(nullif(split_part(source, '/', 1), ''), 'default') AS namespace, (doc_id // 7) % 3 AS k FROM documents) GROUP BY namespace")
def embedding_run_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.expr("(doc_id div 7) % 3")
    outcome = F.when(k == 0, "success").when(k == 1, "failed").otherwise("skipped")
    return lookups.run_totals(table(spark, d, "documents").select(lookups.namespace_of(F.col("source")).alias("repository"), outcome.alias("outcome")))


@query("page_main_text")
def page_main_text(spark: SparkSession, d: str) -> DataFrame:
    return web.main_texts(table(spark, d, "pages"))
