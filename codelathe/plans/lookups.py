"""Queries for lookups, call paths, exceptions, configuration and small columns, each beside its SQL.

Those over source files take the rows of ``FILES`` and ``CALLS``, so cycles, ties, nulls and near misses are all there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.functions import text
from codelathe.functions.vector import guarded_cosine
from codelathe.operators import callpaths, code, graph, lookups, retrieval, store
from codelathe.plans.catalog import query
from codelathe.plans.queries import _EDGES, _SIMS, COS, _edges, _first, _logs, _vectors
from codelathe.sources.readers import table

FILES = [
    ("shop", "shop/A.java", 'try { a(); } catch (IOException e) { log.error("x", e); }\nthrow new IOException("disk full");\nthrow new StoreException("s", new IOException(""));'),
    ("shop", "shop/B.java", 'try { b(); } catch (IOException e) { }\nthrow new IOException("disk full");\nlogger.warn("IOException seen");'),
    ("shop", "shop/C.java", 'try { c(); } catch (IOException x) { x.printStackTrace(); }\nthrow new IOException("other");'),
    ("tool", "tool/D.java", 'try { d(); } catch (IOException e) { Thread.sleep(5); }\ncatch (Exception e) { return; }\nthrow new IOException(new TimeoutException("t"));'),
    ("tool", "tool/E.java", "try { e(); } catch (IOException e) { return 1; }\n// an import of java.io.IOException"),
    ("tool", "tool/F.java", None),
    ("void", "void\\G.java", ""),
]
CALLS = [("a.A.run()", "b.B.go(int)"), ("a.A.run()", "b.B.go(long)"), ("b.B.go(int)", "c.C.end()"), ("c.C.end()", "a.A.run()"), ("d.D.x", "b.B.go"), ("d.D.x", "b.B.gone(int)"), ("a.A.run()", "b.B.go(int)")]
PARENTS = [("Leaf", "Twig"), ("Twig", "Branch"), ("Branch", "Trunk"), ("Moss", "Branch"), ("Ring", "Gold"), ("Gold", "Ring"), ("Leaf", "Green"), ("Twig", "Branch")]
METHODS = [("Trunk", "grow"), ("Branch", "bend"), ("Branch", "grow"), ("Twig", "snap"), ("Gold", "shine"), ("Green", "grow")]
PROPERTIES = ["spring.datasource.url", "spring.jpa.show-sql", "app.timeout.ms", "app.db.name", "server.port", "feature.enabled", "api.key", "hibernate.dialect", "mail.password", "pool.size", "Database.x", "service.uri"]


def _values(rows: list, columns: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quoted, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + f") AS v({columns}))"


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "repository string, path string, content string")


_FILES, _CALLS, _PARENTS = _values(FILES, "repository, path, content"), _values(CALLS, "caller, callee"), _values(PARENTS, "child, parent")
_LINE = f"(SELECT unnest(string_split(content, chr(10))) AS line FROM {_FILES})"
_META = "(SELECT doc_id AS id, lang AS namespace, source AS path FROM documents)"


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("namespace"), F.col("source").alias("path"))


@query("vector_remove", "SELECT vec_id AS id, label AS namespace FROM embeddings WHERE vec_id % 3 <> 1")
def vector_remove(spark: SparkSession, d: str) -> DataFrame:
    held = _vectors(spark, d).select("id", "namespace")
    return lookups.removed(held, held.where("id % 3 = 1"))


@query("knn_by_namespace", f"{_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) AS r FROM s WHERE label IN (1, 3, 5)) SELECT id, label AS namespace, similarity FROM r WHERE r <= 4 ORDER BY similarity DESC, id LIMIT 7")
def knn_by_namespace(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn_by_namespace(_vectors(spark, d), _first(spark, d), 4, 7, [1, 3, 5]).select("id", "namespace", F.round("similarity", 6).alias("similarity"))


@query("knn_least", f"{_SIMS} SELECT id, similarity FROM (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 12) WHERE similarity >= 0.15")
def knn_least(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.knn(_vectors(spark, d), _first(spark, d), 12, 0.15).select("id", F.round("similarity", 6).alias("similarity"))


@query("guarded_similarity", f"SELECT e.vec_id AS id, CASE WHEN e.vec_id % 4 = 0 THEN 0.0 ELSE round({COS}, 6) END AS similarity FROM (SELECT vec_id, embedding AS a FROM embeddings) e, (SELECT embedding AS b FROM embeddings WHERE vec_id = 0) q")
def guarded_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d).crossJoin(F.broadcast(_first(spark, d)))
    short = F.when(F.col("id") % 4 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector"))
    return rows.select("id", F.round(guarded_cosine(short, F.col("query_vector")), 6).alias("similarity"))


@query("metadata_of_first_namespace", f"SELECT path AS id, min(namespace) AS namespace FROM {_META} WHERE path IS NOT NULL AND namespace IS NOT NULL GROUP BY path")
def metadata_of_first_namespace(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).where("path is not null and namespace is not null").select(F.col("path").alias("id"), "namespace")
    return lookups.first_namespace(m)


@query("metadata_with_vectors", f"SELECT id, max(path) AS path, max(namespace) AS namespace FROM {_META} WHERE id IN (SELECT vec_id FROM embeddings) GROUP BY id")
def metadata_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return lookups.last_namespace(_meta(spark, d), _vectors(spark, d)).select("id", "path", "namespace")


@query("metadata_by_path", f"SELECT id, path, 1.0::DOUBLE AS score FROM {_META} WHERE path = 'src1' UNION ALL SELECT id, path, 1.0 FROM {_META} WHERE contains(replace(path, chr(92), '/'), 'rc1')")
def metadata_by_path(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    return lookups.by_path(m, "src1").unionByName(lookups.by_path(m, "rc1", True)).select("id", "path", "score")


@query("namespaced_ids", f"SELECT coalesce(namespace || ':' || id, 'default') AS name, coalesce(namespace, 'default') AS namespace, CASE WHEN namespace IS NULL THEN 'default' ELSE CAST(id AS VARCHAR) END AS key FROM {_META}")
def namespaced_ids(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select(F.coalesce(lookups.namespaced(F.col("namespace"), F.col("id")), F.lit("default")).alias("name"))
    return m.select("name", lookups.parts_of(F.col("name")).alias("p")).select("name", "p.namespace", "p.key")


@query("namespace_start_up", "WITH m AS (SELECT DISTINCT doc_id % 10 AS namespace, doc_id AS id FROM documents), v AS (SELECT label AS namespace, vec_id AS id FROM embeddings) SELECT namespace, count(m.id) AS n_metadata, count(v.id) AS n_vectors, count(*) FILTER (WHERE m.id IS NULL OR v.id IS NULL) AS n_unmatched FROM m FULL JOIN v USING (namespace, id) GROUP BY namespace")
def namespace_start_up(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select((F.col("doc_id") % 10).alias("namespace"), F.col("doc_id").alias("id")).distinct()
    return lookups.start_up(m, _vectors(spark, d).select(F.col("namespace").cast("long").alias("namespace"), "id"))


@query("usable_vectors", "SELECT vec_id AS id, vec_id % 5 <> 0 AS usable FROM embeddings")
def usable_vectors(spark: SparkSession, d: str) -> DataFrame:
    zero = F.when(F.col("id") % 5 == 0, F.transform("vector", lambda x: x * 0)).otherwise(F.col("vector"))
    return _vectors(spark, d).select("id", lookups.usable(zero).alias("usable"))


@query("chunk_batches", "SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 16 AS batch FROM documents WHERE lang IS NOT NULL")
def chunk_batches(spark: SparkSession, d: str) -> DataFrame:
    return lookups.batches(table(spark, d, "documents").where("lang is not null"), 16, "lang", "doc_id").select("doc_id", "batch")


@query("path_parts", "SELECT page_id, array_to_string(list_filter(string_split(url, '/'), lambda p: p <> ''), '|') AS parts FROM pages")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(lookups.path_parts(F.col("url")), "|").alias("parts"))


@query("answer_sources", "SELECT 'KnowledgeArticle:' || item_id AS source FROM benchmark UNION ALL SELECT 'CodeSnippet:' || source FROM documents UNION ALL SELECT 'ErrorPattern:' || left(n_name || ' is a long pattern name', 20) FROM nation")
def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    patterns = table(spark, d, "nation").select(F.concat("n_name", F.lit(" is a long pattern name")).alias("template"))
    return lookups.source_list(table(spark, d, "benchmark").select(F.col("item_id").alias("id")), table(spark, d, "documents").select(F.col("source").alias("path")), patterns)


@query("article_search", "SELECT doc_id FROM documents WHERE contains(lower(source), 'license') OR contains(lower(text), 'license') ORDER BY doc_id LIMIT 25")
def article_search(spark: SparkSession, d: str) -> DataFrame:
    return lookups.search_articles(table(spark, d, "documents"), "LICENSE", 25, "doc_id", "source", "text").select("doc_id")


@query("article_by_id", "SELECT doc_id, source, lang FROM documents WHERE doc_id = 7")
def article_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 7").select("doc_id", "source", "lang")


@query("mean_rating", "SELECT round(coalesce(avg(CASE WHEN event_id % 3 = 0 THEN user_id % 5 END), 0.0), 6) AS rating FROM events")
def mean_rating(spark: SparkSession, d: str) -> DataFrame:
    return lookups.mean_rating(table(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 5).alias("rating"))).select(F.round("rating", 6).alias("rating"))


@query("recorded_interactions", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS request_id FROM events WHERE event_type = 'view' UNION ALL SELECT user_id || '-' || event_id, CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'click'")
def recorded_interactions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    new = e.where("event_type = 'click'").select(F.col("user_id").cast("string").alias("request_id"), F.col("event_id").cast("string").alias("response_id"))
    return lookups.recorded(e.where("event_type = 'view'").select(F.col("event_id").cast("string").alias("id")), new).select("id", "request_id")


@query(
    "evidence_scores",
    "WITH x AS (SELECT user_id, (event_id % 11 - 3) / 8.0 AS r, 's' AS k FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, (event_id % 10) / 10.0 * 0.8, 'a' FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, 0.7, 'e' FROM events WHERE event_type = 'error'), "
    "g AS (SELECT user_id, avg(r) FILTER (WHERE k = 's' AND r > 0) AS positive, count(*) FILTER (WHERE k = 's') AS n_snippets, count(*) AS n_items, count(*) FILTER (WHERE k <> 's' OR r >= 0.5) AS n_relevant, avg(r) FILTER (WHERE k <> 's' OR r >= 0.5) AS q FROM x GROUP BY user_id) "
    "SELECT user_id, round(CASE WHEN n_snippets = 0 THEN 0.0 ELSE coalesce(positive, 0.3) END, 6)::DOUBLE AS vector, n_items, n_relevant, round(coalesce(q, 0.0), 6)::DOUBLE AS quality FROM g",
)
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    of = lambda kind, r: e.where(F.col("event_type") == kind).select("user_id", r.cast("double").alias("relevance"))
    found = lookups.evidence_scores(of("view", (F.col("event_id") % 11 - 3) / 8.0), of("click", (F.col("event_id") % 10) / 10.0), of("error", F.lit(1.0)), "user_id")
    return found.select("user_id", F.round("vector", 6).alias("vector"), "n_items", "n_relevant", F.round("quality", 6).alias("quality"))


@query("graph_view", f"{_EDGES}, n AS (SELECT DISTINCT unnest([source, target]) AS id FROM edges) SELECT id FROM n WHERE id IN (SELECT unnest([source, target]) FROM edges WHERE source = 'nation:7' OR target = 'nation:7') UNION ALL SELECT id FROM (SELECT id FROM n ORDER BY id LIMIT 50)")
def graph_view(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return lookups.view(nodes, edges, "nation:7").unionByName(lookups.view(nodes, edges, None))


@query("edges_of_top_nodes", f"{_EDGES}, t AS (SELECT 'nation:' || n_nationkey AS id FROM nation WHERE contains(lower(n_name), '1') OR contains(lower('x.' || n_name), '1') ORDER BY n_name, id LIMIT 5) SELECT id, target AS other, 'out' AS direction FROM t JOIN edges ON source = id UNION ALL SELECT id, source, 'in' FROM t JOIN edges ON target = id")
def edges_of_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("class").alias("type"), F.col("n_name").alias("name"), F.concat(F.lit("x."), "n_name").alias("full_name"))
    return lookups.with_edges(graph.search_nodes(nodes, "1", 5), _edges(spark, d))


@query("nodes_by_path", f"SELECT path FROM {_FILES} WHERE contains(replace(path, chr(92), '/'), 'void/G') OR contains(path, 'tool/')")
def nodes_by_path(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark)
    return lookups.nodes_by_path(f, "void\\G").unionByName(lookups.nodes_by_path(f, "tool/")).select("path")


_PATHS = "(SELECT user_id AS path, list_distinct(list(event_type)) AS files FROM events GROUP BY user_id)"


@query("path_index", f"SELECT file, max(path) AS path, count(*) FILTER (WHERE file = 'error') AS n FROM (SELECT path, unnest(files) AS file FROM {_PATHS}) GROUP BY file")
def path_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.collect_set("event_type").alias("files"))
    through = lookups.paths_through(p, "error").agg(F.count("*").alias("k"))
    return lookups.path_index(p).crossJoin(F.broadcast(through)).select("file", "path", F.when(F.col("file") == "error", F.col("k")).otherwise(0).alias("n"))


@query("callers_of", f"SELECT DISTINCT caller FROM {_CALLS} WHERE callee = 'b.B.go' OR starts_with(callee, 'b.B.go(')")
def callers_of(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.callers(spark.createDataFrame(CALLS, "caller string, callee string"), "b.B.go")


@query("method_parts", f"SELECT callee, regexp_extract(split_part(callee, '(', 1), '^(.*)\\.[^.]*$', 1) AS owner, regexp_extract(split_part(callee, '(', 1), '([^.]*)$', 1) AS method, CASE WHEN contains(callee, '(') THEN regexp_extract(callee, '\\(([^)]*)', 1) END AS arguments, starts_with(callee, 'java.') AS library FROM {_CALLS}")
def method_parts(spark: SparkSession, d: str) -> DataFrame:
    c = spark.createDataFrame(CALLS, "caller string, callee string")
    return c.select("callee", callpaths.method_parts(F.col("callee")).alias("p"), callpaths.is_library(F.col("callee")).alias("library")).select("callee", "p.owner", "p.method", "p.arguments", "library")


_UP = f"WITH RECURSIVE p AS (SELECT DISTINCT child, parent FROM {_PARENTS}), u AS (SELECT child, parent AS ancestor, 1 AS depth FROM p UNION SELECT u.child, p.parent, depth + 1 FROM u JOIN p ON p.child = u.ancestor WHERE depth < 9), a AS (SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM u GROUP BY child, ancestor)"


@query("class_ancestors", f"{_UP} SELECT * FROM a")
def class_ancestors(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.ancestors(spark.createDataFrame(PARENTS, "child string, parent string"))


@query("inherited_methods", f"{_UP}, m AS {_values(METHODS, 'class, method')}, c AS (SELECT class, method, class AS owner, 0 AS depth FROM m UNION ALL SELECT child, method, ancestor, depth FROM a JOIN m ON m.class = ancestor) SELECT class, method, arg_min(owner, (depth, owner)) AS owner FROM c GROUP BY class, method")
def inherited_methods(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.inherited(spark.createDataFrame(METHODS, "class string, method string"), spark.createDataFrame(PARENTS, "child string, parent string"))


@query("exception_wrapping", f"SELECT other, role, count(*) AS n FROM (SELECT regexp_extract(line, 'new\\s+([\\w.]+Exception)\\(.*IOException.*\\)', 1) AS other, 'wrapper' AS role FROM {_LINE} UNION ALL SELECT regexp_extract(line, 'new\\s+IOException\\(.*?([\\w.]+Exception).*\\)', 1), 'wrapped' FROM {_LINE}) WHERE other <> '' GROUP BY other, role")
def exception_wrapping(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.wrapping(_files(spark), "java.io.IOException")


@query("exception_log_levels", f"SELECT level, count(*) AS n FROM (SELECT regexp_extract(line, 'log(?:ger)?\\.(error|warn|info|debug|trace)\\(.*IOException.*\\)', 1) AS level FROM {_LINE}) WHERE level <> '' GROUP BY level")
def exception_log_levels(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.logging_levels(_files(spark), "java.io.IOException")


@query("exception_messages", f"SELECT message, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, 'new\\s+IOException\\(\\s*\"([^\"]+)\"', 1)) AS message FROM {_FILES}) GROUP BY message HAVING count(*) >= 2")
def exception_messages(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.common_messages(_files(spark), "java.io.IOException")


@query("exception_uses", f"SELECT path, regexp_matches(content, 'throw\\s+new\\s+IOException\\b') AS throws, regexp_matches(content, 'catch\\s*\\([^)]*\\bIOException\\b') AS catches FROM {_FILES} WHERE regexp_matches(content, 'throw\\s+new\\s+IOException\\b') OR regexp_matches(content, 'catch\\s*\\([^)]*\\bIOException\\b')")
def exception_uses(spark: SparkSession, d: str) -> DataFrame:
    return code.exception_uses(_files(spark), "java.io.IOException")


@query(
    "exception_anti_patterns",
    f"WITH f AS {_FILES}, c AS (SELECT path, unnest(regexp_extract_all(content, 'catch\\s*\\(\\s*IOException\\s+\\w+\\s*\\)\\s*\\{{[^{{}}]*\\}}')) AS h FROM f), b AS (SELECT path, regexp_extract(h, 'IOException\\s+(\\w+)', 1) AS v, regexp_extract(h, '\\{{([^{{}}]*)\\}}', 1) AS body FROM c) "
    "SELECT DISTINCT 'empty_catch' AS pattern, path FROM b WHERE trim(body) = '' UNION ALL SELECT DISTINCT 'swallowed', path FROM b WHERE NOT regexp_matches(body, 'throw|log|return') UNION ALL SELECT DISTINCT 'generic_catch', path FROM f WHERE regexp_matches(content, 'catch\\s*\\(\\s*Exception\\s+\\w+\\s*\\)') "
    "UNION ALL SELECT DISTINCT 'log_only', path FROM b WHERE contains(regexp_extract(body, 'log(?:ger)?\\.[a-z]+\\((.*)\\)', 1), v) UNION ALL SELECT DISTINCT 'print_stack_trace', path FROM b WHERE contains(body, v || '.printStackTrace()') UNION ALL SELECT DISTINCT 'sleep_in_catch', path FROM b WHERE regexp_matches(body, 'Thread\\.sleep\\([^)]*\\)')",
)
def exception_anti_patterns(spark: SparkSession, d: str) -> DataFrame:
    return code.anti_patterns(_files(spark), "java.io.IOException")


_NAMES = ["java.lang.RuntimeException", "java.io.IOException", "x.SQLException", "x.TimeoutException", "x.OtherException"]


@query("exception_advice", f"SELECT name, CASE WHEN name LIKE '%RuntimeException' THEN 'RuntimeException Handling|' WHEN contains(name, 'IO') THEN 'IO Exception Handling|' WHEN contains(name, 'SQL') THEN 'SQL Exception Handling|' WHEN contains(name, 'Timeout') THEN 'Timeout Exception Handling|' ELSE '' END || 'Exception Documentation|Exception Specificity' AS topics, NOT (contains(name, 'RuntimeException') OR name LIKE '%Error') AS checked FROM {_values(_NAMES, 'name')}")
def exception_advice(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", F.array_join(callpaths.advice(F.col("name")), "|").alias("topics"), callpaths.is_checked(F.col("name")).alias("checked"))


_COMPONENTS = ["x.UserController", "x.ErrorAdvice", "x.UserService", "x.UserRepository", "x.UserDao", "x.Plain", "x.security.Plain", "x.core.Plain", "x.LoginForm"]


@query("handling_components", f"SELECT name, CASE WHEN contains(name, 'Controller') OR contains(name, 'Advice') THEN 'High' WHEN contains(name, 'Repository') OR contains(name, 'Dao') THEN 'Low' ELSE 'Medium' END AS effectiveness, regexp_matches(name, '\\.security\\.|\\.auth\\.|\\.core\\.|\\.persistence\\.|Security|Auth|JWT|Login|Permission') AS critical FROM {_values(_COMPONENTS, 'name')}")
def handling_components(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _COMPONENTS], "name string").select("name", callpaths.effectiveness(F.col("name")).alias("effectiveness"), code.is_critical(F.col("name")).alias("critical"))


@query(
    "property_kinds",
    "SELECT name, regexp_matches(name, '^(spring\\.datasource|spring\\.jpa|spring\\.data\\.jdbc|spring\\.data\\.mongodb|spring\\.data\\.redis|spring\\.data\\.cassandra|spring\\.data\\.elasticsearch|hibernate|jdbc|database|db)') OR regexp_matches(name, 'database|datasource|db|jdbc|jpa|hibernate') AS is_db, "
    "CASE WHEN regexp_matches(name, 'url|uri|endpoint') THEN 'endpoint' WHEN contains(name, 'timeout') THEN 'timeout' WHEN regexp_matches(name, 'enable|disable') THEN 'switch' WHEN regexp_matches(name, 'password|secret|key') THEN 'secret' END AS topic, "
    f"CASE WHEN regexp_matches(name, 'url|jdbc') THEN 'connection' WHEN regexp_matches(name, 'username|user|password') THEN 'authentication' WHEN contains(name, 'driver') THEN 'driver' WHEN regexp_matches(name, 'pool|connection') THEN 'pool-config' WHEN contains(name, 'dialect') THEN 'dialect' WHEN regexp_matches(name, 'jpa|hibernate') THEN 'orm-config' ELSE 'other' END AS kind FROM {_values(PROPERTIES, 'name')}",
)
def property_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    return spark.createDataFrame([(p,) for p in PROPERTIES], "name string").select("name", code.is_db_property(n).alias("is_db"), code.note_topic(n).alias("topic"), code.db_property_type(n).alias("kind"))


@query("usage_summary", "SELECT p_partkey, 'Injected via field. Read ' || p_size || ' times. ' || CASE WHEN p_partkey % 3 > 0 THEN 'Written ' || p_partkey % 3 || ' times. ' ELSE '' END || CASE WHEN p_partkey % 2 > 0 THEN 'Used in ' || p_partkey % 2 || ' loops. ' ELSE '' END AS summary FROM part")
def usage_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", code.usage_summary(F.lit("field"), F.col("p_size"), k % 3, F.lit(0), k % 2, F.lit(0)).alias("summary"))


@query("repository_totals", f"SELECT count(*) AS n_matches, count(DISTINCT repository) AS n_repositories FROM (SELECT repository, unnest(string_split(content, chr(10))) AS line FROM {_FILES} WHERE repository IN ('shop', 'tool')) WHERE contains(lower(line), 'throw')")
def repository_totals(spark: SparkSession, d: str) -> DataFrame:
    return callpaths.search_totals(code.search_repositories(callpaths.in_repositories(_files(spark), ["shop", "tool", "unknown"]), "throw"))


@query("code_types", f"SELECT path, 'class' AS type, 'java' AS language FROM {_FILES}")
def code_types(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark).select("path", text.code_type(F.col("path")).alias("type"), text.language(F.col("path")).alias("language"))


@query("conceptual_turns", "SELECT conv_id, turn, contains(lower(text), 'what is') OR contains(lower(text), 'purpose') OR contains(lower(text), 'why') OR contains(lower(text), 'how does') OR contains(lower(text), 'when to use') OR contains(lower(text), 'functionality') OR contains(lower(text), 'explain') OR contains(lower(text), 'describe') AS conceptual FROM conversations")
def conceptual_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_conceptual(F.col("text")).alias("conceptual"))


@query("embedding_failures", "SELECT sha256(message) AS text_hash, left(message, 100) AS preview, count(*) AS failures, max(ts) AS last_time FROM (SELECT 'user ' || user_id % 7 AS message, ts FROM events WHERE event_type = 'error') GROUP BY message")
def embedding_failures(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type = 'error'").select(F.concat(F.lit("user "), (F.col("user_id") % 7).cast("string")).alias("text"), "ts", F.lit("no answer").alias("error"))
    return store.failures(e).select("text_hash", "preview", "failures", "last_time")


@query("related_edges", f"{_EDGES}, one AS (SELECT source, target FROM edges WHERE source = 'nation:3' UNION ALL SELECT target, source FROM edges WHERE target = 'nation:3') SELECT source, target, 1 AS depth FROM one UNION ALL SELECT e.source, e.target, 2 FROM one JOIN edges e ON e.source = one.target")
def related_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.related(_edges(spark, d), "nation:3", 2).select("source", "target", "depth")


@query("logs_without_service", "SELECT event_id AS ord FROM events WHERE event_type = 'error' AND user_id % 5 NOT IN (1, 2)")
def logs_without_service(spark: SparkSession, d: str) -> DataFrame:
    """One source's rows are dropped, as a repository's are."""
    rows = _logs(spark, d).where("level = 'ERROR'")
    return lookups.removed(rows, spark.createDataFrame([("svc1",), ("svc2",)], "service string"), ["service"]).select("ord")
