"""The operators as queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelathe.functions import scoring, text
from codelathe.operators import chunks, code, graph, limits, logs, neighbours, retrieval, store
from codelathe.plans.catalog import query
from codelathe.sources.readers import table

WORDS = "the of retion"
COS = "list_sum(list_transform(list_zip(a, b), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE))) / (sqrt(list_sum(list_transform(a, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))))"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("namespace"))


def _first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


_SIMS = f"WITH v AS (SELECT e.vec_id AS id, e.label, e.embedding AS a, q.embedding AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), s AS (SELECT id, label, round({COS}, 6) AS similarity FROM v)"


@query("semantic_topk", f"{_SIMS} SELECT id, similarity, source, lang FROM (SELECT * FROM s ORDER BY similarity DESC, id LIMIT 10) t LEFT JOIN documents ON doc_id = id")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.scored(_vectors(spark, d), _first(spark, d)).select("id", F.round("similarity", 6).alias("similarity"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang")
    return F.broadcast(retrieval.top_k(found, "similarity", "id", 10)).join(docs, "id", "left")


@query("semantic_threshold", f"{_SIMS} SELECT id, similarity FROM s WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 25")
def semantic_threshold(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.scored(_vectors(spark, d), _first(spark, d)).select("id", F.round("similarity", 6).alias("similarity"))
    return retrieval.top_k(found.where("similarity >= 0.2"), "similarity", "id", 25)


@query("semantic_topk_by_label", f"{_SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, id) AS r FROM s) SELECT id, label AS namespace, similarity FROM r WHERE r <= 5 ORDER BY similarity DESC, id LIMIT 20")
def semantic_topk_by_label(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.scored(_vectors(spark, d), _first(spark, d)).select("id", "namespace", F.round("similarity", 6).alias("similarity"))
    order = Window.partitionBy("namespace").orderBy(F.desc("similarity"), "id")
    return retrieval.top_k(found.withColumn("r", F.row_number().over(order)).where("r <= 5").drop("r"), "similarity", "id", 20)


@query("nearest_of_queries", f"WITH v AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.embedding AS a, q.embedding AS b FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id), s AS (SELECT qid, id, round({COS}, 6) AS similarity FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM s) SELECT qid, id, similarity, rank FROM r WHERE rank <= 5")
def nearest_of_queries(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return neighbours.nearest(v, v.where("id % 50 = 0"), 5)


@query("namespace_sizes", "SELECT label AS namespace, count(*) AS n, min(len(embedding)) AS dims FROM embeddings GROUP BY label")
def namespace_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).groupBy("namespace").agg(F.count("*").alias("n"), F.min(F.size("vector")).cast("long").alias("dims"))


@query("missing_vectors", "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark: SparkSession, d: str) -> DataFrame:
    return store.missing(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), _vectors(spark, d))


@query("documents_with_vectors", "SELECT doc_id AS id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def documents_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source").join(_vectors(spark, d).select("id"), "id", "left_semi")


@query("vector_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS namespace FROM embeddings")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    held = _vectors(spark, d).select("id", "namespace")
    return retrieval.upsert(held, held.where("id % 7 = 0").withColumn("namespace", F.lit(-1)), ["id"])


_OCC = "CAST((length(lower(text)) - length(replace(lower(text), '{0}', ''))) / length('{0}') AS BIGINT)"
_KEY = " + ".join(f"2.0 * {_OCC.format(w)}" for w in ("retion",))


@query("keyword_topk", f"SELECT doc_id, score FROM (SELECT doc_id, CAST({_KEY} AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.keyword_scores(table(spark, d, "documents"), WORDS, "doc_id", "text")
    return retrieval.top_k(found.select("doc_id", "score"), "score", "doc_id", 20)


@query(
    "hybrid_fusion",
    f"{_SIMS}, sem AS (SELECT id, similarity AS score FROM s ORDER BY score DESC, id LIMIT 40), kw AS (SELECT doc_id AS id, score FROM (SELECT doc_id, CAST({_KEY} AS DOUBLE) AS score FROM documents) WHERE score > 0 ORDER BY score DESC, id LIMIT 40), "
    "a AS (SELECT id, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, id) + 1) * 0.7 AS x FROM sem), b AS (SELECT id, (count(*) OVER () - row_number() OVER (ORDER BY score DESC, id) + 1) * 0.3 AS x FROM kw) "
    "SELECT coalesce(a.id, b.id) AS id, CAST(round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS DOUBLE) AS score FROM a FULL JOIN b ON a.id = b.id ORDER BY score DESC, id LIMIT 20",
)
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    semantic = retrieval.scored(_vectors(spark, d), _first(spark, d)).select("id", F.round("similarity", 6).alias("score"))
    keyword = retrieval.keyword_scores(table(spark, d, "documents").withColumnRenamed("doc_id", "id"), WORDS, "id", "text").select("id", "score")
    fused = retrieval.fuse(retrieval.top_k(semantic, "score", "id", 40), retrieval.top_k(keyword, "score", "id", 40), 1000)
    return retrieval.top_k(fused.select("id", F.round("score", 6).alias("score")), "score", "id", 20)


@query(
    "rerank_documents",
    "SELECT doc_id, round(greatest(0.0, least(1.0, 0.5 + 0.03 * (CAST(contains(lower(source), 'src1') AS INT) + CAST(contains(lower(source), 'retion') AS INT)) + 0.02 * (CAST(contains(lower(text), 'src1') AS INT) + CAST(contains(lower(text), 'retion') AS INT)) + CASE WHEN lang = 'en' THEN 0.05 ELSE 0.0 END + CASE WHEN n_chars > 2000 THEN 0.10 ELSE 0.0 END)), 6)::DOUBLE AS relevance FROM documents",
)
def rerank_documents(spark: SparkSession, d: str) -> DataFrame:
    c = retrieval.reranked(F.lit(0.5), F.lit("src1 the retion"), F.col("source"), F.col("text"), F.col("lang") == "en", F.col("n_chars") > 2000, F.lit(False))
    return table(spark, d, "documents").select("doc_id", F.round(c, 6).alias("relevance"))


def _or(words, column="lower(text)"):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("query_types", f"SELECT role, CASE WHEN {_or(text.CONCEPTUAL)} AND NOT {_or(text.IMPLEMENTATION)} THEN 'CONCEPTUAL' WHEN {_or(text.IMPLEMENTATION)} AND NOT {_or(text.CONCEPTUAL)} THEN 'IMPLEMENTATION' ELSE 'MIXED' END AS kind, count(*) AS n FROM conversations GROUP BY ALL")
def query_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role", text.query_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("query_clarity", f"SELECT conv_id, turn, round(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 0.1 ELSE greatest(0.1, least(1.0, 0.4 * least(1.0, length(text) / 50.0) + 0.6 * (CASE WHEN {_or(scoring.QUESTION_WORDS)} THEN 0.2 ELSE 0.0 END + CASE WHEN {_or(scoring.CODE_WORDS)} THEN 0.3 ELSE 0.0 END))) END, 6)::DOUBLE AS clarity FROM conversations")
def query_clarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(scoring.clarity(F.col("text")), 6).alias("clarity"))


_SET = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@query(
    "relevant_documents",
    f"WITH q AS (SELECT {_SET.format('text')} AS w FROM benchmark WHERE item_id = 2), s AS (SELECT doc_id, CAST(3 * len(list_intersect({_SET.format('source')}, w)) + len(list_intersect({_SET.format('text')}, w)) AS DOUBLE) / len(w) AS r FROM documents, q) SELECT doc_id, round(r, 6) AS relevance FROM s WHERE r > 0 ORDER BY relevance DESC, doc_id LIMIT 20",
)
def relevant_documents(spark: SparkSession, d: str) -> DataFrame:
    item = F.broadcast(table(spark, d, "benchmark").where("item_id = 2").select(F.col("text").alias("q")))
    s = table(spark, d, "documents").crossJoin(item).select("doc_id", F.round(logs.article_relevance(F.col("source"), F.col("text"), F.col("q")), 6).alias("relevance"))
    return retrieval.top_k(s.where("relevance > 0"), "relevance", "doc_id", 20)


@query("tag_overlap", "SELECT doc_id, lang, source FROM documents WHERE lower(lang) IN ('fr', 'src3') OR lower(source) IN ('fr', 'src3')")
def tag_overlap(spark: SparkSession, d: str) -> DataFrame:
    return logs.tagged(table(spark, d, "documents").withColumn("tags", F.array("lang", "source")), ["FR", "src3"]).select("doc_id", "lang", "source")


_MSG = "'user ' || user_id || ' at /api/' || event_type || '/' || event_id || ' value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)"


def _logs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    message = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" at /api/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(" value "), F.floor("value").cast("string"))
    return e.select(F.col("event_id").alias("ord"), "ts", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string")).alias("service"), message.alias("message"))


@query("log_filter", f"SELECT event_id AS ord, {_MSG} AS message FROM events WHERE event_type = 'error' AND user_id % 5 = 2 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND contains(lower({_MSG}), '/api/')")
def log_filter(spark: SparkSession, d: str) -> DataFrame:
    return logs.search_logs(_logs(spark, d), "/API/", "ERROR", "SVC2", "2024-01-05", "2024-01-20").select("ord", "message")


@query(
    "error_patterns",
    rf"WITH e AS (SELECT event_id AS ord, {_MSG} AS message FROM events WHERE event_type = 'error'), t AS (SELECT *, regexp_replace(regexp_replace(message, '\b\d+\b', '<NUM>', 'g'), '/[\w/.-]+', '<PATH>', 'g') AS template FROM e), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY ord, message) AS r FROM t) SELECT template, count(*) AS frequency, array_to_string(list(message ORDER BY ord) FILTER (WHERE r <= 3), ' | ') AS examples FROM r GROUP BY template HAVING count(*) >= 2",
)
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return logs.error_patterns(_logs(spark, d)).select("template", "frequency", F.array_join("examples", " | ").alias("examples"))


@query("model_stats", "SELECT event_type AS model, round(avg(value), 6) AS avg_latency, round(avg(user_id), 6) AS avg_tokens, count(*) AS n FROM events GROUP BY event_type")
def model_stats(spark: SparkSession, d: str) -> DataFrame:
    s = logs.model_stats(table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("value").alias("latency"), F.col("user_id").alias("tokens")))
    return s.select("model", F.round("avg_latency", 6).alias("avg_latency"), F.round("avg_tokens", 6).alias("avg_tokens"), "n")


@query("audit_search", "SELECT conv_id, turn FROM conversations WHERE contains(text, 'the') AND role = 'user' UNION SELECT conv_id, turn FROM conversations WHERE contains(text, 'tion') AND role <> 'user'")
def audit_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    hit = (F.col("text").contains("the") & (F.col("role") == "user")) | (F.col("text").contains("tion") & (F.col("role") != "user"))
    return c.where(hit).select("conv_id", "turn").distinct()


_PARTS = "0.4 * least(1.0, value / 100.0) + 0.3 * CASE WHEN user_id % 4 > 0 THEN (user_id % 3) * 1.0 / 4 ELSE 0.5 END + 0.2 * CASE WHEN event_id % 5 > 0 THEN 0.6 * (event_id % 3) / (event_id % 5) + 0.4 * 0.5 ELSE 0.3 END + 0.1 * 0.7"


@query("confidence_bands", f"WITH s AS (SELECT round(greatest(0.0, least(1.0, {_PARTS})), 6)::DOUBLE AS score FROM events WHERE value IS NOT NULL AND value >= 0) SELECT CASE WHEN score >= 0.9 THEN 'Very High' WHEN score >= 0.75 THEN 'High' WHEN score >= 0.5 THEN 'Medium' WHEN score >= 0.25 THEN 'Low' ELSE 'Very Low' END AS rating, count(*) AS n, round(avg(score), 4) AS mean FROM s GROUP BY 1")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null and value >= 0")
    tools = F.when(F.col("user_id") % 4 > 0, 4).otherwise(0)
    parts = scoring.components(F.col("value") / 100.0, tools, F.col("user_id") % 3, F.col("event_id") % 5, F.col("event_id") % 3, F.lit(0.5), F.lit(0.7))
    s = e.select(F.round(scoring.score(parts), 6).alias("score"))
    return s.groupBy(scoring.rating(F.col("score")).alias("rating")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean"))


_WIN = "WITH d AS (SELECT doc_id, text, length(text) AS len, CASE WHEN length(text) <= 8000 THEN 1 ELSE CAST(ceil((length(text) - 200) / 7800.0) AS INT) END AS c FROM documents), m AS (SELECT *, c > 1 AND len - (c - 1) * 7800 < 100 AS merged FROM d), k AS (SELECT *, CASE WHEN merged THEN c - 1 ELSE c END AS kept FROM m), w AS (SELECT doc_id, n, substr(text, n * 7800 + 1, 8000) || CASE WHEN merged AND n = kept - 1 THEN substr(text, kept * 7800 + 1) ELSE '' END AS content FROM (SELECT *, CAST(unnest(range(0, kept)) AS INT) AS n FROM k))"


@query("chunk_windows", f"{_WIN}, x AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY n) AS b, lead(content) OVER (PARTITION BY doc_id ORDER BY n) AS a, CAST(floor(length(content) * 0.15) AS INT) AS s FROM w) SELECT doc_id, n, md5(content) AS content, md5(coalesce(CASE WHEN s > 0 THEN right(b, s) END, '')) AS before, md5(coalesce(CASE WHEN s > 0 THEN left(a, s) END, '')) AS after FROM x")
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.with_context(chunks.windows(table(spark, d, "documents"), "doc_id"), "doc_id")
    return found.select("doc_id", "n", F.md5("content").alias("content"), F.md5("context_before").alias("before"), F.md5("context_after").alias("after"))


@query("line_blocks", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, CAST(unnest(range(0, CAST((len(l) - 1) // 4 AS BIGINT) + 1)) AS INT) AS block FROM l) SELECT doc_id, block, block * 4 + 1 AS first_line, CAST(len(l[block * 4 + 1:block * 4 + 4]) AS INT) AS n_lines, md5(array_to_string(l[block * 4 + 1:block * 4 + 4], chr(10))) AS content FROM b WHERE len(l[block * 4 + 1:block * 4 + 4]) >= 2")
def line_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.line_blocks(table(spark, d, "documents").where("text is not null"), "doc_id", size=4, least=2)
    return found.withColumn("content", F.md5("content"))


_LINES = "WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents), p AS (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS line FROM l), h AS (SELECT *, l[line] AS matched FROM p WHERE contains(lower(l[line]), 'license'))"


@query("context_lines", f"{_LINES} SELECT doc_id, CAST(line AS INT) AS line, matched, array_to_string(l[greatest(1, line - 2):line + 2], chr(10)) AS context FROM h")
def context_lines(spark: SparkSession, d: str) -> DataFrame:
    return chunks.context_lines(table(spark, d, "documents"), "LICENSE", 2, "doc_id")


@query("cross_repository_search", f"{_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, line) AS r FROM h) SELECT source AS repository, doc_id AS path, CAST(line AS INT) AS line, matched, array_to_string(list_concat(l[greatest(1, line - 3):line - 1], l[line + 1:line + 3]), chr(10)) AS context FROM r WHERE r <= 1000")
def cross_repository_search(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "documents").select(F.col("source").alias("repository"), F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return code.search_repositories(files, "license").withColumn("context", F.array_join("context", "\n"))


@query("passage_topk", r"WITH s AS (SELECT doc_id, regexp_split_to_array(text, '[.!?\n]') AS l FROM documents), p AS (SELECT doc_id, CAST(i - 1 AS INT) AS position, l[i] AS segment FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)), h AS (SELECT doc_id, position, trim(segment) AS segment, CAST(len(regexp_extract_all(lower(segment), '\bthat\b')) + len(regexp_extract_all(lower(segment), '\bwith\b')) AS BIGINT) AS hits FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, position) AS r FROM h WHERE hits > 0) SELECT doc_id, position, segment, hits FROM r WHERE r <= 10")
def passage_topk(spark: SparkSession, d: str) -> DataFrame:
    return chunks.passages(table(spark, d, "documents"), ["that", "with"], 10, "doc_id")


_EDGES = "WITH edges AS (SELECT 'region:' || r.r_regionkey AS source, 'nation:' || n_nationkey AS target FROM nation JOIN region r ON r_regionkey = n_regionkey UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    def edge(name: str, a: str, ka: str, b: str, kb: str) -> DataFrame:
        return table(spark, d, name).select(F.concat(F.lit(f"{a}:"), F.col(ka).cast("string")).alias("source"), F.concat(F.lit(f"{b}:"), F.col(kb).cast("string")).alias("target"), F.lit(f"{a}_{b}").alias("type"))

    return edge("nation", "region", "n_regionkey", "nation", "n_nationkey").unionAll(edge("customer", "nation", "c_nationkey", "customer", "c_custkey")).unionAll(edge("orders", "customer", "o_custkey", "order", "o_orderkey"))


@query("graph_neighbours", f"{_EDGES} SELECT source, target, 'out' AS direction FROM edges WHERE source = 'nation:7' UNION ALL SELECT target, source, 'in' FROM edges WHERE target = 'nation:7'")
def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(_edges(spark, d), "nation:7").select("source", "target", "direction")


@query("graph_reach", f"{_EDGES} SELECT 'region:2' AS node, 0 AS depth UNION ALL SELECT target, 1 FROM edges WHERE source = 'region:2' UNION ALL SELECT b.target, 2 FROM edges a JOIN edges b ON b.source = a.target WHERE a.source = 'region:2' UNION ALL SELECT c.target, 3 FROM edges a JOIN edges b ON b.source = a.target JOIN edges c ON c.source = b.target WHERE a.source = 'region:2'")
def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    return graph.reach(_edges(spark, d), spark.range(1).select(F.lit("region:2").alias("node")), 3)


@query("graph_degrees", f"{_EDGES} SELECT split_part(source, ':', 1) AS kind, count(*) AS n_edges, count(DISTINCT source) AS n_sources, count(DISTINCT target) AS n_targets FROM edges GROUP BY 1")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy(F.substring_index("source", ":", 1).alias("kind")).agg(F.count("*").alias("n_edges"), F.count_distinct("source").alias("n_sources"), F.count_distinct("target").alias("n_targets"))


@query("node_search", "WITH n AS (SELECT 'nation:' || n_nationkey AS id, 'class' AS type, n_name AS name, 'nation.' || n_name AS full_name FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, 'interface', s_name, 'supplier.' || s_name FROM supplier) SELECT id, type, name FROM n WHERE contains(lower(name), 'ia') OR contains(lower(full_name), 'ia') OR contains(lower(name), '1') ORDER BY CASE WHEN type = 'class' THEN 0 ELSE 1 END, name, id LIMIT 15")
def node_search(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("class").alias("type"), F.col("n_name").alias("name"), F.concat(F.lit("nation."), "n_name").alias("full_name"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("interface").alias("type"), F.col("s_name").alias("name"), F.concat(F.lit("supplier."), "s_name").alias("full_name"))
    both = n.unionAll(s)
    hit = graph.search_nodes(both, "ia", 1000).unionAll(graph.search_nodes(both.where("lower(name) like '%1%'"), "1", 1_000_000)).distinct()
    return hit.orderBy(F.when(F.col("type") == "class", 0).otherwise(1), "name", "id").limit(15).select("id", "type", "name")


@query("path_enumeration", f"{_EDGES} SELECT a.source || '>' || a.target || coalesce('>' || b.target, '') || coalesce('>' || c.target, '') AS path FROM edges a LEFT JOIN edges b ON b.source = a.target LEFT JOIN edges c ON c.source = b.target WHERE a.source = 'region:1'")
def path_enumeration(spark: SparkSession, d: str) -> DataFrame:
    return graph.paths(_edges(spark, d), spark.range(1).select(F.lit("region:1").alias("node")), 3).select(F.array_join("path", ">").alias("path"))


_STEP = "WITH e AS (SELECT event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c, lead(event_type, 3) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT a || '>' || b AS chain, 2 AS length FROM e WHERE b IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c, 3 FROM e WHERE c IS NOT NULL UNION ALL SELECT a || '>' || b || '>' || c || '>' || d, 4 FROM e WHERE d IS NOT NULL)"


@query("frequent_chains", f"{_STEP} SELECT chain, length, count(*) AS n FROM g WHERE chain IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def frequent_chains(spark: SparkSession, d: str) -> DataFrame:
    return graph.chains(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("impact_severity", "WITH r AS (SELECT p_brand AS property, p_size > 45 AS critical, p_type LIKE '%BRASS' AS conditional, p_name FROM part), a AS (SELECT property, count(*) AS n_references, count(*) FILTER (WHERE critical) AS n_critical, count(*) FILTER (WHERE conditional) AS n_conditional, count(DISTINCT p_name) AS n_classes FROM r GROUP BY property) SELECT *, CASE WHEN n_critical > 0 OR n_conditional > 1 THEN 'HIGH' WHEN n_references > 5 OR n_conditional > 0 THEN 'MEDIUM' WHEN n_references > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS severity FROM a")
def impact_severity(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("property"), (F.col("p_size") > 45).alias("is_critical"), F.when(F.col("p_type").endswith("BRASS"), "conditional").otherwise("direct").alias("access"), F.col("p_name").alias("class_name"))
    return code.impact(p)


@query("domain_filter", "WITH d AS (SELECT page_id, split_part(regexp_replace(lower(url), '^https?://', ''), '/', 1) AS domain FROM pages) SELECT page_id, domain, domain = 'example.com' OR domain LIKE '%.example.com' OR domain = 'example.org' OR domain LIKE '%.example.org' AS trusted FROM d")
def domain_filter(spark: SparkSession, d: str) -> DataFrame:
    host = text.domain(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("domain"), text.trusted(host, text.parse_allowed("example.com, Example.org,,example.com")).alias("trusted"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(regexp_replace(lower(url), '^https?://', ''), '/', 1) AS source FROM pages")
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    site = F.nullif(F.regexp_extract("html", r'<meta property="og:site_name" content="([^"]*)"', 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.coalesce(site, text.domain(F.col("url"))).alias("source"))


@query("rate_limited_events", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id) AS r FROM events) SELECT event_id, user_id FROM r WHERE r <= 1")
def rate_limited_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return limits.limited(e, 1, 3600, "user_id").select(F.col("id").alias("event_id"), "user_id")


@query("first_request_limits")
def first_request_limits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return limits.limited_from_first(e, 1, 3600, "user_id")


@query("cached_pages", "WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts >= TIMESTAMP '2024-01-28 12:00:00' - INTERVAL 24 HOUR) SELECT 'http://u/' || user_id AS key, event_id FROM r WHERE r = 1 ORDER BY ts DESC, key LIMIT 1000")
def cached_pages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.lit("HTTP://u/"), F.col("user_id").cast("string"), F.lit("/")).alias("url"), "event_id", "ts")
    return limits.cached(e.select("event_id", "url", "ts"), "2024-01-28 12:00:00").select("key", "event_id")


@query("evidence_union", "SELECT 'Document' AS kind, count(*) AS n, count(DISTINCT source) AS n_sources FROM documents UNION ALL SELECT 'Page', count(*), count(DISTINCT url) FROM pages UNION ALL SELECT 'Turn', count(*), count(DISTINCT conv_id) FROM conversations")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    def part(kind: str, name: str, key: str) -> DataFrame:
        return table(spark, d, name).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_sources")).select(F.lit(kind).alias("kind"), "n", "n_sources")

    return part("Document", "documents", "source").unionByName(part("Page", "pages", "url")).unionByName(part("Turn", "conversations", "conv_id"))


@query("repository_priority", "WITH r AS (SELECT source AS name, count(*) AS size FROM documents GROUP BY source) SELECT name, size, CASE WHEN size > 1000 THEN 30 WHEN size > 500 THEN 20 WHEN size > 100 THEN 10 ELSE 0 END + CASE WHEN contains(name, '1') THEN 0 ELSE 0 END AS priority FROM r")
def repository_priority(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("size"))
    return r.select("name", "size", retrieval.repository_priority(F.col("name"), F.col("size")).alias("priority"))


@query("metrics_snapshot", "SELECT (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) AS edges, (SELECT count(*) FROM events WHERE event_type = 'error') AS failures")
def metrics_snapshot(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, name: df.agg(F.count("*").alias(name))
    edges = table(spark, d, "nation").select(F.lit(1)).unionAll(table(spark, d, "customer").select(F.lit(1)))
    return one(table(spark, d, "embeddings"), "embeddings").crossJoin(one(edges, "edges")).crossJoin(one(table(spark, d, "events").where("event_type = 'error'"), "failures"))
