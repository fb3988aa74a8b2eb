"""Composed searches and the evidence of an answer, each beside its SQL: lazy plans of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.functions import text
from codelathe.operators import chunks, graph, logs, lookups, retrieval
from codelathe.plans.catalog import query
from codelathe.plans.queries import _EDGES, _MSG, _SET, _SIMS, _edges, _first, _logs, _vectors
from codelathe.sources.readers import table

QUESTION = "what is retion"


def code_search(docs: DataFrame, question: str, vectors: DataFrame, query_vector: DataFrame, k: int, boost: float = 1.0) -> DataFrame:
    """(id, score, relevance): the question is expanded, terms choose ``2 * k`` texts, their similarity to the question's vector is the base, and boosts order them.

    ``docs`` has id, content, description, has_logs and has_context.
    """
    asked = docs.sparkSession.range(1).select(text.expanded(F.lit(question)).alias("q")).first()["q"]
    chosen = retrieval.top_k(retrieval.keyword_scores(docs, asked, boost=boost), "score", "id", 2 * k)
    near = retrieval.scored(vectors, query_vector).select("id", "similarity")
    base = F.coalesce("similarity", F.lit(0.0))
    order = retrieval.reranked(base, F.lit(question), F.col("description"), F.col("content"), F.col("has_logs"), F.col("has_context"), F.lit(False))
    return retrieval.top_k(F.broadcast(chosen).join(near, "id", "left").select("id", "score", F.round(order, 6).alias("relevance")), "relevance", "id", k)


def answer_context(question: str, articles: DataFrame, snippets: DataFrame, edges: DataFrame, node: str, logs_: DataFrame | None = None, n_articles: int = 3, n_snippets: int = 5) -> DataFrame:
    """(kind, id, score): the evidence of an answer: articles (id, title, content), snippets (id, content), edges of an entity, and error patterns where the question is about errors."""
    best = articles.select(F.col("id").cast("string").alias("id"), F.round(logs.article_relevance(F.col("title"), F.col("content"), F.lit(question)), 6).alias("score")).where("score > 0")
    out = retrieval.top_k(best, "score", "id", n_articles).select(F.lit("article").alias("kind"), "id", "score")
    found = retrieval.keyword_scores(snippets.withColumn("id", F.col("id").cast("string")), question).select("id", "score")
    out = out.unionByName(retrieval.top_k(found, "score", "id", n_snippets).select(F.lit("snippet").alias("kind"), "id", "score"))
    out = out.unionByName(graph.neighbours(edges, node).select(F.lit("edge").alias("kind"), F.col("target").alias("id"), F.lit(1.0).alias("score")))
    if logs_ is not None and any(w in question.lower() for w in ("error", "exception")):
        out = out.unionByName(logs.error_patterns(logs_).select(F.lit("pattern").alias("kind"), F.col("template").alias("id"), F.col("frequency").cast("double").alias("score")))
    return out


_DESCRIBED = "(SELECT id, similarity, CASE WHEN id % 2 = 0 THEN repeat('d', CAST(id % 7 * 100 AS INT)) ELSE '' END AS description FROM s)"


def _described(spark: SparkSession, d: str) -> DataFrame:
    near = retrieval.scored(_vectors(spark, d), _first(spark, d)).select("id", F.round("similarity", 6).alias("similarity"))
    return near.withColumn("description", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("d"), (F.col("id") % 7 * 100).cast("int"))).otherwise(""))


@query("semantic_search", f"{_SIMS}, x AS (SELECT id, similarity * CASE WHEN length(description) > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS score FROM {_DESCRIBED}) SELECT id, round(score, 6) AS score FROM x WHERE score >= 0.2 ORDER BY x.score DESC, id LIMIT 15")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.semantic_search(_described(spark, d), "CONCEPTUAL", 15, 0.2).select("id", F.round("score", 6).alias("score"))


@query("default_search", f"{_SIMS}, n AS (SELECT * FROM {_DESCRIBED} WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 20), x AS (SELECT id, least(1.0::DOUBLE, similarity + CASE WHEN length(description) > 100 THEN least(0.15::DOUBLE, length(description) / 10000.0::DOUBLE) ELSE 0.0::DOUBLE END) AS score FROM n) SELECT id, round(score, 6) AS score FROM x ORDER BY x.score DESC, id LIMIT 10")
def default_search(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.default_search(_described(spark, d), True, 10, 0.2).select("id", F.round("score", 6).alias("score"))


_N = "((length(lower(text)) - length(replace(lower(text), '{0}', ''))) // length('{0}'))"
_CODE = f"2.0 * (5 * {_N.format('retion')} + " + " + ".join(_N.format(w) for w in ("class", "implementation", "functionality", "purpose", "code")) + ")"


@query("code_search", f"{_SIMS}, k AS (SELECT doc_id AS id, CAST({_CODE} AS DOUBLE) AS score, source, text, lang, n_chars FROM documents WHERE text IS NOT NULL), c AS (SELECT * FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 40), q AS (SELECT id, score, round(greatest(0.0, least(1.0, coalesce(s.similarity, 0.0) + 0.03 * CAST(contains(lower(source), 'retion') AS INT) + 0.02 * CAST(contains(lower(text), 'retion') AS INT) + CASE WHEN lang = 'en' THEN 0.05 ELSE 0.0 END + CASE WHEN n_chars > 2000 THEN 0.10 ELSE 0.0 END)), 4)::DOUBLE AS relevance FROM c LEFT JOIN s USING (id)) SELECT id, score, relevance FROM q ORDER BY relevance DESC, id LIMIT 20")
def code_search_query(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("description"), (F.col("lang") == "en").alias("has_logs"), (F.col("n_chars") > 2000).alias("has_context"))
    found = code_search(docs, QUESTION, _vectors(spark, d), _first(spark, d), 20)
    return found.select("id", "score", F.round("relevance", 4).alias("relevance"))


_ASKED = "error of retion"


@query(
    "answer_context",
    f"{_EDGES}, w AS (SELECT list_distinct(list_filter(regexp_split_to_array(lower('{_ASKED}'), '[^a-z0-9]+'), lambda w: length(w) > 2)) AS w), a AS (SELECT CAST(doc_id AS VARCHAR) AS id, round(CAST(3 * len(list_intersect({_SET.format('source')}, w)) + len(list_intersect({_SET.format('text')}, w)) AS DOUBLE) / len(w), 6) AS score FROM documents, w), "
    f"k AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(2.0 * ({_N.format('error')} + {_N.format('retion')}) AS DOUBLE) AS score FROM documents WHERE text IS NOT NULL), "
    rf"e AS (SELECT regexp_replace(regexp_replace({_MSG}, '\b\d+\b', '<NUM>', 'g'), '/[\w/.-]+', '<PATH>', 'g') AS template FROM events WHERE event_type = 'error') "
    "SELECT 'article' AS kind, id, score FROM (SELECT * FROM a WHERE score > 0 ORDER BY score DESC, id LIMIT 3) UNION ALL SELECT 'snippet', id, score FROM (SELECT * FROM k WHERE score > 0 ORDER BY score DESC, id LIMIT 5) "
    "UNION ALL SELECT 'edge', target, 1.0 FROM edges WHERE source = 'nation:7' UNION ALL SELECT 'edge', source, 1.0 FROM edges WHERE target = 'nation:7' UNION ALL SELECT 'pattern', template, CAST(count(*) AS DOUBLE) FROM e GROUP BY template HAVING count(*) >= 2",
)
def answer_context_query(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"))
    return answer_context(_ASKED, docs, docs.select("id", "content"), _edges(spark, d), "nation:7", _logs(spark, d))


@query("block_overlap", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, l, CAST(unnest(range(0, (len(l) - 1) // 4 + 1)) AS INT) AS block FROM l), x AS (SELECT doc_id, block, l[block * 4 + 1:block * 4 + 4] AS p FROM b WHERE len(l[block * 4 + 1:block * 4 + 4]) >= 2) SELECT doc_id, block, coalesce(lag(array_to_string(p[greatest(1, len(p) - 1):len(p)], chr(10))) OVER w, '') AS before, coalesce(lead(array_to_string(p[1:2], chr(10))) OVER w, '') AS after FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY block)")
def block_overlap(spark: SparkSession, d: str) -> DataFrame:
    blocks = chunks.line_blocks(table(spark, d, "documents").where("text is not null"), "doc_id", size=4, least=2)
    return chunks.with_overlap(blocks, "doc_id", 2).select("doc_id", "block", "before", "after")


@query("estimated_chunks", "SELECT lang, CAST(sum(greatest(1, length(text) // 500)) AS BIGINT) AS n_chunks, count(*) AS n_files FROM documents WHERE text IS NOT NULL GROUP BY lang")
def estimated_chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.sum(chunks.estimated_chunks()).alias("n_chunks"), F.count("*").alias("n_files"))


@query("newest_turns", "SELECT role, arg_max(text, (conv_id, turn)) AS text FROM conversations GROUP BY role")
def newest_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last namespace wins for equal keys, as stored rows are overwritten."""
    c = table(spark, d, "conversations").select(F.col("role").alias("id"), F.struct("conv_id", "turn").alias("namespace"), "text")
    return lookups.last_namespace(c, c.select("id")).select(F.col("id").alias("role"), "text")
