"""Queries for scores, evidence, dependents and trees, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.functions import scoring, text
from codelathe.operators import javagraph, patterns, retrieval
from codelathe.plans.catalog import query
from codelathe.plans.queries import _EDGES, _SIMS, _edges, _first, _vectors
from codelathe.sources.readers import table


@query("threshold_counts", f"{_SIMS} SELECT count(*) FILTER (WHERE similarity >= 0.1) AS n_low, count(*) FILTER (WHERE similarity >= 0.25) AS n_threshold, max(similarity) AS best FROM s")
def threshold_counts(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.scored(_vectors(spark, d), _first(spark, d)).select(F.round("similarity", 6).alias("similarity"))
    return patterns.threshold_counts(found, 0.25)


@query("vector_dimensions", "SELECT vec_id AS id FROM embeddings WHERE len(embedding) = 64")
def vector_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.valid_vectors(_vectors(spark, d), 64).select("id")


_EXPLAINED = "WITH p AS (SELECT event_id, 0.4 * least(1.0, greatest(0.0, value / 100.0)) AS v, 0.3 * (CASE WHEN user_id % 4 > 0 THEN (user_id % 2) / (user_id % 4)::DOUBLE ELSE 0.5 END) AS t, 0.2 * 0.3 AS e, 0.1 * 0.5 AS c FROM events WHERE value IS NOT NULL), s AS (SELECT *, v + t + e + c AS total FROM p)"


@query("confidence_explanation", f"{_EXPLAINED} SELECT event_id, round(v, 6)::DOUBLE AS vector, round(t, 6)::DOUBLE AS tool, round(e, 6)::DOUBLE AS evidence, round(c, 6)::DOUBLE AS clarity, round(total, 6)::DOUBLE AS score FROM s")
def confidence_explanation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("value is not null")
    parts = scoring.components(F.col("value") / 100.0, F.col("user_id") % 4, F.col("user_id") % 2, F.lit(0), F.lit(0), F.lit(0.0), F.lit(0.5))
    told = e.select("event_id", scoring.explanation(parts).alias("x"), F.round(scoring.score(parts), 6).alias("score"))
    return told.select("event_id", *(F.round(f"x.{k}.contribution", 6).alias(k) for k in scoring.WEIGHTS), "score")


@query("file_excerpts", "WITH p AS (SELECT doc_id, text, strpos(lower(text), 'that') - 1 AS b FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(CASE WHEN length(text) <= 20000 THEN text WHEN b >= 0 THEN substr(text, greatest(0, b - 5000) + 1, b + 4 + 5000 - greatest(0, b - 5000)) ELSE substr(text, 1, 15000) END) AS excerpt FROM p")
def file_excerpts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    at = F.nullif(F.instr(F.lower("text"), "that"), F.lit(0)) - 1
    return docs.select("doc_id", F.md5(patterns.excerpt(F.col("text"), at, at + 4)).alias("excerpt"))


@query("truncated_turns", "SELECT conv_id, turn, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '... [' || (length(text) - 80) || ' more chars]' ELSE text END AS shown FROM conversations")
def truncated_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", text.truncated(F.col("text"), 80).alias("shown"))


@query("evidence_bands", "SELECT event_type AS source, count(*) FILTER (WHERE c > 0.8) AS n_high, count(*) FILTER (WHERE c > 0.5 AND c <= 0.8) AS n_medium, count(*) FILTER (WHERE c IS NULL OR c <= 0.5) AS n_low, max(c) AS best FROM (SELECT event_type, round(value / 100.0, 6) AS c FROM events) GROUP BY 1")
def evidence_bands(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select(F.col("event_type").alias("source"), F.round(F.col("value") / 100.0, 6).alias("confidence"))
    return patterns.evidence_bands(steps)


@query("chain_confidence", "SELECT l_orderkey AS entry, round(avg(1 - l_discount), 6) AS mean, count(*) AS n_steps FROM lineitem GROUP BY 1")
def chain_confidence(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entry"), (1 - F.col("l_discount")).alias("confidence"))
    return patterns.chain_confidence(steps, ["entry"]).withColumn("mean", F.round("mean", 6))


@query("steps_of_file", f"{_EDGES} SELECT DISTINCT source, target FROM edges WHERE source = 'nation:3' OR target = 'nation:3'")
def steps_of_file(spark: SparkSession, d: str) -> DataFrame:
    return patterns.steps_of_file(_edges(spark, d), "nation:3")


@query("transitive_dependents", f"{_EDGES} SELECT source AS name FROM edges WHERE target IN (SELECT target FROM edges WHERE source = 'nation:4' OR source = 'region:1') UNION SELECT a.source FROM edges a JOIN edges b ON b.source = a.target WHERE b.target IN (SELECT target FROM edges WHERE source = 'nation:4' OR source = 'region:1')")
def transitive_dependents(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    direct = edges.where("source = 'nation:4' or source = 'region:1'").select(F.col("target").alias("name"))
    return javagraph.dependents(edges, direct)


@query("interface_implementations", "SELECT 'region:' || n_regionkey AS interface, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS implementations FROM nation GROUP BY 1")
def interface_implementations(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "nation").select(F.lit("implements").alias("kind"), F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")).alias("target"), F.col("n_name").alias("owner"))
    return javagraph.implementations(facts).select("interface", F.array_join("implementations", ",").alias("implementations"))


@query("call_tree", f"{_EDGES}, t AS (SELECT 'region:3' AS path, 0 AS depth UNION ALL SELECT 'region:3>' || target, 1 FROM edges WHERE source = 'region:3' UNION ALL SELECT a.source || '>' || a.target || '>' || b.target, 2 FROM edges a JOIN edges b ON b.source = a.target WHERE a.source = 'region:3') SELECT path, depth, false AS is_cycle FROM t")
def call_tree(spark: SparkSession, d: str) -> DataFrame:
    return patterns.tree(_edges(spark, d), "region:3", 2).select(F.array_join("path", ">").alias("path"), "depth", "is_cycle")
