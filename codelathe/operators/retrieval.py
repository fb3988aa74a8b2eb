"""Vector, keyword and fused retrieval as frames in, frames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelathe.functions.text import occurrences, rerank_terms, search_terms
from codelathe.functions.vector import cosine

# Fixed values.
THRESHOLDS = {"CONCEPTUAL": 0.55, "IMPLEMENTATION": 0.70, "MIXED": 0.65}
SEMANTIC_WEIGHTS = {"CONCEPTUAL": 0.8, "IMPLEMENTATION": 0.6, "MIXED": 0.7}
CONCEPT_BOOST = 1.1


def top_k(df: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def scored(vectors: DataFrame, query: DataFrame, vector: str = "vector", query_vector: str = "query_vector") -> DataFrame:
    """Each vector's ``similarity`` to the one query row, which is broadcast."""
    return vectors.crossJoin(F.broadcast(query.limit(1))).withColumn("similarity", cosine(F.col(vector), F.col(query_vector))).drop(query_vector)


def knn(vectors: DataFrame, query: DataFrame, k: int, least: float | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    found = scored(vectors, query, vector)
    if least is not None:
        found = found.where(F.col("similarity") >= least)
    return top_k(found, "similarity", key, k)


def knn_by_namespace(vectors: DataFrame, query: DataFrame, per: int, k: int, namespaces: list[str] | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """The best ``per`` of each namespace, then the best ``k`` of those; no names mean all."""
    if namespaces:
        vectors = vectors.where(F.col("namespace").isin(namespaces))
    order = Window.partitionBy("namespace").orderBy(F.desc("similarity"), key)
    return top_k(scored(vectors, query, vector).withColumn("r", F.row_number().over(order)).where(F.col("r") <= per).drop("r"), "similarity", key, k)


def valid_vectors(vectors: DataFrame, dims: int, vector: str = "vector") -> DataFrame:
    return vectors.where(F.size(vector) == dims)


def upsert(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those with equal keys."""
    return held.join(new.select(*keys), keys, "left_anti").unionByName(new)


def keyword_scores(docs: DataFrame, query: str, key: str = "id", content: str = "content", description: str | None = None, purpose: str | None = None, boost: float = 1.0) -> DataFrame:
    """Sum over the query's terms of weighted literal counts; rows without content or score are left out.

    The terms are literals of the plan, so each text is read once and nothing is shuffled.
    """
    spark = docs.sparkSession
    terms = spark.range(1).select(search_terms(F.lit(query)).alias("t")).first()["t"]
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    total = F.lit(0.0)
    for term in terms:
        total = total + 2.0 * occurrences(low(content), F.lit(term))
        if description:
            total = total + boost * occurrences(low(description), F.lit(term))
        if purpose:
            total = total + 2.0 * boost * occurrences(low(purpose), F.lit(term))
    return docs.where(F.col(content).isNotNull()).withColumn("score", total).where("score > 0")


def semantic_search(found: DataFrame, kind: str, k: int, least: float | None = None, description: str = "description", key: str = "id") -> DataFrame:
    """The best ``k`` rows of ``similarity``, from the threshold of the query's type on; for a conceptual query, rows with a description gain first."""
    boost = F.when(F.length(F.trim(F.coalesce(F.col(description), F.lit("")))) > 0, CONCEPT_BOOST).otherwise(1.0) if kind == "CONCEPTUAL" else F.lit(1.0)
    held = found.withColumn("score", F.col("similarity") * boost)
    return top_k(held.where(F.col("score") >= (THRESHOLDS[kind] if least is None else least)), "score", key, k)


def default_search(found: DataFrame, conceptual: bool, k: int, threshold: float = 0.7, description: str = "description", key: str = "id") -> DataFrame:
    """The best ``k`` of the ``2 * k`` nearest rows above the threshold; a conceptual query relaxes it and adds up to 0.15 for long descriptions."""
    least = max(0.5, threshold - 0.15) if conceptual and threshold >= 0.5 else threshold
    near = top_k(found.where(F.col("similarity") >= least), "similarity", key, 2 * k)
    size = F.length(F.coalesce(F.col(description), F.lit("")))
    more = F.when(size > 100, F.least(F.lit(0.15), size / 10000.0)).otherwise(0.0) if conceptual else F.lit(0.0)
    return top_k(near.withColumn("score", F.least(F.lit(1.0), F.col("similarity") + more)), "score", key, k)


def strategy(name: str | None):
    """Search by strategy name; unknown names and none mean ``hybrid``."""
    return {"semantic": semantic_search, "keyword": keyword_scores, "hybrid": fuse}.get((name or "hybrid").lower(), fuse)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, weight: float = SEMANTIC_WEIGHTS["MIXED"], key: str = "id") -> DataFrame:
    """Rank fusion of two scored lists of bounded length: (length - rank) * weight, summed."""

    def ranked(df: DataFrame, w: float, name: str) -> DataFrame:
        everything = Window.partitionBy(F.lit(0))
        rank = F.row_number().over(everything.orderBy(F.desc("score"), key)) - 1
        return df.select(key, ((F.count("*").over(everything) - rank) * F.lit(w)).alias(name))

    both = ranked(semantic, weight, "s").join(ranked(keyword, 1 - weight, "w"), key, "full_outer")
    return top_k(both.select(key, (F.coalesce("s", F.lit(0.0)) + F.coalesce("w", F.lit(0.0))).alias("score")), "score", key, k)


def reranked(base: Column, query: Column, description: Column, content: Column, has_logs: Column, has_context: Column, path_resolved: Column) -> Column:
    """A base relevance with boosts for terms, logs and paths, in [0, 1]."""
    terms = rerank_terms(query)
    found = lambda text: F.size(F.filter(terms, lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t)))
    total = base + 0.03 * found(description) + 0.02 * found(content)
    for flag, more in ((has_logs, 0.05), (has_context, 0.10), (path_resolved, 0.05)):
        total = total + F.when(flag, more).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def repository_priority(name: Column, size: Column) -> Column:
    """Priority of a repository by its size and name."""
    by_size = F.when(size > 1000, 30).when(size > 500, 20).when(size > 100, 10).otherwise(0)
    by_name = F.when(name.contains("api") | name.contains("core"), 50).when(name.contains("test") | name.contains("mock"), -20).when(name.contains("doc") | name.contains("example"), 10).otherwise(0)
    return by_size + by_name
