"""Lookups and upkeep of stored rows: vectors and their metadata, articles, audit rows, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelathe.functions import scoring


def removed(held: DataFrame, gone: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """``held`` without the rows whose keys are in ``gone``."""
    return held.join(gone.select(*keys), list(keys), "left_anti")


def first_namespace(rows: DataFrame, key: str = "id", order: str = "namespace") -> DataFrame:
    """One row for each key: the one of its first namespace."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(key, "r.*")


def last_namespace(metadata: DataFrame, vectors: DataFrame, key: str = "id", order: str = "namespace") -> DataFrame:
    """Metadata that has a vector, one row for each key: a later namespace overwrites an earlier one."""
    rest = [c for c in metadata.columns if c != key]
    held = metadata.join(vectors.select(key).distinct(), key, "left_semi")
    return held.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("r")).select(key, "r.*")


def by_path(metadata: DataFrame, path: str, within: bool = False, column: str = "path") -> DataFrame:
    """Rows of a file with the fixed score 1; ``within`` also takes paths that contain it, whichever way slashes lean."""
    lean = F.replace(F.col(column), F.lit("\\"), F.lit("/"))
    hit = lean.contains(path.replace("\\", "/")) if within else F.col(column) == path
    return metadata.where(hit).withColumn("score", F.lit(1.0))


def namespaced(namespace: Column, key: Column) -> Column:
    return F.concat(namespace.cast("string"), F.lit(":"), key.cast("string"))


def parts_of(name: Column) -> Column:
    """The namespace before the first colon and the key behind it; without a colon the namespace is ``default``."""
    at = F.instr(name, ":")
    return F.struct(F.when(at > 0, F.substring(name, F.lit(1), at - 1)).otherwise("default").alias("namespace"), F.when(at > 0, F.substring(name, at + 1, F.length(name))).otherwise(name).alias("key"))


def usable(vector: Column) -> Column:
    """Whether a vector has a number other than zero."""
    return F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))


def start_up(metadata: DataFrame, vectors: DataFrame, key: str = "id", by: str = "namespace") -> DataFrame:
    """(namespace, n_metadata, n_vectors, n_unmatched): what a namespace loads, and ids on one side only."""
    a = metadata.select(by, key, F.lit(1).alias("m"))
    b = vectors.select(by, key, F.lit(1).alias("v"))
    both = a.join(b, [by, key], "full_outer")
    return both.groupBy(by).agg(F.count("m").alias("n_metadata"), F.count("v").alias("n_vectors"), F.count_if(F.col("m").isNull() | F.col("v").isNull()).alias("n_unmatched"))


def batches(rows: DataFrame, size: int, by: str, order: str) -> DataFrame:
    """Rows with the number of their batch of ``size`` rows within ``by``."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def source_list(articles: DataFrame, snippets: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """(source): what an answer rests on: article ids, file paths and the beginnings of error patterns."""
    out = articles.select(F.concat(F.lit("KnowledgeArticle:"), F.col("id").cast("string")).alias("source"))
    out = out.unionByName(snippets.select(F.concat(F.lit("CodeSnippet:"), F.col("path").cast("string")).alias("source")))
    if patterns is not None:
        out = out.unionByName(patterns.select(F.concat(F.lit("ErrorPattern:"), F.left("template", F.lit(20))).alias("source")))
    return out


def search_articles(articles: DataFrame, text: str, k: int, key: str = "id", title: str = "title", content: str = "content") -> DataFrame:
    """The first ``k`` articles by id whose title or content holds the text, in any case."""
    low = F.lit(text.lower())
    hit = F.coalesce(F.contains(F.lower(title), low), F.lit(False)) | F.coalesce(F.contains(F.lower(content), low), F.lit(False))
    return articles.where(hit).orderBy(key).limit(k)


def mean_rating(audit: DataFrame, rating: str = "rating") -> DataFrame:
    """One row: the mean of the ratings there are, 0 without any."""
    return audit.agg(F.coalesce(F.avg(rating), F.lit(0.0)).alias("rating"))


def recorded(audit: DataFrame, interactions: DataFrame) -> DataFrame:
    """Audit rows with new ones, known by request and response."""
    return audit.unionByName(interactions.withColumn("id", F.concat_ws("-", "request_id", "response_id")), allowMissingColumns=True)


def evidence_scores(snippets: DataFrame, articles: DataFrame, entities: DataFrame, by: str) -> DataFrame:
    """(by, vector, n_items, n_relevant, quality): the evidence of a question.

    ``vector`` is the mean relevance of snippets above 0; 0.3 if all are at 0 or
    below, 0 without snippets. Snippets count as relevant from 0.5 on, articles
    (quality 0.8 of their relevance) and entities (0.7) always.
    """
    s = snippets.select(by, F.col("relevance").alias("r"), F.lit("s").alias("k"))
    a = articles.select(by, (F.col("relevance") * 0.8).alias("r"), F.lit("a").alias("k"))
    e = entities.select(by, F.lit(0.7).alias("r"), F.lit("e").alias("k"))
    snippet = F.col("k") == "s"
    out = s.unionByName(a).unionByName(e).groupBy(by).agg(
        F.avg(F.when(snippet & (F.col("r") > 0), F.col("r"))).alias("positive"), F.count_if(snippet).alias("n_snippets"), F.count("*").alias("n_items"), F.count_if(~snippet | (F.col("r") >= 0.5)).alias("n_relevant"), F.avg(F.when(~snippet | (F.col("r") >= 0.5), F.col("r"))).alias("q")
    )
    vector = F.when(F.col("n_snippets") == 0, 0.0).otherwise(F.coalesce("positive", F.lit(0.3)))
    return out.select(by, vector.alias("vector"), "n_items", "n_relevant", F.coalesce("q", F.lit(0.0)).alias("quality"))


def enhanced_confidence(snippets: DataFrame, articles: DataFrame, entities: DataFrame, tools: DataFrame, questions: DataFrame, by: str) -> DataFrame:
    """(by, score, rating, factors and the figures behind them) of each question.

    ``questions`` has by and question, ``tools`` by, n_used and n_succeeded; a
    question without tools or evidence takes the scores that none have.
    """
    rows = questions.join(evidence_scores(snippets, articles, entities, by), by, "left").join(tools, by, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.select(by, "question", F.coalesce("vector", F.lit(0.0)).alias("vector"), *(n(c).alias(c) for c in ("n_items", "n_relevant", "n_used", "n_succeeded")), F.coalesce("quality", F.lit(0.0)).alias("quality"))
    parts = scoring.components(F.col("vector"), F.col("n_used"), F.col("n_succeeded"), F.col("n_items"), F.col("n_relevant"), F.col("quality"), scoring.clarity(F.col("question")))
    score = scoring.score(parts)
    return rows.select(by, score.alias("score"), scoring.rating(score).alias("rating"), scoring.key_factors(parts).alias("factors"), "vector", "n_used", "n_succeeded", "n_items", "n_relevant", "quality")


def namespace_of(path: Column) -> Column:
    """First part of a path; ``default`` where it is null or empty."""
    return F.coalesce(F.nullif(F.substring_index(path, "/", 1), F.lit("")), F.lit("default"))


def run_totals(results: DataFrame, by: str = "repository") -> DataFrame:
    """(by, n_success, n_failed, n_skipped, status) of embedding runs; ``results`` has by and outcome."""
    count = lambda v: F.count_if(F.col("outcome") == v)
    out = results.groupBy(by).agg(count("success").alias("n_success"), count("failed").alias("n_failed"), count("skipped").alias("n_skipped"))
    return out.withColumn("status", F.when(F.col("n_failed") == 0, "success").when(F.col("n_success") > 0, "partial_success").otherwise("error"))


def nodes_by_path(nodes: DataFrame, path: str, column: str = "path") -> DataFrame:
    return nodes.where(F.replace(F.col(column), F.lit("\\"), F.lit("/")).contains(path.replace("\\", "/")))


def view(nodes: DataFrame, edges: DataFrame, centre: str | None, most: int = 50) -> DataFrame:
    """The nodes of a picture: a centre with all ends of its edges, or the first ``most`` by id."""
    if centre is None:
        return nodes.orderBy("id").limit(most)
    near = edges.where((F.col("source") == centre) | (F.col("target") == centre))
    ends = near.select(F.explode(F.array("source", "target")).alias("id")).distinct().unionByName(nodes.where(F.col("id") == centre).select("id")).distinct()
    return nodes.join(ends, "id", "left_semi")


def with_edges(found: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """(id, other, direction): edges out of and into each of the first ``k`` rows of ``found``, which is in order."""
    top = F.broadcast(found.limit(k).select("id"))
    out = edges.join(top, F.col("source") == F.col("id")).select("id", F.col("target").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.join(top, F.col("target") == F.col("id")).select("id", F.col("source").alias("other"), F.lit("in").alias("direction")))


def path_index(paths: DataFrame) -> DataFrame:
    """(file, path): each file with the last path that it is on; ``paths`` has path and files."""
    return paths.select("path", F.explode("files").alias("file")).groupBy("file").agg(F.max("path").alias("path"))


def paths_through(paths: DataFrame, file: str) -> DataFrame:
    return paths.where(F.array_contains("files", file))
