"""Runtime logs, articles and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelathe.functions.text import keyword_set, template


def in_time(ts: Column, begin: str | None = None, end: str | None = None) -> Column:
    """Inclusive bounds, an absent bound is open, a null time fails."""
    ok = ts.isNotNull()
    if begin is not None:
        ok = ok & (ts >= F.lit(begin).cast("timestamp_ntz"))
    if end is not None:
        ok = ok & (ts <= F.lit(end).cast("timestamp_ntz"))
    return ok


def search_logs(logs: DataFrame, text: str | None = None, level: str | None = None, service: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    out = logs.where(in_time(F.col("ts"), begin, end))
    if text is not None:
        out = out.where(F.lower("message").contains(text.lower()))
    if level is not None:
        out = out.where(F.col("level") == level)
    if service is not None:
        out = out.where(F.lower("service") == service.lower())
    return out


def error_patterns(logs: DataFrame, least: int = 2, examples: int = 3) -> DataFrame:
    """Templates of ERROR and FATAL messages with their counts and first messages, most frequent first.

    Counts are summed before the shuffle, and each task keeps only the first
    messages of a template before theirs, so a frequent one is no hot spot.
    """
    errors = logs.where(F.col("level").isin("ERROR", "FATAL") & F.col("message").isNotNull()).select("ord", "message", template(F.col("message")).alias("template"))
    counts = errors.groupBy("template").agg(F.count("*").alias("frequency")).where(F.col("frequency") >= least)
    first = errors.withColumn("r", F.row_number().over(Window.partitionBy("template").orderBy("ord", "message"))).where(F.col("r") <= examples)
    held = first.groupBy("template").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "message"))), lambda e: e["message"]).alias("examples"))
    return counts.join(held, "template").select("template", "frequency", "examples").orderBy(F.desc("frequency"), "template")


def article_relevance(title: Column, content: Column, query: Column) -> Column:
    """(3 * title words + content words) of the query's words, over their number."""
    words = keyword_set(query)
    hits = 3 * F.size(F.array_intersect(keyword_set(title), words)) + F.size(F.array_intersect(keyword_set(content), words))
    return F.when(content.isNull() | (F.size(words) == 0), 0.0).otherwise(hits / F.nullif(F.size(words), F.lit(0)).cast("double"))


def tagged(articles: DataFrame, tags: list[str]) -> DataFrame:
    return articles.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags))))


def model_stats(audit: DataFrame) -> DataFrame:
    return audit.groupBy("model").agg(F.coalesce(F.avg("latency"), F.lit(0.0)).alias("avg_latency"), F.coalesce(F.avg("tokens"), F.lit(0.0)).alias("avg_tokens"), F.count("*").alias("n"))
