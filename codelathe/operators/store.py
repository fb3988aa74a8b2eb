"""Embedding store upkeep, model answers, tickets and audit rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BINARY_SUFFIXES = ("jpg", "jpeg", "png", "gif", "pdf", "zip", "jar", "class", "exe", "bin", "so", "dll", "jks", "war")


def combined_text(description: Column, purpose: Column, capabilities: Column, content: Column) -> Column:
    """The text to embed; empty parts are left out."""
    some = lambda label, c: F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, F.concat(F.lit(label), c))
    bullets = F.when(F.size(capabilities) > 0, F.concat(F.lit("Capabilities:\n"), F.array_join(F.transform(capabilities, lambda c: F.concat(F.lit("- "), c)), "\n")))
    return F.concat_ws("\n\n", some("Description: ", description), some("Purpose: ", purpose), bullets, some("Code:\n", content))


def embed(df: DataFrame, text: str, model: Callable[[list[str]], list[list[float]]], key: str = "id") -> DataFrame:
    """(key, vector): vectors of non-blank texts from an injected model, a batch at a time; a failed batch gives nulls, never zero vectors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            try:
                found = model(part[text].tolist())
            except Exception:  # noqa: BLE001  the failures are rows
                found = [None] * len(part)
            yield pd.DataFrame({key: part[key], "vector": found})

    rows = df.where(F.length(F.trim(text)) > 0).select(key, text)
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, vector array<float>")


def missing(items: DataFrame, held: DataFrame, key: str = "id") -> DataFrame:
    """Items without a vector, for a new run."""
    return items.join(held.where("vector is not null").select(key), key, "left_anti")


def failures(attempts: DataFrame) -> DataFrame:
    """(text_hash, preview, failures, last_time, last_error) of failed attempts (text, ts, error)."""
    rows = attempts.where("error is not null").select(F.sha2("text", 256).alias("text_hash"), F.substring("text", 1, 100).alias("preview"), "ts", "error")
    return rows.groupBy("text_hash").agg(F.min("preview").alias("preview"), F.count("*").alias("failures"), F.max("ts").alias("last_time"), F.max_by("error", F.struct("ts", "error")).alias("last_error"))


def smoothed_latency(rows: DataFrame, key: str, ts: str = "ts", value: str = "value", keep: float = 0.2) -> DataFrame:
    """(key, latency): exponential average, ``keep`` of the old and the rest of the new value, in order of time.

    Only the last values matter beyond rounding: the fold takes the newest of a key until ``keep`` to their number is below 1e-16, 23 for 0.2.
    """
    import math

    from pyspark.sql import Window

    if not 0 <= keep < 1:
        raise ValueError("keep must be from 0 to below 1")
    most = 2 if keep == 0 else max(2, math.ceil(math.log(1e-16) / math.log(keep)))
    last = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(value)))).where(F.col("r") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), F.col(value).cast("double").alias("v")))), lambda x: x["v"])
    return last.groupBy(key).agg(ordered.alias("v")).select(key, F.aggregate(F.slice("v", 2, most), F.element_at("v", 1), lambda a, x: keep * a + (1 - keep) * x).alias("latency"))


def chat_answer(body: Column) -> Column:
    """Content, tokens and finish reason of a model's JSON answer; an error leaves them null."""
    j = F.from_json(body, "result boolean, error string, data struct<model: string, usage: struct<prompt_tokens: int, completion_tokens: int, total_tokens: int, cost: double>, choices: array<struct<message: struct<role: string, content: string>, finish_reason: string>>>")
    u, first = j["data"]["usage"], F.try_element_at(j["data"]["choices"], F.lit(1))
    return F.struct(first["message"]["content"].alias("content"), first["finish_reason"].alias("finish_reason"), u["prompt_tokens"].alias("prompt_tokens"), F.coalesce(u["total_tokens"], u["prompt_tokens"] + u["completion_tokens"]).alias("total_tokens"), j["error"].alias("error"))


def vector_answer(body: Column) -> Column:
    """The numbers of a JSON answer in any of four shapes."""
    paths = ("$.data[0].embedding", "$.data.embedding", "$.embedding", "$.data")
    return F.coalesce(*(F.from_json(F.get_json_object(body, p), "array<float>") for p in paths))


def is_binary(files: DataFrame) -> DataFrame:
    """(path, binary) of (path, content bytes): by suffix, a zero byte in the first 1000, or bytes that are no UTF-8."""
    suffix = F.lower(F.substring_index("path", ".", -1))
    head = F.substring("content", 1, 1000)
    zero = F.hex(head).rlike("^(?:..)*?00(?:..)*$")
    return files.select("path", (suffix.isin(*BINARY_SUFFIXES) | zero | ~F.is_valid_utf8(F.col("content").cast("string"))).alias("binary"))


def with_message(tickets: DataFrame, ticket: str, message: Column) -> DataFrame:
    """Tickets with a message appended to one conversation."""
    return tickets.withColumn("conversation", F.when(F.col("ticketId") == ticket, F.array_append(F.coalesce("conversation", F.array()), message)).otherwise(F.col("conversation")))


def with_feedback(audit: DataFrame, feedback: DataFrame) -> DataFrame:
    """Audit rows with new ratings by request id; the latest counts."""
    last = feedback.groupBy("request_id").agg(F.max_by("rating", "ts").alias("new"))
    return audit.join(last, "request_id", "left").withColumn("rating", F.coalesce("new", "rating")).drop("new")


def criteria_passages(content: str | None, terms: list[str], around: int = 200) -> list[str]:
    """Stretches of ``around`` characters about each term, widened to white space; stretches that touch are one."""
    text = content or ""
    low, spans = text.lower(), []
    for term in (t.lower() for t in terms if t):
        at = low.find(term)
        while at >= 0:
            b, e = max(0, at - around), min(len(text), at + len(term) + around)
            while b > 0 and not text[b - 1].isspace():
                b -= 1
            while e < len(text) and not text[e].isspace():
                e += 1
            spans.append((b, e))
            at = low.find(term, at + len(term))
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [text[b:e] for b, e in out]


def filtered_pages(pages: DataFrame, terms: list[str], key: str = "page_id", text: str = "text") -> DataFrame:
    """(key, passages) of texts that hold a term."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "passages": [criteria_passages(t, terms) for t in part[text]]})

    rows = pages.select(key, text)
    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, passages array<string>").where("size(passages) > 0")
