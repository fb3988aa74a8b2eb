"""A training-data pipeline: each stage takes and returns documents, the last one their encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelathe.llm import bpe, chosen_path, decontaminate, repeats, toxicity
from codelathe.llm.common import shared_path, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 0.8 similarity of five-word shingles."""
    return chosen_path.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings that repeat; ``n_chars`` follows the text."""
    df, out = repeats.cleaned(docs)
    new = {"text": F.when(F.col("text").isNotNull(), F.col(f"{out}.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(f"{out}.n_removed") > 0, F.length(f"{out}.text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.withColumns(new).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's columns with its token ids (``ids``), their number and the text they decode to."""
    df, out = bpe.encode(docs)
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), F.col(f"{out}.ids").alias("ids"), F.size(f"{out}.ids").cast("long").alias("n_tokens"), F.col(f"{out}.decoded").alias("decoded"))


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", keep_one_of_near_copies),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The stages learn a model and follow links, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read from there."""
    docs = table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
