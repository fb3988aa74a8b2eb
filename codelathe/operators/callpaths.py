"""Method names, callers, class hierarchies and what exceptions go through."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
LIBRARY_PREFIXES = ("java.", "javax.", "sun.", "com.sun.", "jdk.")
LOG_LEVELS = ("error", "warn", "info", "debug", "trace")
#: Topic of advice by what an exception's name contains, first match first.
ADVICE = (("RuntimeException", "RuntimeException Handling"), ("IO", "IO Exception Handling"), ("SQL", "SQL Exception Handling"), ("Timeout", "Timeout Exception Handling"))
GENERAL_ADVICE = ("Exception Documentation", "Exception Specificity")


def is_library(name: Column) -> Column:
    return F.coalesce(*(F.when(F.startswith(name, F.lit(p)), F.lit(True)) for p in LIBRARY_PREFIXES), F.lit(False))


def method_parts(path: Column) -> Column:
    """Class, method and arguments of ``pkg.Class.method(args)``; without brackets the arguments are null."""
    head = F.substring_index(path, "(", 1)
    args = F.when(F.contains(path, F.lit("(")), F.regexp_extract(path, r"\(([^)]*)\)?", 1))
    owner = F.when(F.contains(head, F.lit(".")), F.regexp_extract(head, r"^(.*)\.[^.]*$", 1))
    return F.struct(owner.alias("owner"), F.substring_index(head, ".", -1).alias("method"), args.alias("arguments"))


def callers(calls: DataFrame, method: str) -> DataFrame:
    """Distinct callers of a method, with any arguments where ``method`` names none."""
    return calls.where((F.col("callee") == method) | F.startswith("callee", F.lit(method + "("))).select("caller").distinct()


def ancestors(parents: DataFrame, most: int = 1000) -> DataFrame:
    """(child, ancestor, depth): all ancestors of each class with their least distance; ``parents`` has child and parent.

    Walks until no pair is new; each level is materialised, so the plan stays
    small, and a cycle ends as its pairs repeat.
    """
    from codelathe.operators.javagraph import _cut

    found = _cut(parents.select("child", F.col("parent").alias("ancestor")).distinct().withColumn("depth", F.lit(1)))
    front = found
    for level in range(2, most):
        step = front.join(parents.select(F.col("child").alias("ancestor"), F.col("parent").alias("next")), "ancestor").select("child", F.col("next").alias("ancestor")).distinct()
        front = _cut(step.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        found = _cut(found.unionByName(front))
    return found


def inherited(methods: DataFrame, parents: DataFrame) -> DataFrame:
    """(class, method, owner): a method that a class has or takes from its nearest ancestor that has it, ties by name."""
    own = methods.select(F.col("class").alias("class"), "method", F.col("class").alias("owner"), F.lit(0).alias("depth"))
    above = ancestors(parents).join(methods.select(F.col("class").alias("ancestor"), "method"), "ancestor").select(F.col("child").alias("class"), "method", F.col("ancestor").alias("owner"), "depth")
    return own.unionByName(above).groupBy("class", "method").agg(F.min_by("owner", F.struct("depth", "owner")).alias("owner"))


def is_checked(name: Column) -> Column:
    return ~(name.contains("RuntimeException") | name.endswith("Error"))


def wrapping(files: DataFrame, exception: str) -> DataFrame:
    """(other, role, n): exceptions that wrap the given one (``wrapper``) or are wrapped by it (``wrapped``), line by line."""
    name = re.escape(exception.rsplit(".", 1)[-1])
    line = files.where(F.col("content").contains(exception.rsplit(".", 1)[-1])).select(F.explode(F.split("content", "\n")).alias("line"))
    found = [line.select(F.regexp_extract("line", x, 1).alias("other"), F.lit(role).alias("role")) for role, x in (("wrapper", rf"new\s+([\w.]+Exception)\(.*{name}.*\)"), ("wrapped", rf"new\s+{name}\(.*?([\w.]+Exception).*\)"))]
    return found[0].unionByName(found[1]).where("other <> ''").groupBy("other", "role").agg(F.count("*").alias("n"))


def logging_levels(files: DataFrame, exception: str) -> DataFrame:
    """(level, n): how often the exception is named in calls of each log level."""
    name = re.escape(exception.rsplit(".", 1)[-1])
    line = files.select(F.explode(F.split("content", "\n")).alias("line"))
    level = F.regexp_extract("line", rf"log(?:ger)?\.({'|'.join(LOG_LEVELS)})\(.*{name}.*\)", 1)
    return line.select(level.alias("level")).where("level <> ''").groupBy("level").agg(F.count("*").alias("n"))


def common_messages(files: DataFrame, exception: str, least: int = 2) -> DataFrame:
    """(message, n): literal messages of new exceptions that occur at least ``least`` times."""
    name = re.escape(exception.rsplit(".", 1)[-1])
    messages = F.regexp_extract_all("content", F.lit(rf'new\s+{name}\(\s*"([^"]+)"'), F.lit(1))
    return files.select(F.explode(messages).alias("message")).groupBy("message").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def effectiveness(component: Column) -> Column:
    """How well a component is placed to handle an exception."""
    return F.when(component.contains("Controller") | component.contains("Advice"), "High").when(component.contains("Repository") | component.contains("Dao"), "Low").otherwise("Medium")


def advice(exception: Column) -> Column:
    """Topics of advice on an exception: one by its name, then the general ones."""
    own = F.coalesce(*(F.when(exception.endswith(x) if n == 0 else exception.contains(x), F.lit(topic)) for n, (x, topic) in enumerate(ADVICE)))
    return F.array_compact(F.array(own, *map(F.lit, GENERAL_ADVICE)))


def search_totals(references: DataFrame) -> DataFrame:
    """One row: matches and repositories of a cross-repository search."""
    return references.agg(F.count("*").alias("n_matches"), F.count_distinct("repository").alias("n_repositories"))


def in_repositories(files: DataFrame, names: list[str]) -> DataFrame:
    """Files of the named repositories; unknown names are ignored, no names mean all."""
    return files.where(F.col("repository").isin(names)) if names else files
