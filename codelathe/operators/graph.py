"""Typed graphs as node and edge frames: neighbours, traversal, closure, paths, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """Outgoing edges and reversed incoming ones."""
    out = edges.where(F.col("source") == node).select("source", "target", "type", F.lit("out").alias("direction"))
    back = edges.where(F.col("target") == node).select(F.col("target").alias("source"), F.col("source").alias("target"), "type", F.lit("in").alias("direction"))
    return out.unionAll(back)


def reach(edges: DataFrame, starts: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """(node, depth): each node with its least number of steps from ``starts``, which has the column node.

    One join a level; a level's new nodes alone go on, each level is
    materialised, and the walk ends with the first level without a new node.
    ``most`` keeps the first nodes by depth and name.
    """
    from codelathe.operators.javagraph import _cut

    seen = front = _cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        front = _cut(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen if most is None else seen.orderBy("depth", "node").limit(most)


def related(edges: DataFrame, node: str, depth: int) -> DataFrame:
    """Edges of the node, then of what they lead to, outwards only; repeats are kept."""
    first = neighbours(edges, node).select("source", "target", "type", F.lit(1).alias("depth"))
    out, front = first, first
    for level in range(2, depth + 1):
        front = edges.join(front.select(F.col("target").alias("source")), "source").select("source", "target", "type", F.lit(level).alias("depth"))
        out = out.unionAll(front)
    return out


def search_nodes(nodes: DataFrame, text: str, k: int) -> DataFrame:
    """Nodes by name: equal ones first, then type ``class``, then by name."""
    low = text.lower()
    hit = F.lower("name").contains(low) | F.lower("full_name").contains(low)
    order = [F.when(F.lower("name") == low, 0).otherwise(1), F.when(F.col("type") == "class", 0).otherwise(1), F.col("name"), F.col("id")]
    return nodes.where(hit).orderBy(*order).limit(k)


def paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(path): paths without repeats from ``starts`` to nodes that lead no further, or of ``depth`` steps."""
    grown = starts.select(F.array("node").alias("path"), F.col("node").alias("last"))
    done = None
    for _ in range(depth):
        ahead = grown.join(edges.select(F.col("source").alias("last"), F.col("target").alias("next")).distinct(), "last", "left")
        ends = ahead.where("next is null").select("path")
        done = ends if done is None else done.unionAll(ends)
        on = ahead.where("next is not null and not array_contains(path, next)")
        grown = on.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("last"))
    return grown.select("path") if done is None else done.unionAll(grown.select("path"))


def chains(steps: DataFrame, group: list[str], order: list[str], item: str, shortest: int = 2, longest: int = 4, least: int = 2) -> DataFrame:
    """(chain, length, n): item sequences that follow each other within groups at least ``least`` times.

    Windows of ``lead`` keep the rows of a group spread over sorted runs; no group is collected.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    ahead = [F.col(item), *(F.lead(item, n).over(w) for n in range(1, longest))]
    wide = steps.select(F.array(*ahead).alias("a"))
    sizes = F.explode(F.sequence(F.lit(shortest), F.lit(longest))).alias("length")
    grams = wide.select("a", sizes).select(F.slice("a", F.lit(1), F.col("length")).alias("g"), "length").where("not exists(g, x -> x is null)")
    return grams.groupBy(F.array_join("g", ">").alias("chain"), "length").agg(F.count("*").alias("n")).where(F.col("n") >= least)
