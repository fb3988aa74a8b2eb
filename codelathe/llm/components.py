"""Connected components of a table of links by large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelathe.llm.common import cut

#: Keys with more than this share of all rows are joined by broadcast; so at most 1 / HOT keys are, whatever the size.
HOT = 1 / 500


def joined(rows: DataFrame, stats: DataFrame, key: str | list[str], count: str, total: int) -> DataFrame:
    """``rows`` joined with the one row of each key in ``stats``; ``count`` holds the key's rows, ``total`` their sum.

    The rows of a frequent key are never brought together: such keys are few, by
    their share of ``total``, and are broadcast, and a salt of their own row
    spreads those rows over the tasks where the other keys meet.
    """
    keys = [key] if isinstance(key, str) else key
    values = [c for c in stats.columns if c not in keys]
    often = F.col(count) > max(1, int(total * HOT))
    hot = F.broadcast(stats.where(often).select(*keys, F.struct(*values).alias("_hot")))
    rest = stats.where(~often).select(*keys, F.struct(*values).alias("_rest"), F.lit(0).alias("_salt"))
    spread = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int"))
    met = rows.join(hot, keys, "left").withColumn("_salt", spread).join(rest, [*keys, "_salt"], "left")
    found = met.withColumn("_found", F.coalesce("_hot", "_rest")).where("_found is not null")
    return found.select(*rows.columns, *(F.col(f"_found.{c}").alias(c) for c in values))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(v, component): every linked vertex with the smallest vertex that it reaches.

    ``links`` has the columns a and b; null ends and loops are left out. Each
    round points the neighbours of a vertex to the smallest of them, first the
    larger neighbours, then the smaller ones, until nothing changes. Minima are
    aggregated before the shuffle, and the links of a hub take its minimum by
    :func:`joined`, so they are never brought to one task.
    """
    edges = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if not mark.n or (mark.n, mark.x) == before:
            break
        before = (mark.n, mark.x)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")).select("u", F.least("u", "m").alias("m"), "k"))
        large = cut(joined(both, least, "u", "k", 2 * mark.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Each vertex keeps its smallest neighbour, and gives it to the others; the larger end of a link has few.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.where("u <> v").distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("v")).agg(F.min(edges["v"]).alias("component")).union(edges.select(F.col("v"), F.col("v").alias("component")).distinct())
