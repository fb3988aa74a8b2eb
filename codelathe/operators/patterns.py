"""Steps that code patterns imply, and evidence gathered for prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelathe.operators import javagraph

# Fixed values.
PRIMITIVES = ("void", "boolean", "byte", "short", "char", "int", "long", "float", "double")
INJECTING = r"@(?:Autowired|Inject|Resource)\b"
COMPONENT_ENDS = ("Service", "Repository", "Controller", "Component")
IMPLIED = {"injection": 0.9, "factory": 0.8, "builder": 0.7}
FRAMEWORK_CONFIDENCE = 0.7
WHOLE, AROUND, HEAD = 20_000, 5_000, 15_000


def _simple(owner: str) -> Column:
    return F.substring_index(owner, ".", -1)


def factories(found: DataFrame) -> DataFrame:
    """(owner, simple, method, product): making methods of classes named as factories, with the class they give."""
    methods = found.where((F.col("kind") == "method") & _simple("owner").contains("Factory") & F.col("name").rlike("^(?:create|new|get)"))
    product = F.regexp_replace("result", r"<.*$|\[\]", "")
    return methods.where(~F.col("result").isin(*PRIMITIVES)).select("owner", _simple("owner").alias("simple"), F.col("name").alias("method"), product.alias("product")).distinct()


def builders(found: DataFrame) -> DataFrame:
    """(owner, simple): classes with methods that give themselves back and a method ``build``."""
    fluent = F.regexp_replace("result", r"<.*$", "") == _simple("owner")
    per = found.where("kind = 'method'").groupBy("owner").agg(F.bool_or(fluent).alias("fluent"), F.bool_or(F.col("name") == "build").alias("builds"))
    return per.where("fluent and builds").select("owner", _simple("owner").alias("simple"))


def injections(found: DataFrame) -> DataFrame:
    """(owner, field, target): annotated fields and the class they ask for."""
    return found.where((F.col("kind") == "field") & F.col("modifiers").rlike(INJECTING)).select("owner", F.col("name").alias("field"), "target").distinct()


def implied_steps(found: DataFrame) -> DataFrame:
    """(source, target, pattern, confidence): clients of factories to the products, users of builders, owners of injected fields.

    Clients are found through the receivers of their calls: an equal join on the
    class name, where a search of all texts for both names would pair every file
    with every factory.
    """
    calls = javagraph.steps(found).select("owner", F.substring_index("target_class", ".", -1).alias("simple"), F.col("target_method").alias("method")).distinct()
    made = calls.join(factories(found).withColumnRenamed("owner", "maker"), ["simple", "method"]).select(F.col("owner").alias("source"), F.col("product").alias("target"), F.lit("factory").alias("pattern"))
    built = calls.select("owner", "simple").distinct().join(builders(found).withColumnRenamed("owner", "maker"), "simple").where("owner <> maker").select(F.col("owner").alias("source"), F.col("maker").alias("target"), F.lit("builder").alias("pattern"))
    given = injections(found).select(F.col("owner").alias("source"), "target", F.lit("injection").alias("pattern"))
    weight = F.create_map(*(F.lit(x) for pair in IMPLIED.items() for x in pair))
    return made.unionAll(built).unionAll(given).distinct().withColumn("confidence", weight[F.col("pattern")])


def framework_calls(found: DataFrame, calls: DataFrame) -> DataFrame:
    """(owner, method, target_class, target_full, confidence): unresolved calls on components, matched to the least class whose name ends with theirs."""
    named = F.regexp_extract("target_class", r"(\w+)$", 1)
    ends = F.lit(False)
    for x in COMPONENT_ENDS:
        ends = ends | named.endswith(x)
    open_calls = calls.where("target_full is null").where(ends).select("owner", "method", "target_class", named.alias("wanted")).distinct()
    types = found.where("kind in ('class', 'interface')").select(F.col("owner").alias("full"), "name").distinct()
    # Every ending of a class name that begins with a capital is a key, so the join stays on equal keys.
    keys = F.regexp_extract_all("name", F.lit(r"(?=([A-Z]\w*))"), F.lit(1))
    wanted = types.select("full", F.explode(F.array_distinct(keys)).alias("wanted")).groupBy("wanted").agg(F.min("full").alias("target_full"))
    return open_calls.join(wanted, "wanted").select("owner", "method", "target_class", "target_full", F.lit(FRAMEWORK_CONFIDENCE).alias("confidence"))


def chain_confidence(steps: DataFrame, by: list[str], confidence: str = "confidence") -> DataFrame:
    """Mean confidence of the steps of each entry point."""
    return steps.groupBy(*by).agg(F.avg(confidence).alias("mean"), F.count("*").alias("n_steps"))


def steps_of_file(steps: DataFrame, path: str) -> DataFrame:
    """(source, target): steps from the file, and those to it, each once."""
    return steps.where((F.col("source") == path) | (F.col("target") == path)).select("source", "target").distinct()


def band(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.5, "medium").otherwise("low")


def evidence_bands(steps: DataFrame, by: str = "source", confidence: str = "confidence") -> DataFrame:
    """Steps of each file by confidence band, as counts: what a prompt says of a file stays small however many steps it has."""
    b = band(F.col(confidence))
    return steps.groupBy(by).agg(*(F.count_if(b == x).alias(f"n_{x}") for x in ("high", "medium", "low")), F.max(confidence).alias("best"))


def excerpt(text: Column, begin: Column | None = None, end: Column | None = None) -> Column:
    """What a prompt takes of a file: all of a short one, else the surroundings of characters ``begin`` to ``end`` (from 0), else its head."""
    head = F.substring(text, 1, HEAD)
    if begin is not None and end is not None:
        first = F.greatest(F.lit(0), begin - AROUND)
        head = F.when(begin.isNotNull(), F.substr(text, (first + 1).cast("int"), (end + AROUND - first).cast("int"))).otherwise(head)
    return F.when(F.length(text) <= WHOLE, text).otherwise(head)


def threshold_counts(scores: DataFrame, threshold: float, low: float = 0.1, score: str = "similarity") -> DataFrame:
    """One row: results at the low and at the working threshold, and the best score; one pass over the scores."""
    return scores.agg(F.count_if(F.col(score) >= low).alias("n_low"), F.count_if(F.col(score) >= threshold).alias("n_threshold"), F.max(score).alias("best"))


def tree(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(path, depth, is_cycle): the call tree under ``root`` as one row for each place; a node on its own path is a reference and is not opened again."""
    level = edges.sparkSession.range(1).select(F.array(F.lit(root)).alias("path"), F.lit(False).alias("is_cycle"))
    out = level.select("path", F.lit(0).alias("depth"), "is_cycle")
    links = edges.select("source", "target").distinct()
    for n in range(1, depth + 1):
        open_ends = level.where("not is_cycle").select("path", F.element_at("path", -1).alias("source"))
        level = open_ends.join(links, "source").select(F.array_append("path", F.col("target")).alias("path"), F.array_contains("path", F.col("target")).alias("is_cycle"))
        out = out.unionAll(level.select("path", F.lit(n).alias("depth"), "is_cycle"))
    return out
