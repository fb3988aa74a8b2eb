"""Types, methods, calls and imports of Java files as frames, and joins that resolve them into workflow steps."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TYPE = re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(class|interface|enum|record)\s+(\w+)(?:<[^{]*?>)?(?:\([^)]*\))?(?:\s+extends\s+([\w.,\s<>]+?))?(?:\s+implements\s+([\w.,\s<>]+?))?\s*\{")
_METHOD = re.compile(r"^\s*(?:@\w+(?:\([^)]*\))?\s+)*((?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*)([\w<>\[\].,?]+)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+([\w.,\s]+?))?\s*([{;])")
_CALL = re.compile(r"(?:(\b\w+)\s*\.\s*)?\b(\w+)\s*\(([^()]*)\)")
_FIELD = re.compile(r"^\s*((?:@\w+(?:\([^)]*\))?\s+)*)(?:(?:private|protected|public|final|static)\s+)+([A-Z]\w*)(?:<[^=;]*>)?\s+(\w+)\s*[=;]")
_CATCH = re.compile(r"catch\s*\(\s*(?:final\s+)?([\w.|\s]+?)\s+\w+\s*\)")
_WORDS = frozenset("if for while switch catch return new else try synchronized throw super this assert".split())

#: Levels of dependents after which those found so far are put together.
MERGED_LEVELS = 8
SCHEMA = "kind string, path string, package string, owner string, name string, target string, line int, modifiers string, args int, result string"


def _bare(names: str | None) -> list[str]:
    return [x.strip() for x in re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", names or "")).split(",") if x.strip()]


def parse(path: str, content: str | None) -> list[tuple]:
    """Facts of one file, in order of lines; see :data:`SCHEMA`.

    Kinds: import, class, interface, enum, record, extends, implements, method,
    throws, field, call and catch. A method belongs to the innermost open type.
    """
    out: list[tuple] = []
    text = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), content or "", flags=re.S)
    package = (re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M) or ["", ""])[1]
    full = lambda n: n if "." in n or not package else f"{package}.{n}"
    types: list[tuple[str, int]] = []
    method: tuple[str, int] | None = None
    depth = 0
    for n, row in enumerate(text.split("\n"), 1):
        code = re.sub(r'"(?:\\.|[^"\\])*"', '""', row)
        code = re.sub(r"//.*", "", code)
        add = lambda kind, owner, name, target=None, mods="", args=None, result=None: out.append((kind, path, package, owner, name, target, n, mods, args, result))  # noqa: E731, B023
        if m := re.match(r"\s*import\s+(?:static\s+)?([\w.*]+)\s*;", code):
            add("import", None, m[1])
        if m := _TYPE.match(code):
            own = full(m[2])
            add(m[1], own, m[2])
            for kind, names in (("extends", m[3]), ("implements", m[4])):
                for x in _bare(names):
                    add(kind, own, x, full(x))
            types.append((own, depth))
        elif types and method is None and (m := _METHOD.match(code)) and m[2] not in _WORDS and m[3] not in _WORDS:
            add("method", types[-1][0], m[3], None, m[1].strip(), len([a for a in m[4].split(",") if a.strip()]), m[2])
            for x in _bare(m[5]):
                add("throws", types[-1][0], m[3], x)
            if m[6] == "{":
                method = (m[3], depth)
        elif types and method is None and (m := _FIELD.match(code)):
            add("field", types[-1][0], m[3], m[2], m[1].strip())
        if types and method and not _METHOD.match(code):
            for c in _CATCH.finditer(code):
                for x in c[1].split("|"):
                    add("catch", types[-1][0], method[0], x.strip())
            for c in _CALL.finditer(code):
                if c[2] not in _WORDS and not re.search(r"\bnew\s+$", code[: c.start()]):
                    add("call", types[-1][0], method[0], c[2], c[1] or "this", len([a for a in c[3].split(",") if a.strip()]))
        for ch in code:
            if ch == "{":
                depth += 1
            elif ch == "}":
                depth -= 1
                if method and depth == method[1]:
                    method = None
                if types and depth == types[-1][1]:
                    types.pop()
    return out


def facts(files: DataFrame) -> DataFrame:
    """Facts of all Java files of (path, content); one Python pass, no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [r for p, c in zip(part["path"], part["content"]) for r in parse(p, c)]
            frame = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            yield frame.astype({"line": "int32", "args": "Int32"})

    return files.where(F.lower("path").endswith(".java")).select("path", "content").mapInPandas(run, SCHEMA)


TYPES = ("class", "interface", "enum", "record")


def nodes(found: DataFrame) -> DataFrame:
    """(id, type, name, full_name, path, line) of types and methods."""
    types = found.where(F.col("kind").isin(*TYPES)).select(F.concat(F.lit("java:"), "owner").alias("id"), F.col("kind").alias("type"), "name", F.col("owner").alias("full_name"), "path", "line")
    methods = found.where("kind = 'method'").select(F.concat(F.lit("java:"), "owner", F.lit("."), "name").alias("id"), F.col("kind").alias("type"), "name", F.concat("owner", F.lit("."), "name").alias("full_name"), "path", "line")
    return types.unionAll(methods)


def edges(found: DataFrame) -> DataFrame:
    """(source, target, type): EXTENDS, IMPLEMENTS and CONTAINS."""
    parents = found.where("kind in ('extends', 'implements')").select(F.concat(F.lit("java:"), "owner").alias("source"), F.concat(F.lit("java:"), "target").alias("target"), F.upper("kind").alias("type"))
    inside = found.where("kind = 'method'").select(F.concat(F.lit("java:"), "owner").alias("source"), F.concat(F.lit("java:"), "owner", F.lit("."), "name").alias("target"), F.lit("CONTAINS").alias("type"))
    return parents.unionAll(inside)


def steps(found: DataFrame) -> DataFrame:
    """(path, owner, method, receiver, target_class, target_method, args, line): calls with the receiver's declared type."""
    calls = found.where("kind = 'call'").select("path", "package", "owner", F.col("name").alias("method"), F.col("modifiers").alias("receiver"), F.col("target").alias("target_method"), "args", "line")
    fields = found.where("kind = 'field'").groupBy("owner", F.col("name").alias("receiver")).agg(F.min("target").alias("field_type"))
    typed = calls.join(fields, ["owner", "receiver"], "left")
    target = F.when(F.col("receiver").isin("this", "super"), F.col("owner")).otherwise(F.coalesce("field_type", F.when(F.col("receiver").rlike("^[A-Z]"), F.col("receiver"))))
    return typed.select("path", "package", "owner", "method", "receiver", target.alias("target_class"), "target_method", "args", "line")


def resolved(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with the file and full class of their target, and a confidence.

    A class name is looked up as a full name, an import, in packages imported
    with ``*`` by name, in the same package, in java.lang, then by its simple name
    anywhere; a call on an interface goes to the
    implementations that have the method. Confidence: 1.0 for equal argument
    counts, 0.5 for the name alone, 0.8 over an interface, 0.6 by simple name.
    """
    classes = found.where(F.col("kind").isin(*TYPES)).groupBy(F.col("owner").alias("full")).agg(F.min("path").alias("target_path"), F.min("name").alias("simple"))
    imports = found.where("kind = 'import'").select("path", F.col("name").alias("imported")).withColumn("simple", F.substring_index("imported", ".", -1)).groupBy("path", F.col("simple").alias("target_class")).agg(F.min("imported").alias("imported"))
    by_simple = classes.groupBy(F.col("simple").alias("target_class")).agg(F.min("full").alias("by_simple"))
    # Equal calls share the hash of their columns and the answer.
    known = classes.select(F.col("full").alias("k"))
    rows = calls.withColumn("n", F.xxhash64(*calls.columns)).join(imports, ["path", "target_class"], "left").join(by_simple, "target_class", "left")
    wild = found.where("kind = 'import' and endswith(name, '.*')").groupBy("path").agg(F.array_sort(F.collect_set(F.regexp_replace("name", "[*]$", ""))).alias("wild"))
    rows = rows.join(wild, "path", "left")
    same = F.when(F.col("package") != "", F.concat("package", F.lit("."), "target_class")).otherwise(F.col("target_class"))
    at = lambda r, k: F.struct(F.lit(r).alias("r"), k.alias("k"))
    starred = F.transform(F.coalesce("wild", F.array().cast("array<string>")), lambda w: at(2, F.concat(w, F.col("target_class"))))
    tries = F.concat(F.array(at(0, F.col("target_class")), at(1, F.col("imported")), at(3, same), at(4, F.concat(F.lit("java.lang."), "target_class")), at(5, F.col("by_simple"))), starred)
    hit = rows.select("n", F.explode(tries).alias("t")).select("n", "t.r", "t.k").where("k is not null").join(known, "k").groupBy("n").agg(F.min(F.struct("r", "k")).alias("b"))
    placed = rows.join(hit, "n", "left").select(*calls.columns, "n", F.col("b.k").alias("target_full"), F.col("b.r").alias("how"))
    methods = found.where("kind = 'method'").groupBy(F.col("owner").alias("target_full"), F.col("name").alias("target_method")).agg(F.collect_set("args").alias("arities"))
    direct = placed.join(methods, ["target_full", "target_method"], "left")
    parts = found.where("kind in ('implements', 'extends')").select(F.col("target").alias("target_full"), F.col("owner").alias("implementation")).distinct()
    over = placed.join(found.where("kind = 'interface'").select(F.col("owner").alias("target_full")).distinct(), "target_full", "left_semi").join(parts, "target_full").join(methods.select(F.col("target_full").alias("implementation"), "target_method"), ["implementation", "target_method"])
    first = over.groupBy("n").agg(F.min("implementation").alias("implementation"))
    out = direct.join(first, "n", "left")
    confidence = F.when(F.col("implementation").isNotNull(), 0.8).when(F.col("arities").isNull(), None).when(F.col("how") == 5, 0.6).when(F.array_contains("arities", F.col("args")), 1.0).otherwise(0.5)
    final = F.coalesce("implementation", F.when(F.col("arities").isNotNull(), F.col("target_full")))
    named = out.select(*calls.columns, final.alias("target_full"), confidence.alias("confidence"))
    return named.join(classes.select(F.col("full").alias("target_full"), "target_path"), "target_full", "left").select(*calls.columns, "target_full", "target_path", "confidence")


def entry_points(found: DataFrame, files: DataFrame) -> DataFrame:
    """(path, owner, name): public methods of files with a main method or web mappings."""
    marked = files.where(F.col("content").rlike(r"\bmain\s*\(|@(?:Rest)?Controller\b|@(?:Get|Post|Put|Delete|Patch|Request)Mapping\b")).select("path")
    return found.where("kind = 'method' and modifiers like '%public%'").join(marked, "path", "left_semi").select("path", "owner", "name")


def implementations(found: DataFrame) -> DataFrame:
    return found.where("kind = 'implements'").groupBy(F.col("target").alias("interface")).agg(F.array_sort(F.collect_set("owner")).alias("implementations"))


def thrown(found: DataFrame, exception: str) -> DataFrame:
    """Methods that declare the exception, by full or simple name."""
    simple = exception.rsplit(".", 1)[-1]
    return found.where((F.col("kind") == "throws") & F.col("target").isin(exception, simple)).select("owner", "name").distinct()


def propagation(found: DataFrame, calls: DataFrame, exception: str, depth: int = 10) -> DataFrame:
    """(owner, name, role, depth): THROWS, then callers up to a catch: PROPAGATES or CATCHES. One join a level, each method once."""
    simple = exception.rsplit(".", 1)[-1]
    catching = found.where((F.col("kind") == "catch") & (F.substring_index("target", ".", -1) == simple)).select("owner", "name").distinct()
    back = calls.where("target_full is not null").select(F.col("target_full").alias("owner"), F.col("target_method").alias("name"), F.col("owner").alias("up_owner"), F.col("method").alias("up_name")).distinct()
    back, catching = _cut(back), _cut(catching)
    seen = front = _cut(thrown(found, exception).withColumn("role", F.lit("THROWS")).withColumn("depth", F.lit(0)))
    for level in range(1, depth + 1):
        up = back.join(front.where("role <> 'CATCHES'").select("owner", "name"), ["owner", "name"]).select(F.col("up_owner").alias("owner"), F.col("up_name").alias("name")).distinct().join(seen.select("owner", "name"), ["owner", "name"], "left_anti")
        caught = up.join(catching.withColumn("c", F.lit(True)), ["owner", "name"], "left")
        front = _cut(caught.select("owner", "name", F.when(F.col("c"), "CATCHES").otherwise("PROPAGATES").alias("role"), F.lit(level).alias("depth")))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def _cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; where none is set, in a temporary one in local mode, and an error on a cluster."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.getConf().get("spark.checkpoint.dir") and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="codelathe-"))
    return df.checkpoint(eager=True)


def dependents(references: DataFrame, direct: DataFrame) -> DataFrame:
    """(name): classes that reach ``direct`` (name) over references (source, target), at any distance, without those themselves.

    One join a level, until a level has no new class; each level is materialised.
    """
    edges = _cut(references.select("source", "target").distinct())
    seen = front = _cut(direct.select("name").distinct())
    level = 0
    while not front.isEmpty():
        level += 1
        front = _cut(edges.join(front.select(F.col("name").alias("target")), "target").select(F.col("source").alias("name")).distinct().join(seen, "name", "left_anti"))
        seen = seen.unionAll(front)
        if level % MERGED_LEVELS == 0:
            seen = _cut(seen.distinct())
    return seen.distinct().join(direct.select("name"), "name", "left_anti")


def totals(calls: DataFrame) -> DataFrame:
    """Files, steps, steps into other repositories and resolved steps."""
    other = F.substring_index("path", "/", 1) != F.substring_index("target_path", "/", 1)
    return calls.agg(F.count_distinct("path").alias("files"), F.count("*").alias("steps"), F.count_if(other).alias("cross_repository"), F.count_if(F.col("target_full").isNotNull()).alias("resolved"))


def node_link(some: DataFrame) -> DataFrame:
    """(index, id): dense numbers of edge ends in order of id, for node-link JSON of a bounded graph."""
    ends = some.select(F.col("source").alias("id")).union(some.select("target")).distinct()
    return ends.select((F.row_number().over(Window.orderBy("id")) - 1).alias("index"), "id")
