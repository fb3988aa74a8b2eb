"""Repositories, property files and what single source files say."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelathe.operators.callpaths import effectiveness
from codelathe.operators.code import CRITICAL_NAMES, CRITICAL_PACKAGES, _any, class_name

# Fixed values.
REPOSITORY_SUFFIXES = (".java", ".kt", ".xml", ".gradle", ".properties")
README_NAMES = ("README.md", "README.txt", "README")
STORED_CONFIG = r"(?:extends|implements)\s+.*Repository"
CONFIG_REPOSITORY = "(?:SettingsRepository|ConfigurationRepository|OptionsRepository)"
LOG_CALL = r"\b(?:log|logger)\.(debug|info|warn|error|trace)\s*\(([^;]+)\);"
CAMEL_LOG_CALL = r"\.log\s*\(\s*LoggingLevel\.(INFO|DEBUG|WARN|ERROR)\s*,([^;]+)\);"
LOGIC_WORDS = ("business", "logic", "algorithm", "calculate", "process", "validate", "transform", "convert", "generate", "analyze", "extract", "complex")
JAVA_BOILERPLATE = (
    r"public\s+\w+\s+get\w+\s*\(\s*\)\s*\{\s*return\s+\w+;\s*\}",
    r"public\s+void\s+set\w+\s*\(\s*\w+\s+\w+\s*\)\s*\{\s*this\.\w+\s*=\s*\w+;\s*\}",
    r"@Override\s+public\s+boolean\s+equals\s*\(\s*Object\s+\w+\s*\)\s*\{[^\}]{10,300}\}",
    r"@Override\s+public\s+int\s+hashCode\s*\(\s*\)\s*\{[^\}]{5,200}\}",
    r"@Override\s+public\s+String\s+toString\s*\(\s*\)\s*\{[^\}]{5,300}\}",
)
SCRIPT_EXPORT = r"(export\s+(default\s+)?|module\.exports\s+=\s+)"
MESSAGE_HINTS = ((("(String)", "(java.lang.String)"), "[Custom message]"), (("(String, Throwable)", "(java.lang.String, java.lang.Throwable)"), "[Custom message with cause]"), (("(Throwable)", "(java.lang.Throwable)"), "[Exception cause only]"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def repositories(files: DataFrame) -> DataFrame:
    """(repository, n_files, description) of folders that hold ``.git``, ``src`` or a source file.

    ``files`` has repository, path (relative) and content. The description is the
    first README line of more than ten characters that is no heading, READMEs in
    order of ``README_NAMES``, or else the description of ``pom.xml``, or null.
    """
    path, low = F.col("path"), F.lower("path")
    held = F.startswith(path, F.lit(".git/")) | F.startswith(path, F.lit("src/"))
    for s in REPOSITORY_SUFFIXES:
        held |= low.endswith(s)
    told = F.get(F.filter(F.transform(_lines(F.col("content")), _strip), lambda x: (F.length(x) > 10) & ~x.startswith("#")), F.lit(0))
    pom = r"(?s)<description>(.*?)</description>"
    said = F.when(path.isin(*README_NAMES), told).when((path == "pom.xml") & F.col("content").rlike(pom), _strip(F.regexp_extract("content", pom, 1)))
    rank = F.coalesce(*(F.when(path == n, F.lit(i)) for i, n in enumerate(README_NAMES)), F.lit(len(README_NAMES)))
    found = files.select("repository", held.alias("held"), said.alias("said"), F.when(said.isNotNull(), rank).alias("rank"))
    return found.groupBy("repository").agg(F.bool_or("held").alias("held"), F.count("*").alias("n_files"), F.min_by("said", "rank").alias("description")).where("held").drop("held")


def repository_of(path: Column, root: str = "/data/code/") -> Column:
    """First folder below ``root``; null where the path isn't below it."""
    return F.nullif(F.regexp_extract(path, re.escape(root) + "([^/]+)", 1), F.lit(""))


def property_sources(files: DataFrame, names: list[str]) -> DataFrame:
    """(requested, key, value, path, line): where property and YAML files set the named keys.

    A name may end with ``*``: then every key that begins so counts; of a full
    name the first line of each file. The value follows the first ``=`` of the
    line, or else its first colon; YAML keys count as they are written.
    """
    key = r"^\s*([^\s=:]+)\s*[=:]"
    rows = files.where(F.col("path").rlike(r"\.(?:properties|ya?ml)$")).select("path", F.posexplode(_lines(F.col("content"))).alias("n", "text")).where(F.col("text").rlike(key))
    k = F.regexp_extract("text", key, 1)
    value = _strip(F.when(F.contains("text", F.lit("=")), F.regexp_replace("text", "^[^=]*=", "")).otherwise(F.regexp_replace("text", "^[^:]*:", "")))
    asked = F.array_compact(F.array(*(F.when(F.startswith(k, F.lit(n[:-1])) & (F.length(k) > len(n) - 1) if n.endswith("*") else k == n, F.lit(n)) for n in names)))
    hits = rows.select(F.explode(asked).alias("requested"), k.alias("key"), value.alias("value"), "path", (F.col("n") + 1).alias("line"))
    first = hits.where(~F.col("requested").endswith("*")).groupBy("requested", "path").agg(F.min(F.struct("line", "key", "value")).alias("s")).select("requested", "s.key", "s.value", "path", "s.line")
    return hits.where(F.col("requested").endswith("*")).unionByName(first)


def default_value(files: DataFrame, name: str) -> DataFrame:
    """(value) of a property: its first property or YAML file by path, else its first ``@Value`` fallback; null if nothing sets it."""
    p, leaf = re.escape(name), re.escape(name.rsplit(".", 1)[-1])
    forms = ((r"\.properties$", rf"(?m)^[^\S\n]*{p}[^\S\n]*=[^\S\n]*(.*)$", 0), (r"\.ya?ml$", rf"(?m)\s+{leaf}:[^\S\n]+(.*)$", 0), (r"\.java$", rf'@Value\s*\(\s*"\$\{{{p}:([^}}]*)\}}"', 1))
    hit = F.coalesce(*(F.when(F.col("path").rlike(s) & F.col("content").rlike(x), F.struct(F.lit(r).alias("r"), "path", F.trim(F.regexp_extract("content", x, 1)).alias("value"))) for s, x, r in forms))
    return files.select(hit.alias("h")).agg(F.min("h").alias("h")).select("h.value")


def indirect_references(files: DataFrame, direct: DataFrame) -> DataFrame:
    """(class_name, target): other classes whose files name a class of ``direct`` (class_name) as a word, without those in it.

    Words meet simple names in an equi-join, so no file is compared with every class.
    """
    words = files.select(class_name(F.col("content")).alias("class_name"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\w+"), F.lit(0)))).alias("word"))
    targets = direct.select(F.col("class_name").alias("target"), F.substring_index("class_name", ".", -1).alias("word")).distinct()
    return words.where("class_name <> ''").join(targets, "word").select("class_name", "target").distinct().join(direct.select("class_name"), "class_name", "left_anti")


def stored_configuration(files: DataFrame, name: str) -> DataFrame:
    """(path, class_name) of repository interfaces that may hold the property's value in a database."""
    c, cls = F.col("content"), class_name(F.col("content"))
    asks = (c.contains("findBy") & _any(c, ("Name", "Key", name.rsplit(".", 1)[-1]))) | _any(c, ("getConfiguration", "getSettings", "getOptions"))
    held = files.where(F.col("path").endswith(".java") & _any(F.col("path"), ("Repository", "Config", "Setting")) & c.contains("interface") & c.rlike(STORED_CONFIG) & asks)
    return held.select("path", cls.alias("class_name")).where(F.col("class_name").rlike(CONFIG_REPOSITORY) | _any(F.col("class_name"), ("Config", "Setting", "Option")))


def content_component(content: Column) -> Column:
    """Kind of component by annotations, then by words beside ``class`` and ``implements`` anywhere in the text."""
    c, a = content, lambda w, *parts: content.contains(w) & _any(content, parts)
    return (
        F.when(_any(c, ("@Controller", "@RestController")), "Controller").when(c.contains("@Service"), "Service").when(c.contains("@Repository"), "Repository").when(c.contains("@Component"), "Component").when(c.contains("@Configuration"), "Configuration")
        .when(a("class", "Controller"), "Controller").when(a("class", "Service"), "Service").when(a("class", "Repository", "DAO"), "Repository").when(a("class", "Config"), "Configuration")
        .when(a("implements", "Repository"), "Repository").when(a("implements", "Service"), "Service").otherwise("Other")
    )


def content_critical(content: Column) -> Column:
    """Whether the package is critical or the text names security anywhere."""
    return _any(F.regexp_extract(content, r"package\s([^;]*);", 1), CRITICAL_PACKAGES) | _any(content, CRITICAL_NAMES)


def throwing_notes(methods: DataFrame, most: int = 5) -> DataFrame:
    """(exception, n_methods, examples): distinct methods that declare each exception, the first ``most`` of them by name."""
    one = methods.select("exception", "method").distinct()
    first = one.withColumn("r", F.row_number().over(Window.partitionBy("exception").orderBy("method"))).where(F.col("r") <= most)
    examples = first.groupBy("exception").agg(F.sort_array(F.collect_list("method")).alias("examples"))
    return one.groupBy("exception").agg(F.count("*").alias("n_methods")).join(examples, "exception")


def handling_strategies(nodes: DataFrame) -> DataFrame:
    """(exception, component, effectiveness): components of propagation chains that catch."""
    return nodes.where("action = 'CATCHES'").select("exception", "component", effectiveness(F.col("component")).alias("effectiveness")).distinct()


def chain_summary(exception: Column, nodes: Column) -> Column:
    """One line for a chain of nodes with component and action."""
    return F.concat(exception, F.lit(": "), F.array_join(F.transform(nodes, lambda n: F.concat_ws(" ", n["component"], n["action"])), " → "))


def message_hint(signature: Column) -> Column:
    """What a constructor's arguments say about an exception's message; null for others."""
    return F.coalesce(*(F.when(_any(signature, parts), F.lit(hint)) for parts, hint in MESSAGE_HINTS))


def file_summary(content: Column) -> Column:
    """Package and the counts of lines that declare public classes, other classes and interfaces."""
    lines = F.transform(_lines(content), _strip)
    n = lambda test: F.size(F.filter(lines, test))
    package = F.get(F.filter(lines, lambda x: x.startswith("package ") & x.endswith(";")), F.lit(0))
    return F.struct(
        F.trim(F.regexp_extract(package, "^package (.*);$", 1)).alias("package"),
        n(lambda x: x.contains("public class ")).alias("public_classes"),
        n(lambda x: x.contains("class ") & ~x.contains("public class ")).alias("other_classes"),
        n(lambda x: x.contains("interface ")).alias("interfaces"),
    )


def entity_id(path: Column, content: Column, strict: bool = False) -> Column:
    """Graph id of a snippet: package and file name of Java, else the path with dots.

    ``strict`` gives null for other languages and where no line is a package line.
    """
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.java$", "")
    if strict:
        return F.when(path.endswith(".java"), F.concat(F.lit("java:"), file_summary(content)["package"], F.lit("."), name))
    package = F.coalesce(F.nullif(F.regexp_extract(content, r"package\s+([\w.]+);", 1), F.lit("")), F.lit(""))
    java = F.concat(F.lit("java:"), F.when(package != "", F.concat(package, F.lit("."))).otherwise(""), name)
    return F.when(path.endswith(".java"), java).when(path != "", F.translate(path, "/", "."))


def declared_name(line: Column, keyword: str) -> Column:
    """Word after the first ``keyword`` of a line; null for none."""
    return F.nullif(F.regexp_extract(F.regexp_extract(line, rf"^.*?{keyword} (.*)$", 1), r"^\s*([\p{L}\p{Nd}_]+)", 1), F.lit(""))


def token_before_bracket(line: Column) -> Column:
    """Last word before the first round bracket; null without one."""
    return F.when(line.contains("("), F.element_at(F.split(_strip(F.substring_index(line, "(", 1)), r"\s+"), -1))


def ratio_boilerplate(content: Column, language: Column, java: float = 0.7, comments: float = 0.7, least: int = 50, lines: int = 3) -> Column:
    """Whether a fragment is boilerplate; one with a word of ``LOGIC_WORDS`` never is, nor null or blank text.

    Java: accessors and object methods take more than ``java`` of its length.
    Others: shorter than ``least``, a short import, or over ten lines with more
    than ``comments`` of comment lines; of JavaScript and TypeScript also a short
    export.
    """
    trimmed, l = _strip(content), F.transform(_lines(F.regexp_replace(content, r"\n+$", "")), _strip)
    taken = sum((F.aggregate(F.regexp_extract_all(content, F.lit(x), F.lit(0)), F.lit(0), lambda s, m: s + F.length(m)) for x in JAVA_BOILERPLATE), F.lit(0))
    remarks = F.size(F.filter(l, lambda x: x.startswith("//") | x.startswith("*") | x.startswith("/*")))
    short = (F.length(trimmed) < least) | (content.rlike(r"^\s*(?:import|include|require|using)\s") & (F.length(trimmed) < 150))
    plain = short | ((F.size(l) >= lines) & (F.size(l) > 10) & (remarks / F.size(l) > comments))
    script = (content.rlike(SCRIPT_EXPORT) & (F.length(trimmed) < 200)) | plain
    low = F.lower(language)
    kind = F.when(low == "java", taken / F.length(content) > java).when(low.isin("javascript", "typescript"), script).otherwise(plain)
    return F.when(content.isNull() | (trimmed == "") | _any(F.lower(content), LOGIC_WORDS), False).otherwise(kind)


def log_calls(files: DataFrame, around: int = 2) -> DataFrame:
    """(path, level, message, line, method, context) of each logger and route log call.

    ``method`` is the last signature before the call, null for none; the context
    has ``around`` lines before and after, the call's own marked.
    """
    signature = r"(?:^|\s)[\w<>\[\]]+\s+(\w+)\s*\([^)]*\)\s*\{"
    clean = F.translate("content", "\x01", " ")
    found = None
    for pattern in (LOG_CALL, CAMEL_LOG_CALL):
        # A mark before each match cuts the text, so places are exact without searching for the match again.
        pieces = files.where(F.col("content").rlike(pattern)).select("path", _lines(clean).alias("l"), F.split(F.regexp_replace(clean, f"({pattern})", "\x01$1"), "\x01").alias("p"))
        one = pieces.select("path", "l", "p", F.posexplode("p").alias("n", "piece")).where("n > 0").withColumn("before", F.array_join(F.expr("slice(p, 1, n)"), ""))
        rows = one.select(
            "path", "l", F.upper(F.regexp_extract("piece", pattern if pattern is CAMEL_LOG_CALL else pattern[2:], 1)).alias("level"), _strip(F.regexp_extract("piece", pattern if pattern is CAMEL_LOG_CALL else pattern[2:], 2)).alias("message"),
            F.size(_lines(F.col("before"))).alias("line"), F.try_element_at(F.regexp_extract_all("before", F.lit(signature), F.lit(1)), F.lit(-1)).alias("method"),
        )
        found = rows if found is None else found.unionByName(rows)
    first = F.greatest(F.lit(1), F.col("line") - around)
    shown = F.slice("l", first, F.col("line") + around - first + 1)
    context = F.array_join(F.transform(shown, lambda x, i: F.concat(F.when(i + first == F.col("line"), "-> ").otherwise("   "), x)), "\n")
    return found.select("path", "level", "message", "line", "method", context.alias("context"))
