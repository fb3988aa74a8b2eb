"""Configuration impact, exception use and cross-repository search over source files."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
CRITICAL_PACKAGES = (".security.", ".auth.", ".core.", ".persistence.")
CRITICAL_NAMES = ("Security", "Auth", "JWT", "Login", "Permission")
DB_PREFIXES = ("spring.datasource", "spring.jpa", "spring.data.jdbc", "spring.data.mongodb", "spring.data.redis", "spring.data.cassandra", "spring.data.elasticsearch", "hibernate", "jdbc", "database", "db")
DB_FRAGMENTS = ("database", "datasource", "db", "jdbc", "jpa", "hibernate")
DB_TYPES = ((("url", "jdbc"), "connection"), (("username", "user"), "authentication"), (("password",), "authentication"), (("driver",), "driver"), (("pool", "connection"), "pool-config"), (("dialect",), "dialect"), (("jpa", "hibernate"), "orm-config"))
DB_TECHNOLOGIES = {"jdbc:mysql": "MySQL", "jdbc:postgresql": "PostgreSQL", "jdbc:oracle": "Oracle", "jdbc:sqlserver": "SQL Server", "jdbc:h2": "H2", "jdbc:db2": "DB2", "jdbc:sqlite": "SQLite", "mongodb://": "MongoDB", "redis://": "Redis"}
NOTE_TOPICS = ((("url", "uri", "endpoint"), "endpoint"), (("timeout",), "timeout"), (("enable", "disable"), "switch"), (("password", "secret", "key"), "secret"))


def _any(c: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def class_name(content: Column) -> Column:
    package, name = F.regexp_extract(content, r"package\s+([\w.]+)\s*;", 1), F.regexp_extract(content, r"\b(?:class|interface|enum|record)\s+(\w+)", 1)
    return F.when(package == "", name).otherwise(F.concat(package, F.lit("."), name))


def component_type(content: Column, name: Column) -> Column:
    """By annotation, then class suffix, then implemented interface."""
    return (
        F.when(_any(content, ("@Controller", "@RestController")), "Controller").when(content.contains("@Service"), "Service").when(content.contains("@Repository"), "Repository").when(content.contains("@Component"), "Component").when(content.contains("@Configuration"), "Configuration")
        .when(name.endswith("Controller"), "Controller").when(name.endswith("Service"), "Service").when(name.endswith("Repository") | name.endswith("DAO"), "Repository").when(name.endswith("Config") | name.endswith("Configuration"), "Configuration")
        .when(content.contains("implements") & content.contains("Repository"), "Repository").when(content.contains("implements") & content.contains("Service"), "Service").otherwise("Other")
    )


def property_references(files: DataFrame, name: str) -> DataFrame:
    """(path, class_name, component, kind, is_critical, access): each use of a property in the five direct forms; ``name`` may be a prefix and ``*``, for all properties that begin so, in the first two."""
    prefix = name[:-1] if name.endswith("*") else None
    p = re.escape(name) if prefix is None else re.escape(prefix)
    forms = {"value": rf'@Value\(\s*"\$\{{{p}{"" if prefix is None else "[^:}]+"}(?::[^}}]*)?\}}"', "environment": rf'getProperty\(\s*"{p}{"" if prefix is None else "[^" + chr(34) + "]+"}"'}
    if prefix is None:
        forms |= {
            "properties": rf'(?:props|properties)\.get\(\s*"{p}"',
            "prefix": rf'@ConfigurationProperties\([^)]*"{re.escape(name.rsplit(".", 1)[0])}"',
            "conditional": rf'@ConditionalOnProperty\([^)]*"{p}"',
        }
    uses = [(F.lit(k).alias("kind"), F.regexp_extract_all("content", F.lit(x), F.lit(0))) for k, x in forms.items()]
    found = F.concat(*(F.arrays_zip(F.array_repeat(k, F.size(m)).alias("kind"), m.alias("match")) for k, m in uses))
    cls = class_name(F.col("content"))
    fallback = (F.col("kind") == "value") & F.col("match").rlike(r"\$\{[^:}]+:")
    access = F.when(F.col("kind") == "conditional", "conditional").when(fallback, "fallback").otherwise("direct")
    held = files.where(F.col("content").contains(name.rsplit(".", 1)[0] if prefix is None else prefix))
    hit = held.select("path", "content", F.explode(found).alias("u")).select("path", "content", "u.kind", "u.match")
    return hit.select("path", cls.alias("class_name"), component_type(F.col("content"), cls).alias("component"), "kind", is_critical(cls).alias("is_critical"), access.alias("access"))


def severity(critical: Column, security: Column, conditional: Column, references: Column) -> Column:
    return F.when((critical > 0) | (security > 0) | (conditional > 1), "HIGH").when((references > 5) | (conditional > 0), "MEDIUM").when(references > 0, "LOW").otherwise("UNKNOWN")


def impact(references: DataFrame, by: str = "property") -> DataFrame:
    counts = references.groupBy(by).agg(F.count("*").alias("n_references"), F.count_if("is_critical").alias("n_critical"), F.count_if(F.col("access") == "conditional").alias("n_conditional"), F.count_distinct("class_name").alias("n_classes"))
    return counts.withColumn("severity", severity(F.col("n_critical"), F.lit(0), F.col("n_conditional"), F.col("n_references")))


def impact_notes(critical: Column, conditional: Column, loops: Column, classes: Column) -> Column:
    """Names of what stands out about a property's use: a critical context, more than five classes."""
    return F.array_compact(F.array(F.when((critical > 0) | (conditional > 0) | (loops > 0), "critical contexts"), F.when(classes > 5, "wide scope")))


def impact_recommendations(conditional: Column, mutating: Column, is_db: Column, classes: Column) -> Column:
    """Names of what to do about a property, in order; documentation always."""
    return F.array_compact(
        F.array(F.when(conditional > 0, "Add Default Value"), F.when(mutating > 0, "Consider Immutability"), F.when(is_db, "Secure Database Configuration"), F.lit("Configuration Documentation"), F.when(classes > 3, "Configuration Centralization"))
    )


def is_critical(class_name: Column) -> Column:
    """Whether a class stands in a critical package or is named so."""
    return _any(class_name, CRITICAL_PACKAGES) | _any(class_name, CRITICAL_NAMES)


def is_db_property(name: Column) -> Column:
    """By prefix or fragment of the property's name, as it is written; null is none."""
    begins = reduce(lambda a, b: a | b, (F.startswith(name, F.lit(p)) for p in DB_PREFIXES))
    return F.coalesce(begins | _any(name, DB_FRAGMENTS), F.lit(False))


def note_topic(name: Column) -> Column:
    """What a note about a property is on, by its name; null for none."""
    return F.coalesce(*(F.when(_any(name, parts), F.lit(topic)) for parts, topic in NOTE_TOPICS))


def usage_summary(injection: Column, reads: Column, writes: Column, conditional: Column, loops: Column, mutating: Column) -> Column:
    """A sentence for each kind of use that occurs."""
    some = lambda n, before, after: F.when(n > 0, F.concat(F.lit(before), n.cast("string"), F.lit(after))).otherwise("")
    parts = ((writes, "Written ", " times. "), (conditional, "Used in ", " conditional statements. "), (loops, "Used in ", " loops. "), (mutating, "Modified by ", " operations. "))
    return F.concat(F.lit("Injected via "), injection, F.lit(". Read "), reads.cast("string"), F.lit(" times. "), *(some(*p) for p in parts))


def db_property_type(name: Column) -> Column:
    low = F.lower(name)
    out = F.when(_any(low, DB_TYPES[0][0]), DB_TYPES[0][1])
    for parts, kind in DB_TYPES[1:]:
        out = out.when(_any(low, parts), kind)
    return out.otherwise("other")


def db_technology(value: Column) -> Column:
    return F.coalesce(*(F.when(F.lower(value).contains(k), F.lit(v)) for k, v in DB_TECHNOLOGIES.items()))


def exception_uses(files: DataFrame, name: str) -> DataFrame:
    """(path, throws, catches) of files that throw or catch the exception."""
    n = re.escape(name.rsplit(".", 1)[-1])
    out = files.select("path", F.col("content").rlike(rf"throw\s+new\s+{n}\b|throws\s+[^{{;]*\b{n}\b").alias("throws"), F.col("content").rlike(rf"catch\s*\([^)]*\b{n}\b").alias("catches"))
    return out.where("throws or catches")


def anti_patterns(files: DataFrame, exception: str = "Exception") -> DataFrame:
    """(pattern, path) of each way in which a file mishandles the exception.

    A handler is what stands between the braces of its ``catch``, without inner
    braces. It may be empty, swallow (neither throw, log nor return in it), only
    log the variable, print its stack trace, or sleep; ``generic_catch`` is any
    catch of Exception.
    """
    name = re.escape(exception.rsplit(".", 1)[-1])
    head = rf"catch\s*\(\s*{name}\s+(\w+)\s*\)\s*\{{([^{{}}]*)\}}"
    catches = F.arrays_zip(F.regexp_extract_all("content", F.lit(head), F.lit(1)).alias("v"), F.regexp_extract_all("content", F.lit(head), F.lit(2)).alias("body"))
    some = lambda test: F.exists(catches, test)
    body = lambda c: c["body"]
    logged = lambda c: body(c).rlike(r"log(?:ger)?\.[a-z]+\(") & F.contains(F.regexp_extract(body(c), r"log(?:ger)?\.[a-z]+\((.*)\)", 1), c["v"])
    tests = {
        "empty_catch": some(lambda c: F.trim(F.regexp_replace(body(c), r"\s+", " ")) == ""),
        "swallowed": some(lambda c: ~body(c).rlike("throw|log|return")),
        "generic_catch": F.col("content").rlike(r"catch\s*\(\s*Exception\s+\w+\s*\)"),
        "log_only": some(logged),
        "print_stack_trace": some(lambda c: F.contains(body(c), F.concat(c["v"], F.lit(".printStackTrace()")))),
        "sleep_in_catch": some(lambda c: body(c).rlike(r"Thread\.sleep\([^)]*\)")),
    }
    names = F.array(*(F.when(test, F.lit(k)) for k, test in tests.items()))
    return files.select(F.explode(F.array_compact(names)).alias("pattern"), "path")


def search_repositories(files: DataFrame, term: str, most: int = 1000, regex: bool = False, ignore_case: bool = True, around: int = 3) -> DataFrame:
    """(repository, path, line, matched, context): at most ``most`` lines of each repository in order of path and line; the context leaves the line out."""
    found = (lambda c: F.lower(c).contains(term.lower())) if ignore_case and not regex else (lambda c: c.rlike(("(?i)" if ignore_case else "") + term) if regex else c.contains(term))
    held = files.where(found(F.col("content"))).select("repository", "path", F.split("content", "\n").alias("l"))
    hits = held.select("repository", "path", "l", F.posexplode("l").alias("p", "matched")).where(found(F.col("matched")))
    first = F.greatest(F.lit(0), F.col("p") - around)
    context = F.concat(F.slice("l", first + 1, F.col("p") - first), F.slice("l", F.col("p") + 2, F.lit(around)))
    rows = hits.select("repository", "path", (F.col("p") + 1).alias("line"), "matched", context.alias("context"))
    order = Window.partitionBy("repository").orderBy("path", "line")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")


def boilerplate(content: Column) -> Column:
    """Whether a Java fragment is a lone getter, setter, toString, equals or hashCode."""
    return F.trim(content).rlike(r"^(?:@Override\s+)?public\s+(?:\w+\s+get\w+\(\)\s*\{\s*return\s+[\w.]+;\s*\}|void\s+set\w+\([^)]*\)\s*\{\s*[\w.]+\s*=\s*\w+;\s*\}|String\s+toString\(\)\s*\{[^}]*\}|boolean\s+equals\([^)]*\)\s*\{[^}]*\}|int\s+hashCode\(\)\s*\{[^}]*\})$")


def log_statements(content: Column) -> Column:
    """(level, message) of each logger call."""
    calls = F.regexp_extract_all(content, F.lit(r"\blog(?:ger)?\.((?:trace|debug|info|warn|error|fatal)\([^;]*)\);"), F.lit(1))
    return F.transform(calls, lambda c: F.struct(F.substring_index(c, "(", 1).alias("level"), F.regexp_extract(c, r'"([^"]*)"', 1).alias("message")))
