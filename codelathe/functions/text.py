"""Text columns: terms, counts, query types, templates, languages, domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CONCEPTUAL = ("how to", "what is", "explain", "purpose of", "function of", "architecture", "design", "capability", "responsibility", "concept")
IMPLEMENTATION = ("implementation", "code for", "where is", "how is", "defined", "declared", "function", "method", "class", "interface")
CONCEPTUAL_SHORT = ("what is", "purpose", "why", "how does", "when to use", "functionality", "explain", "describe")
EXPANDED = ("what is", "how does", "purpose of", "functionality of")
SUBJECT_STOP_WORDS = ("what", "is", "the", "purpose", "of", "how", "does", "work", "function", "code")
KEYWORD_STOP_WORDS = ("the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "in", "on", "at", "to", "for", "with", "by", "about", "like", "from", "of", "how", "what", "why", "when", "where", "who", "which")
RERANK_STOP_WORDS = ("a", "an", "the", "in", "on", "of", "for", "to", "is", "are", "how", "what")
PASSAGE_STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "with", "about", "from", "by", "as", "of", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must", "that", "this", "these",
    "those", "how", "what", "where", "when", "who", "which", "why",
)
LANGUAGES = {"java": "java", "py": "python", "js": "javascript", "ts": "typescript", "rb": "ruby", "go": "golang", "cs": "csharp", "php": "php", "kt": "kotlin", "scala": "scala", "swift": "swift", "c": "c", "cpp": "cpp", "h": "c-header", "hpp": "cpp-header", "sh": "shell", "sql": "sql", "xml": "xml", "json": "json", "yml": "yaml", "yaml": "yaml", "md": "markdown"}
TEMPLATE_STEPS = (
    (r"\b\d+\b", "<NUM>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<ID>"),
    (r"\b[0-9a-f]{32}\b", "<ID>"),
    (r"/[\w/.-]+", "<PATH>"),
    (r"\\[\w\\.-]+", "<PATH>"),
)


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))


def query_type(text: Column) -> Column:
    """CONCEPTUAL, IMPLEMENTATION, or MIXED for both, neither and null."""
    c, i = any_in(text, CONCEPTUAL), any_in(text, IMPLEMENTATION)
    return F.when(c & ~i, "CONCEPTUAL").when(i & ~c, "IMPLEMENTATION").otherwise("MIXED")


def is_conceptual(text: Column) -> Column:
    return any_in(text, CONCEPTUAL_SHORT)


def search_terms(text: Column) -> Column:
    """Lower-case terms of three letters or more, stop words dropped, repeats kept."""
    stop = F.array(*map(F.lit, KEYWORD_STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def rerank_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, RERANK_STOP_WORDS))
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\W_]+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)))


def passage_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, PASSAGE_STOP_WORDS))
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def keyword_set(text: Column) -> Column:
    """Distinct lower-case words of more than two letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 2))


def occurrences(text: Column, term: Column) -> Column:
    """Literal occurrences that don't overlap."""
    return F.when(F.length(term) > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")).otherwise(F.lit(0).cast("long"))


def subject(text: Column) -> Column:
    """The first word in camel case, or else the first identifier that is no common word; empty if none."""
    camel = F.regexp_extract(text, r"\b((?:[A-Z][a-z0-9]+)+)\b", 1)
    common = F.array(*map(F.lit, SUBJECT_STOP_WORDS))
    plain = F.filter(F.regexp_extract_all(text, F.lit(r"\b([a-zA-Z][a-zA-Z0-9_]*)\b"), F.lit(1)), lambda w: ~F.array_contains(common, F.lower(w)))
    return F.when(camel != "", camel).otherwise(F.coalesce(F.try_element_at(plain, F.lit(1)), F.lit("")))


def expanded(text: Column) -> Column:
    """The query with phrases about its subject, if it asks for one."""
    s = subject(text)
    more = F.concat(text, F.lit("; "), s, F.lit(" class implementation; "), s, F.lit(" functionality; "), s, F.lit(" purpose; code for "), s)
    return F.when(any_in(text, EXPANDED) & (s != ""), more).otherwise(text)


def template(message: Column) -> Column:
    """A message with numbers, ids and paths masked, in this order."""
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), TEMPLATE_STEPS, message)


def suffix(path: Column) -> Column:
    return F.when(F.contains(F.substring_index(path, "/", -1), F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("unknown"))


def code_type(path: Column) -> Column:
    java = F.when(path.contains("/interface/") | path.contains("Interface.java"), "interface").when(path.contains("/enum/") | path.contains("Enum.java"), "enum").when(path.contains("Exception.java"), "exception").otherwise("class")
    return F.when(path.endswith(".java"), java).when(path.endswith(".xml"), "xml configuration").when(path.endswith(".properties"), "properties configuration").when(path.endswith(".yml") | path.endswith(".yaml"), "yaml configuration").otherwise("code file")


def domain(url: Column) -> Column:
    """Lower case, without scheme, up to the first slash."""
    return F.substring_index(F.regexp_replace(F.lower(url), "^https?://", ""), "/", 1)


def trusted(host: Column, allowed: list[str]) -> Column:
    """Whether the host is an allowed domain or below one."""
    return reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in allowed), F.lit(False))


def parse_allowed(text: str) -> list[str]:
    return list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("... ["), (F.length(text) - most).cast("string"), F.lit(" more chars]"))).otherwise(text)
