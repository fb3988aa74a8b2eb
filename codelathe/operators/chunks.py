"""Splitting texts: overlapping windows, line blocks, context lines, passages, code structure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, TAIL = 8000, 200, 100


def windows(docs: DataFrame, key: str = "id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP, tail: int = TAIL) -> DataFrame:
    """(key, n, content): windows that overlap; a last one shorter than ``tail`` is appended to the one before."""
    step = size - overlap
    length = F.length(text)
    count = F.when(length <= size, 1).otherwise(F.ceil((length - overlap) / step)).cast("int")
    last = length - (count - 1) * step
    merged = (count > 1) & (last < tail)
    kept = F.when(merged, count - 1).otherwise(count)
    rows = docs.where(F.col(text).isNotNull()).select(key, text, kept.alias("kept"), merged.alias("merged"), F.explode(F.sequence(F.lit(0), kept - 1)).alias("n"))
    own = F.substr(F.col(text), (F.col("n") * step + 1).cast("int"), F.lit(size))
    more = F.when(F.col("merged") & (F.col("n") == F.col("kept") - 1), F.substr(F.col(text), (F.col("kept") * step + 1).cast("int"))).otherwise("")
    return rows.select(key, "n", F.concat(own, more).alias("content"))


def with_context(chunks: DataFrame, key: str = "id", share: float = 0.15) -> DataFrame:
    """Chunks with the end of the one before and the start of the one after, ``share`` of their own length."""
    w = Window.partitionBy(key).orderBy("n")
    size = F.floor(F.length("content") * share).cast("int")
    before, after = F.lag("content").over(w), F.lead("content").over(w)
    return chunks.select("*", F.coalesce(F.when(size > 0, F.right(before, size)), F.lit("")).alias("context_before"), F.coalesce(F.when(size > 0, F.left(after, size)), F.lit("")).alias("context_after"))


def lines(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, line, content) with lines from 1."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("p", "content")).select(key, (F.col("p") + 1).alias("line"), "content")


def line_blocks(docs: DataFrame, key: str = "id", text: str = "text", size: int = 1500, least: int = 50) -> DataFrame:
    """(key, block, first_line, n_lines, content): blocks of ``size`` lines, those below ``least`` dropped; built per text, without a shuffle."""
    held = docs.select(key, F.split(text, "\n").alias("l"))
    blocks = held.select(key, "l", F.explode(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / size).cast("int"))).alias("block"))
    part = F.slice("l", (F.col("block") * size + 1).cast("int"), F.lit(size))
    return blocks.select(key, "block", (F.col("block") * size + 1).alias("first_line"), F.size(part).alias("n_lines"), F.array_join(part, "\n").alias("content")).where(F.col("n_lines") >= least)


def with_overlap(blocks: DataFrame, key: str = "id", lines: int = 20) -> DataFrame:
    """Blocks with the last lines of the one before and the first of the one after."""
    w = Window.partitionBy(key).orderBy("block")
    own = F.split("content", "\n")
    last = F.array_join(F.slice(own, F.greatest(F.lit(1), F.size(own) - lines + 1), F.lit(lines)), "\n")
    first = F.array_join(F.slice(own, F.lit(1), F.lit(lines)), "\n")
    return blocks.select("*", F.coalesce(F.lag(last).over(w), F.lit("")).alias("before"), F.coalesce(F.lead(first).over(w), F.lit("")).alias("after"))


def estimated_chunks(text: str = "text"):
    """About how many chunks a text gives: one for each 500 characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 500)).cast("long")


def context_lines(docs: DataFrame, term: str, around: int = 2, key: str = "id", text: str = "text", with_match: bool = True) -> DataFrame:
    """(key, line, matched, context) of lines that hold ``term`` in any case; built per text, without a shuffle."""
    held = docs.where(F.lower(text).contains(term.lower())).select(key, F.split(text, "\n").alias("l"))
    hits = held.select(key, "l", F.posexplode("l").alias("p", "matched")).where(F.lower("matched").contains(term.lower()))
    first = F.greatest(F.lit(0), F.col("p") - around)
    before = F.slice("l", first + 1, F.col("p") - first)
    after = F.slice("l", F.col("p") + 2, F.lit(around))
    middle = F.array("matched") if with_match else F.array().cast("array<string>")
    return hits.select(key, (F.col("p") + 1).alias("line"), "matched", F.array_join(F.concat(before, middle, after), "\n").alias("context"))


def passages(docs: DataFrame, terms: list[str], k: int = 10, key: str = "id", text: str = "text") -> DataFrame:
    """(key, position, segment, hits): each text's segments with the most whole-word hits, ties by position."""
    segments = docs.select(key, F.posexplode(F.split(text, r"[.!?\n]")).alias("position", "segment"))
    hits = sum((F.regexp_count(F.lower("segment"), F.lit(rf"\b{re.escape(t)}\b")) for t in terms), F.lit(0))
    found = segments.select(key, "position", F.trim("segment").alias("segment"), hits.cast("long").alias("hits")).where("hits > 0")
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "position")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


_JAVA_TYPE = re.compile(r"\b(class|interface|enum|record)\s+(\w+)")
_JAVA_METHOD = re.compile(r"(?:^|\s)(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{?\s*$")
_NOT_METHODS = frozenset("if for while switch catch return new else try do synchronized".split())


def java_chunks(path: str, content: str) -> list[tuple[str, str, int, int]]:
    """(id, type, first line, last line): the file, its types and their methods, by brace depth."""
    rows = content.replace("\r\n", "\n").split("\n")
    while len(rows) > 1 and not rows[-1]:
        rows.pop()
    out = [(path, "file", 1, len(rows))]
    stack: list[list] = []  # name, type, first line, depth at its brace or None
    depth = 0
    for n, row in enumerate(rows, 1):
        code = re.sub(r'"(?:\\.|[^"\\])*"|//.*', "", row)
        kind, method = _JAVA_TYPE.search(code), _JAVA_METHOD.search(code)
        if kind and not code.lstrip().startswith("*"):
            stack.append([kind[2], kind[1], n, None])
        elif method and stack and stack[-1][1] != "method" and method[1] not in _NOT_METHODS:
            stack.append([method[1], "method", n, None])
        for c in code:
            if c == "{":
                if stack and stack[-1][3] is None:
                    stack[-1][3] = depth
                depth += 1
            elif c == "}":
                depth -= 1
                if stack and stack[-1][3] == depth:
                    name, type_, first, _ = stack.pop()
                    out.append((f"{path}#{'.'.join([s[0] for s in stack] + [name])}", type_, first, n))
            elif c == ";" and stack and stack[-1][3] is None and stack[-1][1] == "method":
                stack.pop()  # a declaration without a body
    return out


def python_chunks(path: str, content: str) -> list[tuple[str, str, int, int]]:
    """The file, its classes and functions, by indentation."""
    rows = content.replace("\r\n", "\n").rstrip("\n").split("\n")
    out, stack = [(path, "file", 1, len(rows))], []
    last = 0
    for n, row in enumerate([*rows, "end"], 1):
        if not row.strip():
            continue
        indent = len(row.expandtabs(4)) - len(row.expandtabs(4).lstrip())
        while stack and indent <= stack[-1][3]:
            name, type_, first, _ = stack.pop()
            out.append((f"{path}#{'.'.join([s[0] for s in stack] + [name])}", type_, first, last))
        if m := re.match(r"\s*(?:async\s+)?(class|def)\s+(\w+)", row):
            stack.append((m[2], "class" if m[1] == "class" else "function", n, indent))
        last = n
    return out


_BRACED = {
    "javascript": re.compile(r"\b(?:class\s+(?P<c>\w+)|function\s+(?P<f>\w+)|(?:const|let|var)\s+(?P<v>\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>))"),
    "golang": re.compile(r"^(?:type\s+(?P<c>\w+)\s+(?:struct|interface)|func\s+(?:\([^)]*\)\s*)?(?P<f>\w+))"),
}


def braced_chunks(path: str, content: str, language: str) -> list[tuple[str, str, int, int]]:
    """The file and its top-level declarations, by brace depth."""
    rows = content.replace("\r\n", "\n").rstrip("\n").split("\n")
    out, depth, open_ = [(path, "file", 1, len(rows))], 0, None
    for n, row in enumerate(rows, 1):
        m = _BRACED[language].search(row)
        if m and depth == 0 and open_ is None:
            named = m.groupdict()
            open_ = (next(v for v in named.values() if v), "class" if named.get("c") else "function", n)
        depth += row.count("{") - row.count("}")
        if open_ and depth == 0 and "}" in row:
            out.append((f"{path}#{open_[0]}", open_[1], open_[2], n))
            open_ = None
    return out


def code_chunks(files: DataFrame) -> DataFrame:
    """(id, path, type, start_line, end_line) of (path, content): one Python pass over Arrow batches, no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for path, content in zip(part["path"], part["content"]):
                suffix, content = path.rsplit(".", 1)[-1].lower(), content or ""
                if suffix == "java":
                    some = java_chunks(path, content)
                elif suffix == "py":
                    some = python_chunks(path, content)
                elif suffix in ("js", "ts", "jsx", "tsx", "go"):
                    some = braced_chunks(path, content, "golang" if suffix == "go" else "javascript")
                else:
                    some = [(path, "file", 1, len(content.split("\n")))]
                found += [(i, path, t, a, b) for i, t, a, b in some]
            yield pd.DataFrame(found, columns=["id", "path", "type", "start_line", "end_line"])

    return files.select("path", "content").mapInPandas(run, "id string, path string, type string, start_line int, end_line int")
