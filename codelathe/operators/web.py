"""Main text of fetched pages by the first container that they have."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values.
DROPPED = ("script", "style", "noscript", "iframe", "img")
CONTAINERS = ("main", "article", "#content", ".content", "#main", ".main")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "var")
HEAD = ("head", "title")


class _Text(HTMLParser):
    """Collects the text of each container while its elements are open, and of the whole body."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str], bool]] = []
        self.seen: set[str] = set()
        self.texts: dict[str, list[str]] = {c: [] for c in (*CONTAINERS, "body")}

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._add(" ")
        if tag in VOID:
            return
        a = dict(attrs)
        names = {tag, f"#{a.get('id')}", *(f".{c}" for c in (a.get("class") or "").split())}
        held = [c for c in CONTAINERS if c in names]
        self.seen.update(held)
        self.open.append((tag, held, tag in DROPPED or tag in HEAD))
        if held:
            self._add(" ")

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
        if tag not in INLINE:
            self._add(" ")

    def handle_data(self, data):
        self._add(data)

    def _add(self, data: str) -> None:
        if any(dropped for _, _, dropped in self.open):
            return
        for c in {c for _, held, _ in self.open for c in held} | {"body"}:
            self.texts[c].append(data)

    def result(self) -> str:
        first = next((c for c in CONTAINERS if c in self.seen), "body")
        return " ".join("".join(self.texts[first]).split())


def main_text(html: str | None) -> str:
    """Text of the first of ``CONTAINERS`` that occurs, all its elements joined, or else of the body; null is empty.

    Elements of ``DROPPED`` are left out, white space is one space, and text in
    nested elements of one container counts once.
    """
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser.result()


def main_texts(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text) of every page's ``html``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([main_text(h) for h in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    kept = pages.select(key, "html")
    return kept.mapInArrow(run, f"{key} {kept.schema[key].dataType.simpleString()}, text string")
