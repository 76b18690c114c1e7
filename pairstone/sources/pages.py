"""Scan of raw HTML pages: one parser pass in each worker, nothing collected."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from pairstone.workers import importable

SKIPPED = frozenset(("script", "style", "template", "noscript"))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.text, self.links, self.inside = [], [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED or tag == "title":
            self.inside.append(tag)
        href = dict(attrs).get("href") if tag == "a" else None
        if href:
            self.links.append(href)

    def handle_endtag(self, tag: str) -> None:
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()

    def handle_data(self, data: str) -> None:
        where = self.inside[-1] if self.inside else ""
        if where == "title":
            self.title.append(data)
        elif not where and data.strip():
            self.text.append(" ".join(data.split()))


def parse(html: str | None) -> tuple[str, str, list[str]]:
    """Title, visible text, and distinct link targets in order; broken markup gives what could be read."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return " ".join("".join(reader.title).split()), " ".join(reader.text), [*dict.fromkeys(reader.links)]


def scan(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text, links."""
    importable(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [parse(x) for x in batch.column("html").to_pylist()]
            columns = [batch.column("page_id"), batch.column("url"), pa.array([p[0] for p in parsed], pa.string()), pa.array([p[1] for p in parsed], pa.string()), pa.array([p[2] for p in parsed], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "title", "text", "links"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, title string, text string, links array<string>")
