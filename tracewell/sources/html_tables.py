"""Tables and label lines of HTML pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th", "li", "dt", "dd"):
            if not self.open:
                self.open.append([])
            if tag in ("li", "dt") or not self.open[-1]:
                self.open[-1].append([])
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "li", "dt", "dd") and self.cell is not None and self.open:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag in ("table", "ul", "ol", "dl") and self.open:
            self.tables.append([r for r in self.open.pop() if r])

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tables(pages: DataFrame, key: str = "page_id", html_col: str = "html", least: int = 2) -> DataFrame:
    """(key, table, row, cells): rows of each page's tables and lists of `least` rows or more; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = _Tables()
                p.feed(text or "")
                p.close()
                out += [(k, t, r, cells) for t, rows in enumerate(x for x in p.tables if len(x) >= least) for r, cells in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate([pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())])], [key, "table", "row", "cells"])

    return pages.select(F.col(key).cast("long"), F.col(html_col)).mapInArrow(run, f"`{key}` long, table int, row int, cells array<string>")
