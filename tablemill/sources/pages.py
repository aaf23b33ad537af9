"""Tables out of raw pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.functions.numbers import ANY_NUMBER

CELLS = "page_id long, table_no int, row_no int, col_no int, is_header boolean, text string, href string"

CELLS_PER_BATCH = 50_000


class _Cells(HTMLParser):
    """Collects (table, row, column, header flag, text, first link) while a page is read."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[tuple] = []
        self.table = self.row = self.col = -1
        self.open: list | None = None

    def _close(self) -> None:
        if self.open is not None:
            header, words, href = self.open
            text = " ".join("".join(words).split())
            self.cells.append((self.table, self.row, self.col, header, text, href))
            self.open = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close()
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self._close()
            self.col += 1
            self.open = [tag == "th", [], None]
        elif tag == "a" and self.open is not None and self.open[2] is None:
            self.open[2] = dict(attrs).get("href")

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.open is not None:
            self.open[1].append(data)


def _read_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CELLS.split(", ")]
    for batch in batches:
        rows: list[tuple] = []
        for page, html in zip(batch["page_id"], batch["html"]):
            reader = _Cells()
            reader.feed(html or "")
            reader.close()
            reader._close()
            rows += [(page, *cell) for cell in reader.cells]
            if len(rows) >= CELLS_PER_BATCH:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def html_tables(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """One row per table cell of every page, with its text and first link."""
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"))
    return source.mapInPandas(_read_pages, CELLS)


def table_lookup(cells: DataFrame, label: str, average_prefix: str = "Average", actual: str = "Actual") -> DataFrame:
    """(page_id, raw, value) for one labelled row of each page.

    The column headed ``actual`` wins, then a column headed ``Average...``. Numbers are
    read from the text: ``MM`` and ``-`` mean missing, ``T...`` (trace) means 0.
    """
    heads = cells.where(F.col("is_header") & (F.col("row_no") == 0)).select("page_id", "table_no", "col_no", F.col("text").alias("head"))
    rows = cells.where((F.col("col_no") == 0) & (F.col("text") == label)).select("page_id", "table_no", "row_no")
    found = cells.where(~F.col("is_header")).join(rows, ["page_id", "table_no", "row_no"]).join(heads, ["page_id", "table_no", "col_no"])
    text = F.when(F.trim("text").isin("", "-"), None).otherwise(F.trim("text"))
    best = found.groupBy("page_id").agg(
        F.coalesce(
            F.max(F.when(F.col("head") == actual, text)), F.max(F.when(F.col("head").startswith(average_prefix), text))
        ).alias("raw")
    )
    number = (
        F.when(F.col("raw").isin("MM", "-"), F.lit(None).cast("double"))
        .when(F.col("raw").startswith("T"), 0.0)
        .otherwise(F.nullif(F.regexp_extract("raw", ANY_NUMBER, 1), F.lit("")).try_cast("double"))
    )
    return best.withColumn("value", number)
