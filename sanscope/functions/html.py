"""Tables of stored HTML pages as they come, read over Arrow batches.

A page is read tag by tag with a stack of open elements, as lenient parsers do: an end tag closes the
innermost open element of its name and all inside it, one without such an element is ignored, elements
left open end with their parent or the page, and void elements hold nothing. Rows and cells are found at any depth
below the first table, so an outer row has the cells of a table nested in it, and an unclosed cell holds
the text of the cells that follow inside it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sanscope.functions.names import _c
from sanscope.session import share_code

#: FIXED VALUES: elements without content, and elements whose text isn't text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))
ROWS_TYPE = "array<struct<pos:int,cells:array<string>,href:string>>"


class _Row:
    def __init__(self):
        self.cells: list[list[int]] = []  # first and last text piece of each
        self.href: str | None = None
        self.linked = False


class TableReader(HTMLParser):
    """Rows of the first table. Text is kept once, as pieces; a cell is a range of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = False
        self.rows: list[_Row] = []
        self._open: list[tuple[str, object]] = []
        self._count: Counter[str] = Counter()
        self._table = -1  # depth of the first table while it is open
        self._open_rows: list[_Row] = []
        self._silent = 0
        self._text: list[str] = []

    def handle_starttag(self, tag, attrs):
        if not self.found and tag == "table":
            self.found, self._table = True, len(self._open)
        holder: object = None
        if self._table >= 0:
            if tag == "tr":
                holder = _Row()
                self.rows.append(holder)
                self._open_rows.append(holder)
            elif tag in ("td", "th"):
                holder = [len(self._text), -1]
                for row in self._open_rows:
                    row.cells.append(holder)
            elif tag == "a":
                for row in self._open_rows:
                    if not row.linked:  # the first link counts, with or without a target
                        row.linked, row.href = True, dict(reversed(attrs)).get("href")
        if tag not in VOID:
            self._open.append((tag, holder))
            self._count[tag] += 1
            self._silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._count[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, holder = self._open.pop()
        self._count[tag] -= 1
        self._silent -= tag in SILENT
        if isinstance(holder, _Row):
            self._open_rows.pop()
        elif holder is not None:
            holder[1] = len(self._text)
        if len(self._open) == self._table:
            self._table = -1
        return tag

    def handle_data(self, data):
        if self._table >= 0 and not self._silent:
            self._text.append(data)

    def result(self) -> list[tuple[list[str], str | None]]:
        self.close()
        while self._open:
            self._close()
        texts = {id(c): "".join(self._text[c[0] : c[1]]).strip() for row in self.rows for c in row.cells}  # a cell may be of several rows
        return [([texts[id(c)] for c in row.cells], row.href) for row in self.rows]


def read_table(html: str | None) -> list[tuple[list[str], str | None]] | None:
    """(cell texts, first link) of the rows of the first table; null without a table."""
    reader = TableReader()
    reader.feed(html or "")
    rows = reader.result()
    return rows if reader.found else None


def table_rows(col) -> Column:
    """array<struct<pos, cells, href>> of the first table's rows; empty without a table."""
    share_code(SparkSession.active())

    @F.pandas_udf(ROWS_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([[{"pos": k, "cells": cells, "href": href} for k, (cells, href) in enumerate(read_table(p) or [])]
                             for p in pages], dtype=object)

    return run(_c(col))


def table_fields(col, first: str) -> Column:
    """array<struct<category, field, value>> of a detail page, in the order of its headings and fields.

    A row of one cell opens a heading, and opening it again empties it; the fields before any belong to
    ``first``. A row of more cells is a field and its value, the field without blanks and colons at its
    end; of a repeated field the last value counts."""
    share_code(SparkSession.active())

    def read(page):
        groups: dict[str, dict[str, str]] = {}
        at = first
        for cells, _ in read_table(page) or []:
            if len(cells) == 1:
                at = cells[0]
                groups[at] = {}
            elif cells:
                groups.setdefault(at, {})[cells[0].rstrip(" :")] = cells[1]
        return [{"category": g, "field": f, "value": v} for g, fields in groups.items() for f, v in fields.items()]

    @F.pandas_udf("array<struct<category:string,field:string,value:string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([read(p) for p in pages], dtype=object)

    return run(_c(col))
