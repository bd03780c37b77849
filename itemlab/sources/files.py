"""Readers of delimited files, spreadsheets and documents. Every cell is a string."""

from __future__ import annotations

import html
import io
import itertools
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What stands for the text of a PDF in which nothing is legible (a fixed value).
NO_PDF_TEXT = "PDF text not extracted (library required)"


def sniff(head: str) -> str:
    """The most frequent of semicolon, comma and tab; semicolon if there is none."""
    return max(";,\t", key=lambda c: (head.count(c), c == ";"))


def read_semicolons(spark: SparkSession, path: str) -> DataFrame:
    """A file with a header whose separator is the semicolon, or the comma if the header has none."""
    head = spark.read.text(path).limit(1).collect()
    return read_delimited(spark, path, ";" if head and ";" in head[0].value else ",")


def read_delimited(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """A file with a header; cells are trimmed, blank rows left out, a byte order mark is no part of the first name."""
    if separator is None:
        head = spark.read.text(path, wholetext=False).limit(20).collect()
        separator = sniff("\n".join(r.value for r in head)[:4096])
    rows = spark.read.csv(path, sep=separator, header=True, multiLine=True, escape='"', inferSchema=False)
    rows = rows.toDF(*(c.replace("﻿", "").strip() for c in rows.columns))
    rows = rows.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns))
    blank = F.lit(True)
    for c in rows.columns:
        blank = blank & (F.coalesce(F.col(f"`{c}`"), F.lit("")) == "")
    return rows.where(~blank)


def column_index(reference: str) -> int:
    """0 for A1, 27 for AB7."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return max(0, n - 1)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(stream, tag: str):
    """The elements of a name, one after the other, each taken off the tree once it is done with."""
    open_elements: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            open_elements.append(e)
            continue
        open_elements.pop()
        if _local(e.tag) == tag:
            yield e
            e.clear()
            if open_elements:
                open_elements[-1].remove(e)


def _shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    with z.open("xl/sharedStrings.xml") as stream:
        return ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in _elements(stream, "si")]


def xlsx_rows(content: bytes) -> Iterator[list[str]]:
    """Cells of the first sheet, a row at a time: shared strings, plain or in runs, inline strings, gaps by cell references."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        if not sheets:
            return
        shared = _shared_strings(z)
        with z.open(sheets[0]) as stream:
            for row in _elements(stream, "row"):
                cells: list[str] = []
                for c in (e for e in row if _local(e.tag) == "c"):
                    at = column_index(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = next((e.text or "" for e in c if _local(e.tag) == "v"), "")
                    if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(e.text or "" for e in c.iter() if _local(e.tag) == "t")
                    cells[at] = value.strip()
                yield cells


def ods_rows(content: bytes) -> Iterator[list[str]]:
    """Cells of the first table, a row at a time, repeated ones as often as they say."""
    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open("content.xml") as stream:
        tables = 0
        open_elements: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                open_elements.append(e)
                continue
            open_elements.pop()
            name = _local(e.tag)
            if name == "table":
                tables += 1
            if name != "table-row" or tables:
                continue
            cells: list[str] = []
            empty = 0  # cells since the last filled one; those at the end are only formatting
            for c in (x for x in e if _local(x.tag) in ("table-cell", "covered-table-cell")):
                repeat = next((int(v) for k, v in c.attrib.items() if _local(k) == "number-columns-repeated"), 1)
                text = " ".join("".join(p.itertext()) for p in c if _local(p.tag) == "p").strip()
                if text:
                    cells += [""] * empty + [text] * repeat
                empty = 0 if text else empty + repeat
            yield cells
            if open_elements:
                open_elements[-1].remove(e)


def as_records(rows: Iterable[list[str]], columns: list[str] | None = None) -> Iterator[dict[str, str]]:
    """Rows by the names in the first that isn't blank, or of them those of columns."""
    rows = (r for r in rows if any(r))
    header = [h.replace("﻿", "").strip() for h in next(rows, [])]
    wanted = [(k, h) for k, h in enumerate(header) if h and (columns is None or h in columns)]
    for r in rows:
        yield {h: (r[k] if k < len(r) else "") for k, h in wanted}


#: Rows of a sheet that leave a task at once.
SHEET_ROWS = 10_000


def read_spreadsheets(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """``path, row, cells`` (a map from header to string) of .xlsx and .ods files.

    A file is read by one task, which holds its bytes and shared strings but only a few of its rows; cells of
    other columns than those named are left out, and reading ends at limit rows of a file.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = as_records((ods_rows if name.lower().endswith(".ods") else xlsx_rows)(content), columns)
                rows, done = itertools.islice(rows, limit), 0
                while part := list(itertools.islice(rows, SHEET_ROWS)):
                    yield pd.DataFrame({"path": [name] * len(part), "row": range(done + 1, done + len(part) + 1), "cells": part})
                    done += len(part)

    return files.mapInPandas(run, "path string, row int, cells map<string,string>")


def columns_of(cells: DataFrame, names: list[str]) -> DataFrame:
    return cells.select("path", "row", *(F.col("cells").getItem(n).alias(n) for n in names))


def read_spreadsheet(spark: SparkSession, path: str) -> DataFrame:
    """``row`` and a column for each name in the header of one .xlsx or .ods file."""
    first = read_spreadsheets(spark, path, limit=1)
    names = [r.name for r in first.select(F.explode(F.map_keys("cells")).alias("name")).collect()]
    return read_spreadsheets(spark, path).select("row", *(F.col("cells").getItem(n).alias(n) for n in names))


def _markup(xml: str, breaks: str, tabs: str) -> str:
    text = re.sub(breaks, "\n", re.sub(tabs, "\t", xml))
    return html.unescape(re.sub(r"<[^>]+>", "", text)).strip()


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _markup(z.read("word/document.xml").decode("utf-8", "replace"), r"</w:p>|</w:tr>|<w:br[^>]*/>", r"</w:tc>|<w:tab[^>]*/>")


def odt_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return _markup(z.read("content.xml").decode("utf-8", "replace"), r"</text:p>|</text:h>|</table:table-row>", r"</table:table-cell>|<text:tab[^>]*/>")


def doc_text(content: bytes) -> str:
    """What is legible of a binary document."""
    return re.sub(r"[^\x20-\x7E\n\r]", "", content.decode("latin-1"))


def pdf_text(content: bytes) -> str:
    """The first string literal of each line, where streams aren't compressed; NO_PDF_TEXT if there is none."""
    found = (re.search(r"\((.*?)\)", line) for line in content.decode("latin-1").split("\n"))
    return " ".join(m[1] for m in found if m).strip() or NO_PDF_TEXT


def plain_text(content: bytes) -> str:
    """UTF-8, else CP1251; line ends become line feeds."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1251", "replace")
    return re.sub(r"\r\n?", "\n", text)


READERS: dict[str, Callable[[bytes], str]] = {
    "docx": docx_text, "odt": odt_text, "doc": doc_text, "pdf": pdf_text, "txt": plain_text,
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of documents by the readers of their extensions; null text where a file can't be read."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            texts = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                reader = READERS.get(name.rpartition(".")[2].lower())
                try:
                    texts.append(reader(content) if reader else None)
                except (zipfile.BadZipFile, KeyError):
                    texts.append(None)
            yield pd.DataFrame({"path": pdf["path"], "text": texts})

    return files.mapInPandas(run, "path string, text string")
