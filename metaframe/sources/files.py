"""Texts, pages, images, PDF files and workbooks as rows. Files are read by Spark, so any store will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metaframe.functions.text import MAX_CHARS, decode, html_to_text, mime_type, source_kind, truncate, truncation_warning
from metaframe.operators.mapping import mapping_of
from metaframe.schema import Schema

PDF_PAGES = 20
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "p": "http://schemas.openxmlformats.org/package/2006/relationships"}


def _no_pdf(content: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("Reading PDF files needs pypdf, or a pdf_reader of your own.") from error
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages[:PDF_PAGES]]


def _pdf_text(reader: Callable[[bytes], list[str]], content: bytes) -> tuple[str, str | None]:
    """The marked texts of a file's pages, and an error; whatever the reader raises is the file's error, not the read's."""
    try:
        pages = [(i, t) for i, t in enumerate(reader(content), 1) if t.strip()]
    except Exception as error:  # noqa: BLE001
        return "", f"The PDF file could not be read: {error}"
    return "\n".join(f"[PDF page {i}]\n{t}" for i, t in pages).strip(), None


def read_sources(spark: SparkSession, path: str, limit: int = MAX_CHARS, pdf_reader: Callable[[bytes], list[str]] = _no_pdf) -> DataFrame:
    """(path, source_kind, mime_type, text, binary_base64, warning, error) of each file, by its suffix.

    Texts and pages are decoded and truncated, images and PDF files without text are base64; a suffix that no
    source reads gives a row with an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content").withColumn("source_kind", source_kind(F.col("path")))

    def pages(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in stream:
            told = [_pdf_text(pdf_reader, c) for c in rows["content"]]
            yield pd.DataFrame({"path": rows["path"], "content": rows["content"], "source_kind": rows["source_kind"], "_pdf": [t for t, _ in told], "_failed": [e for _, e in told]})

    shape = "path string, content binary, source_kind string, _pdf string, _failed string"
    pdf = files.where("source_kind = 'pdf'").mapInPandas(pages, shape)
    rest = files.where("source_kind is null or source_kind <> 'pdf'").withColumns({"_pdf": F.lit(None).cast("string"), "_failed": F.lit(None).cast("string")})
    both = rest.unionByName(pdf)
    raw = decode("content")
    text = F.when(F.col("source_kind") == "text", raw).when(F.col("source_kind") == "html", html_to_text(raw)).when(F.col("source_kind") == "pdf", F.col("_pdf"))
    both = both.withColumn("_text", text)
    binary = F.when((F.col("source_kind") == "image") | (F.col("source_kind") == "pdf") & (F.col("_text") == ""), F.base64("content"))
    empty_pdf = F.when((F.col("source_kind") == "pdf") & (F.col("_text") == ""), "No text could be extracted from the PDF file.")
    return both.select(
        "path", "source_kind", mime_type(F.col("path")).alias("mime_type"), truncate(F.col("_text"), limit).alias("text"), binary.alias("binary_base64"),
        F.coalesce(empty_pdf, truncation_warning(F.col("_text"), limit)).alias("warning"),
        F.when(F.col("_failed").isNotNull(), F.col("_failed")).when(F.col("source_kind").isNull(), F.concat(F.lit("Unsupported file type: "), "path")).when(F.col("source_kind").isin("text", "html") & F.col("_text").isNull(), F.lit("The text has no known encoding.")).alias("error"),
    )


def fetch_pages(urls: DataFrame, fetcher: Callable[[str], tuple[str, bytes]], limit: int = MAX_CHARS) -> DataFrame:
    """(url, text, error) of web addresses (column url) through a fetcher, which returns a content type and bytes. Only http and https are fetched."""
    from metaframe.functions.text import visible_text

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in stream:
            out = []
            for url in rows["url"]:
                if not re.match(r"https?://", url or ""):
                    out.append((url, None, "Only http and https addresses are supported."))
                    continue
                try:
                    kind, body = fetcher(url)
                except OSError as error:
                    out.append((url, None, str(error)))
                    continue
                named = re.search(r"charset=([^;]+)", kind, re.I)
                try:
                    text = body.decode(named[1].strip() if named else "utf-8", "replace")
                except LookupError:
                    text = body.decode("utf-8", "replace")
                out.append((url, visible_text(text) if "html" in kind.lower() or "<html" in text[:1000].lower() else text, None))
            yield pd.DataFrame(out, columns=["url", "text", "error"])

    return urls.mapInPandas(run, "url string, text string, error string").withColumn("text", truncate(F.col("text"), limit))


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _date(serial: float) -> str:
    from datetime import datetime, timedelta

    return str((datetime(1899, 12, 30) + timedelta(days=serial)).replace(microsecond=0))


#: The built-in number formats that are dates or times.
_DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


def workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the active sheet as texts; cached results of formulas, None for empty cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        read = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in read("xl/sharedStrings.xml").findall("m:si", _NS)] if "xl/sharedStrings.xml" in names else []
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = read("xl/styles.xml")
            own = {int(f.get("numFmtId")) for f in styles.findall("m:numFmts/m:numFmt", _NS) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")), re.I)}
            dates = {i for i, x in enumerate(styles.findall("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | own}
        book = read("xl/workbook.xml")
        active = book.find("m:bookViews/m:workbookView", _NS)
        sheet = book.findall("m:sheets/m:sheet", _NS)[int(active.get("activeTab", 0)) if active is not None else 0]
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels").findall("p:Relationship", _NS)}
        target = targets[sheet.get(f"{{{_NS['r']}}}id")]
        with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                cells: list[str | None] = []
                for i, c in enumerate(row.findall("m:c", _NS)):
                    at = _column(c.get("r")) if c.get("r") else i
                    cells += [None] * (at - len(cells))
                    v, kind = c.findtext("m:v", None, _NS), c.get("t", "n")
                    if kind == "inlineStr":
                        v = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None and kind == "s":
                        v = shared[int(v)]
                    elif v is not None and kind == "b":
                        v = "True" if v == "1" else "False"
                    elif v is not None and kind == "n":
                        number = float(v)
                        v = _date(number) if int(c.get("s", 0)) in dates else str(int(v) if re.fullmatch(r"-?\d+", v) else number)
                    cells.append(v)
                yield cells
                row.clear()


def read_workbook(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """Headers of the first row, stripped, and the rows below as (ord, cells); ord follows files by path.

    Several workbooks are one table and must have the same headers. Rows pass through in batches; a sheet is never held.
    """

    def rows(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in stream:
            for name, content in zip(files["path"], files["content"], strict=True):
                sheet = ((name, i, r) for i, r in enumerate(workbook_rows(content)))
                while part := list(islice(sheet, 10_000)):
                    yield pd.DataFrame(part, columns=["path", "row", "cells"])

    def first(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in stream:
            tops = [(name, next(workbook_rows(content), None)) for name, content in zip(files["path"], files["content"], strict=True)]
            yield pd.DataFrame([t for t in tops if t[1] is not None], columns=["path", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    tops = files.mapInPandas(first, "path string, cells array<string>").orderBy("path").collect()  # a row for each file
    headers = [[(h or "").strip() for h in r.cells] for r in tops]
    if any(h != headers[0] for h in headers):
        raise ValueError("Workbooks that are read together must have the same headers.")
    below = files.mapInPandas(rows, "path string, row long, cells array<string>").where("row > 0")
    if len(headers) > 1:
        below = below.sort("path", "row").withColumn("row", F.monotonically_increasing_id())
    return (headers or [[]])[0], below.select(F.col("row").alias("ord"), "cells")


@dataclass
class Preview:
    """A sheet's headers and first rows, the fields that its headers name, and the headers that name none."""

    headers: list[str]
    rows: list[list[str]]
    mapping: dict[str, str]
    unknown: list[str]


def preview(spark: SparkSession, path: str, schema: Schema, n: int = 100) -> Preview:
    """What an import by the schema would find: the first n rows as texts, as wide as the headers."""
    headers, rows = read_workbook(spark, path)
    known, unknown = mapping_of(headers, schema)
    shown = [["" if c is None else c for c in r.cells[: len(headers)]] for r in rows.orderBy("ord").limit(n).collect()]
    return Preview(headers, shown, known, unknown)
