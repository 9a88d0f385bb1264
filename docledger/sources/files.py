"""File sources: delimited text of any dialect, whole texts, workbooks, positioned items, result folders."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions.text import clean_cell
from docledger.streaming.metrics import file_type

ALLOWED = ("pdf", "png", "jpg", "jpeg", "webp", "xlsx", "xls", "csv", "txt", "md")
DELIMITERS = (",", ";", "\t", "|")


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of allowed types, with type and size, without their content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return found.filter(suffix.isin(*ALLOWED)).withColumn("file_type", file_type(F.col("path")))


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """path and text of each file; a byte-order mark goes, bytes that are not UTF-8 become replacement characters."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select("path", F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "").alias("text"))


def grid(spark: SparkSession, folder: str) -> DataFrame:
    """path, row_idx and cells of delimited files without headers, rows of any width; the delimiter is each file's own.

    Of four delimiters, the one that the file holds most often outside quotes. A quoted cell may hold delimiters, quotes
    (doubled) and line breaks. Rows without any cell are left out.
    """
    bare = F.regexp_replace("text", '"[^"]*"', "")
    counts = F.array(*(F.struct(F.length(F.regexp_replace(bare, f"[^{re.escape(d)}]", "")).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            for path, d, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = list(csv.reader(io.StringIO(text, newline=""), delimiter=d))
                columns = [pa.array([path] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "row_idx", "cells"])

    rows = texts(spark, folder).select("path", F.array_max(counts)["d"].alias("d"), "text")
    parsed = rows.mapInArrow(parse, "path string, row_idx long, cells array<string>")
    return parsed.withColumn("cells", F.transform("cells", clean_cell)).filter(F.exists("cells", lambda c: c != ""))


def _sheets(book: zipfile.ZipFile, space: dict[str, str]) -> list[tuple[str, str]]:
    """Title and file of each sheet in the workbook's order: by its relationship, else by the number of the sheet."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {}
    if "xl/_rels/workbook.xml.rels" in book.namelist():
        for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    out = []
    for i, s in enumerate(ElementTree.fromstring(book.read("xl/workbook.xml")).iterfind(".//m:sheet", space), 1):
        name = targets.get(s.get(rel), f"xl/worksheets/sheet{s.get('sheetId') or i}.xml")
        if name not in book.namelist():
            name = f"xl/worksheets/sheet{i}.xml"
        out.append((s.get("name"), name))
    return out


def _sheet_rows(content: bytes) -> list[tuple[str, int, list[str]]]:
    """Rows of a workbook's sheets by their cell references, so that blank cells keep their columns."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    book = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", space)) for s in root.iterfind("m:si", space)]
    out = []
    for title, name in _sheets(book, space):
        for i, row in enumerate(ElementTree.fromstring(book.read(name)).iterfind(".//m:row", space)):
            cells: dict[int, str] = {}
            for c in row.iterfind("m:c", space):
                at = 0
                for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                    at = at * 26 + ord(letter) - 64
                value = c.findtext("m:v", default="", namespaces=space)
                if c.get("t") == "s" and value:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iterfind(".//m:t", space))
                cells[(at or len(cells) + 1) - 1] = value.strip()
            if any(cells.values()):
                out.append((title, i, [cells.get(k, "") for k in range(max(cells) + 1)]))
    return out


def workbooks(spark: SparkSession, folder: str) -> DataFrame:
    """path, sheet, row_idx and cells of all sheets; broken files give no rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows += [{"path": path, "sheet": s, "row_idx": i, "cells": c} for s, i, c in _sheet_rows(content)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row_idx", pa.int64()), ("cells", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")
    return files.mapInArrow(parse, "path string, sheet string, row_idx long, cells array<string>")


ITEMS = "array<struct<text:string,x:double,y:double,w:double,h:double,page:int>>"


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Positioned items from JSON files of tables: path, page, item_idx, text, place, size and centre."""
    read = spark.read.schema(f"type string, items {ITEMS}").option("multiLine", "true").json(folder)
    each = read.filter("type = 'ocr_items'").select(F.input_file_name().alias("path"), F.posexplode("items").alias("item_idx", "i"))
    return each.select("path", "item_idx", "i.*").withColumns({"cx": F.expr("x + w / 2"), "cy": F.expr("y + h / 2")})


def results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of JSON results; files that do not parse keep only their text in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
