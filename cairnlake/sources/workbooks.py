"""SRC6: workbooks (.xlsx: zipped XML) as typed cells, and their tables found by DataFrame operators.

The data source reads cells, a workbook for each partition, row by row; a merged area's value counts in all its cells. Everything else is
joins and windows over cells: regions, header chains, units, summary rows.

    spark.dataSource.register(WorkbookSource)
    table = regions(spark.read.format("workbooks").load(folder))"""

from __future__ import annotations

import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairnlake.session import forget, written
from cairnlake.sources.archives import seekable

#: Rows and columns of a sheet; the namespace of sheets and of references; kinds of built-in formats that are dates or shares.
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
MAIN, REFS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 49: "@"}
CELLS = "workbook string, sheet string, row int, col int, kind string, text string, number double, format string, formula string, merged string, inherited boolean, hidden boolean, status string"
#: A vertical aggregate, a unit in brackets at the end of a header, a currency in a format.
AGGREGATE = r"(?i)^=?(SUM|AVERAGE|MIN|MAX|COUNT|COUNTA)\(\$?([A-Z]+)\$?(\d+):\$?([A-Z]+)\$?(\d+)\)$"
UNIT, CURRENCY = r"(?:\(([^()]+)\)|（([^（）]+)）)\s*$", r"\[\$([^\]\-]+)(?:-[^\]]+)?\]|([$€£¥￥])"


def place(ref: str) -> tuple[int, int]:
    """Row and column of a reference such as B3, from 1."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    if int(digits) > MAX_ROWS or col > MAX_COLUMNS:
        raise ValueError("worksheet exceeds rows or columns")
    return int(digits), col


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


class Workbook:
    """A workbook's sheets, shared strings and formats."""

    def __init__(self, z: zipfile.ZipFile) -> None:
        self.z = z
        names = set(z.namelist())
        relations = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        path = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join("xl", t))
        self.sheets = [(s.get("name"), path(relations[s.get(f"{REFS}id")])) for s in book.iter(f"{MAIN}sheet")]
        self.strings = [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        self.formats = ["General"]
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{MAIN}numFmt")}
            self.formats = [own.get(i, FORMATS.get(i, "General")) for x in styles.findall(f"{MAIN}cellXfs/{MAIN}xf") for i in [int(x.get("numFmtId") or 0)]] or self.formats

    def _nodes(self, path: str, tags: set[str]):
        with self.z.open(path) as source:
            for _, node in ElementTree.iterparse(source):
                if node.tag in tags:
                    yield node
                    node.clear()

    def cells(self, sheet: str, path: str) -> Iterator[tuple]:
        merges, hidden = [], set()
        for node in self._nodes(path, {f"{MAIN}mergeCell", f"{MAIN}row"}):
            if node.tag == f"{MAIN}row":
                if node.get("hidden") == "1":
                    hidden.add(int(node.get("r")))
            else:
                a, _, b = node.get("ref").partition(":")
                merges.append((place(a), place(b or a), node.get("ref")))
        anchors = {a: (a, b, ref) for a, b, ref in merges}
        open_: list[list] = []  # merged areas that the rows have reached: their corners, name and the anchor's value
        for row in self._nodes(path, {f"{MAIN}row"}):
            number = int(row.get("r"))
            found: dict[int, tuple] = {}
            for c in row.findall(f"{MAIN}c"):
                at = place(c.get("r"))
                value = self._value(c)
                ref = None
                if at in anchors:
                    a, b, ref = anchors[at]
                    open_.append([a, b, ref, value])
                if value is not None:
                    found[at[1]] = (*value, ref, False)
            open_ = [m for m in open_ if m[1][0] >= number]
            for (r0, c0), (_, c1), ref, value in open_:
                if value is not None:
                    for col in range(c0, c1 + 1):
                        if (number, col) != (r0, c0):
                            found[col] = (*value[:4], None, ref, True)
            for col, (kind, text, num, fmt, formula, ref, inherited) in sorted(found.items()):
                yield sheet, number, col, kind, text, num, fmt, formula, ref, inherited, number in hidden

    def _value(self, c) -> tuple | None:
        """(kind, text, number, format, formula); none of an empty cell. A formula without a stored result has no text."""
        kind, style = c.get("t", "n"), int(c.get("s") or 0)
        fmt = self.formats[style] if style < len(self.formats) else "General"
        v, f = c.find(f"{MAIN}v"), c.find(f"{MAIN}f")
        formula = "=" + (f.text or "") if f is not None else None
        raw = _text(c.find(f"{MAIN}is")) if kind == "inlineStr" and c.find(f"{MAIN}is") is not None else v.text if v is not None else None
        if raw is None or raw == "":
            return ("formula", None, None, fmt, formula) if formula else None
        if kind == "s":
            raw = self.strings[int(raw)]
        if kind in ("s", "str", "inlineStr"):
            return ("string" if formula is None else "formula", raw, None, fmt, formula)
        if kind == "b":
            return ("boolean", "TRUE" if raw == "1" else "FALSE", None, fmt, formula)
        if kind == "e":
            return ("error", raw, None, fmt, formula)
        date = re.search(r"[ymdhs]", re.sub(r'\[[^\]]*\]|"[^"]*"|\\.', "", fmt), re.I) is not None and fmt != "General"
        return ("formula" if formula else "date" if date else "number", raw, float(raw), fmt, formula)


@dataclass
class Book(InputPartition):
    path: str


class WorkbookReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        """A partition for each workbook: the driver sees names alone."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        return [Book(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.lower().endswith(".xlsx")] or [Book("")]

    def read(self, partition: Book) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        name = partition.path.rsplit("/", 1)[-1]
        nothing = (None,) * 10
        with fs.open_input_file(partition.path) as file:
            try:
                book = Workbook(zipfile.ZipFile(seekable(file)))
                for sheet, path in book.sheets:
                    for cell in book.cells(sheet, path):
                        yield name, *cell, "ok"
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, AttributeError):
                yield name, None, *nothing, "broken"


class WorkbookSource(DataSource):
    """Option: path (a folder). A workbook that can't be read is one row of status ``broken`` after the cells that could."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])


def letters(col: Column) -> Column:
    """A column's name: A to Z, AA to XFD."""
    one = lambda n: F.char(65 + F.pmod(n - 1, F.lit(26)))
    up = F.floor((col - 1) / 26).cast("int")
    top = F.floor((up - 1) / 26).cast("int")
    return F.concat(F.when(top > 0, one(top)).otherwise(F.lit("")), F.when(up > 0, one(up)).otherwise(F.lit("")), one(col))


def _islands(cells: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """Adds ``name``: runs of neighbouring values of ``at`` within keys, from 0."""
    lines = cells.select(*keys, at).distinct()
    order = Window.partitionBy(*keys).orderBy(at)
    opens = (F.col(at) - F.lag(at, 1).over(order) > 1).cast("int")
    numbered = lines.withColumn(name, F.coalesce(F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return cells.join(numbered, [*keys, at])


def regions(cells: DataFrame) -> DataFrame:
    """Typed cells of tables: (workbook, sheet, band, block, row, col, header, kind, text, number, unit, is_header, is_summary).

    A region is a block of columns within a band of rows, with empty lines around both. Its first row is a header if it holds two or more
    texts and nothing else (or one merged text); a row of texts after a header with merged cells is one too. A column's name is the chain of
    its labels; one that only shares a merged label is named by its letters. A row that aggregates the rows above it by a formula is a
    summary. Units come from a cell's format, else from brackets at the end of its header. Cells are written once with their regions, so that
    workbooks are read once."""
    good = written(cells.where("status = 'ok' AND col IS NOT NULL").drop("status"), "cells")
    banded = written(_islands(_islands(good, ["workbook", "sheet"], "row", "band"), ["workbook", "sheet", "band"], "col", "block"), "banded")
    forget(good)
    own = ["workbook", "sheet", "band", "block"]
    texts = (F.col("kind") == "string") & ~F.col("inherited")
    real = ~F.col("inherited") & F.col("text").isNotNull()
    match = lambda n: F.regexp_extract("formula", AGGREGATE, n)
    adds = F.coalesce((match(2) != "") & (match(2) == match(4)) & (match(3).try_cast("int") <= match(5).try_cast("int")) & (match(5).try_cast("int") < F.col("row")), F.lit(False))
    rows = banded.groupBy(*own, "row").agg(F.count_if(real).alias("real"), F.count_if(texts).alias("texts"), F.bool_or(F.col("merged").isNotNull()).alias("has_merged"), F.bool_or(adds).alias("is_summary"))
    order = Window.partitionBy(*own).orderBy("row")
    only = F.col("real") == F.col("texts")
    first = only & ((F.col("texts") > 1) | (F.col("has_merged") & (F.col("texts") > 0)))
    nth = F.row_number().over(order)
    # A chain of header rows goes on while each has merged cells and the next one holds texts alone.
    goes_on = F.when(nth == 1, first).otherwise(only & (F.col("real") > 0) & F.lag("has_merged", 1).over(order))
    rows = rows.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    rows = rows.withColumn("is_header", F.min(F.col("_on").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    told = written(banded.join(rows.select(*own, "row", "is_header", "is_summary"), [*own, "row"]), "told")
    forget(banded)
    label = F.struct("row", "text", "inherited")
    heads = told.where("is_header AND text IS NOT NULL").groupBy(*own, "col").agg(F.array_sort(F.collect_list(label)).alias("labels"))
    chain = F.transform(F.filter("labels", lambda x, i: (i == 0) | (x["text"] != F.get("labels", i - 1)["text"])), lambda x: x["text"])
    named = heads.select(*own, "col", F.when(F.exists("labels", lambda x: ~x["inherited"]), F.array_join(chain, " / ")).alias("header"), F.element_at(chain, -1).alias("last"))
    out = told.join(named, [*own, "col"], "left")
    pick = lambda text, pattern: F.nullif(F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)), F.lit(""))
    by_format = F.when(F.contains("format", F.lit("%")), F.lit("%")).otherwise(pick(F.col("format"), CURRENCY))
    by_header = F.when(F.col("kind").isin("number", "formula"), pick(F.col("last"), UNIT))
    unit = F.when(~F.col("is_header") & F.col("kind").isin("number", "formula", "date"), F.coalesce(by_format, by_header))
    return out.select(*own, "row", "col", F.coalesce("header", letters(F.col("col"))).alias("header"), "kind", "text", "number", unit.alias("unit"), "is_header", "is_summary")
