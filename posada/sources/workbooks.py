"""Workbooks (.xlsx) of a folder as cells, the first sheet, and the sheets that are named after a month.

A workbook is a zip of XML parts. Python only unzips them, one row for each part; Spark reads the XML (``from_xml``), joins cells with the
shared strings that they name, and finds a sheet's part by its relation. Of every cell there is one row, so a table of any form can be
made from it, and ``sheet_rows`` gives whole rows as arrays with blanks where no cell is.

Cells are text as stored: numbers with a point, dates as serial numbers (``serial_date``), truth values as ``true`` and ``false``; styles aren't
read. Defined cases: a file that is no zip, or a part that is no XML, gives a row in ``broken`` and no cell; empty cells give none; a workbook without
month sheets has none in ``month_cells``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posada.functions.dates import month_of_name

PARTS = "path string, part string, xml string, error string"
_RAW = {"ignoreNamespace": "true", "inferSchema": "false", "ignoreSurroundingSpaces": "false"}
_BOOK = "sheets struct<sheet: array<struct<_name: string, _id: string>>>"
_RELATIONS = "Relationship array<struct<_Id: string, _Target: string>>"
_TEXT = "struct<_VALUE: string>"
_STRINGS = f"si array<struct<t: {_TEXT}, r: array<struct<t: {_TEXT}>>>>"
_SHEET = f"sheetData struct<row: array<struct<_r: int, c: array<struct<_r: string, _t: string, v: string, is: struct<t: {_TEXT}>>>>>>"
_READ = (r"xl/workbook\.xml", r"xl/_rels/workbook\.xml\.rels", r"xl/sharedStrings\.xml", r"xl/worksheets/[^/]+\.xml")


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import io
    import re
    import zipfile

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows: list[tuple] = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(path, n, z.read(n).decode("utf-8-sig"), None) for n in z.namelist() if any(re.fullmatch(p, n) for p in _READ)]
            except (zipfile.BadZipFile, UnicodeDecodeError, EOFError) as e:
                rows = [(path, None, None, f"no se puede leer el fichero ({e})")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 4)], ["path", "part", "xml", "error"])


@dataclass
class Workbooks:
    cells: DataFrame  # path, sheet, sheet_no, row, col, value
    sheets: DataFrame  # path, sheet, sheet_no
    broken: DataFrame  # path, part, error


def _column(ref: Column) -> Column:
    """The number from 1 of a cell reference's letters."""
    letters = F.split(F.regexp_extract(ref, "^([A-Z]+)", 1), "")
    return F.aggregate(letters, F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def read(spark: SparkSession, path: str) -> Workbooks:
    """All workbooks below a path or pattern. The parts are unzipped once for each table that is asked for."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    parts = files.mapInArrow(_unzipped, PARTS)
    of = lambda name, schema: parts.where(F.col("part").rlike(f"^{name}$")).select("path", "part", F.from_xml("xml", schema, _RAW).alias("x"))
    book = of(_READ[0], _BOOK).select("path", F.posexplode("x.sheets.sheet").alias("k", "s")).select("path", (F.col("k") + 1).alias("sheet_no"), F.col("s._name").alias("sheet"), F.col("s._id").alias("id"))
    target = of(_READ[1], _RELATIONS).select("path", F.explode("x.Relationship").alias("r")).select("path", F.col("r._Id").alias("id"), F.concat(F.lit("xl/"), F.regexp_replace("r._Target", "^/?(xl/)?", "")).alias("part"))
    sheets = book.join(target, ["path", "id"])
    shown = F.coalesce("s.t._VALUE", F.array_join(F.transform("s.r", lambda r: r["t"]["_VALUE"]), ""), F.lit(""))
    strings = of(_READ[2], _STRINGS).select("path", F.posexplode("x.si").alias("n", "s")).select("path", F.col("n").alias("v"), shown.alias("text"))
    rows = of(_READ[3], _SHEET).join(sheets, ["path", "part"]).select("path", "sheet", "sheet_no", F.explode("x.sheetData.row").alias("row"))
    cells = rows.select("path", "sheet", "sheet_no", F.col("row._r").alias("row"), F.explode("row.c").alias("c"))
    cells = cells.select("path", "sheet", "sheet_no", "row", _column(F.col("c._r")).alias("col"), F.col("c._t").alias("t"), F.col("c.v").alias("raw"), F.col("c.is.t._VALUE").alias("inline"))
    named = cells.withColumn("v", F.when(F.col("t") == "s", F.col("raw").try_cast("int"))).join(strings, ["path", "v"], "left")
    value = F.when(F.col("t") == "s", F.col("text")).when(F.col("t") == "inlineStr", F.col("inline")).when(F.col("t") == "b", F.when(F.col("raw") == "1", "true").otherwise("false")).otherwise(F.col("raw"))
    made = named.select("path", "sheet", "sheet_no", "row", "col", value.alias("value")).where("value IS NOT NULL")
    bad = parts.where("error IS NOT NULL").select("path", "part", "error")
    unread = parts.where(F.col("part").rlike(_READ[3])).withColumn("x", F.from_xml("xml", _SHEET + ", _corrupt_record string", {**_RAW, "mode": "PERMISSIVE"}))
    bad = bad.unionByName(unread.where(F.col("x._corrupt_record").isNotNull()).select("path", "part", F.lit("no se puede leer la hoja").alias("error")))
    return Workbooks(made, sheets.select("path", "sheet", "sheet_no"), bad)


def first_sheet(books: Workbooks) -> DataFrame:
    """The cells of each workbook's first sheet."""
    return books.cells.where("sheet_no = 1")


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(path, sheet, row, celdas): each row's values in order, blank where there is no cell."""
    rows = cells.groupBy("path", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"), F.max("col").alias("last"))
    return rows.select("path", "sheet", "row", F.transform(F.sequence(F.lit(1), "last"), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))).alias("celdas"))


def year_in(text: Column) -> Column:
    """A year of four digits, or of two at the end of a word, null for none."""
    four, two = F.regexp_extract(text, r"(?<!\d)(20\d\d)(?!\d)", 1), F.regexp_extract(text, r"(?<!\d)(\d\d)(?!\d)", 1)
    return F.when(four != "", four.try_cast("int")).when(two != "", 2000 + two.try_cast("int"))


def month_sheets(books: Workbooks) -> DataFrame:
    """(path, sheet, sheet_no, mes, anio) of the sheets named after a month; the year is the sheet name's, else the file name's, else null."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1)
    return books.sheets.withColumn("mes", month_of_name(F.col("sheet"))).where("mes IS NOT NULL").withColumn("anio", F.coalesce(year_in(F.col("sheet")), year_in(stem)))


def month_cells(books: Workbooks) -> DataFrame:
    """The cells of the month sheets, with mes and anio."""
    return books.cells.join(month_sheets(books), ["path", "sheet", "sheet_no"])


def serial_date(value: Column) -> Column:
    """A date from its serial number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(value.try_cast("double")).cast("int"))
