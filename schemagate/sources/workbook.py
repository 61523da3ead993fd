"""Cells of .xlsx workbooks through a Python data source: one partition for each sheet that is wanted.

Sheets are named by ``workbook.xml`` alone, and a sheet is read as a stream: a row of XML at a time, Arrow batches of
bounded size. Files are opened by path through Arrow's file systems, so no workbook passes through the driver or a
shuffle. Stores that only Spark can open are read through its binary reader instead, a workbook in one task.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import BinaryIO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from schemagate.functions.text import file_extension
from schemagate.sources.stores import ARROW_STORES, open_path, store_name

CELLS = "file_id string, sheet string, sheet_no int, row_id bigint, position int, value string"
SHEETS = "file_id string, sheet_no int, sheet string"
BATCH_CELLS = 20_000
_SCHEMA = pa.schema([("file_id", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row_id", pa.int64()), ("position", pa.int32()), ("value", pa.string())])
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Built-in number formats that show dates or times.
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])


def _column_index(reference: str) -> int:
    index = 0
    for letter in re.match("[A-Z]+", reference).group():
        index = index * 26 + ord(letter) - 64
    return index - 1


def _texts(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _rows(file: BinaryIO, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a tag, each dropped after use."""
    events = ElementTree.iterparse(file, events=("start", "end"))
    _, root = next(events)
    parent = root
    for event, element in events:
        if event == "start" and element.tag == f"{_MAIN}sheetData":
            parent = element
        elif event == "end" and element.tag == f"{_MAIN}{tag}":
            yield element
            parent.clear()


def workbook_sheets(file: BinaryIO) -> list[str]:
    """Names of the sheets in order."""
    with zipfile.ZipFile(file) as book:
        return [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")]


def _shows_date(code: str) -> bool:
    """Whether a format code has date or time letters outside of quotes, escapes and brackets (but for elapsed times)."""
    code = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0].lower())
    return bool(re.search("[dmyhs]", code)) and "general" not in code


def _date_styles(book: zipfile.ZipFile, names: set[str]) -> list[bool]:
    """For each cell style whether it shows dates."""
    if "xl/styles.xml" not in names:
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_MAIN}numFmt")}
    styles = root.find(f"{_MAIN}cellXfs")
    ids = [int(x.get("numFmtId", 0)) for x in styles] if styles is not None else []
    return [_shows_date(own[i]) if i in own else i in DATE_FORMATS for i in ids]


def serial_date(serial: float, from_1904: bool = False) -> str | None:
    """Text of a date serial: a date, a time of day below one, else both; None if no date has it."""
    whole = timedelta(days=int(serial // 1), seconds=round(serial % 1 * 86400))
    if serial < 0:
        return None
    if not from_1904 and whole < timedelta(days=1) or from_1904 and serial < 1 and serial % 1:
        return str((datetime(1900, 1, 1) + whole).time())
    # The 1900 calendar counts a 29 February 1900 that never was.
    origin = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    try:
        day = origin + whole
    except OverflowError:
        return None
    return day.strftime("%Y-%m-%d" if day.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def sheet_cells(file: BinaryIO, number: int) -> Iterator[tuple[int, int, str | None]]:
    """(row_id, position, value) of a sheet's cells, row by row; an empty sheet gives (-1, -1, None)."""
    with zipfile.ZipFile(file) as book:
        names = set(book.namelist())
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        props = root.find(f"{_MAIN}workbookPr")
        from_1904 = props is not None and props.get("date1904") in ("1", "true")
        relations = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in relations}
        sheet = list(root.iter(f"{_MAIN}sheet"))[number]
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as part:
                shared = [_texts(item) for item in _rows(part, "si")]
        dates = _date_styles(book, names)
        empty = True
        with book.open(f"xl/{target[sheet.get(_RELATION)]}") as part:
            for place, row in enumerate(_rows(part, "row")):
                row_id = int(row.get("r", place + 1)) - 1
                for order, cell in enumerate(row.iter(f"{_MAIN}c")):
                    position = _column_index(cell.get("r")) if cell.get("r") else order
                    kind, value = cell.get("t"), cell.find(f"{_MAIN}v")
                    text = value.text if value is not None else None
                    if kind == "inlineStr":
                        text = _texts(cell)
                    elif text is not None and kind == "s":
                        text = shared[int(text)]
                    elif text is not None and kind == "b":
                        text = "True" if text == "1" else "False"
                    elif text is not None and kind == "d":
                        text = re.sub(r"T00:00:00(\.0+)?$", "", text).replace("T", " ")
                    elif text is not None and kind in (None, "n") and int(cell.get("s", 0)) < len(dates) and dates[int(cell.get("s", 0))]:
                        text = serial_date(float(text), from_1904) or text
                    empty = False
                    yield row_id, position, text
        if empty:
            yield -1, -1, None


def _batches(path: str, number: int, name: str, file: BinaryIO) -> Iterator[pa.RecordBatch]:
    """A sheet as Arrow batches of bounded size."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = [[path] * len(held), [name] * len(held), [number] * len(held), *map(list, zip(*held))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

    for cell in sheet_cells(file, number):
        held.append(cell)
        if len(held) >= BATCH_CELLS:
            yield flush()
            held.clear()
    if held:
        yield flush()


class _Sheet(InputPartition):
    def __init__(self, path: str, number: int, name: str):
        super().__init__((path, number, name))


class _SheetReader(DataSourceReader):
    def __init__(self, sheets: list):
        self.sheets = sheets

    def partitions(self) -> list[_Sheet]:
        return [_Sheet(*s) for s in self.sheets]

    def read(self, partition: _Sheet) -> Iterator[pa.RecordBatch]:
        path, number, name = partition.value
        with open_path(path) as file:
            yield from _batches(path, number, name, file)


class WorkbookSource(DataSource):
    """Cells of sheets; option ``sheets`` is a JSON list of [path, number, name]."""

    @classmethod
    def name(cls) -> str:
        return "workbook_cells"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader(json.loads(self.options["sheets"]))


def _books(listing: DataFrame) -> DataFrame:
    return listing.filter(file_extension(F.col("path")) == "xlsx")


def sheet_names(listing: DataFrame) -> DataFrame:
    """(file_id, sheet_no, sheet) of every workbook; only its ``workbook.xml`` is read."""
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, path in enumerate(batch["path"].to_pylist()):
                with io.BytesIO(batch["content"][k].as_py()) if "content" in batch.schema.names else open_path(path) as file:
                    found += [{"file_id": path, "sheet_no": i, "sheet": s} for i, s in enumerate(workbook_sheets(file))]
            yield pa.RecordBatch.from_pylist(found, pa.schema([("file_id", pa.string()), ("sheet_no", pa.int32()), ("sheet", pa.string())]))

    books, own = _books(listing), F.regexp_extract("path", r"^(\w+):", 1).isin(["", *ARROW_STORES])
    by_path = books.filter(own).select("path").mapInArrow(names, SHEETS)
    return by_path.unionByName(books.filter(~own).select("path", "content").mapInArrow(names, SHEETS)) if "content" in books.columns else by_path


def workbook_cells(listing: DataFrame, sheet: str | int | None = None) -> DataFrame:
    """One row per cell of the sheets wanted (all, or one by number or name); an empty sheet leaves one row with row_id -1.

    Numbers whose format shows dates become ISO dates, truth values True and False.
    """
    spark: SparkSession = listing.sparkSession
    sheets = sheet_names(listing)
    if sheet is not None:
        sheets = sheets.filter(F.col("sheet_no") == sheet if isinstance(sheet, int) else F.col("sheet") == sheet)
    found = [(r.file_id, r.sheet_no, r.sheet) for r in sheets.collect()]  # a row per sheet: what the partitions are made of
    direct = [s for s in found if store_name(s[0]) in ARROW_STORES]
    spark.dataSource.register(WorkbookSource)
    cells = spark.read.format("workbook_cells").option("sheets", json.dumps(direct)).load() if direct else spark.createDataFrame([], CELLS)
    through = [s for s in found if store_name(s[0]) not in ARROW_STORES]
    if not through:
        return cells

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, number, name = (batch[c][k].as_py() for c in ("path", "sheet_no", "sheet"))
                yield from _batches(path, number, name, io.BytesIO(batch["content"][k].as_py()))

    chosen = spark.createDataFrame(through, "path string, sheet_no int, sheet string")
    return cells.unionByName(_books(listing).select("path", "content").join(F.broadcast(chosen), "path").mapInArrow(read, CELLS))


def read_workbooks(
    listing: DataFrame,
    sheet: str | int = 0,
    skip_rows: int = 0,
    header_row: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """Rows of one sheet per workbook as (file_id, row_id, cells), the header row being row 0."""
    cells = workbook_cells(listing, sheet).filter(F.col("row_id") >= skip_rows + header_row)
    cells = cells.withColumn("row_id", F.col("row_id") - (skip_rows + header_row))
    if max_rows is not None:
        cells = cells.filter(F.col("row_id") <= max_rows)
    # A row is as wide as a sheet can be: a fixed number of columns.
    entries = F.map_from_entries(F.collect_list(F.struct("position", "value")))
    rows = cells.groupBy("file_id", "row_id").agg(entries.alias("at"), F.max("position").alias("last"))
    return rows.select(
        "file_id", "row_id",
        F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.try_element_at("at", i)).alias("cells"),
    )
