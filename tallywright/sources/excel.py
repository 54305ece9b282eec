"""Excel workbooks as a Spark data source: the first sheet, in ranges of rows.

A workbook is an archive of XML, which cannot be entered in the middle: every task streams
the sheet up to the end of its own rows and parses those only, and of the shared strings it
keeps the ones that its rows name. Nothing but the header row comes to the driver.
"""

from __future__ import annotations

import math
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sheet rows of a task.
ROWS_PER_TASK = 50_000
#: Rows whose shared strings are looked up at once.
BATCH = 10_000
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def workbooks(path: str) -> list[str]:
    """The workbook that a path names, or those of a folder in the order of their names."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    prefix = path[:len(path) - len(at)] if path.endswith(at) else "file://"
    if where.get_file_info(at).type == fs.FileType.Directory:
        return [prefix + f.path for f in sorted(where.get_file_info(fs.FileSelector(at)), key=lambda f: f.path) if f.path.lower().endswith((".xlsx", ".xlsm"))]
    return [prefix + at]


def _archive(path: str) -> zipfile.ZipFile:
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return zipfile.ZipFile(where.open_input_file(at))


def first_sheet(book: zipfile.ZipFile) -> str:
    """The archive's name of the sheet that the workbook lists first."""
    sheet = ElementTree.fromstring(book.read("xl/workbook.xml")).find(f"{_MAIN}sheets/{_MAIN}sheet")
    for link in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if link.get("Id") == sheet.get(f"{_REL}id"):
            return link.get("Target").lstrip("/") if link.get("Target").startswith("/") else f"xl/{link.get('Target')}"
    raise ValueError("the workbook does not say where its first sheet lies")


def _number(text: str) -> str:
    """A stored number as it reads: no decimals where there are none."""
    value = float(text)
    return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value) if math.isfinite(value) else text


def column_of(reference: str) -> int:
    """``C7`` is column 2."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


def _text_of(element) -> str:
    """The text of a string item, of all its runs; phonetic hints are not part of it."""
    return "".join(t.text or "" for part in element if part.tag != f"{_MAIN}rPh" for t in ([part] if part.tag == f"{_MAIN}t" else part.iter(f"{_MAIN}t")))


def _rows(book: zipfile.ZipFile, first: int, last: float) -> Iterator[tuple[int, dict[int, str | int]]]:
    """(row number, {column: text, or the number of a shared string}) of the rows from first to last."""
    at = 0
    with book.open(first_sheet(book)) as sheet:
        stack = []
        for event, element in ElementTree.iterparse(sheet, ("start", "end")):
            if event == "start":
                stack.append(element)
                continue
            stack.pop()
            if element.tag != f"{_MAIN}row":
                continue
            at = int(element.get("r", at + 1))
            if at > last:
                return
            if at >= first:
                cells, place = {}, -1
                for c in element:
                    place = column_of(c.get("r")) if c.get("r") else place + 1
                    kind, value = c.get("t", "n"), c.find(f"{_MAIN}v")
                    if kind == "inlineStr":
                        text = c.find(f"{_MAIN}is")
                        cells[place] = "" if text is None else _text_of(text)
                    elif value is not None and value.text is not None and kind != "e":
                        cells[place] = int(value.text) if kind == "s" else ("true" if value.text == "1" else "false") if kind == "b" else _number(value.text) if kind == "n" else value.text
                yield at, cells
            element.clear()
            if stack:
                stack[-1].remove(element)  # else the parent keeps every row that was read


def _with_strings(book: zipfile.ZipFile, rows: list[tuple[int, dict]]) -> list[dict[int, str]]:
    """The rows with their shared strings, read as a stream of which only those named are kept."""
    wanted = {v for _, cells in rows for v in cells.values() if isinstance(v, int)}
    found: dict[int, str] = {}
    if wanted:
        with book.open("xl/sharedStrings.xml") as strings:
            n, root = 0, None
            for event, element in ElementTree.iterparse(strings, ("start", "end")):
                root = element if root is None else root
                if event == "end" and element.tag == f"{_MAIN}si":
                    if n in wanted:
                        found[n] = _text_of(element)
                    n += 1
                    root.clear()
                    if len(found) == len(wanted):
                        break
    return [{k: found[v] if isinstance(v, int) else v for k, v in cells.items()} for _, cells in rows]


def header_of(path: str) -> tuple[int, int, list[str]]:
    """(row of the header, its first column, names) of a workbook: the first row that holds a value.

    Blank headers are ``__EMPTY``; a name that comes again gets a number.
    """
    with _archive(path) as book:
        for at, cells in _rows(book, 1, math.inf):
            if cells:
                texts = _with_strings(book, [(at, cells)])[0]
                low, names = min(texts), []
                for i in range(low, max(texts) + 1):
                    base = name = texts.get(i) or "__EMPTY"
                    again = 0
                    while name in names:
                        again += 1
                        name = f"{base}_{again}"
                    names.append(name)
                return at, low, names
    return 0, 0, []


class Range(InputPartition):
    def __init__(self, path: str, first: int, last: float, columns: list[int]):
        super().__init__((path, first, last, columns))


class ExcelReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.names = options["path"], names
        self.step = int(options.get("rowspertask", str(ROWS_PER_TASK)))

    def partitions(self) -> list[Range]:
        out = []
        for path in workbooks(self.path):
            top, low, own = header_of(path)
            with _archive(path) as book, book.open(first_sheet(book)) as sheet:
                said = re.search(rb'<dimension ref="[A-Z]+[0-9]+:[A-Z]+([0-9]+)"', sheet.read(4096))
            # the last range is open, whatever the sheet says of its size
            firsts = list(range(top + 1, max(top + 1, int(said[1]) if said else 0) + 1, self.step))
            columns = [low + own.index(n) if n in own else -1 for n in self.names]
            out += [Range(path, a, b - 1, columns) for a, b in zip(firsts, [*firsts[1:], math.inf])]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        path, first, last, columns = partition.value
        with _archive(path) as book:
            batch: list[tuple[int, dict]] = []

            def told() -> Iterator[tuple]:
                for cells in _with_strings(book, batch):
                    yield tuple(cells.get(c, "") for c in columns)

            for row in _rows(book, first, last):
                if row[1]:  # rows without a cell that holds a value are no rows
                    batch.append(row)
                if len(batch) == BATCH:
                    yield from told()
                    batch.clear()
            yield from told()


class ExcelSource(DataSource):
    """Options: path of a workbook or of a folder of workbooks with one header, rowsPerTask."""

    @classmethod
    def name(cls) -> str:
        return "excel"

    def _names(self) -> list[str]:
        names: list[str] = []
        for path in workbooks(dict(self.options)["path"])[:1]:
            names = header_of(path)[2]
        return names

    def schema(self) -> str:
        return ", ".join(f"`{name.replace('`', '``')}` string" for name in self._names() or ["__EMPTY"])

    def reader(self, schema) -> ExcelReader:
        return ExcelReader({k.lower(): v for k, v in dict(self.options).items()}, schema.fieldNames())


def read_excel(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rows of the first sheet below its header, every cell as text, missing ones empty.

    Dates are the serial numbers that a sheet stores, booleans ``true`` and ``false``, errors
    empty. Rows without any value are left out.
    """
    spark.dataSource.register(ExcelSource)
    return spark.read.format("excel").option("path", path).option("rowsPerTask", str(rows_per_task)).load()
