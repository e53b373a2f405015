"""Spreadsheet files as a Spark data source: spark.read.format("rowsmith_xlsx").option("sheet", ...).load(path).

Rows are (row_num, cells), a cell being (raw, is_date, formula): the stored text, whether its number format
shows a date or time, and its formula.  A zip member cannot be split, so a sheet is read by one task; every
file of a path with a pattern is a task of its own.  A path is local, or a URI of a store that pyarrow knows.
Files are refused that are no zip, say that they hold more than 2 GB or are packed more than 50 times, or turn
out to while they are read.  A sheet is read as a stream: what is held is a row, and the strings that cells share.
"""

from __future__ import annotations

import contextlib
import fnmatch
import io
import os
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

from pyarrow import ArrowInvalid
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rowsmith.functions.cells import is_date_format, looks_numeric, looks_temporal, typed
from rowsmith.functions.text import column_letter

MAX_BYTES, MAX_RATIO, MAX_COLUMNS = 2 << 30, 50, 1024
#: Rows beyond which merged ranges and formula gaps are not looked for, unless asked.
RANDOM_ACCESS_ROWS, FORMULA_ROWS, FORMULA_SIGNS = 5000, 50, 60
SAMPLE_ROWS = 20
SCHEMA = "row_num long, cells array<struct<raw:string,is_date:boolean,formula:string>>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class UnsafeWorkbook(ValueError):
    pass


def stored(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a local path or a URI."""
    if "://" in path and not path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def matching(path: str) -> list[str]:
    """The files of a path whose last part may be a pattern; the path itself if there are none."""
    if not any(c in path for c in "*?["):
        return [path]
    disk, at = stored(path)
    folder, _, pattern = at.rpartition("/")
    head = path[: len(path) - len(pattern)]
    names = [f.base_name for f in disk.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.File]
    return [head + n for n in sorted(names) if fnmatch.fnmatchcase(n, pattern)] or [path]


@contextlib.contextmanager
def archive(path: str) -> Iterator[zipfile.ZipFile]:
    disk, at = stored(path)
    local = isinstance(disk, pafs.LocalFileSystem)
    with open(at, "rb") if local else disk.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        yield z


class Bounded(io.RawIOBase):
    """A member read as far as the limit, whatever size it claims."""

    def __init__(self, member, limit: int = MAX_BYTES):
        self.member, self.left = member, limit

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.member.read(len(buffer))
        self.left -= len(data)
        if self.left < 0:
            raise UnsafeWorkbook("a part unpacks to more than it says")
        buffer[: len(data)] = data
        return len(data)


def elements(z: zipfile.ZipFile, member: str, *tags: str) -> Iterator[ET.Element]:
    """The elements of these tags of a member, each dropped with all before it once the next is asked for."""
    with z.open(member) as f:
        parents: list[ET.Element] = []
        for event, e in ET.iterparse(io.BufferedReader(Bounded(f)), ("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag in tags:
                yield e
                if parents:
                    parents[-1].clear()


def check_archive(path: str) -> None:
    try:
        with archive(path) as z:
            total, packed = sum(i.file_size for i in z.infolist()), sum(i.compress_size for i in z.infolist())
    except (zipfile.BadZipFile, ArrowInvalid):
        raise UnsafeWorkbook(f"{path} is not a workbook") from None
    if total > MAX_BYTES or packed and total // packed > MAX_RATIO:
        raise UnsafeWorkbook(f"{path} unpacks to {total} bytes from {packed}")


@dataclass
class Workbook:
    """What a workbook says of itself."""

    sheets: dict[str, str]  # member by name, in order
    date1904: bool
    date_styles: frozenset[int]
    strings: list[str]

    @classmethod
    def open(cls, path: str) -> Workbook:
        check_archive(path)
        with archive(path) as z:
            names = set(z.namelist())
            book = ET.fromstring(z.read("xl/workbook.xml"))
            targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
            member = lambda t: t.lstrip("/") if t.startswith("/") else "xl/" + t
            sheets = {s.get("name"): member(targets[s.get(RELATION)]) for s in book.iter(MAIN + "sheet")}
            properties = book.find(MAIN + "workbookPr")
            styles: set[int] = set()
            if "xl/styles.xml" in names:
                root = ET.fromstring(z.read("xl/styles.xml"))
                codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(MAIN + "numFmt")}
                formats = root.find(MAIN + "cellXfs")
                for k, x in enumerate(formats if formats is not None else []):
                    n = int(x.get("numFmtId", 0))
                    if is_date_format(n, codes.get(n, "")):
                        styles.add(k)
            strings = []
            if "xl/sharedStrings.xml" in names:
                strings = ["".join(t.text or "" for t in s.iter(MAIN + "t")) for s in elements(z, "xl/sharedStrings.xml", MAIN + "si")]
        flag = properties is not None and properties.get("date1904", "0") in ("1", "true")
        return cls(sheets, flag, frozenset(styles), strings)


def place(ref: str) -> int:
    """The column of a reference such as AB12."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def rows(path: str, book: Workbook, sheet: str) -> Iterator[tuple[int, list[tuple]]]:
    """(row_num, cells) in order, reading the sheet as a stream."""
    with archive(path) as z:
        last = 0
        for e in elements(z, book.sheets[sheet], MAIN + "row"):
            last = int(e.get("r", last + 1))
            cells: list[tuple] = []
            for c in e.iter(MAIN + "c"):
                at = place(c.get("r")) if c.get("r") else len(cells)
                if at >= MAX_COLUMNS:
                    break
                cells += [("", False, None)] * (at - len(cells))
                kind, v, formula = c.get("t", "n"), c.find(MAIN + "v"), c.find(MAIN + "f")
                raw = (v.text or "") if v is not None else ""
                if kind == "s" and raw:
                    raw = book.strings[int(raw)]
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in c.iter(MAIN + "t"))
                elif kind == "b":
                    raw = "TRUE" if raw == "1" else "FALSE"
                cells.append((raw, kind == "n" and int(c.get("s", 0)) in book.date_styles, (formula.text or "") if formula is not None else None))
            yield last, cells


@dataclass
class File(InputPartition):
    path: str


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[File]:
        return [File(p) for p in matching(self.options["path"])]

    def read(self, partition: File) -> Iterator[tuple]:
        book = Workbook.open(partition.path)
        sheet = self.options.get("sheet") or next(iter(book.sheets))
        start = int(self.options.get("startrow", self.options.get("startRow", 1)))
        for number, cells in rows(partition.path, book, sheet):
            if number >= start:
                yield number, cells


class XlsxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowsmith_xlsx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> XlsxReader:
        return XlsxReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def read_sheet(spark: SparkSession, path: str, sheet: str = "", start: int = 1) -> DataFrame:
    register(spark)
    return spark.read.format("rowsmith_xlsx").option("sheet", sheet).option("startRow", start).load(path)


def typed_rows(df: DataFrame, date1904: bool = False) -> DataFrame:
    """(row_num, cells) with every cell typed."""
    return df.select("row_num", F.transform("cells", lambda c: typed(c["raw"], c["is_date"], date1904)).alias("cells"))


def _filled(df: DataFrame) -> F.Column:
    return F.exists("cells", lambda c: F.trim(F.coalesce(c["raw"], F.lit(""))) != "")


def count_rows(df: DataFrame) -> tuple[int, int]:
    """The last row, and the last that is not blank."""
    r = df.agg(F.max("row_num"), F.max(F.when(_filled(df), F.col("row_num")))).first()
    return r[0] or 0, r[1] or 0


def preview(df: DataFrame, start: int, n: int) -> DataFrame:
    return df.where(F.col("row_num") >= start).orderBy("row_num").limit(n)


def sampled_date_columns(df: DataFrame, start: int) -> list[int]:
    """Places read as dates by a sample, for sheets whose cells have no styles: numbers that are shown as a date somewhere."""
    cells = df.where(F.col("row_num").between(start, start + SAMPLE_ROWS - 1)).select(F.posexplode("cells").alias("at", "c"))
    by = cells.groupBy("at").agg(F.bool_or(F.col("c.is_date") & looks_numeric(F.col("c.raw")) | looks_temporal(F.col("c.raw")) & F.col("c.is_date")).alias("d"))
    return sorted(r["at"] for r in by.where("d").collect())


def formula_gaps(df: DataFrame, start: int, columns: int, most: int = FORMULA_ROWS) -> DataFrame:
    """Formulas without a stored value: row_num, column, ref, formula."""
    cells = df.where(F.col("row_num").between(start, start + most - 1)).select("row_num", F.posexplode("cells").alias("column", "c"))
    text = F.col("c.formula")
    short = F.when(F.length(text) > FORMULA_SIGNS, F.concat(F.substring(text, 1, FORMULA_SIGNS), F.lit("…"))).otherwise(text)
    letters = F.lit([column_letter(i) for i in range(columns)]) if columns else F.array().cast("array<string>")
    gaps = cells.where(text.isNotNull() & (F.coalesce("c.raw", F.lit("")) == "") & (F.col("column") < columns))
    return gaps.select("row_num", "column", F.concat(F.get(letters, F.col("column")), F.col("row_num").cast("string")).alias("ref"), F.concat(F.lit("="), short).alias("formula"))


def random_access_affordable(n_rows: int) -> bool:
    return 0 < n_rows <= RANDOM_ACCESS_ROWS


def merged_ranges(path: str, sheet: str, n_rows: int | None = None) -> tuple[list[str], bool]:
    """Merged ranges, and whether they were looked for: only in sheets of few rows if their number is given."""
    if n_rows is not None and not random_access_affordable(n_rows):
        return [], False
    book = Workbook.open(path)
    with archive(path) as z:
        out = [e.get("ref") for e in elements(z, book.sheets[sheet], MAIN + "row", MAIN + "mergeCell") if e.tag == MAIN + "mergeCell"]
    return out, True
