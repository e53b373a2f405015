"""Any DataFrame as a sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions.cells import EMPTY, text_of
from rowsmith.operators.validate import Sheet
from rowsmith.plans.headers import detect_header, header_names
from rowsmith.plans.model import Problem
from rowsmith.sources.xlsx import FORMULA_ROWS, Workbook, count_rows, formula_gaps, read_sheet, sampled_date_columns, typed_rows


def from_frame(df: DataFrame, row_num: Column, columns: list[str] | None = None, name: str = "sheet", texts: bool = False) -> Sheet:
    """Columns become raw text; row_num must be a stable number of each row, such as one from a key.

    Columns that no mapping uses are never read: each cell is a column of its own, so scans are pruned.

    texts: string columns are taken as texts as they stand, where else they are typed as a spreadsheet's cells are.
    """
    names = columns or df.columns
    types = dict(df.dtypes)
    raw = [(F.when(F.col(f"`{c}`"), "TRUE").otherwise("FALSE") if t == "boolean" else F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, (c, t) in enumerate((c, types[c]) for c in names)]
    plain = frozenset(i for i, c in enumerate(names) if texts and types[c] == "string")
    return Sheet(df.select(row_num.cast("long").alias("row_num"), *raw), names, name=name, texts=plain)


def from_workbook(spark, path: str, sheet: str = "", header_row: int | None = None, data_start: int | None = None, whole_columns: bool = False) -> Sheet:
    """A workbook's sheet: the header row is guessed if not given.  Dates are told by each cell's own style.

    whole_columns: dates are told by column instead: where one of the first rows has a date, all numbers are read as dates.

    Formulas without a stored value in the first rows, whose cells read as blanks, are a problem of the sheet (W204).
    """
    book = Workbook.open(path)
    df = read_sheet(spark, path, sheet)
    typed = typed_rows(df, book.date1904)
    header_row = header_row or detect_header(typed).row
    found = typed.where(F.col("row_num") == header_row).select(F.transform("cells", lambda c: F.when(c["kind"] == EMPTY, "").otherwise(text_of(c))).alias("t")).first()
    if found is None:
        raise ValueError(f"the sheet has no row {header_row}")
    headers = header_names(found["t"])
    start, (_, last) = data_start or header_row + 1, count_rows(df)
    body = df.where(F.col("row_num").between(start, last))
    cells = [F.get("cells", F.lit(i)) for i in range(len(headers))]
    dates = frozenset(sampled_date_columns(df, start) if whole_columns else range(len(headers)))
    marks = [] if whole_columns else [c["is_date"].alias(f"d{i}") for i, c in enumerate(cells)]
    return Sheet(body.select("row_num", *[c["raw"].alias(f"c{i}") for i, c in enumerate(cells)], *marks), headers, dates, book.date1904, sheet or next(iter(book.sheets)), uncalculated(df, start, headers))


def uncalculated(df: DataFrame, start: int, headers: list[str]) -> tuple[Problem, ...]:
    n, first = formula_gaps(df, start, len(headers)).agg(F.count("*"), F.min(F.struct("row_num", "column", "ref"))).first()
    if not n:
        return ()
    message = f"{n} formula cells in the first {FORMULA_ROWS} rows have no stored value, the first is {first['ref']}"
    return (Problem("W204", message, "recalculate and save the workbook: these cells are read as blanks", headers[first["column"]], severity="warning"),)
