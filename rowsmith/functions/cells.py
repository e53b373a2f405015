"""Typing of raw cell text: struct(kind, str, num, bool, ts, raw)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.text import normalize_invisible, shortened, trimmed

EMPTY, STRING, NUMBER, BOOL, DATE, ERROR = "empty", "string", "number", "bool", "date", "error"
CELL = "struct<kind:string,str:string,num:decimal(38,18),bool:boolean,ts:timestamp_ntz,raw:string>"
NUM = "decimal(38,18)"

# Error tokens of spreadsheets.
ERROR_TOKENS = [
    "#N/A", "#REF!", "#DIV/0!", "#VALUE!", "#NAME?", "#NULL!", "#NUM!", "#GETTING_DATA",
    "#SPILL!", "#CALC!", "#CONNECT!", "#BLOCKED!", "#UNKNOWN!", "#FIELD!", "#EXTERNAL_ERROR!",
]
# Ids of built-in number formats that show dates or times.
DATE_FORMAT_IDS = [14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47]
PHANTOM_SERIAL = 60
PHANTOM = "serial 60, which names a leap day that 1900 did not have"
SIGNIFICANT = 15
#: Day numbers that a timestamp can hold, from the first day that the server keeps; a date beyond has no ts.
FIRST_SERIAL, LAST_SERIAL = -2_415_018, 106_700_000


def looks_numeric(s: Column) -> Column:
    return s.rlike(r"^[0-9.eE+\-]+$")


def looks_temporal(s: Column) -> Column:
    """Displayed text with a day-month-year, a time of day or a month's name."""
    return s.rlike(r"(?i)\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}:\d{2}|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")


def to_number(s: Column) -> Column:
    """A decimal, or null if the text is none; more than 20 integer digits are beyond the working type and give null."""
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast(NUM))


def number_text(num: Column) -> Column:
    """Without padding zeros."""
    s = num.cast("string")
    plain = F.when(F.instr(s, ".") > 0, F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
    return F.when(num == 0, F.lit("0")).otherwise(plain)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, where an expression would otherwise repeat it in every branch."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def recovered(num: Column) -> Column:
    """Fractions of more than 15 significant digits rounded to 15, half away from zero; integers as they are.

    The places to keep follow from the power of ten below the number, so this is one rounding of a decimal and no text is made.
    """
    size = F.abs(num)
    good = F.when(size < F.lit("0.001").cast(NUM), num)  # its 18 places hold no more than 15 digits
    for power in range(-2, SIGNIFICANT):
        good = good.when(size < F.lit(f"1e{power}").cast(NUM), F.round(num, SIGNIFICANT - power).try_cast(NUM))
    return F.coalesce(good.otherwise(F.round(num, 0).try_cast(NUM)), num)


def from_serial(serial: Column, date1904: bool = False) -> Column:
    """A spreadsheet's day number, with its fraction as the time of day, to the second."""
    days = F.floor(serial).cast("int")
    seconds = F.round((serial - F.floor(serial)) * 86400, 0).cast("int")
    if date1904:
        start = F.lit("1904-01-01")
    else:  # before the phantom day the count is one short
        start = F.when(serial < PHANTOM_SERIAL, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30"))
    return (start.cast("timestamp_ntz") + F.make_dt_interval(days, F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))).cast("timestamp_ntz")


def typed(raw: Column, is_date: Column | bool = False, date1904: bool = False) -> Column:
    """The cell of a raw text; is_date says that numbers are to be read as dates."""
    raw = F.coalesce(raw.cast("string"), F.lit(""))
    as_date = is_date if isinstance(is_date, Column) else F.lit(is_date)
    return let(normalize_invisible(raw), lambda norm: let(to_number(trimmed(norm)), lambda num: assembled(raw, norm, trimmed(norm), num, recovered(num), as_date, date1904)))


def assembled(raw: Column, norm: Column, cut: Column, num: Column, good: Column, is_date: Column, date1904: bool) -> Column:
    """The cell from a raw text, the same normalised and trimmed, its number, and that number recovered."""
    as_date = is_date & num.isNotNull()
    phantom = as_date & F.lit(not date1904) & (num >= PHANTOM_SERIAL) & (num < PHANTOM_SERIAL + 1)
    is_bool = norm.isin("TRUE", "FALSE")
    plain = num.isNotNull() & ~as_date
    kind = (
        F.when(cut == "", EMPTY).when(phantom | cut.isin(ERROR_TOKENS), ERROR).when(is_bool, BOOL)
        .when(as_date, DATE).when(plain, NUMBER).otherwise(STRING)
    )
    text = F.when(cut == "", F.lit(None)).when(phantom, PHANTOM).when(plain & (good != num), number_text(good)).otherwise(norm)
    return F.struct(
        kind.alias("kind"), text.alias("str"), F.when(plain, good).alias("num"), F.when(is_bool, norm == "TRUE").alias("bool"),
        F.when(as_date & ~phantom & num.between(FIRST_SERIAL, LAST_SERIAL), from_serial(num, date1904)).alias("ts"), raw.alias("raw"),
    )


def as_text(s: Column) -> Column:
    """The cell of a text that is one already, as it stands: only null is blank, and nothing is read as a number, date or error."""
    none = F.lit(None)
    return F.struct(
        F.when(s.isNull(), EMPTY).otherwise(STRING).alias("kind"), s.alias("str"), none.cast(NUM).alias("num"), none.cast("boolean").alias("bool"),
        none.cast("timestamp_ntz").alias("ts"), F.coalesce(s, F.lit("")).alias("raw"),
    )


def text_of(cell: Column) -> Column:
    """What a cell says as text."""
    return (
        F.when(cell["kind"] == EMPTY, F.lit("")).when(cell["kind"] == BOOL, F.when(cell["bool"], "TRUE").otherwise("FALSE"))
        .when(cell["kind"] == DATE, F.coalesce(F.date_format(cell["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'"), cell["raw"])).when(cell["kind"] == ERROR, cell["raw"])
        .otherwise(F.coalesce(cell["str"], number_text(cell["num"])))
    )


def shown(cell: Column) -> Column:
    """For previews and reports."""
    return shortened(F.when((cell["kind"] == DATE) & cell["ts"].isNotNull(), F.date_format(cell["ts"], "yyyy-MM-dd HH:mm:ss")).otherwise(text_of(cell)))


def is_date_format(number: int, code: str = "") -> bool:
    """Whether a number format shows a date or time: by built-in id, or by its code outside quotes and brackets."""
    if number in DATE_FORMAT_IDS:
        return True
    bare = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code or "").lower()
    return any(c in bare for c in "ydh") or "m" in bare and "s" in bare
