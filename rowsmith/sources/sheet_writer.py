"""A minimal workbook writer, for issue reports: bounded lists, so written by the driver."""

from __future__ import annotations

import csv
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from rowsmith.functions.text import column_letter

# The columns of an issue report.
TITLES = ["Severity", "Code", "Excel row", "Excel cell", "Sheet column", "Table column", "Value", "Problem", "Suggested fix"]
FIELDS = ["severity", "code", "excel_row", "excel_ref", "excel_column", "db_column", "value", "message", "hint"]
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_xlsx(path: str, sheet: str, titles: list[str], rows: Iterable[list], date_columns: frozenset[int] = frozenset()) -> None:
    """Bold titles in a frozen row with a filter; numbers as numbers, in date columns with a date format, all else as text."""

    def cell(r: int, c: int, v: object, style: int = 0) -> str:
        ref, s = f"{column_letter(c)}{r}", f' s="{style}"' if style else ""
        if v is None or v == "":
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}"{s} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"{s}><v>{v}</v></c>'
        text = escape("".join(ch for ch in str(v) if ch >= " " or ch in "\t\n"))
        return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'

    body, last = [], 1
    body.append('<row r="1">' + "".join(cell(1, c, t, 1) for c, t in enumerate(titles)) + "</row>")
    for last, row in enumerate(rows, 2):
        body.append(f'<row r="{last}">' + "".join(cell(last, c, v, 2 if c in date_columns and not isinstance(v, str) else 0) for c, v in enumerate(row)) + "</row>")
    view = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>'
    files = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
        '<Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {NS}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
        '<cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="0" fontId="1" applyFont="1"/><xf numFmtId="14" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {NS}>{view}<sheetData>{"".join(body)}</sheetData><autoFilter ref="A1:{column_letter(len(titles) - 1)}{last}"/></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text if name.startswith("[") else '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)


def write_issues_xlsx(issues: DataFrame, path: str) -> None:
    write_xlsx(path, "Issues", TITLES, ([r[f] for f in FIELDS] for r in issues.select(*FIELDS).toLocalIterator()))


def write_issues_csv(issues: DataFrame, path: str) -> None:
    """With a byte order mark, for spreadsheet programs."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(TITLES)
        out.writerows(["" if r[x] is None else r[x] for x in FIELDS] for r in issues.select(*FIELDS).toLocalIterator())
