"""Text normalisation, quoting and naming, as Column builders with plain-Python twins where names need them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spaces that spreadsheets hide in text become a blank, zero-width signs go.
SPACES = "    　  "
ZERO_WIDTH = "​‌‍﻿"
#: Joins the parts of a composite key or of headers.
SEPARATOR = "\x1f"
WHITE = r"\p{IsWhite_Space}"
# The characters of that class.
WHITE_CHARACTERS = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Parts of column names that hint at personal data.
PERSONAL = [
    "email", "mail", "phone", "tel", "mobile", "name", "address", "addr",
    "national", "nid", "ssn", "passport", "birth", "dob", "iban", "card",
    "salary", "gender", "religion",
]


def normalize_invisible(s: Column) -> Column:
    """Exotic spaces to blanks, zero-width signs removed; no trimming."""
    return F.translate(s, SPACES + ZERO_WIDTH, " " * len(SPACES))


def trimmed(s: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(s, F.lit(WHITE_CHARACTERS))


def normalize_key(s: Column) -> Column:
    return trimmed(normalize_invisible(s))


def normalize_header(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(normalize_invisible(s), f"{WHITE}+", " ")))


def header_key(name: str) -> str:
    """normalize_header for a driver-side name."""
    table = {ord(c): " " for c in SPACES} | {ord(c): None for c in ZERO_WIDTH}
    return " ".join(name.translate(table).split()).lower()


def strip_non_digits(s: Column) -> Column:
    """Digits, and a plus sign that comes before any digit."""
    digits = F.regexp_replace(s, r"[^\p{Nd}]", "")
    return F.when(s.rlike(r"^[^\p{Nd}+]*\+"), F.concat(F.lit("+"), digits)).otherwise(digits)


def shortened(s: Column, limit: int = 100) -> Column:
    """The first code points, with an ellipsis if more were there."""
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit), F.lit("…"))).otherwise(s)


def quote_literal(s: Column, conforming: bool = True) -> Column:
    """A SQL string literal; where backslashes escape, the E form is used for texts that have any."""
    quoted = F.replace(s, F.lit("'"), F.lit("''"))
    plain = F.concat(F.lit("'"), quoted, F.lit("'"))
    if conforming:
        return plain
    escaped = F.concat(F.lit(" E'"), F.replace(quoted, F.lit("\\"), F.lit("\\\\")), F.lit("'"))
    return F.when(F.instr(s, "\\") > 0, escaped).otherwise(plain)


def quote_literal_text(s: str) -> str:
    """quote_literal for driver-side text; NUL must have been refused before."""
    if "\x00" in s:
        raise ValueError("NUL byte in a string literal")
    return "'" + s.replace("'", "''") + "'"


def quote_identifier(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def qualified(schema: str, name: str) -> str:
    return quote_identifier(name) if not schema else f"{quote_identifier(schema)}.{quote_identifier(name)}"


def quote_comment(s: str) -> str:
    """Text for one comment line."""
    return re.sub(r"\r\n|\n|\r", " ", s).replace("\x00", "").encode("utf-8", "replace").decode()


def copy_field(s: Column) -> Column:
    """A field of COPY's text format; null is \\N."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for sign, name in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.coalesce(out, F.lit("\\N"))


def enum_cast(schema: str, name: str) -> str:
    return "::" + qualified(schema, name)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def personal_data(names: Column) -> Column:
    """Whether a column's name hints at personal data."""
    return F.lower(names).rlike("|".join(PERSONAL))


def column_letter(index: int) -> str:
    """0 is A, 26 is AA; negative ones have none."""
    out = ""
    while index >= 0:
        out = chr(65 + index % 26) + out
        index = index // 26 - 1
    return out


def cell_ref(index: int, row: Column) -> Column:
    return F.concat(F.lit(column_letter(index)), row.cast("string"))


def fingerprint(headers: Column) -> Column:
    """Of an array of header names."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform(headers, normalize_header), SEPARATOR), 256))


def slug(name: str, table: str, extension: str) -> str:
    """A file name from a title, or else from a table."""
    part = re.sub(r"[^a-z0-9]+", "-", (name or table).lower()).strip("-")
    return f"{part or 'import'}{extension}"


def byte_size(n: int) -> str:
    for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
        if n >= size:
            return f"{n / size:.1f} {unit}"
    return f"{n} B"
