"""The chain of per-column transforms, in its fixed order, as one expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.functions.cells import BOOL, DATE, EMPTY, ERROR, NUMBER, STRING, text_of
from rowsmith.functions.text import header_key, normalize_invisible, normalize_key, strip_non_digits, trimmed
from rowsmith.plans.model import TEMPORAL, Transform

# Words read as true and as false when a column has no words of its own.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "oui", "vrai", "actif", "نعم", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "non", "faux", "inactif", "لا", "off"]
# Date layouts tried in order, as patterns; a fraction of a second may follow seconds.
LAYOUTS = [
    "yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd H:mm:ss[.SSSSSS]", "yyyy-MM-dd'T'H:mm:ss[.SSSSSS]",
    "dd/MM/yyyy H:mm", "dd/MM/yyyy H:mm:ss[.SSSSSS]", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy",
]


#: What the letters of a layout look like, and the part of an ISO text that each is.
SHAPES = {"yyyy": r"(\d{4})", "MM": r"(0[1-9]|1[0-2])", "dd": r"(\d{2})", "d": r"(\d{1,2})", "HH": r"(\d{2})", "H": r"(\d{1,2})", "mm": r"(\d{2})", "ss": r"(\d{2})", "XXX": r"(Z|[+-]\d{2}:\d{2})"}
PARTS = {"yyyy": "year", "MM": "month", "dd": "day", "d": "day", "HH": "hour", "H": "hour", "mm": "minute", "ss": "second", "XXX": "zone"}
#: Stands before an ISO text that a rule has made, without and with a zone; no layout's text begins so.
MADE, ZONED = "=", "~"
#: Layouts with a month's name: groups for day, name and year.
NAMED = {("d MMMM yyyy", "d MMM yyyy"): r"^(?<d>\d{1,2}) (?<m>\p{L}+) (?<y>\d{4})$", ("MMMM d, yyyy", "MMM d, yyyy"): r"^(?<m>\p{L}+) (?<d>\d{1,2}), (?<y>\d{4})$"}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
MONTH_NUMBERS = {name[:n]: f"{k:02d}" for k, name in enumerate(MONTHS, 1) for n in (3, len(name))}


def iso_rule(layout: str) -> tuple[str, str] | None:
    """A pattern that the texts of a layout have, and the replacement that makes one an ISO text; none for layouts of other letters."""
    pattern, part = ["^"], {}
    for quoted, optional, letters, _, sign in re.findall(r"'([^']*)'|\[\.(S+)\]|(([A-Za-z])\4*)|(.)", layout):
        if letters and letters not in SHAPES:
            return None
        if letters or optional:
            part["fraction" if optional else PARTS[letters]] = f"${len(part) + 1}"
        pattern.append(SHAPES[letters] if letters else rf"(\.\d{{1,{len(optional)}}})?" if optional else re.escape(quoted or sign))
    day = f"{part.get('year', '1970')}-{part.get('month', '01')}-{part.get('day', '01')}"
    clock = f" {part['hour']}:{part.get('minute', '00')}:{part.get('second', '00')}{part.get('fraction', '')}{part.get('zone', '')}" if "hour" in part else ""
    return "".join([*pattern, "$"]), (ZONED if "zone" in part else MADE) + day + clock


def parsed(s: Column, layouts: list[str]) -> Column:
    """The first layout's reading as a naive timestamp, or null.

    Layouts of digits, and those of a month's English name where its long and short form are both allowed, are rules
    that rewrite a text of their shape to an ISO text, which one cast reads; an attempt for each layout would cost far
    more.  Of layouts of one shape the earlier takes what it can.  With any other layout among them all are tried in turn.
    """
    pairs = [pair for pair in NAMED if set(pair) <= set(layouts)]
    rules = [iso_rule(x) for x in layouts if not any(x in pair for pair in pairs)]
    if None in rules:
        return F.coalesce(*[F.try_to_timestamp(s, F.lit(x)).cast("timestamp_ntz") for x in layouts])
    out = s
    if pairs:
        numbers = F.create_map(*[F.lit(x) for kv in MONTH_NUMBERS.items() for x in kv])
        for pair in pairs:
            out = F.regexp_replace(out, NAMED[pair], MADE + "${y}-${m}-${d}")
        month = F.regexp_extract(out, r"^=\d{4}-(\p{L}+)-", 1)
        out = F.when(F.startswith(out, F.lit(MADE)), F.replace(out, month, F.coalesce(F.try_element_at(numbers, F.lower(month)), month))).otherwise(out)
    for pattern, iso in rules:
        out = F.regexp_replace(out, pattern, iso)
    read = F.when(F.startswith(out, F.lit(MADE)), F.substr(out, F.lit(2)).try_cast("timestamp_ntz"))
    if any("XXX" in x for x in layouts):
        read = read.when(F.startswith(out, F.lit(ZONED)), F.substr(out, F.lit(2)).try_cast("timestamp").cast("timestamp_ntz"))
    return read


def mapped(s: Column, words: dict[str, str]) -> Column:
    """A word's replacement by its key, exactly or else without case; others pass."""
    key = normalize_key(s)
    exact = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    loose = F.create_map(*[F.lit(x) for k, v in words.items() for x in (k.lower(), v)])
    return F.coalesce(F.try_element_at(exact, key), F.try_element_at(loose, F.lower(key)), s)


def truth(s: Column, words: dict[str, bool]) -> Column:
    """A word read as a boolean, or null.  A column's own words replace the common ones."""
    key = F.lower(normalize_key(s))
    if words:
        return F.try_element_at(F.create_map(*[F.lit(x) for k, v in words.items() for x in (header_key(k), v)]), key)
    return F.when(key.isin(TRUE_WORDS), True).when(key.isin(FALSE_WORDS), False)


def is_textual(t: Transform, family: str) -> bool:
    """Whether a column's transforms look at cells as texts."""
    textual = t.strip_non_digits or t.trim or t.upper or t.lower or bool(t.value_map) or t.blank_as_null or bool(t.default_on_blank)
    return textual or family == "boolean" or bool(t.date_format) and family in TEMPORAL


def cut(cell: Column, t: Transform) -> Column:
    """A cell's text after stripping and trimming."""
    s = text_of(cell)
    if t.strip_non_digits:
        s = strip_non_digits(s)
    return trimmed(normalize_invisible(s)) if t.trim else s


def replaced(s: Column, t: Transform) -> Column:
    """A cut text after defaults, case and value map."""
    if t.default_on_blank:
        s = F.when(trimmed(s) == "", F.lit(t.default_on_blank)).otherwise(s)
    if t.upper:
        s = F.upper(s)
    if t.lower:
        s = F.lower(s)
    return mapped(s, t.value_map) if t.value_map else s


def moment(s: Column, t: Transform) -> Column:
    """A replaced text read as a date."""
    return parsed(normalize_key(s), [t.date_format] if t.date_format else LAYOUTS)


def apply(cell: Column, t: Transform, family: str, at_hand: dict[str, Column] | None = None) -> Column:
    """struct(kind, str, num, bool, ts, raw, date_failed) of a cell after its transforms.

    at_hand: what a caller holds as columns already, of `cut`, `replaced` and `moment`.
    """
    kind, at_hand = cell["kind"], at_hand or {}
    none = F.lit(None)

    def out(kind: Column, s: Column = none, num: Column = none, b: Column = none, ts: Column = none, failed: Column = F.lit(False)) -> Column:
        return F.struct(
            kind.alias("kind"), s.cast("string").alias("str"), num.cast("decimal(38,18)").alias("num"), b.cast("boolean").alias("bool"),
            ts.cast("timestamp_ntz").alias("ts"), cell["raw"].alias("raw"), failed.alias("date_failed"),
        )

    same = out(kind, cell["str"], cell["num"], cell["bool"], cell["ts"])
    if not is_textual(t, family):
        return same
    before = at_hand["cut"] if "cut" in at_hand else cut(cell, t)
    s = at_hand["replaced"] if "replaced" in at_hand else replaced(before, t)
    was_blank = trimmed(before) == ""
    blank = F.lit(False) if t.default_on_blank else was_blank
    is_number = (kind == NUMBER) & F.lit(not t.strip_non_digits)
    failed = F.lit(False)
    result = F.when((kind == ERROR) | (kind == DATE), same)
    if t.blank_as_null:
        result = result.when(was_blank, out(F.lit(EMPTY)))
    if family == "boolean":
        b = truth(s, t.bool_map)
        result = result.when(b.isNotNull(), out(F.lit(BOOL), b=b)).when(kind == BOOL, same)
    if family in TEMPORAL:
        ts = at_hand["moment"] if "moment" in at_hand else moment(s, t)
        result = result.when(ts.isNotNull(), out(F.lit(DATE), ts=ts))
        failed = normalize_key(s) != ""
    result = result.when(blank & (kind == EMPTY), out(F.lit(EMPTY), failed=failed))
    return result.otherwise(out(F.when(is_number, NUMBER).otherwise(STRING), s, F.when(is_number, cell["num"]), failed=failed))
