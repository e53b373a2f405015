"""Header rows: detection, names, fingerprints and drift."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowsmith.functions.cells import EMPTY, STRING
from rowsmith.functions.text import SEPARATOR, column_letter, header_key, normalize_header

SCAN_ROWS = 20
CONTRAST, FILLED, STRINGS, UNIQUE = 0.35, 0.30, 0.20, 0.15
SPARSE, CONFIDENT, MARGIN = 0.4, 0.6, 0.15


def header_score(cells: Column, following: Column) -> Column:
    """How much a row (array of cells) looks like a header, given the row below it (null if it is the last)."""
    width = F.greatest(F.size(cells), F.coalesce(F.size(following), F.lit(0)))
    at = lambda a, i: F.coalesce(F.get(a, i)["kind"], F.lit(EMPTY))
    places = F.sequence(F.lit(0), width - 1)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    filled = F.size(F.filter(cells, lambda c: c["kind"] != EMPTY))
    strings = F.size(F.filter(cells, lambda c: c["kind"] == STRING))
    keys = F.filter(F.transform(F.filter(cells, lambda c: c["kind"] == STRING), lambda c: normalize_header(c["str"])), lambda k: k != "")
    repeated = F.size(keys) - F.size(F.array_distinct(keys))
    below = (
        lambda i: F.when(at(cells, i) != STRING, 0).when(at(following, i) == STRING, 1).when(at(following, i) == EMPTY, 0).otherwise(2)
    )
    contrast = F.when(F.coalesce(F.size(following), F.lit(0)) == 0, width).otherwise(total(F.transform(places, below)))
    unique = F.when(strings > 0, 1 - repeated / strings).otherwise(1.0)
    score = FILLED * filled / width + STRINGS * strings / width + UNIQUE * unique + CONTRAST * contrast / (2 * width)
    sparse = (width >= 3) & (filled <= F.floor(width / 3))
    return F.when(width == 0, 0.0).otherwise(F.when(sparse, score * SPARSE).otherwise(score))


@dataclass(frozen=True)
class Guess:
    row: int
    score: float
    margin: float

    @property
    def confident(self) -> bool:
        return self.score >= CONFIDENT and self.margin >= MARGIN


def header_scores(rows: DataFrame) -> DataFrame:
    """row_num and score of the first rows of (row_num, cells)."""
    first = rows.where(F.col("row_num") <= SCAN_ROWS + 1)  # so few that one task orders them
    both = first.withColumn("below", F.lead("cells").over(Window.partitionBy(F.lit(1)).orderBy("row_num")))
    return both.where(F.col("row_num") <= SCAN_ROWS).select("row_num", header_score(F.col("cells"), F.col("below")).alias("score"))


def detect_header(rows: DataFrame) -> Guess:
    """The best row and its lead over the next; of equal ones the earlier."""
    top = header_scores(rows).orderBy(F.desc("score"), "row_num").limit(2).collect()
    if not top:
        raise ValueError("the sheet is empty")
    return Guess(top[0]["row_num"], top[0]["score"], top[0]["score"] - (top[1]["score"] if len(top) > 1 else 0.0))


def header_names(texts: list[str]) -> list[str]:
    """Names of columns: blank ones by their letter, repeated ones numbered, trailing blank ones dropped."""
    out: list[str] = []
    seen: dict[str, int] = {}
    last = 0
    for i, text in enumerate(texts):
        name = " ".join((text or "").split()) and (text or "").strip()
        blank = not name
        name = name or f"(column {column_letter(i)})"
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(name if n == 1 else f"{name} ({n})")
        last = last if blank else i + 1
    return out[:last]


def numbered(names: DataFrame) -> DataFrame:
    """header_names for a DataFrame (pos, name) of non-blank names."""
    w = Window.partitionBy(F.lower("name")).orderBy("pos")
    n = F.row_number().over(w)
    return names.select("pos", F.when(n == 1, F.col("name")).otherwise(F.format_string("%s (%d)", "name", n)).alias("name"))


def fingerprint(headers: list[str]) -> str:
    return "sha256:" + hashlib.sha256(SEPARATOR.join(map(header_key, headers)).encode()).hexdigest()


@dataclass(frozen=True)
class Drift:
    match: bool
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    moved: list[str] = field(default_factory=list)


def compare_headers(saved: list[str], current: list[str]) -> Drift:
    if fingerprint(saved) == fingerprint(current):
        return Drift(True)
    was, now = ({header_key(h): i for i, h in enumerate(x)} for x in (saved, current))
    return Drift(
        False,
        [h for h in current if header_key(h) not in was],
        [h for h in saved if header_key(h) not in now],
        [h for h in saved if now.get(header_key(h), was[header_key(h)]) != was[header_key(h)]],
    )


def header_diff(saved: DataFrame, current: DataFrame) -> DataFrame:
    """compare_headers over (pos, name) frames: change and name."""
    a, b = (x.withColumn("key", normalize_header(F.col("name"))) for x in (saved, current))
    added = b.join(a, "key", "left_anti").select(F.lit("added").alias("change"), "name")
    removed = a.join(b, "key", "left_anti").select(F.lit("removed").alias("change"), "name")
    moved = a.alias("a").join(b.alias("b"), "key").where("a.pos <> b.pos").select(F.lit("moved").alias("change"), F.col("a.name").alias("name"))
    return added.unionByName(removed).unionByName(moved)
