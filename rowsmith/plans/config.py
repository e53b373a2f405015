"""Saved layouts: a versioned JSON file with target, source, mappings and settings, and checks for drift."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from rowsmith.plans.headers import compare_headers
from rowsmith.plans.model import MAPPED, NONE, Mapping, Table, Transform

VERSION = 1
# A transform's fields in files.
TRANSFORM_KEYS = {
    "trim": "trim", "blank_as_null": "blankAsNull", "default_on_blank": "defaultOnBlank", "upper": "upperCase", "lower": "lowerCase",
    "strip_non_digits": "stripNonDigits", "value_map": "valueMap", "bool_map": "boolMap", "date_format": "dateFormat",
}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    schema: str
    table: str
    mappings: list[Mapping]
    sheet: str = ""
    header_row: int = 1
    data_start: int = 2
    fingerprint: str = ""
    headers: list[str] = field(default_factory=list)
    strategy: str = NONE
    key_columns: list[str] = field(default_factory=list)
    setval: bool = False
    validation: dict = field(default_factory=dict)
    output: dict = field(default_factory=dict)
    name: str = ""
    created_at: str = ""

    DEFAULT_VALIDATION = {
        "checkUniqueAgainstDb": True, "checkForeignKeys": False, "columnMisalignThreshold": 0.30, "maxIssues": 10000,
        "allowNumericRounding": False, "enumCaseInsensitive": False, "sourceTimezone": "",
    }
    DEFAULT_OUTPUT = {"mode": "insert", "batchSize": 500, "wrapInTransaction": True, "includeSummaryHeader": True, "skipBlankRows": True}

    def __post_init__(self):
        self.validation = self.DEFAULT_VALIDATION | self.validation
        self.output = self.DEFAULT_OUTPUT | self.output

    def to_json(self) -> dict:
        def mapping(m: Mapping) -> dict:
            t = {name: v for k, name in TRANSFORM_KEYS.items() if (v := asdict(m.transform)[k])}
            return {"excelColumn": m.sheet_column, "excelIndex": m.index, "dbColumn": m.db_column, "enabled": m.enabled, "transform": t}

        return {
            "configVersion": VERSION, "name": self.name, "createdAt": self.created_at or datetime.now(timezone.utc).isoformat(),
            "target": {"schema": self.schema, "table": self.table},
            "source": {"sheetName": self.sheet, "headerRow": self.header_row, "dataStartRow": self.data_start, "headerFingerprint": self.fingerprint, "headers": self.headers},
            "mappings": [mapping(m) for m in self.mappings],
            "primaryKey": {"strategy": self.strategy, "columns": self.key_columns, "emitSetval": self.setval},
            "validation": self.validation, "output": self.output,
        }


def check_config(c: Config) -> None:
    bad = []
    if not c.schema or not c.table:
        bad.append("the target needs a schema and a table")
    if not c.mappings:
        bad.append("nothing is mapped")
    if c.header_row < 1 or c.data_start <= c.header_row:
        bad.append("data must start below the header row")
    names = [m.db_column for m in c.mappings if m.enabled]
    bad += [f"{n} is mapped more than once" for n in sorted({n for n in names if names.count(n) > 1})]
    if c.strategy == MAPPED and not c.key_columns:
        bad.append("a mapped key needs its columns")
    if not 0 <= c.validation["columnMisalignThreshold"] <= 1 or c.validation["maxIssues"] < 0:
        bad.append("a validation setting is out of range")
    if c.output["mode"] not in ("insert", "copy") or not 100 <= c.output["batchSize"] <= 1000:
        bad.append("an output setting is out of range")
    if bad:
        raise ConfigError("; ".join(bad))


#: Steps from a version to the next, by the version they start from.
STEPS: dict = {}


def migrate(raw: dict) -> dict:
    version = raw.get("configVersion", 1)
    if version > VERSION:
        raise ConfigError(f"version {version} of the file is newer than {VERSION}, the newest known")
    while version < VERSION:
        raw = STEPS[version](raw)
        version += 1
    return raw | {"configVersion": VERSION}


def load(path: str) -> Config:
    try:
        raw = migrate(json.loads(Path(path).read_text(encoding="utf-8-sig")))
        source, key = raw.get("source", {}), raw.get("primaryKey", {})
        words = {name: k for k, name in TRANSFORM_KEYS.items()}
        mappings = [
            Mapping(m["excelColumn"], m.get("excelIndex", 0), m["dbColumn"], Transform(**{words[k]: v for k, v in m.get("transform", {}).items() if k in words and v is not None}), m.get("enabled", True))
            for m in raw.get("mappings", [])
        ]
        c = Config(
            raw["target"]["schema"], raw["target"]["table"], mappings, source.get("sheetName", ""), source.get("headerRow", 1), source.get("dataStartRow", source.get("headerRow", 1) + 1),
            source.get("headerFingerprint", ""), source.get("headers") or [], key.get("strategy", NONE), key.get("columns") or [], key.get("emitSetval", False),
            raw.get("validation", {}), raw.get("output", {}), raw.get("name", ""), raw.get("createdAt", ""),
        )
    except (KeyError, TypeError, json.JSONDecodeError) as e:
        raise ConfigError(f"{path}: {e!r}") from e
    check_config(c)
    return c


def save(c: Config, path: str) -> None:
    """Write beside the file, then replace it."""
    check_config(c)
    folder = os.path.dirname(os.path.abspath(path))
    with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8") as f:
        json.dump(c.to_json(), f, indent=2, ensure_ascii=False)
    os.replace(f.name, path)


def check_workbook(c: Config, headers: list[str]) -> list[str]:
    d = compare_headers(c.headers, headers)
    return [] if d.match else [f"{what}: {', '.join(names)}" for what, names in (("added", d.added), ("removed", d.removed), ("moved", d.moved)) if names]


def check_schema(c: Config, table: Table) -> list[str]:
    out = []
    if (c.schema, c.table) != (table.schema, table.name):
        out.append(f"the layout is for {c.schema}.{c.table}, not {table.schema}.{table.name}")
    for m in (m for m in c.mappings if m.enabled):
        column = table.column(m.db_column)
        if column is None:
            out.append(f"{m.db_column} is no longer in the table")
        elif not column.accepts_value:
            out.append(f"{m.db_column} can no longer be written")
    return out
