"""SQL text from validated rows: literals, INSERT batches, COPY rows, and the script around them."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions import text as T
from rowsmith.plans.model import Column as Target
from rowsmith.plans.model import Plan, Table

INSERT, COPY = "insert", "copy"
LEAST_BATCH, MOST_BATCH, BATCH = 100, 1000, 500
LINE = "-- " + "=" * 61 + "\n"


@dataclass(frozen=True)
class Output:
    mode: str = INSERT
    batch: int = BATCH
    transaction: bool = True
    header: bool = True
    timeout: str = ""
    setval: str = ""  # the key column whose sequence is moved on
    conforming: bool = True
    skip_blank: bool = True

    @property
    def batch_size(self) -> int:
        return min(MOST_BATCH, max(LEAST_BATCH, self.batch))


def literal(v: Column, column: Target, conforming: bool = True) -> Column:
    """The SQL literal of a coerced value."""
    text, family = v["text"], column.family
    if family in ("integer", "numeric", "float"):
        out = text
    elif family == "boolean":
        out = F.upper(text)
    else:
        out = T.quote_literal(text, conforming)
        if family == "enum":
            out = F.concat(out, F.lit(T.enum_cast(column.enum_schema, column.data_type)))
        elif family != "text":
            out = F.concat(out, F.lit("::" + ("time" if family == "time" else column.data_type)))
    return F.when(v["is_null"], F.lit("NULL")).otherwise(out)


def copy_value(v: Column, column: Target) -> Column:
    """The COPY field of a coerced value, made from the value itself and not from its literal."""
    return F.when(v["is_null"], F.lit("\\N")).otherwise(T.copy_field(F.upper(v["text"]) if column.family == "boolean" else v["text"]))


def _sound(rows: DataFrame, plan: Plan, skip_blank: bool) -> DataFrame:
    """Rows to be written.  A value with an error stops the job: only clean reports are rendered."""
    if skip_blank:
        rows = rows.where(~F.col("blank"))
    bad = F.coalesce(*[F.when(F.col(f"v_{i}.code").isNotNull(), F.concat(F.lit(f"{c.column.name}: "), F.col(f"v_{i}.message"))) for i, c in enumerate(plan.columns)])
    return rows.withColumn("sound", F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("row "), F.col("row_num").cast("string"), F.lit(": "), bad))).otherwise(F.lit(True))).where("sound")


def insert_values(rows: DataFrame, plan: Plan, output: Output = Output()) -> DataFrame:
    """row_num and values, the parenthesised literals of a row."""
    parts = [literal(F.col(f"v_{i}"), c.column, output.conforming) for i, c in enumerate(plan.columns)]
    return _sound(rows, plan, output.skip_blank).select("row_num", F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")")).alias("values"))


def copy_rows(rows: DataFrame, plan: Plan, output: Output = Output()) -> DataFrame:
    """row_num and line, the tab-separated fields of a row."""
    parts = [copy_value(F.col(f"v_{i}"), c.column) for i, c in enumerate(plan.columns)]
    return _sound(rows, plan, output.skip_blank).select("row_num", F.concat_ws("\t", *parts).alias("line"))


def numbered(df: DataFrame, order: str = "row_num", held: list[DataFrame] | None = None) -> DataFrame:
    """Adds n, each row's number from 1 in the given order, without gathering rows in one task.

    Rows are range partitioned; partitions' sizes, one number each, give the offsets.  What is persisted for it is added
    to held, for the caller to let go once the result has been read.
    """
    spark = df.sparkSession
    ids = F.monotonically_increasing_id()  # the partition in the high bits, the place in it in the low 33
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", ids).persist()
    if held is not None:
        held.append(ranged)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    offsets, at = [], 0
    for r in ranged.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], at))
        at += r["count"]
    base = spark.createDataFrame(offsets or [(0, 0)], "_part long, _base long")
    return ranged.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn("n", place + F.col("_base") + 1).drop("_part", "_base", "_id")


def insert_batches(values: DataFrame, table: Table, names: list[str], size: int = BATCH, held: list[DataFrame] | None = None) -> DataFrame:
    """batch, first_row, last_row, n_rows and statement of every batch of rows."""
    rows = numbered(values, held=held).withColumn("batch", F.floor((F.col("n") - 1) / size))
    lines = F.array_sort(F.collect_list(F.struct("row_num", "values")))  # at most `size` rows
    each = rows.groupBy("batch").agg(F.min("row_num").alias("first_row"), F.max("row_num").alias("last_row"), F.count("*").alias("n_rows"), lines.alias("lines"))
    head = f"\nINSERT INTO {T.qualified(table.schema, table.name)}\n    ({', '.join(map(T.quote_identifier, names))})\nVALUES\n"
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("    "), x["values"])), ",\n")
    tail = F.format_string(";   -- rows %d-%d\n", "first_row", "last_row")
    return each.select("batch", "first_row", "last_row", "n_rows", F.concat(F.lit(head), body, tail).alias("statement"))


def safe_timeout(s: str) -> str:
    return re.sub(r"[^0-9smh]", "", s) or "300s"


def setval_statement(table: Table, column: str) -> str:
    whole = T.qualified(table.schema, table.name)
    return (
        "\n-- Explicit key values were supplied: the sequence is moved past them.\n"
        f"SELECT setval(\n    pg_get_serial_sequence({T.quote_literal_text(table.schema + '.' + table.name)}, {T.quote_literal_text(column)}),\n"
        f"    (SELECT COALESCE(MAX({T.quote_identifier(column)}), 1) FROM {whole}),\n    true\n);\n"
    )


@dataclass(frozen=True)
class Provenance:
    """What a script's header says of its making."""

    source: str = ""
    sheet: str = ""
    fingerprint: str = ""
    header_row: int = 0
    first_row: int = 0
    last_row: int = 0
    table: str = ""
    server: str = ""
    rows: int = 0
    skipped: int = 0
    columns: tuple[str, ...] = ()
    defaulted: tuple[str, ...] = ()
    primary_key: str = ""
    key_note: str = ""
    warnings: int = 0
    validated: str = ""
    config: str = ""
    at: datetime | None = None

    def render(self) -> str:
        out = [LINE, "--  Generated import script\n", LINE]

        def say(label: str, text: object) -> None:
            out.append(f"--  {label:<17}: {T.quote_comment(str(text))}\n")

        say("Generated at", (self.at or datetime.now().astimezone()).isoformat(" ", "seconds"))
        say("Source file", self.source)
        say("Sheet", self.sheet + (f" (header row {self.header_row}, data rows {self.first_row} to {self.last_row})" if self.header_row else ""))
        say("Fingerprint", self.fingerprint)
        if self.config:
            say("Config", self.config)
        out.append("--\n")
        say("Target", self.table)
        if self.server:
            say("Server", self.server)
        out.append("--\n")
        say("Rows to insert", f"{self.rows:,}")
        if self.skipped:
            say("Rows skipped", f"{self.skipped}  (fully blank)")
        say("Columns mapped", len(self.columns))
        if self.defaulted:
            say("Columns defaulted", f"{len(self.defaulted)}  ({', '.join(self.defaulted)})")
        if self.primary_key:
            out.append("--\n")
            say("Primary key", self.primary_key)
            if self.key_note:
                out.append(f"--                 {T.quote_comment(self.key_note)}\n")
        if self.warnings:
            out.append("--\n")
            say("Warnings", self.warnings)
        if self.validated:
            say("Validated", self.validated)
        personal = [c for c in self.columns if any(h in c.lower() for h in T.PERSONAL)]
        if personal:
            out.append(f"--\n--  NOTE: this file contains personal data in the columns {', '.join(personal)}.\n--        Treat it as you would the database itself.\n")
        return "".join([*out, LINE])


def script(rows: DataFrame, plan: Plan, output: Output = Output(), provenance: Provenance | None = None):
    """The lines of a whole script, in order, a part at a time; the driver never holds all rows."""
    table, names = plan.table, plan.names
    if output.header and provenance:
        yield provenance.render()
    if output.transaction:
        yield "\nBEGIN;\n"
        yield f"SET LOCAL statement_timeout = '{safe_timeout(output.timeout)}';\n" if output.timeout else "-- SET LOCAL statement_timeout = '300s';\n"
    written = statements = 0
    if output.mode == COPY:
        yield f"\nCOPY {T.qualified(table.schema, table.name)} ({', '.join(map(T.quote_identifier, names))}) FROM stdin;\n"
        for r in copy_rows(rows, plan, output).orderBy("row_num").toLocalIterator():
            written += 1
            yield r["line"] + "\n"
        statements = 1
        yield "\\.\n"
    else:
        held: list[DataFrame] = []
        try:
            for r in insert_batches(insert_values(rows, plan, output), table, names, output.batch_size, held).orderBy("batch").toLocalIterator():
                written += r["n_rows"]
                statements += 1
                yield r["statement"]
        finally:
            for df in held:
                df.unpersist()
    if output.setval:
        yield setval_statement(table, output.setval)
    if output.transaction:
        yield "\nCOMMIT;\n"
    yield f"\n{LINE}--  End of script: {written:,} rows across {statements} statement(s)\n{LINE}"


def write_script(path: str, parts) -> int:
    """Write a script's parts to a new local file; the bytes written.  A partial file is removed."""
    size = 0
    try:
        with open(path, "xb") as f:
            for part in parts:
                size += f.write(part.encode())
    except FileExistsError:
        raise
    except BaseException:
        if os.path.exists(path):
            os.remove(path)
        raise
    return size


def head_lines(path: str, n: int, limit: int = 1 << 16) -> list[str]:
    """The first lines of a local file, from one bounded read however large it is."""
    with open(path, "rb") as f:
        return f.read(limit).decode("utf-8", "ignore").split("\n")[:n]


def write_parts(rows: DataFrame, plan: Plan, path: str, output: Output = Output()) -> None:
    """The rows' SQL as text files in order of rows, written by all tasks: the sink for tables too large for one file."""
    held: list[DataFrame] = []
    if output.mode == COPY:
        df = copy_rows(rows, plan, output).repartitionByRange("row_num").sortWithinPartitions("row_num").select("line")
    else:
        df = insert_batches(insert_values(rows, plan, output), plan.table, plan.names, output.batch_size, held)
        df = df.repartitionByRange("batch").sortWithinPartitions("batch").select("statement")
    try:
        df.write.text(path)
    finally:
        for x in held:
            x.unpersist()
