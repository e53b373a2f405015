"""Writing validated rows to the target: by a staging table and one transaction, and a rehearsal without one."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.functions import text as T
from rowsmith.operators.render import setval_statement
from rowsmith.operators.validate import Report, Settings, Sheet, validate
from rowsmith.plans.model import Plan
from rowsmith.sources.catalog import Connection

# A server's error states, as issue codes.
SQLSTATES = {"23505": "E304", "23503": "E305", "23502": "E202", "23514": "E306", "22001": "E203", "22003": "E205", "22P02": "E201"}
OTHER_STATE = "E306"


class Rejected(RuntimeError):
    """A statement that the server refused, as an issue."""

    def __init__(self, issue: dict):
        super().__init__(issue["message"])
        self.issue = issue


def server_issue(plan: Plan, state: str, message: str, column: str = "", constraint: str = "", detail: str = "", row: int | None = None) -> dict:
    """A server's error as an issue: its state as a code, its column or else its constraint's first planned one as a sheet column."""
    of_constraint = next((c.columns for c in (*plan.table.constraints, *plan.table.indexes) if c.name == constraint), ())
    name = column or next((c for c in of_constraint if plan.find(c)), ", ".join(of_constraint))
    at = plan.find(name)
    ref = f"{T.column_letter(at.mapping.index)}{row}" if at and row is not None else ""
    return {
        "code": state_code(state), "severity": "error", "scope": "cell", "excel_row": row, "excel_column": at.mapping.sheet_column if at else "", "excel_ref": ref,
        "db_column": name, "value": "", "message": message, "hint": detail.strip(),
    }


class Refused(RuntimeError):
    """A gate before writing that was not passed."""


def state_code(state: str) -> str:
    return SQLSTATES.get(state, OTHER_STATE)


def gates(report: Report | None, plan: Plan | None, can_insert: bool, typed_name: str) -> None:
    if plan is None or not plan.columns:
        raise Refused("nothing is mapped")
    if report is None or not report.clean:
        raise Refused("the last validation is missing or has errors")
    if not can_insert:
        raise Refused("the user may not insert into the table")
    if typed_name != plan.table.name:
        raise Refused("the table's name was not repeated")


def rehearse(sheet: Sheet, plan: Plan, snapshot: DataFrame, references: dict[str, DataFrame], settings: Settings = Settings()) -> Report:
    """Every constraint, also the references, against snapshots of the target: what a server would refuse, without writing."""
    return validate(sheet, plan, Settings(settings.options, settings.misaligned, settings.max_issues, True, True), snapshot, references)


def staged(rows: DataFrame, plan: Plan) -> DataFrame:
    """Coerced texts by column name, as a staging table takes them."""
    return rows.where(~F.col("blank")).select(*[F.when(~F.col(f"v_{i}.is_null"), F.col(f"v_{i}.text")).alias(c.column.name) for i, c in enumerate(plan.columns)])


def publish_sql(plan: Plan, staging: str, setval: str = "") -> str:
    """One transaction from the staging table of texts to the target: all rows or none."""
    names = ", ".join(map(T.quote_identifier, plan.names))
    casts = ", ".join(f"{T.quote_identifier(c.column.name)}::{T.enum_cast(c.column.enum_schema, c.column.data_type)[2:] if c.column.enum_values else c.column.type_text}" for c in plan.columns)
    target = T.qualified(plan.table.schema, plan.table.name)
    move = setval_statement(plan.table, setval) if setval else ""
    return f"BEGIN;\nINSERT INTO {target} ({names}) SELECT {casts} FROM {T.quote_identifier(staging)};\n{move}DROP TABLE {T.quote_identifier(staging)};\nCOMMIT;\n"


def execute(rows: DataFrame, plan: Plan, connection: Connection, staging: str, report: Report | None, can_insert: bool, typed_name: str, setval: str = "") -> None:
    """Stage in parallel, then publish at once.  Needs a clean report, the privilege, and the table's name typed again."""
    gates(report, plan, can_insert, typed_name)
    properties = {"user": connection.user, "password": connection.password, "driver": "org.postgresql.Driver"}
    staged(rows, plan).write.jdbc(connection.url, staging, mode="overwrite", properties=properties)
    jvm = rows.sparkSession._jvm
    link = jvm.java.sql.DriverManager.getConnection(connection.url, connection.user, connection.password)
    try:
        link.createStatement().execute(publish_sql(plan, staging, setval))
    except Py4JJavaError as e:
        told = e.java_exception
        if not hasattr(told, "getSQLState"):
            raise
        parts = told.getServerErrorMessage() if hasattr(told, "getServerErrorMessage") else None
        more = (parts.getColumn() or "", parts.getConstraint() or "", parts.getDetail() or "") if parts else ()
        raise Rejected(server_issue(plan, told.getSQLState() or "", connection.redact(told.getMessage() or ""), *more)) from None
    finally:
        link.close()
