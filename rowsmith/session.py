"""A working session: choose a table and a sheet, map, validate, and produce output."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.cells import shown as shown_text
from rowsmith.operators import render, validate
from rowsmith.operators.checks import compile_checks
from rowsmith.plans import config as layouts
from rowsmith.plans import matching, model
from rowsmith.plans.headers import fingerprint
from rowsmith.sources import catalog, execute, sheet_writer, xlsx
from rowsmith.sources.frames import from_frame, from_workbook

JOB_GROUP = "rowsmith"


#: Rows shown of a chosen sheet.
PREVIEW_ROWS = 10


class NotReady(RuntimeError):
    pass


@dataclass(frozen=True)
class Selection:
    """A chosen sheet: its first rows (row_num and cells of text and kind), warnings, and how the mappings fit."""

    sheet: validate.Sheet
    preview: DataFrame
    warnings: list[str]
    status: model.Status | None
    mappings: list[model.Mapping]


@dataclass
class Session:
    spark: SparkSession
    connection: catalog.Connection | None = None
    table: model.Table | None = None
    sheet: validate.Sheet | None = None
    mappings: list[model.Mapping] = field(default_factory=list)
    strategy: str = model.NONE
    settings: validate.Settings = validate.Settings()
    output: render.Output = render.Output()
    target: DataFrame | None = None
    references: dict[str, DataFrame] = field(default_factory=dict)
    report: validate.Report | None = None
    source: str = ""
    path: str = ""
    server: catalog.Server | None = None
    privileges: catalog.Privileges | None = None
    layout: layouts.Config | None = None
    rehearsed: bool = False
    written: int = 0

    def connect(self, connection: catalog.Connection) -> catalog.Server:
        """Reach a server; literals will be written as it reads them."""
        self.server = catalog.probe(self.spark, connection)
        self.connection = connection
        self.output = replace(self.output, conforming=self.server.conforming)
        self.settings = replace(self.settings, options=replace(self.settings.options, conforming=self.server.conforming))
        return self.server

    def tables(self) -> DataFrame:
        """Tables to choose from: the server's, or Spark's own."""
        if self.connection:
            return self.connection.query(self.spark, catalog.tables_sql()).orderBy("schema", "name")
        rows = [(t.namespace[0] if t.namespace else "", t.name, 0) for t in self.spark.catalog.listTables()]
        return self.spark.createDataFrame(rows, "schema string, name string, estimate long").orderBy("schema", "name")

    def describe(self, schema: str, name: str) -> model.Table:
        if not self.connection:
            raise NotReady("no connection")
        table = catalog.describe(self.spark, self.connection, schema, name)
        self.privileges = catalog.privileges(self.spark, self.connection, schema, name)
        return self.use_table(table)

    def overview(self) -> dict:
        """The chosen table with its rules, what the user may do with it, the choices for its key, and what cannot be verified."""
        self._need("table")
        _, beyond = compile_checks(self.table)
        return {"table": self.table, "rules": model.uniqueness_rules(self.table), "privileges": self.privileges, "key_options": model.key_options(self.table), "unverifiable": beyond}

    def use_table(self, table: model.Table, rows: DataFrame | None = None, references: dict[str, DataFrame] | None = None) -> model.Table:
        self.table, self.target, self.references, self.report = table, rows, references or {}, None
        self.strategy = model.default_key_strategy(table)
        return table

    def open(self, source: str | DataFrame, row_num=None, sheet: str = "", header_row: int | None = None) -> validate.Sheet:
        """A workbook's path, or a DataFrame with an expression that numbers its rows."""
        if isinstance(source, str):
            self.sheet, self.source, self.path = from_workbook(self.spark, source, sheet, header_row), os.path.basename(source), source
        else:
            self.sheet, self.source = from_frame(source, row_num), "DataFrame"
        self.mappings, self.report = model.resolve_indexes(self.mappings, self.sheet.headers), None
        return self.sheet

    def sheets(self) -> list[str]:
        self._need("sheet")
        return list(xlsx.Workbook.open(self.path).sheets) if self.path else [self.sheet.name]

    def select_sheet(self, name: str, header_row: int | None = None, shown: int = PREVIEW_ROWS) -> Selection:
        """Go to another sheet of the workbook: its first rows, what to beware of, and the mappings as they now stand."""
        if not self.path:
            raise NotReady("no workbook is open")
        sheet = self.open(self.path, sheet=name, header_row=header_row)
        df = xlsx.read_sheet(self.spark, self.path, name)
        first = sheet.rows.agg(F.min("row_num")).first()[0] or 0
        cells = F.transform("cells", lambda c: F.struct(shown_text(c).alias("text"), c["kind"].alias("kind")))
        preview = xlsx.typed_rows(xlsx.preview(df, first, shown), sheet.date1904).select("row_num", cells.alias("cells"))
        merged, looked = xlsx.merged_ranges(self.path, name, xlsx.count_rows(df)[0])
        warnings = [] if looked else ["merged cells were not looked for in so many rows; all but the first cell of a merged range read as blanks"]
        if merged:
            warnings.append(f"{len(merged)} merged ranges ({', '.join(merged[:3])}): all but the first cell of each read as blanks")
        warnings += layouts.check_workbook(self.layout, sheet.headers) if self.layout else []
        return Selection(sheet, preview, warnings, self.status() if self.table and self.mappings else None, self.mappings)

    def auto_match(self) -> list[matching.Suggestion]:
        self._need("table", "sheet")
        found = matching.auto_match(self.spark, self.sheet.headers, self.table)
        self.mappings = matching.to_mappings(found, self.table)
        return found

    def map(self, *mappings: model.Mapping) -> model.Status:
        self.mappings, self.report = list(mappings), None
        return self.status()

    def status(self) -> model.Status:
        self._need("table")
        return model.check(self.mappings, self.table, self.sheet.headers if self.sheet else None, self.strategy)

    def key(self, strategy: str) -> None:
        allowed = {o["strategy"] for o in model.key_options(self.table) if o["available"]}
        if strategy not in allowed:
            raise ValueError(f"{strategy} is not available for this table")
        self.strategy = strategy

    @property
    def plan(self) -> model.Plan:
        self._need("table")
        return model.build_plan(self.mappings, self.table, self.strategy)

    def validate(self) -> validate.Report:
        self._need("table", "sheet")
        self.spark.sparkContext.setJobGroup(JOB_GROUP, "validate", interruptOnCancel=True)
        status = self.status()
        known = {p.code for p in model.check([c.mapping for c in self.plan.columns], self.table, self.sheet.headers, self.strategy).problems}
        extra = [p for p in status.problems if p.code not in known]
        self.report = validate.validate(self.sheet, self.plan, self.settings, self.target, self.references, extra)
        return self.report

    def rehearse(self) -> validate.Report:
        self._need("table", "sheet")
        if self.target is None:
            raise NotReady("a rehearsal needs the target's rows")
        report = execute.rehearse(self.sheet, self.plan, self.target, self.references, self.settings)
        self.rehearsed = report.clean
        return report

    def _rows(self) -> DataFrame:
        if self.report is None or not self.report.clean:
            raise NotReady("validate first, without errors")
        return validate.evaluated(self.sheet, self.plan, self.settings.options)

    def provenance(self) -> render.Provenance:
        first, last = self.sheet.rows.selectExpr("min(row_num)", "max(row_num)").first()
        return render.Provenance(
            self.source, self.sheet.name, fingerprint(self.sheet.headers), (first or 2) - 1, first or 0, last or 0, f"{self.table.schema}.{self.table.name}", f"{self.server.version} ({self.server.database})" if self.server else "",
            self.report.rows_total, self.report.rows_skipped, tuple(self.plan.names), tuple(model.defaulted_columns(self.plan)), ", ".join(self.table.primary_key),
            {model.SEQUENCE: "Values assigned by the database.", model.MAPPED: "Values from the sheet."}.get(self.strategy, ""), self.report.warnings, self.settings.describe(self.rehearsed),
        )

    def generate(self, path: str) -> str:
        """Write the script to a local file; a partial one is removed."""
        rows = self._rows()
        if os.path.exists(path):
            raise FileExistsError(path)
        self.written = render.write_script(path, render.script(rows, self.plan, self.output, self.provenance()))
        return path

    def generate_parts(self, path: str) -> None:
        """Write the rows' SQL as files by all tasks, to any store."""
        render.write_parts(self._rows(), self.plan, path, self.output)

    def execute(self, staging: str, typed_name: str) -> None:
        """Publish to the server, which is asked anew whether the user may."""
        if not self.connection:
            raise NotReady("no connection")
        allowed = catalog.privileges(self.spark, self.connection, self.table.schema, self.table.name)
        execute.execute(self._rows(), self.plan, self.connection, staging, self.report, allowed.can_insert, typed_name, self.output.setval)

    def export_issues(self, path: str) -> None:
        if self.report is None:
            raise NotReady("validate first")
        write = sheet_writer.write_issues_csv if path.endswith(".csv") else sheet_writer.write_issues_xlsx
        write(self.report.issues, path)

    def save(self, path: str, name: str = "") -> None:
        s, o = self.settings, self.output
        validation = {"checkUniqueAgainstDb": s.check_existing, "checkForeignKeys": s.check_foreign, "columnMisalignThreshold": s.misaligned, "maxIssues": s.max_issues, "allowNumericRounding": s.options.rounding, "enumCaseInsensitive": s.options.enum_ignore_case, "sourceTimezone": s.options.timezone}
        output = {"mode": o.mode, "batchSize": o.batch_size, "wrapInTransaction": o.transaction, "includeSummaryHeader": o.header, "skipBlankRows": o.skip_blank}
        headers = self.sheet.headers if self.sheet else []
        layouts.save(layouts.Config(self.table.schema, self.table.name, self.mappings, self.sheet.name if self.sheet else "", 1, 2, fingerprint(headers), headers, self.strategy, list(self.table.primary_key), bool(o.setval), validation, output, name), path)

    def load(self, path: str) -> list[str]:
        """Take a saved layout over; what has drifted since is returned."""
        self.layout = c = layouts.load(path)
        self.mappings, self.strategy = c.mappings, c.strategy
        v, o = c.validation, c.output
        options = validate.Options(v["sourceTimezone"] or "UTC", v["allowNumericRounding"], v["enumCaseInsensitive"])
        self.settings = validate.Settings(options, v["columnMisalignThreshold"] or validate.MISALIGNED, v["maxIssues"] or validate.MAX_ISSUES, v["checkUniqueAgainstDb"], v["checkForeignKeys"])
        self.output = render.Output(o["mode"], o["batchSize"], o["wrapInTransaction"], o["includeSummaryHeader"], setval=c.key_columns[0] if c.setval and c.key_columns else "", skip_blank=o["skipBlankRows"])
        drift = layouts.check_schema(c, self.table) if self.table else []
        if self.sheet:
            drift += layouts.check_workbook(c, self.sheet.headers)
            self.mappings = model.resolve_indexes(self.mappings, self.sheet.headers)
        return drift

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(JOB_GROUP)

    def close(self) -> None:
        """Forget the connection and its credentials."""
        self.connection = self.server = self.privileges = None

    def about(self) -> dict[str, str]:
        return {"name": "rowsmith", "spark": self.spark.version, "server": self.server.version if self.server else ""}

    def _need(self, *names: str) -> None:
        for n in names:
            if getattr(self, n) is None:
                raise NotReady(f"no {n} is chosen")
