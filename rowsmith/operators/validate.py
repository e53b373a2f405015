"""Validation of a sheet against a plan: column verdicts from a sample, then every row, then keys."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowsmith.functions import text as T
from rowsmith.functions.cells import SIGNIFICANT, DATE, EMPTY, ERROR, as_text, assembled, recovered, shown, to_number
from rowsmith.operators import keys
from rowsmith.operators.checks import Check, compile_checks
from rowsmith.operators.coerce import Options, coerce, enum_hint, key_of, reading
from rowsmith.operators.transforms import apply, cut, is_textual, moment, replaced
from rowsmith.plans.model import TEMPORAL, Plan, PlanColumn, Problem, Table, check, uniqueness_rules

ISSUE = (
    "code string, severity string, scope string, excel_row long, excel_column string, excel_ref string, "
    "db_column string, value string, message string, hint string"
)
NAMES = [f.split()[0] for f in ISSUE.split(", ")]
MAX_ISSUES, MISALIGNED = 10_000, 0.30
SAMPLE_ALL, HEAD, TAIL, MIDDLE = 1000, 200, 200, 600


@dataclass(frozen=True)
class Sheet:
    """Rows of row_num and one raw text column c0, c1, ... for each header.

    dates: places read as dates; where the rows have a column d0, d1, ... too, only cells that it marks are.
    problems: what the source has to say of the sheet; validate() reports it.
    texts: places whose values are texts as they stand, not raw text to be typed.
    """

    rows: DataFrame
    headers: list[str]
    dates: frozenset[int] = frozenset()
    date1904: bool = False
    name: str = "sheet"
    problems: tuple[Problem, ...] = ()
    texts: frozenset[int] = frozenset()

    def marked(self, index: int) -> Column:
        if index not in self.dates:
            return F.lit(False)
        return F.coalesce(f"d{index}", F.lit(False)) if f"d{index}" in self.rows.columns else F.lit(True)


@dataclass(frozen=True)
class Settings:
    options: Options = Options()
    misaligned: float = MISALIGNED
    max_issues: int = MAX_ISSUES
    check_existing: bool = True
    check_foreign: bool = False
    stop_at_sample: bool = True  # else rows are looked at in spite of the sample, and condemned columns' issues are counted only

    def describe(self, rehearsed: bool = False) -> str:
        """What a run with these settings looks at, for a script's header."""
        also = [(self.check_existing, "keys of the target"), (self.check_foreign, "references"), (rehearsed, "a rehearsal without refusals")]
        return ", ".join(["every row", *[what for holds, what in also if holds]])


@dataclass
class Verdict:
    sheet_column: str
    db_column: str
    sampled: int
    failures: int
    blanks: int
    blocked: bool = False
    reason: str = ""

    @property
    def failure_rate(self) -> float:
        return self.failures / self.sampled if self.sampled else 0.0


@dataclass
class Report:
    issues: DataFrame
    errors: int = 0
    warnings: int = 0
    rows_total: int = 0
    rows_valid: int = 0
    rows_skipped: int = 0
    truncated: bool = False
    by_code: dict[str, int] = field(default_factory=dict)
    by_column: dict[str, int] = field(default_factory=dict)
    verdicts: list[Verdict] = field(default_factory=list)
    unverifiable: list[tuple[str, str, str]] = field(default_factory=list)

    @property
    def clean(self) -> bool:
        return not self.errors

    def summary(self) -> str:
        skipped = f", {self.rows_skipped} blank rows skipped" if self.rows_skipped else ""
        cut = " (issue list truncated)" if self.truncated else ""
        return f"{self.rows_total} rows, {self.rows_valid} valid{skipped}, {self.errors} errors, {self.warnings} warnings{cut}"


def settled(c: Column) -> Column:
    """A value that the optimiser leaves where it is.

    A cell's expression is large and has many readers.  Substituted into each of them, or into a filter on
    its way down, it would be worked out over and over and the plan would outgrow the driver.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def apart(c: Column) -> Column:
    """A settled value that is worked out outside of a stage's one generated method.

    That method holds all operators of a stage in one piece, and with several wide columns it outgrows what the JVM
    takes; Spark would then compile in vain and fall back.  A higher-order function keeps a projection out of it: on its
    own, its code is split into methods of a size that the JVM compiles.
    """
    return F.when(F.exists(F.array(F.spark_partition_id()), lambda x: x >= 0), c)


def evaluation_steps(sheet: Sheet, plan: Plan, options: Options = Options()) -> list[list[Column]]:
    """The projections of evaluated(), one after another; sheets of the same columns may share them.

    Every step is a projection of its own: what several branches of a later step use is a column, not a repeated expression.
    """
    columns = list(enumerate(plan.columns))
    row = F.col("row_num")
    raw = {i for i, c in columns if c.mapping.index not in sheet.texts}
    said = lambda i, s: F.coalesce(s, F.lit("")) if i in raw else s
    first = [row, *[said(i, F.col(f"c{c.mapping.index}").cast("string")).alias(f"r_{i}") for i, c in columns], *[sheet.marked(c.mapping.index).alias(f"m_{i}") for i, c in columns]]
    steps, present = [first], {"row_num": None} | {f"{k}_{i}": k for k in "rm" for i, _ in columns}

    def step(keep: list[str], name: str, make, only=None) -> None:
        """The columns of these names, and name_<i> of each planned column, or of those in `only`."""
        nonlocal present
        present = {x: k for x, k in present.items() if k is None or k in keep}
        made = [(i, c) for i, c in columns if only is None or i in only]
        # one that is apart keeps all of a projection so
        steps.append([*map(F.col, present), *[(settled if k else apart)(make(i, c)).alias(f"{name}_{i}") for k, (i, c) in enumerate(made)]])
        present |= {f"{name}_{i}": name for i, _ in made}

    if raw:
        step(["r", "m"], "n", lambda i, c: T.normalize_invisible(F.col(f"r_{i}")), raw)
        step(["r", "m", "n"], "t", lambda i, c: T.trimmed(F.col(f"n_{i}")), raw)
        step(["r", "m", "n", "t"], "a", lambda i, c: to_number(F.col(f"t_{i}")), raw)
        step(["r", "m", "n", "t", "a"], "g", lambda i, c: F.when(F.length(f"t_{i}") > SIGNIFICANT, recovered(F.col(f"a_{i}"))).otherwise(F.col(f"a_{i}")), raw)
    step([], "x", lambda i, c: assembled(*[F.col(f"{k}_{i}") for k in "rntagm"], sheet.date1904) if i in raw else as_text(F.col(f"r_{i}")))
    blank = reduce(lambda a, b: a & b, [F.col(f"x_{i}.kind") == EMPTY for i, _ in columns], F.lit(True))
    steps.append([row, blank.alias("blank"), *[F.col(f"x_{i}") for i, _ in columns]])
    present = {"row_num": None, "blank": None} | {f"x_{i}": "x" for i, _ in columns}
    textual = {i for i, c in columns if is_textual(c.mapping.transform, c.column.family)}
    dated = {i for i, c in columns if i in textual and c.column.family in TEMPORAL}
    step(["x"], "cut", lambda i, c: cut(F.col(f"x_{i}"), c.mapping.transform), textual)
    step(["x", "cut"], "replaced", lambda i, c: replaced(F.col(f"cut_{i}"), c.mapping.transform), textual)
    if dated:
        step(["x", "cut", "replaced"], "moment", lambda i, c: moment(F.col(f"replaced_{i}"), c.mapping.transform), dated)
    at_hand = lambda i: {k: F.col(f"{k}_{i}") for k, of in (("cut", textual), ("replaced", textual), ("moment", dated)) if i in of}
    step(["x"], "p", lambda i, c: apply(F.col(f"x_{i}"), c.mapping.transform, c.column.family, at_hand(i)))
    step(["x", "p"], "k", lambda i, c: key_of(F.col(f"p_{i}")))
    read = {i: r for i, c in columns if (r := reading(F.col(f"p_{i}"), c.column, options, F.col(f"k_{i}"))) is not None}
    if read:
        step(["x", "p", "k"], "h", lambda i, c: read[i], read)
    step(["x", "p"], "v", lambda i, c: valued(F.col(f"p_{i}"), c, options, F.col(f"k_{i}"), F.col(f"h_{i}") if i in read else None))
    return steps


def evaluated(sheet: Sheet, plan: Plan, options: Options = Options(), steps: list[list[Column]] | None = None) -> DataFrame:
    """row_num, blank, and for each planned column its applied cell p_<i> and coerced value v_<i>, each worked out once."""
    return reduce(lambda df, step: df.select(*step), steps or evaluation_steps(sheet, plan, options), sheet.rows)


def valued(applied: Column, c: PlanColumn, options: Options, key: Column | None = None, read: Column | None = None) -> Column:
    """The coerced value, or E201 where the column's date layouts did not read the text."""
    out = coerce(applied, c.column, options, key, read)
    if c.column.family not in TEMPORAL:
        return out
    failed = applied["date_failed"] & ~applied["kind"].isin(DATE, EMPTY, ERROR)
    fields = [F.lit(False).alias("is_null"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("decimal(38,18)").alias("num"), F.lit("E201").alias("code")]
    return F.when(failed, F.struct(*fields, F.concat(F.lit('"'), T.shortened(applied["str"]), F.lit('" is not a date in this column\'s layout')).alias("message"))).otherwise(out)


def _issue(code: Column | str, row: Column, c: PlanColumn | None, value: Column, message: Column | str, hint: str = "", scope: str = "cell", severity: str = "error") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    name = c.mapping.sheet_column if c else ""
    ref = T.cell_ref(c.mapping.index, row) if c else F.lit("")
    return F.struct(
        lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(scope).alias("scope"), row.cast("long").alias("excel_row"), F.lit(name).alias("excel_column"),
        ref.alias("excel_ref"), F.lit(c.column.name if c else "").alias("db_column"), value.alias("value"), lit(message).alias("message"), F.lit(hint).alias("hint"),
    )


def row_issues(rows: DataFrame, plan: Plan, checks: list[Check]) -> DataFrame:
    """row_num and issues (an array) of every row that is not blank: cells first; CHECKs only where cells have none."""
    row = F.col("row_num")
    of_cell = []
    for i, c in enumerate(plan.columns):
        v = F.col(f"v_{i}")
        hint = enum_hint(c.column) if c.column.enum_values else ""
        of_cell.append(F.when(v["code"].isNotNull(), _issue(v["code"], row, c, shown(F.col(f"x_{i}")), v["message"], hint)))
    none = F.array().cast(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in ISSUE.split(', '))}>>")
    wrong = reduce(lambda a, b: a | b, [F.col(f"v_{i}.code").isNotNull() for i in range(len(plan.columns))], F.lit(False))
    cells = F.when(wrong, F.array_compact(F.array(*of_cell))).otherwise(none)
    values = {c.column.name: F.col(f"v_{i}") for i, c in enumerate(plan.columns)}
    families = {c.column.name: c.column.family for c in plan.columns}
    of_check = []
    for k in checks:
        at = next((plan.find(p.column) for p in k.predicates if plan.find(p.column)), None)
        why = k.failure(values, families)
        seen = values[at.column.name]["text"] if at else F.lit("")
        of_check.append(F.when(why.isNotNull(), _issue("E306", row, at, T.shortened(F.coalesce(seen, F.lit(""))), F.concat(F.lit(f"constraint {k.name}: "), why))))
    df = rows.where(~F.col("blank")).select("*", apart(cells).alias("issues"))
    if of_check:
        df = df.withColumn("issues", apart(F.when(F.size("issues") == 0, F.array_compact(F.array(*of_check))).otherwise(F.col("issues"))))
    return df


def _key_rows(rows: DataFrame, plan: Plan, columns: tuple[str, ...]) -> DataFrame | None:
    """row_num, k_0, k_1, ... and the key's text; none if a part is not mapped.

    rows are to be persisted: the optimiser follows a join's keys down to their scan, and an evaluation's many steps would
    make that endless.
    """
    at = [next((i for i, c in enumerate(plan.columns) if c.column.name == name), None) for name in columns]
    if any(i is None for i in at) or not at:
        return None
    parts = [F.when(F.col(f"v_{i}.code").isNull() & ~F.col(f"v_{i}.is_null"), F.col(f"v_{i}.text")).alias(f"k_{j}") for j, i in enumerate(at)]
    return rows.where(~F.col("blank")).select("row_num", *parts)


def _key_issues(df: DataFrame, plan: Plan, columns: tuple[str, ...], code: str, message: Column | str) -> DataFrame:
    c = plan.find(columns[0])
    value = T.shortened(F.concat_ws(", ", *[F.col(f"k_{j}") for j in range(len(columns))]))
    return df.select(_issue(code, F.col("row_num"), c, value, message).alias("i")).select("i.*")


def key_issues(rows: DataFrame, plan: Plan, settings: Settings, target: DataFrame | None, references: dict[str, DataFrame]) -> list[DataFrame]:
    """Duplicates in the sheet, keys that the target has, and missing references.

    target and references are read as text of their columns cast to strings, as the coerced values are.
    """
    out = []
    for rule in uniqueness_rules(plan.table):
        df = _key_rows(rows, plan, rule.columns)
        if df is None:
            continue
        names = [f"k_{j}" for j in range(len(rule.columns))]
        again = keys.duplicates(df, names)
        out.append(_key_issues(again, plan, rule.columns, "E301" if rule.primary else "E303", F.format_string(f"{rule.name}: row %d has the same key", "first_row")))
        if target is not None and settings.check_existing:
            known = keys.existing(df, names, target.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rule.columns]), list(rule.columns))
            out.append(_key_issues(known, plan, rule.columns, "E302" if rule.primary else "E304", f"{rule.name}: the table has this key already"))
    for c in plan.table.of_kind("f") if settings.check_foreign else []:
        df = _key_rows(rows, plan, c.columns)
        if df is None or c.ref_table not in references:
            continue
        ref = references[c.ref_table].select(*[F.col(f"`{x}`").cast("string").alias(x) for x in c.ref_columns])
        lost = keys.missing(df, [f"k_{j}" for j in range(len(c.columns))], ref, list(c.ref_columns))
        out.append(_key_issues(lost, plan, c.columns, "E305", f"{c.name}: {c.ref_table} has no such row"))
    return out


def sample_bounds(rows: DataFrame) -> tuple[int, int, int]:
    """The number of rows, the row_num of the last one of the head, and that of the first one of the tail; row_nums may have gaps."""
    total = rows.count()
    if total <= SAMPLE_ALL:
        return total, 0, 0
    row = F.col("row_num")
    head = rows.select(row).orderBy(row).limit(HEAD).agg(F.max(row)).first()[0]
    tail = rows.select(row).orderBy(row.desc()).limit(TAIL).agg(F.min(row)).first()[0]
    return total, head, tail


def drawn(rows: DataFrame, total: int, head: int, tail: int) -> DataFrame:
    """All rows of up to 1000; of more, those up to the head's last and from the tail's first, and about 600 between, by a hash of their place."""
    if total <= SAMPLE_ALL:
        return rows
    row = F.col("row_num")
    middle = F.pmod(F.xxhash64(row, F.lit(total)), F.lit(total - HEAD - TAIL)) < MIDDLE
    return rows.where((row <= head) | (row >= tail) | middle)


def sampled(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The sample of rows whose row_nums run from first to last without a gap."""
    return drawn(rows, last - first + 1, first + HEAD - 1, last - TAIL + 1)


def column_stats(rows: DataFrame, plan: Plan) -> list[dict]:
    """Sampled, blank, failed and overlong cells of each column, and its first error, in one aggregation."""
    out = [F.count("*").alias("n")]
    for i, c in enumerate(plan.columns):
        blank = F.col(f"x_{i}.kind") == EMPTY
        bad = ~blank & F.col(f"v_{i}.code").isNotNull()
        first = F.min_by(F.struct("row_num", shown(F.col(f"x_{i}")).alias("value"), F.col(f"v_{i}.message").alias("message")), F.when(bad, F.col("row_num")))
        out += [F.count_if(blank).alias(f"b_{i}"), F.count_if(bad).alias(f"f_{i}"), F.count_if(F.col(f"v_{i}.code") == "E203").alias(f"t_{i}"), first.alias(f"e_{i}")]
    r = rows.agg(*out).first()
    return [{"n": r["n"], "blanks": r[f"b_{i}"], "failures": r[f"f_{i}"], "long": r[f"t_{i}"], "first": r[f"e_{i}"]} for i in range(len(plan.columns))]


def column_verdicts(stats: list[dict], plan: Plan, threshold: float = MISALIGNED) -> tuple[list[Verdict], list[Problem]]:
    """E107, E104, W201 and W202 from the sample."""
    verdicts, problems = [], []
    for s, c in zip(stats, plan.columns, strict=True):
        col, name = c.column, c.mapping.sheet_column
        v = Verdict(name, col.name, s["n"], s["failures"], s["blanks"])

        def tell(code: str, message: str, hint: str, severity: str = "error", name: str = name, col=col) -> None:
            problems.append(Problem(code, message, hint, name, col.name, severity))

        if s["n"] and s["blanks"] == s["n"] and col.required and not c.mapping.transform.default_on_blank:
            v.blocked, v.reason = True, "every sampled cell is empty and the target column is required"
            tell("E107", f'"{name}" is empty in every sampled row, but {col.name} is required', "map another sheet column, or set a fixed value for blanks")
        elif v.failure_rate > threshold:
            v.blocked, v.reason = True, f"{v.failure_rate:.0%} of sampled values cannot be written to {col.type_text}"
            first = s["first"]
            hint = f'row {first["row_num"]} has "{first["value"]}": {first["message"]}' if first else "the wrong sheet column may be mapped here"
            tell("E104", f'"{name}" does not match {col.type_text}: {s["failures"]} of {s["n"]} sampled values failed', hint)
        if s["long"] and col.max_length:
            tell("W201", f"{s['long']} sampled values are longer than the {col.max_length} characters {col.name} allows", "shorten the values or widen the column", "warning")
        if s["n"] and not col.required and 0.5 < s["blanks"] / s["n"] < 1:
            tell("W202", f'{s["blanks"] / s["n"]:.0%} of sampled values in "{name}" are empty', "confirm that this column is the one you meant", "warning")
        verdicts.append(v)
    return verdicts, problems


def as_issues(spark, problems: list[Problem]) -> DataFrame:
    rows = [(p.code, p.severity, "column" if p.sheet_column or p.db_column else "file", None, p.sheet_column, "", p.db_column, "", p.message, p.hint) for p in problems]
    return spark.createDataFrame(rows, ISSUE)


def ordered(issues: DataFrame, most: int | None = None) -> DataFrame:
    """Column and file issues first, then by row and sheet column; most: a ceiling of the list."""
    out = issues.orderBy(F.col("scope") == "cell", F.col("excel_row").asc_nulls_first(), "excel_column", "code", "message")
    return out.limit(most) if most is not None else out


def counted(issues: DataFrame) -> DataFrame:
    """Issues by code, severity and sheet column: all that a report's counters need."""
    return issues.groupBy("code", "severity", "excel_column").count()


def listed(issues: DataFrame, condemned: list[str]) -> DataFrame:
    """Without the cell issues of sheet columns that the sample has condemned: one issue says it for all of them."""
    return issues.where((F.col("scope") != "cell") | ~F.col("excel_column").isin(condemned)) if condemned else issues


def filtered(issues: DataFrame, severity: str = "", code: str = "", column: str = "", search: str = "") -> DataFrame:
    """As a reader of the report would narrow it."""
    for name, wanted in (("severity", severity), ("code", code), ("excel_column", column)):
        if wanted:
            issues = issues.where(F.col(name) == wanted)
    if search:
        needle = F.lit(search.lower())
        issues = issues.where(reduce(lambda a, b: a | b, [F.contains(F.lower(c), needle) for c in ("message", "value", "excel_column", "excel_ref")]))
    return issues


def validate(sheet: Sheet, plan: Plan, settings: Settings = Settings(), target: DataFrame | None = None, references: dict[str, DataFrame] | None = None, problems: list[Problem] = ()) -> Report:
    """The whole run.  Rows are looked at only if the sample found no error; counters are of all issues, the list is cut."""
    spark = sheet.rows.sparkSession
    mappings = [c.mapping for c in plan.columns]
    status = check(mappings, plan.table, sheet.headers, plan.strategy)
    checks, beyond = compile_checks(plan.table)
    found = [*problems, *sheet.problems, *status.problems]
    if not plan.columns:
        found.append(Problem("E102", "nothing is mapped", "map a sheet column"))
    if not plan.table.primary_key:
        found.append(Problem("W203", f"{plan.table.name} has no primary key", "rows cannot be told apart later", severity="warning"))
    verdicts: list[Verdict] = []
    blocked = any(p.severity == "error" for p in found)
    if not blocked:  # a wrong mapping costs the evaluation of a sample only
        part, steps = replace(sheet, rows=drawn(sheet.rows, *sample_bounds(sheet.rows))), evaluation_steps(sheet, plan, settings.options)
        verdicts, more = column_verdicts(column_stats(evaluated(part, plan, settings.options, steps), plan), plan, settings.misaligned)
        found += more
        blocked = settings.stop_at_sample and any(p.severity == "error" for p in found)
    fixed = as_issues(spark, found)
    if blocked:
        return summed(fixed, settings, verdicts=verdicts, unverifiable=beyond)
    rows = evaluated(sheet, plan, settings.options, steps).persist()
    try:
        judged = row_issues(rows, plan, checks)
        counts = rows.agg(F.count("*"), F.count_if("blank")).first()
        valid = judged.where(F.size("issues") == 0).count()
        parts = [judged.select(F.explode("issues").alias("i")).select("i.*"), *key_issues(rows, plan, settings, target, references or {})]
        return summed(reduce(DataFrame.unionByName, parts, fixed), settings, counts[0] - counts[1], valid, counts[1], verdicts, beyond)
    finally:
        rows.unpersist()


def summed(issues: DataFrame, settings: Settings, total: int = 0, valid: int = 0, skipped: int = 0, verdicts=(), unverifiable=()) -> Report:
    """A report whose counters are of all issues and whose list, of max_issues rows at most, is held by the driver."""
    rows = counted(issues).collect()
    shown_rows = ordered(listed(issues, [v.sheet_column for v in verdicts if v.blocked]), settings.max_issues)
    out = Report(issues.sparkSession.createDataFrame(shown_rows.collect(), ISSUE), rows_total=total, rows_valid=valid, rows_skipped=skipped, verdicts=list(verdicts), unverifiable=list(unverifiable))
    for r in rows:
        out.errors += r["count"] * (r["severity"] == "error")
        out.warnings += r["count"] * (r["severity"] == "warning")
        out.by_code[r["code"]] = out.by_code.get(r["code"], 0) + r["count"]
        if r["excel_column"]:
            out.by_column[r["excel_column"]] = out.by_column.get(r["excel_column"], 0) + r["count"]
    out.truncated = out.errors + out.warnings > settings.max_issues
    return out


def table_of(df: DataFrame, schema: str, name: str, **kinds: str) -> Table:
    """A table description from a DataFrame's schema, for targets that Spark itself holds."""
    from rowsmith.plans.model import Column as Target

    names = {"string": "text", "bigint": "int8", "int": "int4", "smallint": "int2", "double": "float8", "float": "float4", "boolean": "bool", "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp"}
    return Table(schema, name, tuple(Target(n, kinds.get(n, "numeric" if t.startswith("decimal") else names.get(t, t))) for n, t in df.dtypes))
