"""Queries of sources, sinks, plans, reports and streams: they go through files, catalog rows and sessions.

Workbooks, layouts and scripts are written to the folder that machines share, or to a temporary one on a single machine.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith import cli
from rowsmith.functions import cells, text
from rowsmith.operators import coerce, render, validate
from rowsmith.operators.validate import Settings, Sheet
from rowsmith.plans import config, headers, matching, model
from rowsmith.plans.model import Constraint, Mapping, Table, Transform, UniqueIndex
from rowsmith.plans.model import Column as Target
from rowsmith.queries import TRIM, checked, check_sql, customer_run, one_column, plan_of, query, read
from rowsmith.session import Session
from rowsmith.sources import catalog, execute, sheet_writer, xlsx
from rowsmith.sources.frames import from_frame, from_workbook
from rowsmith.streaming import incremental


def folder(spark: SparkSession) -> str:
    """A new local path that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = f"{base.removeprefix('file://').removeprefix('file:')}/rowsmith/files-{uuid.uuid4().hex[:12]}"
        os.makedirs(path)
    else:
        path = tempfile.mkdtemp(prefix="rowsmith-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def listed(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def values(names: str, *rows: tuple) -> str:
    """SQL of fixed rows."""
    say = lambda v: "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({names})"


# Workbooks

FIRST_DAY = date(1999, 12, 31)


def nations_book(spark: SparkSession, sf_dir: str) -> str:
    """A workbook of the nations: name, number, region and a day each."""
    path = f"{folder(spark)}/nations.xlsx"
    rows = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    serial = lambda k: (FIRST_DAY + timedelta(days=k) - date(1899, 12, 30)).days
    sheet_writer.write_xlsx(path, "Nations", ["Name", "Number", "Region", "Day"], [[r["n_name"], r["n_nationkey"], r["n_regionkey"], serial(r["n_nationkey"])] for r in rows], frozenset({3}))
    return path


@query("SELECT n_nationkey + 2 AS row_num, n_name AS name, n_nationkey AS number, strftime(DATE '1999-12-31' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d') AS day FROM nation")
def workbook_scan(spark, sf_dir):
    """Written, opened, scanned and typed, a cell's place being its index."""
    df = xlsx.typed_rows(xlsx.read_sheet(spark, nations_book(spark, sf_dir), "Nations", 2))
    c = lambda i: F.get("cells", F.lit(i))
    return df.select("row_num", c(0)["str"].alias("name"), c(1)["num"].cast("bigint").alias("number"), F.date_format(c(3)["ts"], "yyyy-MM-dd").alias("day"))


@query("SELECT 'rows' AS what, count(*) + 1 AS n FROM nation UNION ALL SELECT 'filled', count(*) + 1 FROM nation UNION ALL SELECT 'sheets', 1 UNION ALL SELECT 'merged', 0 UNION ALL SELECT 'date column', 3")
def workbook_metadata(spark, sf_dir):
    path = nations_book(spark, sf_dir)
    df = xlsx.read_sheet(spark, path)
    last, filled = xlsx.count_rows(df)
    book, (merged, looked) = xlsx.Workbook.open(path), xlsx.merged_ranges(path, "Nations", last)
    (day,) = xlsx.sampled_date_columns(df, 2)
    return listed(spark, "what string, n long", ("rows", last), ("filled", filled), ("sheets", len(book.sheets)), ("merged", len(merged) if looked else -1), ("date column", day))


@query("SELECT n_nationkey + 2 AS row_num, n_name AS shown, 'string' AS kind FROM nation WHERE n_nationkey BETWEEN 3 AND 7")
def workbook_preview(spark, sf_dir):
    df = xlsx.typed_rows(xlsx.preview(xlsx.read_sheet(spark, nations_book(spark, sf_dir)), 5, 5))
    return df.select("row_num", cells.shown(F.get("cells", F.lit(0))).alias("shown"), F.get("cells", F.lit(0))["kind"].alias("kind"))


@query("SELECT n_nationkey + 2 AS row_num, strftime(DATE '1999-12-31' + CAST(n_nationkey AS INTEGER), '%Y-%m-%d') AS value FROM nation")
def workbook_dates(spark, sf_dir):
    """A sheet described, its header found, and its dates told by column and taken to a date column."""
    sheet = from_workbook(spark, nations_book(spark, sf_dir), whole_columns=True)
    plan = model.Plan(Table("public", "t", (Target("day", "date"),)), (model.PlanColumn(Target("day", "date"), Mapping("Day", sheet.headers.index("Day"), "day")),))
    return validate.evaluated(sheet, plan).select("row_num", F.col("v_0.text").alias("value"))


@query(values("pos, name, header_row, confident", *[(i, n, 3, False) for i, n in enumerate(["Name", "Number", "Region", "Day"])]))
def workbook_header(spark, sf_dir):
    """Two lines above the header row are no header."""
    path = f"{folder(spark)}/titled.xlsx"
    rows = [["", "", "", ""], ["Name", "Number", "Region", "Day"], *[[r["n_name"], r["n_nationkey"], r["n_regionkey"], "x"] for r in read(spark, sf_dir, "nation").collect()]]
    sheet_writer.write_xlsx(path, "S", ["All nations"], rows)
    df = xlsx.read_sheet(spark, path)
    guess = headers.detect_header(xlsx.typed_rows(df))
    found = df.where(F.col("row_num") == guess.row).select(F.transform("cells", lambda c: c["raw"]).alias("t")).first()["t"]
    return listed(spark, "pos long, name string, header_row long, confident boolean", *[(i, n, guess.row, guess.confident) for i, n in enumerate(headers.header_names(found))])


GAPS = [(2, "B2", "=A2&" + '"' + "x" * 56 + "…"), (4, "B4", "=A4")]


@query(values("row_num, ref, formula, code", *[(*g, "W204") for g in GAPS]))
def formula_gaps(spark, sf_dir):
    """Formulas without a stored value, and the warning that the sheet carries."""
    rows = [(1, [("name", False, None), ("note", False, None)]), (2, [("a", False, None), ("", False, 'A2&"' + "x" * 80 + '"')]), (3, [("b", False, None), ("2", False, "1+1")]), (4, [("c", False, None), ("", False, "A4")])]
    df = spark.createDataFrame(rows, xlsx.SCHEMA)
    from rowsmith.sources.frames import uncalculated

    (problem,) = uncalculated(df, 2, ["name", "note"])
    return xlsx.formula_gaps(df, 2, 2).select("row_num", "ref", "formula", F.lit(problem.code).alias("code"))


@query(values("files, refused, affordable", (2, 2, 1)))
def archive_safety(spark, sf_dir):
    """What is no archive or packed beyond reason is refused before it is read."""
    import zipfile

    at, refused = folder(spark), 0
    with open(f"{at}/a.xlsx", "wb") as f:
        f.write(b"not a zip")
    with zipfile.ZipFile(f"{at}/b.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"0" * 10_000_000)
    paths = xlsx.matching(f"{at}/*.xlsx")
    for p in paths:
        try:
            xlsx.check_archive(p)
        except xlsx.UnsafeWorkbook:
            refused += 1
    return listed(spark, "files long, refused long, affordable long", (len(paths), refused, sum(map(xlsx.random_access_affordable, (0, 5000, 5001)))))


@query("SELECT event_id, event_id % 3 <> 2 AS numeric_text, event_id % 3 <> 0 AS temporal FROM events")
def text_shapes(spark, sf_dir):
    s = F.expr("CASE event_id % 3 WHEN 0 THEN '-1.5e3' WHEN 1 THEN '2024-01-02' ELSE 'Mon 3 Feb' END")
    return read(spark, sf_dir, "events").select("event_id", cells.looks_numeric(s).alias("numeric_text"), cells.looks_temporal(s).alias("temporal"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN event_id || '.50' WHEN 2 THEN '2024-03-15T12:00:00Z' ELSE '' END AS text, CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN event_id || '.50' WHEN 2 THEN '2024-03-15 12:00:00' ELSE '' END AS shown FROM events")
def cell_texts(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN concat(event_id, '.50') WHEN 2 THEN '45366.5' ELSE ' ' END")
    df = read(spark, sf_dir, "events").select("event_id", cells.typed(raw, F.col("event_id") % 4 == 2).alias("c"))
    return df.select("event_id", cells.text_of(F.col("c")).alias("text"), cells.shown(F.col("c")).alias("shown"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…' ELSE text END AS shown FROM documents")
def shortened_values(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.shortened(F.col("text")).alias("shown"))


# Casts that the tables' own values do not reach

@query("SELECT o_orderkey AS row_num, CASE WHEN o_orderkey % 2 = 0 THEN 'E209' ELSE '' END AS code, CASE WHEN o_orderkey % 2 = 1 THEN '1900-01-01' END AS value FROM orders")
def date_out_of_range(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_num", "CASE WHEN o_orderkey % 2 = 0 THEN '120000000' ELSE '1' END AS c0", "o_orderkey % 4 = 2 AS low").withColumn("c0", F.expr("CASE WHEN low THEN '-3000000' ELSE c0 END")).drop("low")
    t = Target("day", "date")
    plan = model.Plan(Table("public", "t", (t,)), (model.PlanColumn(t, Mapping("day", 0, "day")),))
    return validate.evaluated(Sheet(df, ["day"], frozenset({0})), plan).select("row_num", F.coalesce("v_0.code", F.lit("")).alias("code"), F.col("v_0.text").alias("value"))


@query("SELECT c_custkey AS row_num, CASE c_custkey % 3 WHEN 0 THEN 'E211' ELSE '' END AS code, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS value FROM customer")
def nul_bytes(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN concat(c_name, decode(unhex('00'), 'UTF-8')) ELSE c_name END", Target("name", "text"), Transform())


@query("SELECT c_custkey AS row_num, CASE c_custkey % 3 WHEN 0 THEN 'E201' ELSE '' END AS code, CASE c_custkey % 3 WHEN 1 THEN '2001:db8::' || c_custkey % 10 WHEN 2 THEN 'fe80::/10' END AS value FROM customer")
def coerce_ipv6(spark, sf_dir):
    raw = "CASE c_custkey % 3 WHEN 0 THEN '2001:db8:::1' WHEN 1 THEN concat('2001:db8::', c_custkey % 10) ELSE 'fe80::/10' END"
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", raw, Target("ip", "inet"))


@query("SELECT c_custkey AS row_num, '' AS code, '08:00:2b:01:02:0' || c_custkey % 10 AS value FROM customer")
def coerce_macaddr(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "concat(' 08:00:2b:01:02:0', c_custkey % 10, ' ')", Target("mac", "macaddr"), TRIM)


@query(values("n, hint", (2, "labels: l0, l1"), (14, "14 labels, among them " + ", ".join(f"l{i}" for i in range(12)))))
def enum_hints(spark, sf_dir):
    hint = lambda n: coerce.enum_hint(Target("e", "e", enum_values=tuple(f"l{i}" for i in range(n))))
    return listed(spark, "n long, hint string", *[(n, hint(n)) for n in (2, 14)])


@query(check_sql("p_size", "p_partkey % 3 <> 0"))
def check_is_null(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_size IS NULL))", "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END")


@query(check_sql("p_brand", "NOT p_brand >= 'Brand#3'"))
def check_text_compare(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_brand >= 'Brand#3'::text))")


# Keys and whole runs

ORDER_TABLE = Table(
    "public", "orders", (Target("k", "int8", False), Target("c", "int8"), Target("s", "text")),
    (Constraint("orders_pkey", "p", ("k",)), Constraint("orders_s_key", "u", ("s", "c")), Constraint("orders_c_fkey", "f", ("c",), "", "customer", ("c_custkey",))),
)
ORDER_KEYS = [Mapping(n, i, n, Transform(trim=True, blank_as_null=True)) for i, n in enumerate("kcs")]
ORDER_SQL = """
WITH o AS (SELECT o_orderkey AS r, o_orderkey % 20000 // 2 AS k, o_custkey AS c, o_orderstatus AS s FROM orders),
d AS (SELECT r, k, min(r) OVER (PARTITION BY k) AS first FROM o),
u AS (SELECT r, s, c, min(r) OVER (PARTITION BY s, c) AS first FROM o),
i AS (SELECT r, 'E301' AS code FROM d WHERE r > first UNION ALL SELECT r, 'E303' FROM u WHERE r > first
  UNION ALL SELECT first, 'E302' FROM d WHERE k % 3 = 0 AND r = first UNION ALL SELECT first, 'E304' FROM u WHERE s = 'F' AND c % 4 = 0 AND r = first
  UNION ALL SELECT r, 'E305' FROM o WHERE c % 7 = 0)
"""


def orders_run(spark: SparkSession, sf_dir: str):
    """An orders sheet whose keys repeat, with the target's rows and a referenced table that has gaps."""
    orders = read(spark, sf_dir, "orders")
    df = orders.selectExpr("o_orderkey AS r", "cast(o_orderkey % 20000 div 2 AS string) AS k", "cast(o_custkey AS string) AS c", "o_orderstatus AS s")
    sheet = from_frame(df, F.col("r"), ["k", "c", "s"])
    target = spark.range(0, 10_000).where("id % 3 = 0").selectExpr("id AS k", "cast(null AS bigint) AS c", "cast(null AS string) AS s")
    target = target.unionByName(orders.where("o_custkey % 4 = 0").selectExpr("cast(null AS bigint) AS k", "o_custkey AS c", "'F' AS s").distinct())
    return sheet, model.build_plan(ORDER_KEYS, ORDER_TABLE), target, {"customer": read(spark, sf_dir, "orders").where("o_custkey % 7 <> 0").selectExpr("o_custkey AS c_custkey").distinct()}


@query(ORDER_SQL + "SELECT r AS excel_row, code FROM i")
def key_issues(spark, sf_dir):
    sheet, plan, target, references = orders_run(spark, sf_dir)
    rows = validate.evaluated(sheet, plan).persist()
    found = validate.key_issues(rows, plan, Settings(check_foreign=True), target, references)
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.select("excel_row", "code")


@query(ORDER_SQL + "SELECT code, count(*) AS n FROM i GROUP BY 1 UNION ALL SELECT 'rows', count(*) FROM o UNION ALL SELECT 'errors', count(*) FROM i")
def rehearsal(spark, sf_dir):
    """A whole run against snapshots: columns, rows, then keys and references; its counters are of all issues."""
    sheet, plan, target, references = orders_run(spark, sf_dir)
    r = execute.rehearse(sheet, plan, target, references)
    return listed(spark, "code string, n long", *r.by_code.items(), ("rows", r.rows_total), ("errors", r.errors))


@query(ORDER_SQL + "SELECT DISTINCT r AS excel_row, 'orders_c_fkey: customer has no such row' AS message FROM i WHERE code = 'E305'")
def missing_reference_messages(spark, sf_dir):
    sheet, plan, _, references = orders_run(spark, sf_dir)
    found = validate.key_issues(validate.evaluated(sheet, plan).persist(), plan, Settings(check_existing=False, check_foreign=True), None, references)
    return found[-1].select("excel_row", "message")


@query("SELECT c_custkey + 1 AS excel_row, 'E201' AS code FROM customer WHERE c_custkey % 17 = 0")
def issue_filter_code(spark, sf_dir):
    return validate.filtered(customer_run(spark, sf_dir)[2], "error", "E201", "balance", "N/A").select("excel_row", "code")


@query("SELECT 'E104' AS code, 1::BIGINT AS counted, 1::BIGINT AS listed UNION ALL SELECT 'E201', count(*), 0 FROM supplier WHERE s_suppkey % 5 < 2")
def condemned_columns(spark, sf_dir):
    """A column that the sample condemns: its cells are counted, one issue is listed."""
    df = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 5 < 2 THEN 'x' ELSE cast(s_nationkey AS string) END AS c0")
    table = Table("public", "t", (Target("c0", "int4"),), (Constraint("p", "p", ("c0",)),))
    plan = model.build_plan([Mapping("c0", 0, "c0", Transform(trim=True))], table)
    r = validate.validate(from_frame(df, F.col("s_suppkey"), ["c0"]), plan, Settings(stop_at_sample=False))
    shown = {x["code"]: x["count"] for x in r.issues.groupBy("code").count().collect()}
    return listed(spark, "code string, counted long, listed long", *[(c, r.by_code[c], shown.get(c, 0)) for c in ("E104", "E201")])


# Plans

CATALOG = Table(
    "s", "t", (Target("id", "int4", False, identity="BY DEFAULT"), Target("name", "varchar", False, max_length=20), Target("mood", "mood", enum_values=("a", "b"), enum_schema="s")),
    (Constraint("t_pkey", "p", ("id",)), Constraint("t_name", "u", ("name",)), Constraint("t_mood", "c", (), "CHECK ((mood = 'a'::mood))"), Constraint("t_or", "c", (), "CHECK ((id > 1) OR (id < 0))"), Constraint("t_ex", "x")),
    (UniqueIndex("t_name_ix", ("name",)), UniqueIndex("t_part", ("mood",), "CREATE UNIQUE INDEX t_part ON t (mood) WHERE id > 1")),
)


@query(values("ord, name, type_text, nullable, labels", (1, "id", "integer", False, ""), (2, "name", "character varying(20)", False, ""), (3, "mood", "s.mood", True, "a,b")))
def catalog_columns(spark, sf_dir):
    """Catalog rows in any order put together by their ordinals."""
    kind = "ord int, name string, udt string, type_schema string, formatted string, nullable boolean, has_default boolean, identity string, generated string, max_length int, precision int, scale int, element string, category string"
    cols = listed(spark, kind, (3, "mood", "mood", "s", "s.mood", True, False, "", "", None, None, None, "", "e"), (1, "id", "int4", "pg_catalog", "integer", False, False, "d", "", None, 32, 0, "", "b"), (2, "name", "varchar", "pg_catalog", "character varying(20)", False, False, "", "", 20, None, None, "", "b"))
    labels = listed(spark, "type_schema string, udt string, label string, ord double", ("s", "mood", "b", 2.0), ("x", "mood", "z", 0.0), ("s", "mood", "a", 1.0))
    cons = listed(spark, "name string, kind string, definition string, ord int, column string, ref_table string, ref_column string", ("p", "p", "", 1, "id", None, None))
    ix = spark.createDataFrame([], "name string, definition string, ord int, column string, expressions boolean")
    t = catalog.assemble("s", "t", cols, labels, cons, ix)
    return listed(spark, "ord long, name string, type_text string, nullable boolean, labels string", *[(i, c.name, c.type_text, c.nullable, ",".join(c.enum_values)) for i, c in enumerate(t.columns, 1)])


@query(values("name, kind, here, there", ("fk", "f", "a,b", "x,y"), ("ix", "index", "b,a", ""), ("pk", "p", "a", "")))
def catalog_constraints(spark, sf_dir):
    """Key pairs by ordinal; an index of a constraint's name is that constraint."""
    cols = spark.createDataFrame([], "ord int, name string, udt string, type_schema string, formatted string, nullable boolean, has_default boolean, identity string, generated string, max_length int, precision int, scale int, element string, category string")
    labels = spark.createDataFrame([], "type_schema string, udt string, label string, ord double")
    cons = listed(spark, "name string, kind string, definition string, ord int, column string, ref_table string, ref_column string", ("fk", "f", "", 2, "b", "s.r", "y"), ("pk", "p", "", 1, "a", None, None), ("fk", "f", "", 1, "a", "s.r", "x"))
    ix = listed(spark, "name string, definition string, ord int, column string, expressions boolean", ("ix", "", 2, "a", False), ("ix", "", 1, "b", False), ("pk", "", 1, "a", False))
    t = catalog.assemble("s", "t", cols, labels, cons, ix)
    rows = [(c.name, c.kind, ",".join(c.columns), ",".join(c.ref_columns)) for c in t.constraints] + [(i.name, "index", ",".join(i.columns), "") for i in t.indexes]
    return listed(spark, "name string, kind string, here string, there string", *rows)


@query(values("what, value", ("split", "a.b|c"), ("next of none", "7"), ("next", "12"), ("redacted", "password=**** for u"), ("slug", "my-layout.json"), ("size", "1.5 KB"), ("timeout", "30s"), ("comment", "a b"), ("qualified", '"s"."t""x"'), ("cast", '::"s"."mood"')))
def names_and_texts(spark, sf_dir):
    c = catalog.Connection("h", "d", "u", "pw")
    rows = [
        ("split", "|".join(catalog.split_qualified('"a.b".c'))), ("next of none", str(catalog.next_value(None, 5, 7))), ("next", str(catalog.next_value(7, 5, 1))), ("redacted", c.redact("password=pw for u")),
        ("slug", text.slug("My Layout!", "t", ".json")), ("size", text.byte_size(1536)), ("timeout", render.safe_timeout("30 s;")), ("comment", text.quote_comment("a\nb")), ("qualified", text.qualified("s", 't"x')),
        ("cast", text.enum_cast("s", "mood")),
    ]
    return listed(spark, "what string, value string", *rows)


@query(values("what, name", ("rule", "t_name"), ("rule", "t_pkey"), ("check", "t_mood"), ("beyond", "t_ex"), ("beyond", "t_or"), ("beyond", "t_part"), ("strategy", "sequence"), ("option", "mapped"), ("option", "sequence")))
def table_rules(spark, sf_dir):
    checks, beyond = validate.compile_checks(CATALOG)
    rows = [("rule", r.name) for r in model.uniqueness_rules(CATALOG)] + [("check", c.name) for c in checks] + [("beyond", b[0]) for b in beyond]
    rows += [("strategy", model.default_key_strategy(CATALOG))] + [("option", o["strategy"]) for o in model.key_options(CATALOG) if o["available"]]
    return listed(spark, "what string, name string", *rows)


@query(values("header, db_column, place, trim, blank_as_null", ("E-Mail", "email", 1, True, True), ("Full Name", "name", 0, True, False), ("Mobile", "phone", 2, True, True)))
def auto_matching(spark, sf_dir):
    table = Table("s", "t", (Target("name", "text", False), Target("email", "text"), Target("phone", "text"), Target("total", "text", generated=True)))
    found = matching.to_mappings(matching.auto_match(spark, ["Full Name", "E-Mail", "Mobile", "Total"], table), table)
    return listed(spark, "header string, db_column string, place long, trim boolean, blank_as_null boolean", *[(m.sheet_column, m.db_column, m.index, m.transform.trim, m.transform.blank_as_null) for m in found])


@query(values("sheet_column, place, found", ("Name", 2, True), ("code", 0, True), ("gone", 9, False)))
def resolved_mappings(spark, sf_dir):
    ms = model.resolve_indexes([Mapping("NAME ", 5, "name"), Mapping("code", 7, "id"), Mapping("gone", 9, "x")], ["code", "x", "Name"])
    plan = model.build_plan(ms, CATALOG)
    return listed(spark, "sheet_column string, place long, found boolean", *[(m.sheet_column, m.index, plan.find(m.db_column) is not None) for m in ms])


@query(values("what, value", ("mappings", "name<-Name"), ("drift", "added: New"), ("drift", "removed: Old"), ("schema", "gone is no longer in the table"), ("refused", "version 99"), ("invalid", "nothing is mapped")))
def saved_layouts(spark, sf_dir):
    path, rows = f"{folder(spark)}/layout.json", []
    config.save(config.Config("s", "t", [Mapping("Name", 0, "name", TRIM), Mapping("Old", 1, "gone")], headers=["Name", "Old"]), path)
    c = config.load(path)
    rows.append(("mappings", ",".join(f"{m.db_column}<-{m.sheet_column}" for m in c.mappings if m.transform == TRIM)))
    rows += [("drift", d) for d in config.check_workbook(c, ["Name", "New"])] + [("schema", d) for d in config.check_schema(c, CATALOG)]
    for name, run, most in (("refused", lambda: config.migrate({"configVersion": 99}), 10), ("invalid", lambda: config.check_config(replace(c, mappings=[])), 100)):
        try:
            run()
        except config.ConfigError as e:
            rows.append((name, str(e)[:most]))
    return listed(spark, "what string, value string", *rows)


# Output

def supplier_session(spark: SparkSession, sf_dir: str) -> Session:
    """Suppliers mapped, and validated without an error."""
    s = Session(spark)
    s.use_table(Table("public", "suppliers", (Target("id", "int8", False), Target("name", "text")), (Constraint("p", "p", ("id",)),)))
    df = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    s.open(df.select("id", "name"), F.col("id") + 1)
    s.auto_match()
    s.key(model.MAPPED)
    s.validate()
    return s


@query("""
WITH r AS (SELECT s_suppkey AS k, '    (' || s_suppkey || ', ''' || s_name || ''')' AS line, (row_number() OVER (ORDER BY s_suppkey) - 1) // 500 AS batch FROM supplier),
b AS (SELECT line, batch, k = max(k) OVER (PARTITION BY batch) AS last, min(k) OVER (PARTITION BY batch) + 1 AS lo, max(k) OVER (PARTITION BY batch) + 1 AS hi FROM r)
SELECT CASE WHEN last THEN line || ';   -- rows ' || lo || '-' || hi ELSE line || ',' END AS value FROM b
""")
def script_rows(spark, sf_dir):
    """The rows of a generated script, read from its file."""
    s = supplier_session(spark, sf_dir)
    path = s.generate(f"{folder(spark)}/out.sql")
    return spark.read.text(path).where(F.col("value").startswith("    (") & ~F.col("value").startswith('    ("'))


@query("""
SELECT 'first lines' AS what, 2::BIGINT AS n UNION ALL SELECT 'statements', CAST(ceil(count(*) / 500.0) AS BIGINT) FROM supplier UNION ALL SELECT 'bytes as written', 1 UNION ALL SELECT 'setval', 1
UNION ALL SELECT 'batch size', 100 UNION ALL SELECT 'whole', 1
""")
def script_frame(spark, sf_dir):
    """A script's header, statements, size, key sequence and end."""
    s = supplier_session(spark, sf_dir)
    s.output = replace(s.output, setval="id", timeout="60s")
    path = s.generate(f"{folder(spark)}/out.sql")
    whole = spark.read.text(path, wholetext=True).first()[0]
    head = render.head_lines(path, 2)
    rows = [("first lines", len(head)), ("statements", whole.count("INSERT INTO")), ("bytes as written", int(os.path.getsize(path) == s.written)), ("setval", whole.count("SELECT setval("))]
    rows += [("batch size", render.Output(batch=7).batch_size), ("whole", int(whole.startswith(render.LINE) and "SET LOCAL statement_timeout = '60s'" in whole and "COMMIT;" in whole))]
    return listed(spark, "what string, n long", *rows)


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def staged_rows(spark, sf_dir):
    """What a staging table is given, behind the gates before it."""
    s = supplier_session(spark, sf_dir)
    execute.gates(s.report, s.plan, True, "suppliers")
    return execute.staged(s._rows(), s.plan).select(F.col("id").cast("bigint").alias("id"), "name")


@query(values("state, code, sheet_column", ("22001", "E203", "Name"), ("22003", "E205", ""), ("22P02", "E201", ""), ("23502", "E202", ""), ("23503", "E305", ""), ("23505", "E304", "Name"), ("23514", "E306", ""), ("XX000", "E306", "")))
def server_errors(spark, sf_dir):
    plan = model.build_plan([Mapping("Name", 0, "name")], CATALOG)
    said = {"23505": {"constraint": "t_name"}, "22001": {"column": "name"}}
    states = ["22001", "22003", "22P02", "23502", "23503", "23505", "23514", "XX000"]
    issues = [execute.server_issue(plan, x, "no", **said.get(x, {})) for x in states]
    return listed(spark, "state string, code string, sheet_column string", *[(x, i["code"], i["excel_column"]) for x, i in zip(states, issues)])


ISSUES = "SELECT c_custkey + 1 AS excel_row, 'E201' AS code, 'B' || (c_custkey + 1) AS excel_ref FROM customer WHERE c_custkey % 17 = 0"


@query(ISSUES)
def issues_as_csv(spark, sf_dir):
    path = f"{folder(spark)}/issues.csv"
    sheet_writer.write_issues_csv(customer_run(spark, sf_dir)[2].where("code = 'E201'"), path)
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.select(F.col("Excel row").cast("bigint").alias("excel_row"), F.col("Code").alias("code"), F.col("Excel cell").alias("excel_ref"))


@query(ISSUES)
def issues_as_workbook(spark, sf_dir):
    path = f"{folder(spark)}/issues.xlsx"
    sheet_writer.write_issues_xlsx(customer_run(spark, sf_dir)[2].where("code = 'E201'"), path)
    c = lambda i: F.get("cells", F.lit(i))["raw"]
    return xlsx.read_sheet(spark, path, "Issues", 2).select(c(2).cast("bigint").alias("excel_row"), c(1).alias("code"), c(3).alias("excel_ref"))


@query("SELECT '  error E201 B' || (c_custkey + 1) AS line FROM customer WHERE c_custkey % 17 = 0 ORDER BY c_custkey LIMIT 50")
def printed_report(spark, sf_dir):
    """The command line's report: a summary and the first fifty issues."""
    report = validate.summed(customer_run(spark, sf_dir)[2].where("code = 'E201'"), Settings())
    out = io.StringIO()
    cli.print_report(report, False, out)
    return listed(spark, "line string", *[(x.partition(":")[0],) for x in out.getvalue().split("\n") if x.startswith("  error")])


@query("SELECT count(*) AS total, count(*) AS valid, 0::BIGINT AS errors, max(s_suppkey) AS sequence FROM supplier")
def session_report(spark, sf_dir):
    """A session from opening to a clean report, and where its key sequence would be moved to."""
    s = supplier_session(spark, sf_dir)
    assert "setval(" in render.setval_statement(s.table, "id")
    top = execute.staged(s._rows(), s.plan).agg(F.coalesce(F.max(F.col("id").cast("bigint")), F.lit(1))).first()[0]
    return listed(spark, "total long, valid long, errors long, sequence long", (s.report.rows_total, s.report.rows_valid, s.report.errors, top))


# Streams

def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(read(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def run_out(df: DataFrame) -> DataFrame:
    """All that a stream gives for what is there now."""
    name, spark = f"stream_{uuid.uuid4().hex[:12]}", df.sparkSession
    at = folder(spark)
    df.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/{name}")


@query("SELECT s_suppkey AS excel_row, 'E203' AS code FROM supplier WHERE s_suppkey % 3 = 0")
def stream_row_issues(spark, sf_dir):
    df = stream(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 3 = 0 THEN concat(s_name, '!') ELSE 'ok' END AS name")
    plan = plan_of((Target("name", "varchar", max_length=5),))
    return run_out(incremental.stream_issues(from_frame(df, F.col("s_suppkey"), ["name"]), plan).select("excel_row", "code"))


@query("SELECT DISTINCT n_regionkey AS k FROM nation")
def stream_first_seen(spark, sf_dir):
    df = stream(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    return run_out(incremental.first_seen(df, ["k"], "at", "1 hour").select("k"))


@query("SELECT n_name AS k FROM nation WHERE n_nationkey % 2 = 0")
def stream_against_target(spark, sf_dir):
    found: list[DataFrame] = []
    table = Table("public", "t", (Target("name", "text"),), (Constraint("u", "u", ("name",)),))
    plan = model.build_plan([Mapping("name", 0, "name", Transform(trim=True, blank_as_null=True))], table)
    target = read(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"))
    at = folder(spark)
    sink = lambda df, n: df.select(F.col("k_0").alias("k")).write.mode("append").parquet(f"{at}/out")
    run = incremental.against_target(lambda b: from_frame(b, F.col("n_nationkey"), ["n_name"]), plan, target, sink)
    stream(spark, sf_dir, "nation").select("n_nationkey", "n_name").writeStream.foreachBatch(run).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("k string").parquet(f"{at}/out")
