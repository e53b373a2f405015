"""A query for each operator over the sample tables, with the SQL that must give the same rows.

The tables hold no dirt, so it is made from keys, by expressions that Spark and the SQL share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions import cells, text
from rowsmith.operators import keys, render, transforms, validate
from rowsmith.operators.coerce import Options, coerce
from rowsmith.operators.validate import Settings, Sheet
from rowsmith.plans import headers, matching, model
from rowsmith.plans.model import Constraint, Mapping, PlanColumn, Table, Transform
from rowsmith.plans.model import Column as Target
from rowsmith.sources.frames import from_frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TRIM = Transform(trim=True)
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_column(df: DataFrame, row: str, raw: str, target: Target, t: Transform = TRIM, options: Options = Options(), texts: bool = False) -> DataFrame:
    """row_num, code and value of a raw expression taken to a column; texts: of one that is no sheet's cell but a text as it stands."""
    plan = model.Plan(Table("public", "t", (target,)), (PlanColumn(target, Mapping("raw", 0, target.name, t)),))
    sheet = from_frame(df.select(F.expr(row).alias("row"), F.expr(raw).alias("raw")), F.col("row"), ["raw"], texts=texts)
    out = validate.evaluated(sheet, plan, options)
    return out.select("row_num", F.coalesce("v_0.code", F.lit("")).alias("code"), F.col("v_0.text").alias("value"))


# Text and cells

DIRTY_NAME = "CASE c_custkey % 4 WHEN 0 THEN concat(chr(160), c_name, chr(8203)) WHEN 1 THEN concat('  ', c_name, chr(8239), 'X ') WHEN 2 THEN concat(chr(65279), c_name) ELSE c_name END"
SPARK_DIRTY_NAME = DIRTY_NAME.replace("chr(160)", "decode(unhex('C2A0'),'UTF-8')").replace("chr(8203)", "decode(unhex('E2808B'),'UTF-8')").replace("chr(8239)", "decode(unhex('E280AF'),'UTF-8')").replace("chr(65279)", "decode(unhex('EFBBBF'),'UTF-8')")
NORM = "replace(replace(replace(replace(s, chr(160), ' '), chr(8239), ' '), chr(8203), ''), chr(65279), '')"


@query(f"SELECT c_custkey, {NORM} AS plain, trim({NORM}) AS key, lower(trim(regexp_replace({NORM}, ' +', ' ', 'g'))) AS header FROM (SELECT c_custkey, {DIRTY_NAME} AS s FROM customer)")
def text_normalize(spark, sf_dir):
    s = F.expr(SPARK_DIRTY_NAME)
    return read(spark, sf_dir, "customer").select("c_custkey", text.normalize_invisible(s).alias("plain"), text.normalize_key(s).alias("key"), text.normalize_header(s).alias("header"))


RAW_CELL = "CASE event_id % 8 WHEN 0 THEN '#N/A' WHEN 1 THEN 'TRUE' WHEN 2 THEN '   ' WHEN 3 THEN concat(' ', cast(event_id AS VARCHAR(20)), ' ') WHEN 4 THEN event_type WHEN 5 THEN '12.50' WHEN 6 THEN '1e3' ELSE ' TRUE' END"


@query(f"SELECT event_id, CASE WHEN trim(r) = '' THEN 'empty' WHEN trim(r) = '#N/A' THEN 'error' WHEN r = 'TRUE' THEN 'bool' WHEN regexp_full_match(trim(r), '[0-9.e]+') THEN 'number' ELSE 'string' END AS kind, CASE WHEN regexp_full_match(trim(r), '[0-9.e]+') THEN cast(cast(trim(r) AS DOUBLE) * 100 AS BIGINT) END AS hundredths FROM (SELECT event_id, {RAW_CELL} AS r FROM events)")
def cell_typing(spark, sf_dir):
    c = cells.typed(F.expr(RAW_CELL))
    df = read(spark, sf_dir, "events").select("event_id", c.alias("c"))
    return df.select("event_id", "c.kind", (F.col("c.num") * 100).cast("bigint").alias("hundredths"))


DUSTY = "concat(cast(l_orderkey % 999 + 1 AS VARCHAR(9)), '.', '2500000000000', cast(l_linenumber % 10 AS VARCHAR(9)), '7')"


@query(f"SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(cast(CASE length(split_part(r, '.', 1)) WHEN 1 THEN cast(round(cast(r AS DECIMAL(38,18)), 14) AS DECIMAL(38,18)) WHEN 2 THEN cast(round(cast(r AS DECIMAL(38,18)), 13) AS DECIMAL(38,18)) ELSE cast(round(cast(r AS DECIMAL(38,18)), 12) AS DECIMAL(38,18)) END AS VARCHAR), '0+$', ''), '\\.$', '') AS value FROM (SELECT l_orderkey, l_linenumber, {DUSTY} AS r FROM lineitem)")
def float_dust(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cells.to_number(F.expr(DUSTY)).alias("num"))
    return df.select("l_orderkey", "l_linenumber", cells.number_text(cells.recovered(F.col("num"))).alias("value"))


@query("SELECT o_orderkey, CASE WHEN s = 60 THEN 'error' ELSE 'date' END AS kind, CASE WHEN s <> 60 THEN strftime(DATE '1899-12-30' + CAST(s + CASE WHEN s < 60 THEN 1 ELSE 0 END AS INTEGER), '%Y-%m-%d') END AS day FROM (SELECT o_orderkey, o_orderkey % 40000 + 1 AS s FROM orders)")
def excel_serial_date(spark, sf_dir):
    c = cells.typed((F.col("o_orderkey") % 40000 + 1).cast("string"), True)
    return read(spark, sf_dir, "orders").select("o_orderkey", c.alias("c")).select("o_orderkey", "c.kind", F.date_format("c.ts", "yyyy-MM-dd").alias("day"))


@query("SELECT c_custkey, '(' || n || ')' AS ref, replace(format('{:,}', c_custkey * 1000), ',', ',') AS many FROM (SELECT c_custkey, CASE WHEN c_custkey % 52 < 26 THEN chr(CAST(65 + c_custkey % 52 AS INTEGER)) ELSE 'A' || chr(CAST(39 + c_custkey % 52 AS INTEGER)) END || c_custkey AS n FROM customer)")
def cell_references(spark, sf_dir):
    letters = F.lit([text.column_letter(i) for i in range(52)])
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(key, F.concat(F.lit("("), F.get(letters, (key % 52).cast("int")), key.cast("string"), F.lit(")")).alias("ref"), text.thousands(key * 1000).alias("many"))


# Transforms

@query("SELECT c_custkey AS row_num, '' AS code, CASE WHEN c_custkey % 5 = 0 THEN 'NONE' ELSE upper(trim(c_name)) END AS value FROM customer")
def transform_chain(spark, sf_dir):
    t = Transform(trim=True, default_on_blank="none", upper=True)
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "CASE WHEN c_custkey % 5 = 0 THEN '  ' ELSE concat('  ', c_name, ' ') END", Target("name", "text"), t)


@query("SELECT c_custkey AS row_num, '' AS code, CASE WHEN c_custkey % 2 = 0 THEN '+' ELSE '' END || regexp_replace(c_name || c_custkey, '[^0-9]', '', 'g') AS value FROM customer")
def strip_digits(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "concat(CASE WHEN c_custkey % 2 = 0 THEN '(+' ELSE '(' END, c_name, ')+', c_custkey)", Target("phone", "text"), Transform(strip_non_digits=True))


@query("SELECT c_custkey AS row_num, '' AS code, CASE upper(c_mktsegment) WHEN 'BUILDING' THEN 'B' WHEN 'AUTOMOBILE' THEN 'A' ELSE c_mktsegment END AS value FROM customer")
def value_map(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", Target("segment", "text"), Transform(trim=True, value_map={"building": "B", "AUTOMOBILE": "A"}))


@query("SELECT c_custkey AS row_num, CASE WHEN c_custkey % 3 = 0 THEN 'E202' ELSE '' END AS code, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS value FROM customer")
def blank_to_null(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END", Target("name", "text", nullable=False), Transform(trim=True, blank_as_null=True))


WORDS = "CASE l_linenumber % 7 WHEN 0 THEN 'oui' WHEN 1 THEN 'OFF' WHEN 2 THEN 'maybe' WHEN 3 THEN '1' WHEN 4 THEN 'inactif' WHEN 5 THEN '2' ELSE 'FALSE' END"


@query("SELECT l_orderkey * 10 + l_linenumber AS row_num, CASE WHEN l_linenumber % 7 IN (2, 5) THEN 'E201' ELSE '' END AS code, CASE l_linenumber % 7 WHEN 0 THEN 'true' WHEN 3 THEN 'true' WHEN 1 THEN 'false' WHEN 4 THEN 'false' WHEN 6 THEN 'false' END AS value FROM lineitem")
def bool_words(spark, sf_dir):
    return one_column(read(spark, sf_dir, "lineitem"), "l_orderkey * 10 + l_linenumber", WORDS, Target("flag", "bool"))


DAY = "date_format(o_orderdate, '{}')"
SPARK_DATES = "CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN " + DAY.format(p) for k, p in enumerate(["yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "d MMMM yyyy", "MMM d, yyyy"])) + " ELSE concat(date_format(o_orderdate, 'yyyy'), '-99-99') END"


@query("SELECT o_orderkey AS row_num, CASE WHEN o_orderkey % 6 = 5 THEN 'E201' ELSE '' END AS code, CASE WHEN o_orderkey % 6 <> 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS value FROM orders")
def date_layouts(spark, sf_dir):
    return one_column(read(spark, sf_dir, "orders"), "o_orderkey", SPARK_DATES, Target("day", "date"))


@query("SELECT o_orderkey AS row_num, '' AS code, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS value FROM orders")
def date_one_layout(spark, sf_dir):
    return one_column(read(spark, sf_dir, "orders"), "o_orderkey", "date_format(o_orderdate, 'yyyyMMdd HHmmss')", Target("at", "timestamp"), Transform(trim=True, date_format="yyyyMMdd HHmmss"))


@query("SELECT event_id AS row_num, '' AS code, strftime(w, '%Y-%m-%d %H:%M:%S') || CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(m) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(m) % 60 AS VARCHAR), 2, '0') AS value FROM (SELECT event_id, w, CAST((epoch(w) - epoch(w AT TIME ZONE 'Asia/Beirut')) / 60 AS BIGINT) AS m FROM (SELECT event_id, date_trunc('second', CAST(ts AS TIMESTAMP)) AS w FROM events))")
def timestamptz_offset(spark, sf_dir):
    return one_column(read(spark, sf_dir, "events"), "event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", Target("at", "timestamptz"), options=Options(timezone="Asia/Beirut"))


@query("SELECT event_id AS row_num, CASE WHEN event_id % 9 = 0 THEN 'E201' ELSE '' END AS code, CASE WHEN event_id % 9 <> 0 THEN strftime(CAST(ts AS TIMESTAMP), '%H:%M:%S') END AS value FROM events")
def coerce_time(spark, sf_dir):
    return one_column(read(spark, sf_dir, "events"), "event_id", "CASE WHEN event_id % 9 = 0 THEN '25:61' ELSE date_format(ts, 'HH:mm:ss') END", Target("at", "time"))


# Casts

INTEGERS = "CASE l_partkey % 7 WHEN 0 THEN 'abc' WHEN 1 THEN '12.5' WHEN 2 THEN '12.00' WHEN 3 THEN '99999999999' WHEN 4 THEN '123456789012345678901234567890' WHEN 5 THEN concat(' ', cast(l_suppkey AS VARCHAR(20)), ' ') ELSE cast(l_partkey AS VARCHAR(20)) END"
LINE_ROW = "l_orderkey * 10 + l_linenumber"


@query(f"SELECT {LINE_ROW} AS row_num, CASE l_partkey % 7 WHEN 0 THEN 'E201' WHEN 1 THEN 'E201' WHEN 3 THEN 'E205' WHEN 4 THEN 'E205' ELSE '' END AS code, CASE l_partkey % 7 WHEN 2 THEN '12' WHEN 5 THEN CAST(l_suppkey AS VARCHAR) WHEN 6 THEN CAST(l_partkey AS VARCHAR) END AS value FROM lineitem")
def coerce_integer(spark, sf_dir):
    return one_column(read(spark, sf_dir, "lineitem"), LINE_ROW, INTEGERS, Target("n", "int4"))


NUMBERS = "CASE l_partkey % 6 WHEN 0 THEN '1,234.50' WHEN 1 THEN '12.345' WHEN 2 THEN '12.3000' WHEN 3 THEN '1234567.1' WHEN 4 THEN 'USD 5' ELSE cast(l_partkey AS VARCHAR(20)) END"
NUMBER_SQL = "SELECT {row} AS row_num, CASE l_partkey % 6 {one} WHEN 3 THEN 'E204' WHEN 4 THEN 'E201' ELSE '' END AS code, CASE l_partkey % 6 WHEN 0 THEN '1234.50' {two} WHEN 2 THEN '12.30' WHEN 5 THEN CAST(l_partkey AS VARCHAR) || '.00' END AS value FROM lineitem"


@query(NUMBER_SQL.format(row=LINE_ROW, one="WHEN 1 THEN 'E204'", two=""))
def coerce_numeric(spark, sf_dir):
    return one_column(read(spark, sf_dir, "lineitem"), LINE_ROW, NUMBERS, Target("n", "numeric", precision=8, scale=2))


@query(NUMBER_SQL.format(row=LINE_ROW, one="", two="WHEN 1 THEN '12.35'"))
def coerce_numeric_rounding(spark, sf_dir):
    return one_column(read(spark, sf_dir, "lineitem"), LINE_ROW, NUMBERS, Target("n", "numeric", precision=8, scale=2), options=Options(rounding=True))


@query(f"SELECT {LINE_ROW} AS row_num, CASE WHEN l_partkey % 4 IN (0, 1) THEN 'E201' ELSE '' END AS code, CASE l_partkey % 4 WHEN 2 THEN '2.5' WHEN 3 THEN CAST(l_suppkey AS VARCHAR) || '.25' END AS value FROM lineitem")
def coerce_float(spark, sf_dir):
    raw = "CASE l_partkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '1.5d' WHEN 2 THEN '0.25e1' ELSE concat(l_suppkey, '.25') END"
    return one_column(read(spark, sf_dir, "lineitem"), LINE_ROW, raw, Target("x", "float8"))


@query("SELECT doc_id AS row_num, CASE WHEN length(text) > 500 THEN 'E203' ELSE '' END AS code, CASE WHEN length(text) <= 500 THEN text END AS value FROM documents")
def coerce_text_length(spark, sf_dir):
    return one_column(read(spark, sf_dir, "documents"), "doc_id", "text", Target("text", "varchar", max_length=500), Transform(), texts=True)


@query("SELECT c_custkey AS row_num, CASE WHEN c_custkey % 10 = 0 THEN 'E206' WHEN upper(c_mktsegment) NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN 'E206' ELSE '' END AS code, CASE WHEN c_custkey % 10 <> 0 AND upper(c_mktsegment) IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') THEN upper(c_mktsegment) END AS value FROM customer")
def coerce_enum(spark, sf_dir):
    raw = "CASE WHEN c_custkey % 10 = 0 THEN concat(c_mktsegment, 'X') ELSE lower(c_mktsegment) END"
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", raw, Target("segment", "segment", enum_values=SEGMENTS), options=Options(enum_ignore_case=True))


@query("SELECT p_partkey AS row_num, CASE WHEN p_partkey % 5 = 0 THEN 'E207' ELSE '' END AS code, CASE WHEN p_partkey % 5 <> 0 THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) END AS value FROM (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part)")
def coerce_uuid(spark, sf_dir):
    raw = "CASE WHEN p_partkey % 5 = 0 THEN concat('g', substr(md5(cast(p_partkey AS string)), 2)) ELSE upper(md5(cast(p_partkey AS string))) END"
    return one_column(read(spark, sf_dir, "part"), "p_partkey", raw, Target("id", "uuid"))


@query("SELECT event_id AS row_num, CASE WHEN event_id % 4 = 0 THEN 'E208' ELSE '' END AS code, CASE WHEN event_id % 4 <> 0 THEN props END AS value FROM events")
def coerce_json(spark, sf_dir):
    raw = "CASE WHEN event_id % 4 = 0 THEN substr(props, 1, length(props) - 1) ELSE props END"
    return one_column(read(spark, sf_dir, "events"), "event_id", raw, Target("props", "json"), Transform(), texts=True)


@query("SELECT event_id AS row_num, '' AS code, '{\"a\": [1, 2.50], \"b\": ' || event_id || '}' AS value FROM events")
def json_canonical(spark, sf_dir):
    return one_column(read(spark, sf_dir, "events"), "event_id", "concat('{\"b\":', event_id, ' , \"a\":[1,2.50]}')", Target("props", "jsonb"), Transform())


ADDRESS = "concat('10.', cast(c_custkey % 256 AS VARCHAR(9)), '.', cast(c_nationkey AS VARCHAR(9)), '.', CASE WHEN c_custkey % 6 = 0 THEN '256' ELSE '7' END, CASE WHEN c_custkey % 4 = 1 THEN '/24' ELSE '' END)"


@query(f"SELECT c_custkey AS row_num, CASE WHEN c_custkey % 6 = 0 THEN 'E201' ELSE '' END AS code, CASE WHEN c_custkey % 6 <> 0 THEN {ADDRESS} END AS value FROM customer")
def coerce_inet(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", ADDRESS, Target("ip", "inet"))


@query(f"SELECT c_custkey AS row_num, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 4 <> 1 THEN 'E201' ELSE '' END AS code, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 4 = 1 THEN {ADDRESS} END AS value FROM customer")
def coerce_cidr(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", ADDRESS, Target("ip", "cidr"))


@query("SELECT c_custkey AS row_num, 'E210' AS code, CAST(NULL AS VARCHAR) AS value FROM customer")
def error_cells(spark, sf_dir):
    return one_column(read(spark, sf_dir, "customer"), "c_custkey", "'#DIV/0!'", Target("name", "text"))


@query("SELECT vec_id AS row_num, 'E106' AS code, CAST(NULL AS VARCHAR) AS value FROM embeddings")
def unsupported_type(spark, sf_dir):
    return one_column(read(spark, sf_dir, "embeddings"), "vec_id", "cast(embedding AS string)", Target("embedding", "_float4"))


# CHECK constraints

PART = (Target("p_partkey", "int8"), Target("p_name", "text"), Target("p_brand", "text"), Target("p_type", "text"), Target("p_size", "int4"), Target("p_retailprice", "numeric"))
NULL_SIZE = "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END"


def plan_of(columns: tuple[Target, ...], constraints: tuple[Constraint, ...] = (), t: Transform = Transform(trim=True, blank_as_null=True), name: str = "t") -> model.Plan:
    table = Table("public", name, columns, constraints)
    return model.build_plan([Mapping(c.name, i, c.name, t) for i, c in enumerate(columns)], table)


def checked(spark: SparkSession, sf_dir: str, definition: str, size: str = "p_size") -> DataFrame:
    df = read(spark, sf_dir, "part").withColumn("p_size", F.expr(size)).withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(12,2)"))
    names = [c.name for c in PART]
    plan = plan_of(PART, (Constraint("k", "c", (), definition),))
    checks, _ = validate.compile_checks(plan.table)
    rows = validate.evaluated(from_frame(df, F.col("p_partkey"), names), plan)
    return validate.row_issues(rows, plan, checks).select(F.explode("issues").alias("i")).select(F.col("i.excel_row").alias("row_num"), "i.code", "i.db_column")


def check_sql(column: str, fails: str) -> str:
    return f"SELECT p_partkey AS row_num, 'E306' AS code, '{column}' AS db_column FROM part WHERE {fails}"


@query(check_sql("p_retailprice", "CAST(p_retailprice AS DECIMAL(12,2)) < 1000"))
def check_compare(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_retailprice >= (1000)::numeric))")


@query(check_sql("p_size", "p_size NOT BETWEEN 10 AND 40 OR p_size = 25"))
def check_between(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK (((p_size BETWEEN 10 AND 40) AND (p_size <> '25'::integer)))")


@query(check_sql("p_brand", "p_brand NOT IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21')"))
def check_in(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_brand = ANY (ARRAY['Brand#11'::text, 'Brand#12'::text, 'Brand#13'::text, 'Brand#21'::text])))")


@query(check_sql("p_name", "length(p_name) > 7"))
def check_length(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((char_length(p_name) <= 7))")


@query(check_sql("p_type", "NOT regexp_matches(lower(p_type), '^[a-l].*[a-m]$')"))
def check_regex(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_type ~* '^[a-l].*[a-m]$'::text))")


@query(check_sql("p_size", "p_partkey % 3 <> 0 AND p_size > 20"))
def check_null_semantics(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_size <= 20))", NULL_SIZE)


@query(check_sql("p_size", "p_partkey % 3 = 0"))
def check_not_null(spark, sf_dir):
    return checked(spark, sf_dir, "CHECK ((p_size IS NOT NULL))", NULL_SIZE)


# Rows and keys

@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 9 = 0) AS blank, count(*) FILTER (WHERE o_orderkey % 9 <> 0) AS valid FROM orders")
def blank_rows(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS s", "CASE WHEN o_orderkey % 9 = 0 THEN '  ' ELSE o_orderpriority END AS p")
    plan = plan_of((Target("s", "text"), Target("p", "text")))
    rows = validate.evaluated(from_frame(df, F.col("o_orderkey"), ["s", "p"]), plan)
    judged = validate.row_issues(rows, plan, []).agg(F.count_if(F.size("issues") == 0).alias("valid"))
    return rows.agg(F.count("*").alias("total"), F.count_if("blank").alias("blank")).join(judged)


@query("SELECT o_orderkey AS row_num, k, f AS first_row FROM (SELECT o_orderkey, o_orderkey % 5000 AS k, min(o_orderkey) OVER (PARTITION BY o_orderkey % 5000) AS f FROM orders) WHERE o_orderkey > f")
def dup_single(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_num", "o_orderkey % 5000 AS k")
    return keys.duplicates(df, ["k"]).select("row_num", "k", "first_row")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) - 1 AS BIGINT) AS later FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def dup_composite(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("row_num"))
    first = keys.first_rows(df, ["l_orderkey", "l_linenumber"])
    return first.where("times > 1").select("l_orderkey", "l_linenumber", (F.col("times") - 1).alias("later"))


@query("SELECT o_custkey AS k, min(o_orderkey) AS row_num FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def exists_in_target(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_num", "o_custkey AS k")
    return keys.existing(df, ["k"], read(spark, sf_dir, "customer").where("c_custkey % 2 = 0"), ["c_custkey"])


@query("SELECT o_orderkey AS row_num, o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_missing(spark, sf_dir):
    df = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_num", "o_custkey AS k")
    return keys.missing(df, ["k"], read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), ["c_custkey"]).select("row_num", "k")


@query("SELECT l_orderkey AS a, l_linenumber AS b, l_partkey AS c FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderkey % 7 = l.l_linenumber)")
def fk_missing_composite(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS a", "cast(l_linenumber AS bigint) AS b", "l_partkey AS c")
    ref = read(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 7 AS part")
    return keys.missing(df, ["a", "b"], ref, ["o_orderkey", "part"]).selectExpr("a", "cast(b AS int) AS b", "c")


# Reports

CUSTOMER = (Target("name", "varchar", nullable=False, max_length=18), Target("balance", "numeric", precision=6, scale=2), Target("segment", "segment", enum_values=SEGMENTS, enum_schema="public"))


def customer_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, model.Plan, DataFrame]:
    """Evaluated rows, plan and row issues of customers with some dirt."""
    df = read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN concat(c_name, '-', c_name) ELSE c_name END AS name",
        "CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE cast(cast(c_acctbal AS decimal(12,2)) AS string) END AS balance", "c_mktsegment AS segment",
    )
    plan = plan_of(CUSTOMER, (Constraint("positive", "c", (), "CHECK ((balance >= (0)::numeric))"),), name="customers")
    rows = validate.evaluated(from_frame(df, F.col("c_custkey") + 1, ["name", "balance", "segment"]), plan)
    checks, _ = validate.compile_checks(plan.table)
    issues = validate.row_issues(rows, plan, checks).select(F.explode("issues").alias("i")).select("i.*")
    return rows, plan, issues


BAD = """
WITH c AS (SELECT c_custkey, c_custkey + 1 AS r, c_custkey % 11 = 0 AS no_name, c_custkey % 13 = 0 AND c_custkey % 11 <> 0 AS long_name, c_custkey % 17 = 0 AS no_number,
             CAST(c_acctbal AS DECIMAL(12,2)) AS b, c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD') AS known FROM customer),
i AS (SELECT r AS excel_row, 'name' AS db_column, 'A' || r AS excel_ref, CASE WHEN no_name THEN 'E202' ELSE 'E203' END AS code FROM c WHERE no_name OR long_name
  UNION ALL SELECT r, 'balance', 'B' || r, 'E201' FROM c WHERE no_number
  UNION ALL SELECT r, 'balance', 'B' || r, 'E204' FROM c WHERE NOT no_number AND abs(b) >= 10000
  UNION ALL SELECT r, 'segment', 'C' || r, 'E206' FROM c WHERE NOT known
  UNION ALL SELECT r, 'balance', 'B' || r, 'E306' FROM c WHERE b < 0 AND abs(b) < 10000 AND known AND NOT (no_name OR long_name OR no_number))
"""


@query(BAD + "SELECT * FROM i")
def issues_report(spark, sf_dir):
    return customer_run(spark, sf_dir)[2].select("excel_row", "db_column", "excel_ref", "code")


@query(BAD + "SELECT code, count(*) AS n FROM i GROUP BY 1")
def issues_by_code(spark, sf_dir):
    return customer_run(spark, sf_dir)[2].groupBy("code").agg(F.count("*").alias("n"))


@query(BAD + "SELECT db_column AS excel_column, 'error' AS severity, count(*) AS n FROM i GROUP BY 1")
def issues_by_column(spark, sf_dir):
    counted = validate.counted(customer_run(spark, sf_dir)[2])
    return counted.groupBy("excel_column", "severity").agg(F.sum("count").alias("n"))


@query(BAD + "SELECT * FROM i ORDER BY excel_row, db_column, code LIMIT 100")
def issue_ceiling(spark, sf_dir):
    return validate.ordered(customer_run(spark, sf_dir)[2], 100).select("excel_row", "db_column", "excel_ref", "code")


@query(BAD + "SELECT * FROM i WHERE db_column = 'balance' AND code = 'E204'")
def issue_filter(spark, sf_dir):
    found = validate.filtered(customer_run(spark, sf_dir)[2], "error", "E204", "balance", "b")
    return found.select("excel_row", "db_column", "excel_ref", "code")


@query(BAD + "SELECT count(*) AS total, count(*) FILTER (WHERE r NOT IN (SELECT excel_row FROM i)) AS valid FROM c")
def row_counters(spark, sf_dir):
    rows, plan, _ = customer_run(spark, sf_dir)
    checks, _ = validate.compile_checks(plan.table)
    return validate.row_issues(rows, plan, checks).agg(F.count("*").alias("total"), F.count_if(F.size("issues") == 0).alias("valid"))


@query("SELECT * FROM (VALUES ('c0', 40::BIGINT, 'E104'), ('c1', 0, ''), ('c2', 0, 'W202')) t(col, pct, code)")
def phase_a_verdicts(spark, sf_dir):
    df = read(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 5 < 2 THEN 'x' ELSE cast(s_nationkey AS string) END AS c0", "s_name AS c1", "CASE WHEN s_suppkey % 5 < 3 THEN '' ELSE 'y' END AS c2")
    plan = plan_of((Target("c0", "int4"), Target("c1", "text"), Target("c2", "text")))
    rows = validate.evaluated(from_frame(df, F.col("s_suppkey"), ["c0", "c1", "c2"]), plan)
    verdicts, problems = validate.column_verdicts(validate.column_stats(rows, plan), plan)
    codes = {p.sheet_column: p.code for p in problems}
    return spark.createDataFrame([(v.sheet_column, round(100 * v.failure_rate), codes.get(v.sheet_column, "")) for v in verdicts], "col string, pct long, code string")


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM (SELECT o_orderkey FROM orders WHERE o_orderkey <= (SELECT min(o_orderkey) FROM orders) + 199 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders) - 200)")
def sample_ends(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_num"))
    lo, hi = df.agg(F.min("row_num"), F.max("row_num")).first()
    part = validate.sampled(df, lo, hi).where((F.col("row_num") < lo + validate.HEAD) | (F.col("row_num") > hi - validate.TAIL))
    return part.agg(F.count("*").alias("n"), F.min("row_num").alias("lo"), F.max("row_num").alias("hi"))


# Headers and matching

HEADERS = ["Customer Name", "E-Mail", "Mobile", "Acct Balance", "customername", "Segmnt", "zzz"]
NAMES = ["customer_name", "email", "phone", "balance", "segment"]


@query("""
WITH h(header) AS (VALUES ('Customer Name'), ('E-Mail'), ('Mobile'), ('Acct Balance'), ('customername'), ('Segmnt'), ('zzz')),
c(name) AS (VALUES ('customer_name'), ('email'), ('phone'), ('balance'), ('segment')),
p AS (SELECT header, name, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS hs, regexp_replace(name, '[^a-z0-9]', '', 'g') AS cs FROM h, c),
r AS (SELECT *, 1 - levenshtein(hs, cs) / greatest(length(hs), length(cs)) AS ratio FROM p)
SELECT header, name, CAST(round(1000 * CASE WHEN lower(header) = name THEN 1.0 WHEN hs = cs THEN 0.95 WHEN (lower(header), name) IN (('mobile', 'phone')) THEN 0.7
  WHEN contains(hs, cs) OR contains(cs, hs) THEN 0.75 WHEN ratio > 0.8 THEN 0.6 + (ratio - 0.8) ELSE 0 END) AS BIGINT) AS score FROM r
""")
def header_match_scores(spark, sf_dir):
    h, c = spark.createDataFrame([(x,) for x in HEADERS], "header string"), spark.createDataFrame([(x,) for x in NAMES], "name string")
    pairs = h.crossJoin(F.broadcast(c))  # two lists of names
    return matching.scored(pairs, "header", "name").select("header", "name", F.round(1000 * F.col("score")).cast("bigint").alias("score"))


@query("SELECT c_custkey, 'sha256:' || sha256('name' || chr(31) || lower(c_mktsegment) || chr(31) || 'x y') AS fingerprint FROM customer")
def header_fingerprint(spark, sf_dir):
    names = F.array(F.lit(" Name "), F.col("c_mktsegment"), F.lit("X   y"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.fingerprint(names).alias("fingerprint"))


@query("SELECT * FROM (VALUES ('added', 'Total'), ('removed', 'Code'), ('moved', 'Name'), ('moved', 'Email')) t(change, name)")
def header_diff(spark, sf_dir):
    frame = lambda names: spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    return headers.header_diff(frame(["Name", "Email", "Code", "Notes"]), frame(["email", "NAME", "Total", "notes"]))


@query("SELECT n_nationkey + 1 AS pos, CASE k WHEN 1 THEN 'R' || n_regionkey ELSE 'R' || n_regionkey || ' (' || k || ')' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)")
def header_numbering(spark, sf_dir):
    df = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("pos"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("name"))
    return headers.numbered(df)


@query("SELECT * FROM (VALUES (1::BIGINT, CAST(round(1000 * 0.4 * (0.30 * 1 / 4 + 0.20 * 1 / 4 + 0.15 + 0.35 * 1 / 8)) AS BIGINT)), (2, 1000), (3, CAST(round(1000 * (0.30 + 0.15 + 0.35 * 4 / 8)) AS BIGINT))) t(row_num, score)")
def header_score(spark, sf_dir):
    rows = [(1, ["Report", "", "", ""]), (2, ["Name", "Code", "When", "Total"]), (3, ["1", "2", "3", "4"])]
    df = spark.createDataFrame(rows, "row_num long, raw array<string>").select("row_num", F.transform("raw", lambda r: cells.typed(r)).alias("cells"))
    return headers.header_scores(df).select("row_num", F.round(1000 * F.col("score")).cast("bigint").alias("score"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'customer_email' WHEN c_custkey % 3 = 1 THEN 'order_total' ELSE 'BirthDate' END AS name, c_custkey % 3 <> 1 AS personal FROM customer")
def pii_columns(spark, sf_dir):
    name = F.expr("CASE WHEN c_custkey % 3 = 0 THEN 'customer_email' WHEN c_custkey % 3 = 1 THEN 'order_total' ELSE 'BirthDate' END")
    return read(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), text.personal_data(name).alias("personal"))


@query("SELECT * FROM (VALUES ('created_at'), ('id')) t(name)")
def defaulted_columns(spark, sf_dir):
    table = Table("public", "t", (Target("id", "int4", False, identity="BY DEFAULT"), Target("name", "text"), Target("created_at", "timestamptz", False, True)))
    plan = model.build_plan([Mapping("Name", 0, "name")], table)
    return spark.createDataFrame([(n,) for n in model.defaulted_columns(plan)], "name string")


@query("SELECT * FROM (VALUES ('E101', 'gone'), ('E103', 'id'), ('E105', 'name'), ('E102', 'must'), ('E106', 'tags')) t(code, db_column)")
def structural_problems(spark, sf_dir):
    table = Table("public", "t", (Target("id", "int4", False, identity="ALWAYS"), Target("name", "text"), Target("must", "text", False), Target("tags", "_text")))
    mappings = [Mapping("A", 0, "id"), Mapping("B", 1, "name"), Mapping("C", 2, "name"), Mapping("D", 3, "tags"), Mapping("E", 4, "gone")]
    return spark.createDataFrame([(p.code, p.db_column) for p in model.check(mappings, table, ["a", "b", "c", "d", "e"]).problems], "code string, db_column string")


# Output

def clean_run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, model.Plan]:
    df = read(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN concat(c_name, ' O''Brien \\\\ Co') ELSE c_name END AS name", "cast(cast(c_acctbal AS decimal(12,2)) AS string) AS balance", "CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_mktsegment END AS segment", "c_custkey % 2 = 0 AS active")
    plan = plan_of((Target("name", "text"), Target("balance", "numeric", precision=12, scale=2), Target("segment", "segment", enum_values=(*SEGMENTS, "MACHINERY"), enum_schema="public"), Target("active", "bool")), name="customers")
    return validate.evaluated(from_frame(df, F.col("c_custkey") + 1, ["name", "balance", "segment", "active"]), plan), plan


OUT = "SELECT c_custkey + 1 AS r, CASE WHEN c_custkey % 4 = 0 THEN c_name || ' O''Brien \\ Co' ELSE c_name END AS n, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS b, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS s, c_custkey % 2 = 0 AS a FROM customer"
VALUES = "'(' || '''' || replace(n, '''', '''''') || ''', ' || b || ', ' || coalesce('''' || s || '''::\"public\".\"segment\"', 'NULL') || ', ' || CASE WHEN a THEN 'TRUE' ELSE 'FALSE' END || ')'"


@query(f"SELECT r AS row_num, {VALUES} AS \"values\" FROM ({OUT})")
def insert_literals(spark, sf_dir):
    return render.insert_values(*clean_run(spark, sf_dir))


@query(f"SELECT r AS row_num, replace(n, '\\', '\\\\') || chr(9) || b || chr(9) || coalesce(s, '\\N') || chr(9) || CASE WHEN a THEN 'TRUE' ELSE 'FALSE' END AS line FROM ({OUT})")
def copy_rows(spark, sf_dir):
    return render.copy_rows(*clean_run(spark, sf_dir))


HEAD = "chr(10) || 'INSERT INTO \"public\".\"customers\"' || chr(10) || '    (\"name\", \"balance\", \"segment\", \"active\")' || chr(10) || 'VALUES' || chr(10)"


@query(f"SELECT batch, min(r) AS first_row, max(r) AS last_row, count(*) AS n_rows, sha256({HEAD} || string_agg('    ' || v, ',' || chr(10) ORDER BY r) || ';   -- rows ' || min(r) || '-' || max(r) || chr(10)) AS statement FROM (SELECT r, {VALUES} AS v, (row_number() OVER (ORDER BY r) - 1) // 200 AS batch FROM ({OUT})) GROUP BY batch")
def insert_batches(spark, sf_dir):
    rows, plan = clean_run(spark, sf_dir)
    df = render.insert_batches(render.insert_values(rows, plan), plan.table, plan.names, 200)
    return df.withColumn("statement", F.sha2("statement", 256))


@query("SELECT c_custkey, ' E''' || c_name || '\\\\''''''' AS literal FROM customer")
def quote_literal_escapes(spark, sf_dir):
    s = F.concat(F.col("c_name"), F.lit("\\'"))
    return read(spark, sf_dir, "customer").select("c_custkey", text.quote_literal(s, False).alias("literal"))


@query("SELECT coalesce(max(o_orderkey), 1) AS last_value FROM orders")
def setval_maximum(spark, sf_dir):
    return read(spark, sf_dir, "orders").agg(F.coalesce(F.max("o_orderkey"), F.lit(1)).alias("last_value"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of a dirty customer sheet, counted by code and column."""
    return customer_run(spark, sf_dir)[2].groupBy("code", "db_column").agg(F.count("*").alias("n"))


import rowsmith.queries_more  # noqa: E402,F401  registers the queries that go through files, catalogs, sessions and streams
