import struct
import tracemalloc
import zipfile

import pytest
import xxhash
from pyspark.sql import functions as F

from rowsmith import cli
from rowsmith.operators import render, validate
from rowsmith.operators.checks import Unverifiable, parse_check
from rowsmith.plans import config, headers, matching, model
from rowsmith.plans.model import Column, Constraint, Mapping, Table, Transform, UniqueIndex
from rowsmith.session import NotReady, Session
from rowsmith.sources import catalog, execute, sheet_writer, xlsx
from rowsmith.sources.frames import from_frame, from_workbook

CUSTOMERS = Table(
    "public", "customers",
    (
        Column("id", "int4", False, identity="BY DEFAULT"), Column("name", "varchar", False, max_length=255), Column("email", "varchar", False, max_length=255),
        Column("phone", "varchar", max_length=32), Column("status", "customer_status", enum_values=("active", "inactive"), enum_schema="public"),
        Column("credit_limit", "numeric", precision=12, scale=2), Column("signup_date", "date"), Column("notes", "text"),
    ),
    (Constraint("customers_pkey", "p", ("id",)), Constraint("customers_email_key", "u", ("email",))),
)
HEADERS = ["Customer", "Email", "Mobile", "Status", "Credit Limit", "Signup Date", "Notes"]
ROWS = [
    ("Birke Holzbau", "post@birke.example", "+49 30 901820", "Neu", 8800, 45366, None),
    ("D'Arcy + Töchter", "mail@darcy.example", "+44 20 7946 0018", "Neu", 417.5, 45383, "Net 30"),
    ("Kiel \\ Segel", "crew@kiel.example", "0431 55 667", "Alt", 0, 45291, "Name with a backslash"),
]
WORDS = {"Neu": "active", "Alt": "inactive"}
MAPPINGS = [
    Mapping("Customer", 0, "name", Transform(trim=True)), Mapping("Email", 1, "email", Transform(trim=True)), Mapping("Mobile", 2, "phone", Transform(strip_non_digits=True)),
    Mapping("Status", 3, "status", Transform(trim=True, value_map=WORDS)), Mapping("Credit Limit", 4, "credit_limit"), Mapping("Signup Date", 5, "signup_date"), Mapping("Notes", 6, "notes"),
]


@pytest.fixture
def workbook(tmp_path):
    path = str(tmp_path / "customers.xlsx")
    sheet_writer.write_xlsx(path, "Sheet1", HEADERS, [list(r) for r in ROWS], frozenset({5}))
    return path


def test_workbook_to_script(spark, workbook, tmp_path):
    s = Session(spark)
    s.use_table(CUSTOMERS)
    sheet = s.open(workbook)
    assert sheet.headers == HEADERS
    assert not s.map(*MAPPINGS).blocking and s.strategy == model.SEQUENCE
    with pytest.raises(NotReady):
        s.generate(str(tmp_path / "early.sql"))
    report = s.validate()
    assert report.clean, report.issues.collect()
    assert (report.rows_total, report.rows_valid) == (3, 3)
    out = open(s.generate(str(tmp_path / "out.sql"))).read()
    assert "    ('Birke Holzbau', 'post@birke.example', '+4930901820', 'active'::\"public\".\"customer_status\", 8800.00, '2024-03-15'::date, NULL),\n" in out
    assert "('D''Arcy + Töchter', 'mail@darcy.example', '+442079460018', 'active'::\"public\".\"customer_status\", 417.50, '2024-04-01'::date, 'Net 30'),\n" in out
    assert "('Kiel \\ Segel', 'crew@kiel.example', '043155667', 'inactive'::\"public\".\"customer_status\", 0.00, '2023-12-31'::date, 'Name with a backslash');   -- rows 2-4\n" in out
    assert "personal data in the columns name, email, phone" in out and "3 rows across 1 statement(s)" in out and "BEGIN;" in out
    s.output = render.Output(mode="copy", setval="id")
    text = "".join(render.script(s._rows(), s.plan, s.output))
    assert "Kiel \\\\ Segel\tcrew@kiel.example\t043155667\tinactive\t0.00\t2023-12-31\tName with a backslash\n\\.\n" in text and "setval(" in text
    with pytest.raises(FileExistsError):
        s.generate(str(tmp_path / "out.sql"))
    s.save(str(tmp_path / "layout.json"), "x")
    other = Session(spark)
    other.use_table(CUSTOMERS)
    other.open(workbook)
    assert other.load(str(tmp_path / "layout.json")) == [] and other.mappings == s.mappings


def test_source_metadata(spark, workbook, tmp_path):
    df = xlsx.read_sheet(spark, workbook)
    assert xlsx.count_rows(df) == (4, 4) and xlsx.Workbook.open(workbook).sheets.keys() == {"Sheet1"}
    assert xlsx.preview(df, 2, 2).count() == 2 and xlsx.sampled_date_columns(df, 2) == [5] and xlsx.merged_ranges(workbook, "Sheet1", 4) == ([], True)
    assert xlsx.formula_gaps(df, 1, 7).count() == 0 and not xlsx.random_access_affordable(0)
    guess = headers.detect_header(xlsx.typed_rows(df))
    assert guess.row == 1 and guess.score > 0.6
    bad = tmp_path / "bad.xlsx"
    bad.write_bytes(b"no zip")
    with pytest.raises(xlsx.UnsafeWorkbook):
        xlsx.check_archive(str(bad))


def sheet_of(spark, rows, names):
    return from_frame(spark.createDataFrame([(i + 2, *r) for i, r in enumerate(rows)], "n long, " + ", ".join(f"{c} string" for c in names)), F.col("n"), list(names))


PEOPLE = Table("public", "people", (Column("email", "varchar", False, max_length=20), Column("age", "int2"), Column("region", "text")), (Constraint("pk", "p", ("email",)), Constraint("grown", "c", (), "CHECK ((age >= 18))"), Constraint("fk", "f", ("region",), "", "regions", ("code",))))
THREE = [Mapping("email", 0, "email", Transform(trim=True, blank_as_null=True)), Mapping("age", 1, "age", Transform(trim=True, blank_as_null=True)), Mapping("region", 2, "region", Transform(trim=True, blank_as_null=True))]


def test_codes_and_counts(spark):
    rows = [("a@x", "20", "N"), ("b@x", "17", "N"), ("a@x", "30", "S"), ("", "", ""), ("c@x", "40", "Z"), ("d@x", "50", "N"), ("", "21", "N"), ("e@x", "22", None), ("f@x", "23", "N"), ("g@x", "24", "N")]
    target = spark.createDataFrame([("d@x",), ("zz",)], "email string")
    regions = spark.createDataFrame([("N",), ("S",)], "code string")
    settings = validate.Settings(check_foreign=True)
    r = validate.validate(sheet_of(spark, rows, ["email", "age", "region"]), model.build_plan(THREE, PEOPLE), settings, target, {"regions": regions})
    assert r.by_code == {"E306": 1, "E301": 1, "E305": 1, "E302": 1, "E202": 1}
    assert (r.rows_total, r.rows_valid, r.rows_skipped, r.errors) == (9, 7, 1, 5)
    listed = [(i["code"], i["excel_row"], i["excel_ref"]) for i in r.issues.collect()]
    assert listed == [("E306", 3, "B3"), ("E301", 4, "A4"), ("E305", 6, "C6"), ("E302", 7, "A7"), ("E202", 8, "A8")]
    assert "row 2 has the same key" in r.issues.where("code = 'E301'").first()["message"]
    cut = validate.validate(sheet_of(spark, rows, ["email", "age", "region"]), model.build_plan(THREE, PEOPLE), validate.Settings(max_issues=1), target)
    assert cut.truncated and cut.issues.count() == 1 and cut.errors == 4


def test_misaligned_column_stops_early(spark):
    rows = [(f"e{i}@x", "abc" if i % 2 else str(i + 20), "N") for i in range(40)]
    r = validate.validate(sheet_of(spark, rows, ["email", "age", "region"]), model.build_plan(THREE, PEOPLE))
    assert r.by_code == {"E104": 1} and r.rows_total == 0 and [v.blocked for v in r.verdicts] == [False, True, False]


def test_checks():
    p = parse_check("CHECK (((status)::text = ANY ((ARRAY['a'::character varying, 'b, c'::character varying])::text[])))")
    assert p[0].kind == "in" and p[0].values == ("a", "b, c")
    assert [x.kind for x in parse_check("CHECK (((age >= 0) AND (age <= 120) AND (name IS NOT NULL)))")] == ["compare", "compare", "not null"]
    assert parse_check("CHECK ((x > '-5'::integer)) NOT VALID")[0].values == ("-5",)
    assert parse_check("(length((code)::text) = 3)")[0].kind == "length"
    assert parse_check("CHECK ((n BETWEEN 1 AND 5 AND m <> 2))")[0].kind == "between"
    for bad in ("CHECK ((a > 1) OR (b > 1))", "CHECK ((NOT a))", "CHECK ((a > b))", "CHECK ((f(a) > 1))", "CHECK ((a ~ '(?=x)'))", "CHECK ((a IS NULL) OR (a = ANY (ARRAY['x'])))", ""):
        with pytest.raises(Unverifiable):
            parse_check(bad)


def test_rules_and_structure():
    t = Table("s", "t", (Column("id", "int4", False, identity="ALWAYS"), Column("a", "text", False)), (Constraint("p", "p", ("id",)), Constraint("u", "u", ("a",))), (UniqueIndex("i", ("a",)), UniqueIndex("j", ("a",), "CREATE UNIQUE INDEX j ON t (a) WHERE a > ''")))
    assert [r.name for r in model.uniqueness_rules(t)] == ["p", "u"]
    assert {p.code for p in model.check([Mapping("x", 0, "id")], t, ["x"]).problems} == {"E103", "E102"}
    assert model.resolve_indexes([Mapping("NAME ", 5, "a")], ["Code", "name"])[0].index == 1
    assert model.default_key_strategy(t) == model.SEQUENCE and not model.key_options(t)[1]["available"]
    with pytest.raises(ValueError):
        Transform(value_map={"A": "1", "a": "2"})


def test_headers_and_matching(spark):
    assert headers.header_names(["A", "", "a", "", ""]) == ["A", "(column B)", "a (2)"]
    d = headers.compare_headers(["First", "Last"], ["Last", "First", "Email"])
    assert not d.match and d.added == ["Email"] and d.removed == [] and d.moved == ["First", "Last"]
    found = matching.auto_match(spark, ["Full Name", "E-Mail", "Mobile"], CUSTOMERS)
    assert {(s.header, s.db_column, s.accepted) for s in found if s.accepted} == {("Full Name", "name", True), ("E-Mail", "email", True), ("Mobile", "phone", True)}


def test_config_drift_and_refusals(tmp_path):
    c = config.Config("public", "customers", MAPPINGS, headers=HEADERS, fingerprint=headers.fingerprint(HEADERS))
    config.save(c, str(tmp_path / "c.json"))
    back = config.load(str(tmp_path / "c.json"))
    assert back.mappings == MAPPINGS and config.check_workbook(back, HEADERS[:-1]) == ["removed: Notes"] and config.check_schema(back, PEOPLE)
    (tmp_path / "new.json").write_text('{"configVersion": 99}')
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "new.json"))


def test_catalog_and_gates(spark):
    cols = spark.createDataFrame([(2, "b", "mood", "public", "mood", True, False, "", "", None, None, None, "", "e"), (1, "a", "int4", "pg_catalog", "integer", False, False, "d", "", None, 32, 0, "", "b")], "ord int, name string, udt string, type_schema string, formatted string, nullable boolean, has_default boolean, identity string, generated string, max_length int, precision int, scale int, element string, category string")
    labels = spark.createDataFrame([("public", "mood", "y", 2.0), ("public", "mood", "x", 1.0), ("other", "mood", "z", 1.0)], "type_schema string, udt string, label string, ord double")
    cons = spark.createDataFrame([("f", "f", "FK", 2, "b", "s.r", "k2"), ("f", "f", "FK", 1, "a", "s.r", "k1")], "name string, kind string, definition string, ord int, column string, ref_table string, ref_column string")
    ix = spark.createDataFrame([("i", "CREATE UNIQUE INDEX i ON t (a) WHERE b", 1, "a", False)], "name string, definition string, ord int, column string, expressions boolean")
    t = catalog.assemble("s", "t", cols, labels, cons, ix)
    assert t.columns[0].identity == "BY DEFAULT" and t.columns[1].enum_values == ("x", "y") and t.constraints[0].ref_columns == ("k1", "k2") and t.indexes[0].partial
    assert catalog.split_qualified('"a.b".c') == ["a.b", "c"] and catalog.next_value(None, 1, 7) == 7
    c = catalog.Connection("h", "d", "u", "secret")
    assert "secret" not in repr(c) and c.redact("password=secret x") == "password=**** x"
    plan = model.build_plan(MAPPINGS, CUSTOMERS)
    with pytest.raises(execute.Refused):
        execute.gates(None, plan, True, "customers")
    assert execute.state_code("23505") == "E304" and execute.publish_sql(plan, "stage").count("COMMIT") == 1


def test_numbering_and_batches(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000 + 5).alias("row_num"))
    got = render.numbered(df).orderBy("row_num").collect()
    assert [r["n"] for r in got] == list(range(1, 1001))


def test_issue_files(spark, tmp_path):
    issues = validate.as_issues(spark, [model.Problem("E102", 'say "x"', "do", "A", "a")])
    sheet_writer.write_issues_csv(issues, str(tmp_path / "i.csv"))
    assert open(tmp_path / "i.csv", "rb").read().startswith(b"\xef\xbb\xbfSeverity,Code")
    sheet_writer.write_issues_xlsx(issues, str(tmp_path / "i.xlsx"))
    assert from_workbook(spark, str(tmp_path / "i.xlsx"), header_row=1).headers == sheet_writer.TITLES


def test_stream_has_no_state(spark, tmp_path):
    from rowsmith.streaming.incremental import stream_issues

    spark.createDataFrame([("a@x", "17", "N"), ("b@x", "x", "N")], "email string, age string, region string").write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("email string, age string, region string").parquet(str(tmp_path / "in"))
    issues = stream_issues(from_frame(df, F.lit(1), ["email", "age", "region"]), model.build_plan(THREE, PEOPLE))
    q = issues.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["code"] for r in spark.table("found").collect()) == ["E201", "E306"]


def test_formulas_without_a_stored_value_are_told(spark, tmp_path):
    main, path = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', str(tmp_path / "gaps.xlsx")
    rel = "http://schemas.openxmlformats.org"
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    cells = [text("A1", "name") + text("B1", "note"), text("A2", "x") + '<c r="B2"><f>A2&amp;"y"</f><v></v></c>', text("A3", "z") + '<c r="B3"><f>1+1</f><v>2</v></c>', text("A4", "w") + '<c r="B4"><f>A4</f></c>']
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join(f'<row r="{i}">{c}</row>' for i, c in enumerate(cells, 1)) + "</sheetData></worksheet>")
    sheet = from_workbook(spark, path, header_row=1)
    assert len(sheet.problems) == 1 and "2 formula cells" in sheet.problems[0].message and "B2" in sheet.problems[0].message
    s = Session(spark)
    s.use_table(Table("public", "t", (Column("name", "text"), Column("note", "text"))))
    s.open(path)
    s.auto_match()
    assert s.validate().by_code["W204"] == 1


def test_sample_has_its_middle(spark):
    first, last = 11, 5010
    inner = 5000 - validate.HEAD - validate.TAIL

    def drawn(row):
        h = xxhash.xxh64_intdigest(struct.pack("<i", 5000), xxhash.xxh64_intdigest(struct.pack("<q", row), 42))
        return (h - (h >> 63 << 64)) % inner < validate.MIDDLE

    want = [r for r in range(first, last + 1) if r < first + validate.HEAD or r > last - validate.TAIL or drawn(r)]
    got = sorted(r["row_num"] for r in validate.sampled(spark.range(first, last + 1).withColumnRenamed("id", "row_num"), first, last).collect())
    assert got == want and abs(len(want) - 1000) < 100


def test_sample_of_row_numbers_with_gaps(spark):
    """Head and tail are rows, not numbers: 200 of each however far apart their numbers are."""
    rows = spark.range(0, 3000).select((F.col("id") * F.col("id")).alias("row_num"))
    total, head, tail = validate.sample_bounds(rows)
    assert (total, head, tail) == (3000, 199**2, 2800**2)
    got = sorted(r["row_num"] for r in validate.drawn(rows, total, head, tail).collect())
    assert got[:200] == [i * i for i in range(200)] and got[-200:] == [i * i for i in range(2800, 3000)] and 850 < len(got) < 1150
    assert validate.drawn(rows.limit(900), *validate.sample_bounds(rows.limit(900))).count() == 900


def test_nothing_stays_persisted(spark, tmp_path):
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    spark.catalog.clearCache()
    before = held()
    sheet = sheet_of(spark, [("a@x", "20", "N"), ("b@x", "30", "S")], ["email", "age", "region"])
    s = Session(spark)
    s.use_table(PEOPLE)
    s.sheet, s.mappings = sheet, THREE
    assert s.validate().clean and s.report.issues.count() == 0
    s.generate(str(tmp_path / "x.sql"))
    s.generate_parts(str(tmp_path / "parts"))
    assert held() == before


def write_sheet(path, rows, shared=(), merges=()):
    """A workbook by hand: rows of cell XML."""
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/><sheet name="T" sheetId="2" r:id="rId2"/></sheets></workbook>')
        relation = lambda n: f'<Relationship Id="rId{n}" Type="{rel}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}/package/2006/relationships">{relation(1)}{relation(2)}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        body = "".join(f'<row r="{i}">{c}</row>' for i, c in enumerate(rows, 1))
        joined = f'<mergeCells>{"".join(f"""<mergeCell ref="{m}"/>""" for m in merges)}</mergeCells>' if merges else ""
        for n in (1, 2):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {main}><sheetData>{body}</sheetData>{joined}</worksheet>")


def test_a_long_sheet_is_read_in_bounded_memory(tmp_path):
    path = str(tmp_path / "long.xlsx")
    write_sheet(path, (f'<c r="A{i}" t="s"><v>{i % 3}</v></c><c r="B{i}"><v>{i}</v></c>' for i in range(1, 60_001)), ["one", "two", "six"])
    book, peak, n = xlsx.Workbook.open(path), 0, 0
    tracemalloc.start()
    for number, cells in xlsx.rows(path, book, "S"):
        n += 1
        assert cells[0][0] == ["one", "two", "six"][number % 3] and cells[1][0] == str(number)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 4 << 20


def test_an_archive_that_lies_about_its_size_is_stopped(tmp_path, monkeypatch):
    path = str(tmp_path / "x.xlsx")
    write_sheet(path, [f'<c r="A{i}"><v>{i}</v></c>' for i in range(1, 2000)])
    book = xlsx.Workbook.open(path)
    monkeypatch.setattr(xlsx.Bounded.__init__, "__defaults__", (1000,))
    with pytest.raises(xlsx.UnsafeWorkbook):
        list(xlsx.rows(path, book, "S"))


def test_files_of_a_pattern_and_of_a_uri(spark, tmp_path):
    for k in range(3):
        sheet_writer.write_xlsx(str(tmp_path / f"part{k}.xlsx"), "S", ["n"], [[k]])
    assert xlsx.read_sheet(spark, f"{tmp_path}/part*.xlsx").count() == 6 and xlsx.read_sheet(spark, f"file://{tmp_path}/part1.xlsx").count() == 2
    whole = from_workbook(spark, f"{tmp_path}/part2.xlsx", header_row=1, whole_columns=True)
    assert whole.dates == frozenset() and whole.rows.columns == ["row_num", "c0"]


def test_switching_sheets(spark, workbook, tmp_path):
    path = str(tmp_path / "two.xlsx")
    text = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    write_sheet(path, [text("A1", "name") + text("B1", "note"), text("A2", "x") + text("B2", "y")], merges=["A2:A3"])
    s = Session(spark)
    with pytest.raises(NotReady):
        s.select_sheet("T")
    s.use_table(Table("public", "t", (Column("name", "text"), Column("note", "text"))))
    s.open(path)
    s.mappings = [Mapping("note", 7, "note")]
    s.layout = config.Config("public", "t", s.mappings, headers=["name", "gone"])
    got = s.select_sheet("T")
    assert s.sheets() == ["S", "T"] and got.sheet.name == "T" and got.mappings[0].index == 1 and not got.status.blocking
    assert [[(c["text"], c["kind"]) for c in r["cells"]] for r in got.preview.collect()] == [[("x", "string"), ("y", "string")]]
    assert any("A2:A3" in w for w in got.warnings) and "added: note" in got.warnings and "removed: gone" in got.warnings


class Server:
    """A connection that answers from frames."""

    password = ""

    def __init__(self, spark, insert):
        self.spark, self.insert, self.asked = spark, insert, []

    def query(self, spark, sql):
        self.asked.append(sql)
        if sql == catalog.PROBE_SQL:
            return spark.createDataFrame([("d", "u", "server 17", 170000, "off", "UTC")], "database string, user_name string, version string, number int, conforming string, timezone string")
        if "can_select" in sql:
            return spark.createDataFrame([(True, self.insert)], "can_select boolean, can_insert boolean")
        if "pg_enum" in sql:
            return spark.createDataFrame([], "type_schema string, udt string, label string, ord double")
        if "pg_constraint" in sql:
            return spark.createDataFrame([("p", "u", "", 1, "name", None, None)], "name string, kind string, definition string, ord int, column string, ref_table string, ref_column string")
        if "pg_index" in sql:
            return spark.createDataFrame([], "name string, definition string, ord int, column string, expressions boolean")
        kinds = "ord int, name string, udt string, type_schema string, formatted string, nullable boolean, has_default boolean, identity string, generated string, max_length int, precision int, scale int, element string, category string, default_text string, comment string"
        return spark.createDataFrame([(1, "name", "text", "pg_catalog", "text", False, True, "", "", None, None, None, "", "b", "'x'::text", "who")], kinds)

    def redact(self, s):
        return s


def test_a_server_is_probed_and_asked_what_is_allowed(spark):
    s, server = Session(spark), Server(spark, False)
    assert s.connect(server).version == "server 17" and not s.output.conforming and not s.settings.options.conforming
    table = s.describe("public", "t")
    assert (table.columns[0].default, table.columns[0].comment) == ("'x'::text", "who") and not s.privileges.can_insert
    assert [r.name for r in s.overview()["rules"]] == ["p"] and s.about()["server"] == "server 17"
    s.open(spark.createDataFrame([(2, "a\\b")], "n long, name string"), F.col("n"))
    s.mappings = [Mapping("name", 1, "name")]
    assert s.validate().clean
    assert " E'a\\\\b'" in "".join(render.script(s._rows(), s.plan, s.output))
    with pytest.raises(execute.Refused):
        s.execute("stage", "t")
    s.close()
    assert s.connection is None and s.server is None


def test_server_errors_name_the_sheet_column():
    plan = model.build_plan(MAPPINGS, CUSTOMERS)
    issue = execute.server_issue(plan, "23505", "duplicate", constraint="customers_email_key", detail=" Key exists. ", row=9)
    assert (issue["code"], issue["excel_column"], issue["excel_ref"], issue["db_column"], issue["hint"]) == ("E304", "Email", "B9", "email", "Key exists.")
    assert execute.server_issue(plan, "22001", "too long", column="name")["excel_column"] == "Customer" and execute.server_issue(plan, "99999", "?")["code"] == "E306"


def test_condemned_columns_are_counted_but_not_listed(spark):
    rows = [(f"e{i}@x", "abc" if i % 2 else str(i + 20), "N") for i in range(40)]
    r = validate.validate(sheet_of(spark, rows, ["email", "age", "region"]), model.build_plan(THREE, PEOPLE), validate.Settings(stop_at_sample=False))
    assert r.by_code == {"E104": 1, "E201": 20} and [i["code"] for i in r.issues.collect()] == ["E104"] and r.rows_total == 40


def test_rehearsal_and_what_was_looked_at(spark):
    regions = spark.createDataFrame([("N",)], "code string")
    s = Session(spark)
    s.use_table(PEOPLE, spark.createDataFrame([("a@x",)], "email string"), {"regions": regions})
    s.sheet, s.mappings = sheet_of(spark, [("a@x", "20", "N"), ("b@x", "20", "Q")], ["email", "age", "region"]), THREE
    assert s.rehearse().by_code == {"E302": 1, "E305": 1} and not s.rehearsed
    s.target = s.target.limit(0)
    s.sheet = sheet_of(spark, [("b@x", "20", "N")], ["email", "age", "region"])
    assert s.rehearse().clean and "rehearsal" in s.settings.describe(s.rehearsed)


def test_command_line(spark, workbook, tmp_path, capsys):
    s = Session(spark)
    s.use_table(CUSTOMERS)
    s.open(workbook)
    s.map(*MAPPINGS)
    s.save(str(tmp_path / "layout.json"))
    base = ["--config", str(tmp_path / "layout.json"), "--file", workbook, "--database", "d", "--user", "u"]
    out = str(tmp_path / "out.sql")

    def run(*argv):
        return cli.run(cli.parser().parse_args(list(argv)), Session(spark, table=CUSTOMERS))

    assert run("validate", *base) == cli.DONE and "3 rows, 3 valid" in capsys.readouterr().out
    assert run("validate", *base, "--json") == cli.DONE and '"errors": 0' in capsys.readouterr().out
    assert run("import", *base, "--out", out, "--mode", "copy") == cli.DONE
    assert f"{out}: " in capsys.readouterr().out and "COPY" in open(out).read() and render.head_lines(out, 2)[1].endswith("Generated import script")
    assert run("import", *base, "--out", out) == cli.USAGE
    assert cli.main(["nothing"]) == cli.USAGE
    bad = str(tmp_path / "bad.xlsx")
    sheet_writer.write_xlsx(bad, "Sheet1", HEADERS, [["", "x", "1", "Neu", "abc", 45366, ""]] * 4, frozenset({5}))
    base[3] = bad
    assert run("validate", *base) == cli.DATA and "column Credit Limit" in capsys.readouterr().out
    sheet_writer.write_xlsx(bad, "Sheet1", HEADERS[:-1], [["a"] * 6])
    assert run("validate", *base) == cli.SETUP


def test_streams_against_a_target_and_first_keys(spark, tmp_path):
    from rowsmith.streaming import incremental

    spark.createDataFrame([("a@x", "20", "N", "2024-01-01 00:00:00"), ("b@x", "30", "N", "2024-01-01 00:00:01"), ("a@x", "20", "N", "2024-01-01 00:00:02")], "email string, age string, region string, at string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("email string, age string, region string, at string").parquet(str(tmp_path / "in"))
    found = []
    sheet = lambda df: from_frame(df, F.lit(1), ["email", "age", "region"])
    run = incremental.against_target(sheet, model.build_plan(THREE, PEOPLE), spark.createDataFrame([("b@x",)], "email string"), lambda df, n: found.extend(df.collect()))
    stream().writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["k_0"], r["rule"]) for r in found] == [("b@x", "pk")]
    first = incremental.first_seen(stream().withColumn("at", F.to_timestamp("at")), ["email"], "at", "1 hour")
    q = first.writeStream.format("memory").queryName("first").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["email"] for r in spark.table("first").collect()) == ["a@x", "b@x"]


def test_texts_beside_cells(spark):
    """String columns of a frame opened with texts stand as they are; others, and those of a sheet, are typed."""
    table = Table("public", "t", (Column("a", "text"), Column("n", "int4"), Column("b", "text", nullable=False)))
    plan = model.build_plan([Mapping(c.name, i, c.name, Transform(trim=True) if c.name == "a" else Transform()) for i, c in enumerate(table.columns)], table)
    df = spark.createDataFrame([(1, " #N/A ", 7, " "), (2, None, None, None), (3, "", None, "a\u200b")], "i long, a string, n int, b string")
    row = lambda sheet: [(r["blank"], *[r[f"v_{i}"]["code"] or r[f"v_{i}"]["text"] for i in range(3)]) for r in validate.evaluated(sheet, plan).orderBy("row_num").collect()]
    assert row(from_frame(df, F.col("i"), ["a", "n", "b"], texts=True)) == [(False, "#N/A", "7", " "), (True, None, None, "E202"), (False, "", None, "a\u200b")]
    assert row(from_frame(df, F.col("i"), ["a", "n", "b"])) == [(False, "E210", "7", "E202"), (True, None, None, "E202"), (False, None, None, "a")]
