import pytest
from pyspark.sql import functions as F

from rowsmith.functions import cells, text
from rowsmith.operators.coerce import Options, coerce
from rowsmith.operators.transforms import apply
from rowsmith.plans.model import Column, Transform

#: column, options, transform, then (raw, expected text or code); * marks a code.
CASES = [
    (Column("n", "int2"), Options(), Transform(), [("12", "12"), ("12.00", "12"), (" 7 ", "7"), ("12.5", "*E201"), ("x", "*E201"), ("40000", "*E205"), ("-32768", "-32768"), ("1e3", "1000"), ("9" * 30, "*E205")]),
    (Column("n", "numeric", precision=5, scale=2), Options(), Transform(), [("1,2 3.4", "123.40"), ("12.3400", "12.34"), ("12.345", "*E204"), ("1234.5", "*E204"), ("$5", "*E201"), ("TRUE", "*E201"), ("-0.50", "-0.50")]),
    (Column("n", "numeric", precision=5, scale=2), Options(rounding=True), Transform(), [("12.345", "12.35"), ("-12.345", "-12.35"), ("999.996", "*E204")]),
    (Column("n", "numeric"), Options(), Transform(), [("1.234,56", "1.23456"), ("10", "10")]),
    (Column("x", "float8"), Options(), Transform(), [("1.5", "1.5"), ("abc", "*E201"), ("inf", "*E201"), ("1.5d", "*E201"), ("3", "3")]),
    (Column("b", "bool"), Options(), Transform(), [("oui", "true"), ("OFF", "false"), ("0", "false"), ("2", "*E201"), ("maybe", "*E201"), ("TRUE", "true")]),
    (Column("b", "bool"), Options(), Transform(bool_map={"Da": True, "Net": False}), [("da", "true"), (" NET ", "false"), ("xx", "*E201")]),
    (Column("t", "varchar", max_length=3), Options(), Transform(), [("äöü", "äöü"), ("abcd", "*E203"), ("a\x00", "*E211")]),
    (Column("t", "text", nullable=False), Options(), Transform(), [("", "*E202"), ("  ", "*E202"), ("#N/A", "*E210"), ("#n/a", "#n/a")]),
    (Column("t", "text"), Options(), Transform(trim=True), [("  a​ ", "a")]),
    (Column("e", "mood", enum_values=("Low", "High")), Options(), Transform(), [("Low", "Low"), ("low", "*E206")]),
    (Column("e", "mood", enum_values=("Low", "High")), Options(enum_ignore_case=True), Transform(), [("HIGH", "High")]),
    (Column("d", "date"), Options(), Transform(trim=True), [("2024-03-15", "2024-03-15"), ("15/03/2024", "2024-03-15"), ("3 Jan 2024", "2024-01-03"), ("January 2, 2024", "2024-01-02"), ("2024-13-01", "*E201"), ("45000", "*E201"), ("2024-03-15T10:00:00Z", "*E201")]),
    (Column("d", "date"), Options(), Transform(), [("2024-03-15", "2024-03-15"), ("45000", "*E201")]),
    (Column("d", "timestamp"), Options(), Transform(trim=True), [("2024-03-15 10:11:12", "2024-03-15 10:11:12"), ("2024-03-15 10:11:12.5", "2024-03-15 10:11:12.5")]),
    (Column("d", "timestamptz"), Options(timezone="Asia/Beirut"), Transform(trim=True), [("2024-01-15 10:00:00", "2024-01-15 10:00:00+02:00"), ("2024-07-15 10:00:00", "2024-07-15 10:00:00+03:00")]),
    (Column("d", "time"), Options(), Transform(), [("9:05", "09:05:00"), ("25:00", "*E201")]),
    (Column("u", "uuid"), Options(), Transform(), [("A0EEBC999C0B4EF8BB6D6BB9BD380A11", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), ("a0ee", "*E207")]),
    (Column("j", "jsonb"), Options(), Transform(), [('{"b":1,"a":[1,2.50]}', '{"a": [1, 2.50], "b": 1}'), ("{'a':1}", "*E208"), ('{"a":1} x', "*E208"), ("[1,]", "*E208"), ("NaN", "*E208")]),
    (Column("i", "inet"), Options(), Transform(), [("10.0.0.1", "10.0.0.1"), ("10.0.0.0/8", "10.0.0.0/8"), ("::1", "::1"), ("10.0.0.256", "*E201"), ("fe80::/10", "fe80::/10")]),
    (Column("i", "cidr"), Options(), Transform(), [("10.0.0.1", "*E201"), ("10.0.0.0/33", "*E201"), ("2001:db8::/32", "2001:db8::/32")]),
    (Column("a", "_int4"), Options(), Transform(), [("{1}", "*E106")]),
    (Column("s", "text"), Options(), Transform(strip_non_digits=True), [("(+961) 1-23", "+961123"), ("1+2", "12")]),
    (Column("s", "text"), Options(), Transform(trim=True, value_map={"Actif": "active"}), [(" actif", "active"), ("other", "other")]),
    (Column("s", "text"), Options(), Transform(trim=True, default_on_blank="none", upper=True), [(" ", "NONE"), ("a", "A")]),
]


def test_cells_to_values(spark):
    for column, options, transform, cases in CASES:
        df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string")
        df = df.select("i", cells.typed(F.col("raw")).alias("x")).select("i", apply(F.col("x"), transform, column.family).alias("p"))
        failed = F.col("p.date_failed") & (F.col("p.kind") != "date")
        got = {r["i"]: r for r in df.select("i", failed.alias("failed"), coerce(F.col("p"), column, options).alias("v")).collect()}
        for i, (raw, want) in enumerate(cases):
            v = got[i]["v"]
            found = f"*{v['code']}" if v["code"] else "*E201" if got[i]["failed"] else v["text"]
            assert found == want, (column, transform, raw, v)


@pytest.mark.parametrize("raw,kind,text_", [("TRUE", "bool", "TRUE"), (" TRUE", "string", " TRUE"), ("0.30000000000000004", "number", "0.3"), ("12345678901234567890", "number", "12345678901234567890"), ("1.10", "number", "1.10"), ("00123", "number", "00123"), ("​", "empty", None), ("1-2", "string", "1-2"), ("99.99999999999999999", "number", "100")])
def test_typing(spark, raw, kind, text_):
    c = spark.createDataFrame([(raw,)], "r string").select(cells.typed(F.col("r")).alias("c")).first()["c"]
    assert (c["kind"], c["str"]) == (kind, text_)


def test_dates_of_both_epochs(spark):
    df = spark.createDataFrame([("1",), ("59",), ("60",), ("61",), ("45366",), ("45366.5",)], "r string")
    got = [(r["c"]["kind"], str(r["c"]["ts"])) for r in df.select(cells.typed(F.col("r"), True).alias("c")).collect()]
    assert got[2][0] == "error"
    assert [g[1] for g in got if g[0] == "date"] == ["1900-01-01 00:00:00", "1900-02-28 00:00:00", "1900-03-01 00:00:00", "2024-03-15 00:00:00", "2024-03-15 12:00:00"]
    zero = spark.createDataFrame([("0",)], "r string").select(cells.typed(F.col("r"), True, True).alias("c")).first()["c"]
    assert str(zero["ts"]) == "1904-01-01 00:00:00"


def test_quoting(spark):
    df = spark.createDataFrame([("O'Brien \\ x\ty",)], "s string")
    s = F.col("s")
    r = df.select(text.quote_literal(s), text.quote_literal(s, False), text.copy_field(s), text.copy_field(F.lit(None).cast("string"))).first()
    assert list(r) == ["'O''Brien \\ x\ty'", " E'O''Brien \\\\ x\ty'", "O'Brien \\\\ x\\ty", "\\N"]
    assert text.column_letter(0) == "A" and text.column_letter(26) == "AA" and text.column_letter(701) == "ZZ" and text.column_letter(-1) == ""
    assert text.quote_identifier('a"b') == '"a""b"'


def test_room_before_the_point_is_judged_with_the_digits_after_it(spark):
    """9999.80 has four digits before the point; compared in whole numbers it would have five."""
    cases = [(6, 2, "9999.80", ""), (6, 2, "10000", "E204"), (30, 2, "99999999999999999999.99", "")]
    df = spark.createDataFrame([tuple(raw for _, _, raw, _ in cases)], "c0 string, c1 string, c2 string").select(*[cells.typed(F.col(f"c{i}")).alias(f"x{i}") for i in range(len(cases))])
    df = df.select(*[apply(F.col(f"x{i}"), Transform(), "numeric").alias(f"p{i}") for i in range(len(cases))])
    got = df.select(*[coerce(F.col(f"p{i}"), Column("n", "numeric", precision=p, scale=s), Options())["code"].alias(f"v{i}") for i, (p, s, _, _) in enumerate(cases)]).first()
    assert [code or "" for code in got] == [code for *_, code in cases]


def test_recovering_a_number_is_compiled(spark):
    """One rounding, without lambdas, which Spark interprets row by row; the edges of each power of ten are kept."""
    cases = {
        "0.0009999999999999": "0.000999999999999900", "0.001000000000000005": "0.001000000000000010", "0.099999999999999999": "0.100000000000000000", "-2.5000000000000005": "-2.500000000000000000",
        "-2.500000000000005": "-2.500000000000010000", "999999999999999.5": "1000000000000000.000000000000000000", "12345678901234567890.4": "12345678901234567890.000000000000000000", "99999999999999999999.9": "99999999999999999999.900000000000000000",
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", cells.recovered(F.col("s").cast(cells.NUM)).alias("n"))
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {r["s"]: f"{r['n']:.18f}" for r in df.collect()} == cases
