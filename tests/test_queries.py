"""Every query of the catalogue that has SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from rowsmith import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture
def compiled(spark):
    """Generated code must compile: there is no falling back to interpretation."""
    strict = {"spark.sql.codegen.fallback": "false", "spark.sql.codegen.factoryMode": "CODEGEN_ONLY"}
    before = {k: spark.conf.get(k) for k in strict}
    for k, v in strict.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) & set(queries.SQL)))
def test_same_as_sql(spark, con, compiled, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())
    spark.catalog.clearCache()


def test_every_query_has_a_twin():
    assert set(queries.SQL) == set(queries.QUERIES)


#: Texts that a sheet's cell would be emptied, shortened, taken as a number or refused for.
ODD = ["", " ", "  \n\t ", " " * 501, "#N/A", " #REF! ", "TRUE", " TRUE", "12.50", "0.1234567890123456789", "12345678901234567890.5", "2.4500000000000001", "a\u00a0b", "a\u202fb", "\ufeffa", "a\u200bb", "\u200b", "x" * 499 + "\u200b", "x" * 500 + "\u200b", "\u3000", "\u0085", "\U0001f986" * 500, "\U0001f986" * 501, "line\r\nnext\n", " 'a' \\ ", None]


@pytest.mark.parametrize("name, table, columns, rows", [
    ("coerce_text_length", "documents", "doc_id long, text string", list(enumerate(ODD))),
    ("coerce_json", "events", "event_id long, props string", list(enumerate(['{"a": "x\u00a0y"}', '{"a": "\u200bx"}', ' {"a": 1}\n', '"#N/A"', "0.1234567890123456789", "true"], 1))),
])
def test_texts_of_a_table_are_taken_as_they_stand(spark, tmp_path, compiled, name, table, columns, rows):
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{table}.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path)).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(c.execute(f"SELECT row_num, code, value FROM ({queries.SQL[name]})").fetchall())
