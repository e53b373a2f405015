"""Target tables: from a PostgreSQL catalog over JDBC, or from Spark's own tables.

The catalog is asked for plain rows, one for each column of a constraint or index, which are put together
here by their ordinal; names travel as quoted literals.  Credentials are options of a connection only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.functions.text import quote_literal_text
from rowsmith.plans.model import Column, Constraint, Table, UniqueIndex

SSL_MODES = ["disable", "allow", "prefer", "require", "verify-ca", "verify-full"]


@dataclass(frozen=True)
class Connection:
    """How to reach a server; its text hides the password."""

    host: str
    database: str
    user: str
    password: str = field(default="", repr=False)
    port: int = 5432
    sslmode: str = "prefer"
    partitions: int = 4

    def __post_init__(self):
        if self.sslmode not in SSL_MODES:
            raise ValueError(f"sslmode {self.sslmode} is not one of {', '.join(SSL_MODES)}")

    @property
    def url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}?sslmode={self.sslmode}"

    def redact(self, message: str) -> str:
        out = message.replace(self.password, "****") if self.password else message
        return re.sub(r"(password=)[^\s&;]+", r"\1****", out, flags=re.I)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=self.url, user=self.user, password=self.password, driver="org.postgresql.Driver", query=sql).load()

    def table(self, spark: SparkSession, name: str, **options: str) -> DataFrame:
        """A table's rows; partitionColumn, lowerBound and upperBound make the read parallel."""
        reader = spark.read.format("jdbc").options(url=self.url, user=self.user, password=self.password, driver="org.postgresql.Driver", dbtable=name)
        return reader.options(**({"numPartitions": str(self.partitions)} | options if "partitionColumn" in options else options)).load()


def _where(schema: str, table: str) -> str:
    return f"ns.nspname = {quote_literal_text(schema)} AND rel.relname = {quote_literal_text(table)}"


REL = "pg_catalog.pg_class rel JOIN pg_catalog.pg_namespace ns ON ns.oid = rel.relnamespace"


def tables_sql() -> str:
    """Tables that may be read, outside the system's schemas."""
    return (
        f"SELECT ns.nspname::text AS schema, rel.relname::text AS name, greatest(rel.reltuples, 0)::bigint AS estimate FROM {REL} "
        "WHERE rel.relkind IN ('r', 'p') AND ns.nspname !~ '^(pg_|information_schema$)' AND has_table_privilege(rel.oid, 'SELECT')"
    )


def columns_sql(schema: str, table: str) -> str:
    return (
        "SELECT att.attnum::int AS ord, att.attname::text AS name, ty.typname::text AS udt, tyns.nspname::text AS type_schema, format_type(att.atttypid, att.atttypmod) AS formatted, "
        "NOT att.attnotnull AS nullable, att.atthasdef AS has_default, att.attidentity::text AS identity, att.attgenerated::text AS generated, "
        "ic.character_maximum_length::int AS max_length, ic.numeric_precision::int AS precision, ic.numeric_scale::int AS scale, coalesce(el.typname::text, '') AS element, ty.typtype::text AS category, "
        "coalesce(pg_get_expr(def.adbin, def.adrelid), '') AS default_text, coalesce(col_description(rel.oid, att.attnum), '') AS comment "
        f"FROM pg_catalog.pg_attribute att JOIN ({REL}) ON rel.oid = att.attrelid JOIN pg_catalog.pg_type ty ON ty.oid = att.atttypid JOIN pg_catalog.pg_namespace tyns ON tyns.oid = ty.typnamespace "
        "LEFT JOIN pg_catalog.pg_attrdef def ON def.adrelid = att.attrelid AND def.adnum = att.attnum "
        "LEFT JOIN information_schema.columns ic ON ic.table_schema = ns.nspname AND ic.table_name = rel.relname AND ic.column_name = att.attname "
        f"LEFT JOIN pg_catalog.pg_type el ON el.oid = ty.typelem AND ty.typcategory = 'A' WHERE {_where(schema, table)} AND att.attnum > 0 AND NOT att.attisdropped"
    )


def labels_sql(schema: str, table: str) -> str:
    """Enum labels of all of a table's columns, by schema and type, so that two types of one name are kept apart."""
    return (
        f"SELECT tyns.nspname::text AS type_schema, ty.typname::text AS udt, en.enumlabel::text AS label, en.enumsortorder::double precision AS ord FROM pg_catalog.pg_enum en "
        f"JOIN pg_catalog.pg_type ty ON ty.oid = en.enumtypid JOIN pg_catalog.pg_namespace tyns ON tyns.oid = ty.typnamespace "
        f"WHERE ty.oid IN (SELECT att.atttypid FROM pg_catalog.pg_attribute att JOIN ({REL}) ON rel.oid = att.attrelid WHERE {_where(schema, table)})"
    )


def constraints_sql(schema: str, table: str) -> str:
    """A row for each column of each constraint, with the column it refers to at the same ordinal."""
    return (
        "SELECT k.conname::text AS name, k.contype::text AS kind, pg_get_constraintdef(k.oid) AS definition, u.ord::int AS ord, att.attname::text AS column, "
        "(fns.nspname || '.' || frel.relname)::text AS ref_table, fatt.attname::text AS ref_column "
        f"FROM pg_catalog.pg_constraint k JOIN ({REL}) ON rel.oid = k.conrelid LEFT JOIN LATERAL unnest(k.conkey, k.confkey) WITH ORDINALITY AS u(here, there, ord) ON true "
        "LEFT JOIN pg_catalog.pg_attribute att ON att.attrelid = k.conrelid AND att.attnum = u.here LEFT JOIN pg_catalog.pg_class frel ON frel.oid = k.confrelid "
        "LEFT JOIN pg_catalog.pg_namespace fns ON fns.oid = frel.relnamespace LEFT JOIN pg_catalog.pg_attribute fatt ON fatt.attrelid = k.confrelid AND fatt.attnum = u.there "
        f"WHERE {_where(schema, table)}"
    )


def indexes_sql(schema: str, table: str) -> str:
    return (
        "SELECT ixrel.relname::text AS name, pg_get_indexdef(ix.indexrelid) AS definition, u.ord::int AS ord, att.attname::text AS column, (ix.indexprs IS NOT NULL) AS expressions "
        f"FROM pg_catalog.pg_index ix JOIN pg_catalog.pg_class ixrel ON ixrel.oid = ix.indexrelid JOIN ({REL}) ON rel.oid = ix.indrelid LEFT JOIN LATERAL unnest(ix.indkey::int2[]) WITH ORDINALITY AS u(num, ord) ON true "
        f"LEFT JOIN pg_catalog.pg_attribute att ON att.attrelid = ix.indrelid AND att.attnum = u.num WHERE {_where(schema, table)} AND ix.indisunique"
    )


def sequence_sql(schema: str, table: str, column: str) -> str:
    """A column's sequence and where it stands; nothing is drawn from it."""
    name = f"format('%I.%I', {quote_literal_text(schema)}, {quote_literal_text(table)})"
    return (
        f"SELECT own.seq::text AS sequence, s.last_value, s.increment_by, s.start_value FROM (SELECT pg_get_serial_sequence({name}, {quote_literal_text(column)}) AS seq) own "
        "LEFT JOIN pg_catalog.pg_sequences s ON (quote_ident(s.schemaname) || '.' || quote_ident(s.sequencename)) = own.seq"
    )


PROBE_SQL = (
    "SELECT current_database()::text AS database, current_user::text AS user_name, version()::text AS version, current_setting('server_version_num')::int AS number, "
    "current_setting('standard_conforming_strings')::text AS conforming, current_setting('TimeZone')::text AS timezone"
)


@dataclass(frozen=True)
class Server:
    """What a server says of itself; conforming: backslashes in plain literals are literal."""

    database: str
    user: str
    version: str
    number: int
    conforming: bool
    timezone: str


def probe(spark: SparkSession, c: Connection) -> Server:
    """Ask the server who it is; it also tells whether it can be reached."""
    r = c.query(spark, PROBE_SQL).first()
    return Server(r["database"], r["user_name"], r["version"], r["number"], r["conforming"] == "on", r["timezone"])


@dataclass(frozen=True)
class Privileges:
    can_select: bool = False
    can_insert: bool = False


def privileges(spark: SparkSession, c: Connection, schema: str, table: str) -> Privileges:
    """What the connected user may do with a table."""
    r = c.query(spark, privileges_sql(schema, table)).first()
    return Privileges(bool(r["can_select"]), bool(r["can_insert"]))


def privileges_sql(schema: str, table: str) -> str:
    name = f"format('%I.%I', {quote_literal_text(schema)}, {quote_literal_text(table)})"
    return f"SELECT has_table_privilege({name}, 'SELECT') AS can_select, has_table_privilege({name}, 'INSERT') AS can_insert"


def next_value(last: int | None, increment: int, start: int) -> int:
    """What a sequence will give next."""
    return start if last is None else last + increment


def split_qualified(name: str) -> list[str]:
    """Parts of a dotted name, with quotes undone; dots in quotes do not part."""
    parts = re.findall(r'"((?:[^"]|"")*)"|([^."]+)', name)
    return [a.replace('""', '"') if a or not b else b for a, b in parts]


def assemble(schema: str, name: str, columns: DataFrame, labels: DataFrame, constraints: DataFrame, indexes: DataFrame) -> Table:
    """A table from catalog rows; ordinals put columns, labels and key pairs in order, whatever order rows come in."""
    enums: dict[tuple[str, str], list[str]] = {}
    for r in labels.orderBy("type_schema", "udt", "ord").collect():
        enums.setdefault((r["type_schema"], r["udt"]), []).append(r["label"])
    kinds = {"a": "ALWAYS", "d": "BY DEFAULT"}
    cols = tuple(
        Column(
            r["name"], r["udt"], r["nullable"], r["has_default"], r["max_length"], r["precision"], r["scale"], kinds.get(r["identity"], ""), r["generated"] == "s",
            tuple(enums.get((r["type_schema"], r["udt"]), ())), r["type_schema"] if r["category"] == "e" else "", r["element"], r["formatted"], *(r[k] or "" for k in ("default_text", "comment") if k in columns.columns),
        )
        for r in columns.orderBy("ord").collect()
    )
    gathered = constraints.groupBy("name", "kind", "definition", "ref_table").agg(F.array_sort(F.collect_list(F.struct("ord", "column", "ref_column"))).alias("k"))
    cons = tuple(
        Constraint(r["name"], r["kind"], tuple(k["column"] for k in r["k"] if k["column"]), r["definition"], r["ref_table"] or "", tuple(k["ref_column"] for k in r["k"] if k["ref_column"]))
        for r in gathered.orderBy("name").collect()
    )
    by = indexes.groupBy("name", "definition", "expressions").agg(F.array_sort(F.collect_list(F.struct("ord", "column"))).alias("k"))
    own = {c.name for c in cons}
    ixs = tuple(UniqueIndex(r["name"], tuple(k["column"] for k in r["k"] if k["column"]), r["definition"], r["expressions"]) for r in by.orderBy("name").collect() if r["name"] not in own)
    return Table(schema, name, cols, cons, ixs)


def describe(spark: SparkSession, c: Connection, schema: str, table: str) -> Table:
    return assemble(schema, table, *[c.query(spark, sql(schema, table)) for sql in (columns_sql, labels_sql, constraints_sql, indexes_sql)])
