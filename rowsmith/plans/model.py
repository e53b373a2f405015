"""Tables, mappings and plans: the driver-side description of an import."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from rowsmith.functions.text import header_key

ARRAY, UNSUPPORTED = "array", "unsupported"
# Type families by type name, and the bounds of integer types.
FAMILIES = {
    "text": ["text", "varchar", "bpchar", "char", "name", "citext"],
    "integer": ["int2", "int4", "int8"],
    "numeric": ["numeric", "decimal", "money"],
    "float": ["float4", "float8"],
    "boolean": ["bool"],
    "date": ["date"],
    "timestamp": ["timestamp"],
    "timestamptz": ["timestamptz"],
    "time": ["time", "timetz"],
    "uuid": ["uuid"],
    "json": ["json", "jsonb"],
    "network": ["inet", "cidr", "macaddr", "macaddr8"],
}
INTEGER_BITS = {"int2": 16, "int4": 32, "int8": 64}
FAMILY_OF = {name: family for family, names in FAMILIES.items() for name in names}
TEMPORAL = {"date", "timestamp", "timestamptz"}
SEQUENCE, MAPPED, NONE = "sequence", "mapped", "none"


@dataclass(frozen=True)
class Column:
    name: str
    data_type: str
    nullable: bool = True
    has_default: bool = False
    max_length: int | None = None
    precision: int | None = None
    scale: int | None = None
    identity: str = ""  # "", "ALWAYS" or "BY DEFAULT"
    generated: bool = False
    enum_values: tuple[str, ...] = ()
    enum_schema: str = ""
    array_element: str = ""
    formatted: str = ""
    default: str = ""
    comment: str = ""

    @property
    def family(self) -> str:
        if self.enum_values:
            return "enum"
        if self.array_element or self.data_type.startswith("_"):
            return ARRAY
        return FAMILY_OF.get(self.data_type, UNSUPPORTED)

    @property
    def type_text(self) -> str:
        if self.formatted:
            return self.formatted
        if self.max_length:
            return f"{self.data_type}({self.max_length})"
        return f"{self.data_type}({self.precision},{self.scale})" if self.precision is not None else self.data_type

    @property
    def accepts_value(self) -> bool:
        return not self.generated and self.identity != "ALWAYS"

    @property
    def required(self) -> bool:
        return not (self.nullable or self.has_default or self.identity or self.generated)


@dataclass(frozen=True)
class Constraint:
    name: str
    kind: str  # p, u, c, f or x
    columns: tuple[str, ...] = ()
    definition: str = ""
    ref_table: str = ""
    ref_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class UniqueIndex:
    name: str
    columns: tuple[str, ...]
    definition: str = ""
    expressions: bool = False

    @property
    def partial(self) -> bool:
        return " WHERE " in self.definition


@dataclass(frozen=True)
class Table:
    schema: str
    name: str
    columns: tuple[Column, ...]
    constraints: tuple[Constraint, ...] = ()
    indexes: tuple[UniqueIndex, ...] = ()

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    @property
    def primary_key(self) -> tuple[str, ...]:
        return next((c.columns for c in self.constraints if c.kind == "p"), ())

    def of_kind(self, kind: str) -> list[Constraint]:
        return [c for c in self.constraints if c.kind == kind]


@dataclass(frozen=True)
class UniquenessRule:
    name: str
    columns: tuple[str, ...]
    primary: bool = False


def uniqueness_rules(table: Table) -> list[UniquenessRule]:
    """Primary key, unique constraints and whole unique indexes, once for each list of columns."""
    found = [UniquenessRule(c.name, c.columns, c.kind == "p") for kind in "pu" for c in table.of_kind(kind)]
    found += [UniquenessRule(i.name, i.columns) for i in table.indexes if not i.partial and not i.expressions and i.columns]
    out: dict[tuple[str, ...], UniquenessRule] = {}
    for rule in found:
        out.setdefault(rule.columns, rule)
    return list(out.values())


@dataclass(frozen=True)
class Transform:
    trim: bool = False
    blank_as_null: bool = False
    default_on_blank: str = ""
    upper: bool = False
    lower: bool = False
    strip_non_digits: bool = False
    value_map: dict[str, str] = field(default_factory=dict)
    bool_map: dict[str, bool] = field(default_factory=dict)
    date_format: str = ""

    def __post_init__(self):
        for words in (self.value_map, self.bool_map):
            if len({header_key(k) for k in words}) < len(words):
                raise ValueError("two words of a map differ in case or blanks only")


def default_transform(column: Column) -> Transform:
    return Transform(trim=True, blank_as_null=column.nullable)


@dataclass(frozen=True)
class Mapping:
    sheet_column: str
    index: int
    db_column: str
    transform: Transform = Transform()
    enabled: bool = True


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    hint: str = ""
    sheet_column: str = ""
    db_column: str = ""
    severity: str = "error"


@dataclass
class Status:
    problems: list[Problem] = field(default_factory=list)
    mapped: int = 0
    defaulted: int = 0
    unmapped_sheet: int = 0

    @property
    def blocking(self) -> bool:
        return any(p.severity == "error" for p in self.problems)


def check(mappings: list[Mapping], table: Table, headers: list[str] | None, strategy: str = NONE) -> Status:
    """What is wrong with a mapping before any data is read; headers is None while no sheet is chosen."""
    st = Status()
    known = {header_key(h) for h in headers or []}
    sources: dict[str, list[str]] = {}
    used: set[int] = set()

    def tell(code: str, m: Mapping, message: str, hint: str) -> None:
        st.problems.append(Problem(code, message, hint, m.sheet_column, m.db_column))

    for m in (m for m in mappings if m.enabled):
        st.mapped += 1
        sources.setdefault(m.db_column, []).append(m.sheet_column)
        used.add(m.index)
        column = table.column(m.db_column)
        if headers is not None and header_key(m.sheet_column) not in known:
            tell("E101", m, f'the sheet has no column named "{m.sheet_column}"', "the sheet has changed since this mapping was saved; map the column again")
        elif column is None:
            tell("E101", m, f'the table has no column named "{m.db_column}"', "the table has changed since this mapping was saved; map the column again")
        else:
            if not column.accepts_value:
                why = "it is generated" if column.generated else "it is GENERATED ALWAYS AS IDENTITY"
                tell("E103", m, f"{m.db_column} cannot receive a value: {why}", "remove this mapping; the database supplies the value")
            if column.family in (ARRAY, UNSUPPORTED):
                tell("E106", m, f"{m.db_column} has type {column.type_text}, which cannot be written", "leave this column unmapped")
    for name in sorted(n for n, s in sources.items() if len(s) > 1):
        st.problems.append(Problem("E105", f"{len(sources[name])} sheet columns are mapped to {name}: {', '.join(sources[name])}", "a table column takes values from one sheet column", db_column=name))
    for c in table.columns:
        if c.name in sources:
            continue
        if c.has_default or c.identity or c.generated:
            st.defaulted += 1
        elif not c.nullable and not (strategy == SEQUENCE and c.name in table.primary_key):
            st.problems.append(Problem("E102", f"{c.name} is required ({c.type_text} NOT NULL, no default) and nothing is mapped to it", "map a sheet column to it", db_column=c.name))
    st.unmapped_sheet = sum(i not in used for i in range(len(headers or [])))
    return st


def resolve_indexes(mappings: list[Mapping], headers: list[str]) -> list[Mapping]:
    """Mappings pointed at their headers' places: by exact name, else by normalised name; an ambiguous one keeps its place."""
    exact: dict[str, int] = {}
    loose: dict[str, list[int]] = {}
    for i, h in enumerate(headers):
        exact.setdefault(h, i)
        loose.setdefault(header_key(h), []).append(i)
    out = []
    for m in mappings:
        if m.sheet_column in exact:
            m = replace(m, index=exact[m.sheet_column])
        elif places := loose.get(header_key(m.sheet_column)):
            at = m.index if m.index in places else places[0]
            m = replace(m, index=at, sheet_column=headers[at])
        out.append(m)
    return out


@dataclass(frozen=True)
class PlanColumn:
    column: Column
    mapping: Mapping


@dataclass(frozen=True)
class Plan:
    table: Table
    columns: tuple[PlanColumn, ...]
    strategy: str = NONE

    @property
    def names(self) -> list[str]:
        return [c.column.name for c in self.columns]

    def find(self, name: str) -> PlanColumn | None:
        return next((c for c in self.columns if c.column.name == name), None)


def build_plan(mappings: list[Mapping], table: Table, strategy: str = NONE) -> Plan:
    """Mapped columns in the table's order; the last mapping of a column wins; sequence keys are left to the database."""
    by = {m.db_column: m for m in mappings if m.enabled}
    left_out = set(table.primary_key) if strategy == SEQUENCE else set()
    return Plan(table, tuple(PlanColumn(c, by[c.name]) for c in table.columns if c.name in by and c.name not in left_out), strategy)


def defaulted_columns(plan: Plan) -> list[str]:
    """Table columns that are not mapped and that the database fills."""
    return [c.name for c in plan.table.columns if c.name not in plan.names and (c.has_default or c.identity or c.generated)]


def default_key_strategy(table: Table) -> str:
    """none without a primary key, sequence if the database supplies every part of it, else mapped."""
    key = [table.column(n) for n in table.primary_key]
    if not key:
        return NONE
    return SEQUENCE if all(c and (c.identity or c.has_default) for c in key) else MAPPED


def key_options(table: Table) -> list[dict]:
    """The strategies, whether each is available, and what it means."""
    key, default = table.primary_key, default_key_strategy(table)
    always = any((c := table.column(n)) and c.identity == "ALWAYS" for n in key)
    return [
        {"strategy": SEQUENCE, "available": default == SEQUENCE, "text": "the database assigns the key of every row"},
        {"strategy": MAPPED, "available": bool(key) and not always, "text": "the sheet supplies the key" if not always else "the key is GENERATED ALWAYS"},
        {"strategy": NONE, "available": not key, "text": "the table has no primary key"},
    ]
