"""CHECK constraints compiled to column predicates.

A definition is read by a tokenizer and a parser, not by patterns, so casts and blanks inside literals stay
as they are.  What is understood: a conjunction of IS [NOT] NULL, comparisons with a constant, BETWEEN, IN,
= ANY (ARRAY[...]), length() comparisons, and ~ or ~* with a pattern both dialects share, each on one
column.  Anything else, every OR and NOT included, makes the whole constraint unverifiable.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowsmith.plans.model import Table

TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>-?\d+(?:\.\d+)?|-?\.\d+)|(?P<name>\"(?:[^\"]|\"\")+\"|[A-Za-z_]\w*)|(?P<sign>::|<=|>=|<>|!=|~\*|!~\*|!~|[~=<>(),\[\]])|(?P<other>\S))")
NUMERIC = {"integer", "numeric", "float"}
WORDS = {"AND", "OR", "NOT", "IS", "NULL", "IN", "ANY", "ARRAY", "BETWEEN", "CHECK", "VALID"}


class Unverifiable(ValueError):
    pass


@dataclass(frozen=True)
class Predicate:
    column: str
    kind: str  # null, not null, in, compare, length, between, matches
    op: str = ""
    values: tuple = ()

    def describe(self) -> str:
        c, v = self.column, [str(x) for x in self.values]
        return {
            "not null": f"{c} must not be empty", "null": f"{c} must be empty", "in": f"{c} must be one of: {', '.join(v)}",
            "between": f"{c} must be between {' and '.join(v)}", "length": f"length({c}) {self.op} {''.join(v)}",
            "matches": f"{c} must match {''.join(v)}", "compare": f"{c} {self.op} {''.join(v)}",
        }[self.kind]

    def holds(self, coerced: Column, family: str) -> Column:
        """True, false, or null where it does not apply."""
        text, num, null = coerced["text"], coerced["num"], coerced["is_null"]
        if self.kind in ("null", "not null"):
            return null if self.kind == "null" else ~null
        numeric = family in NUMERIC
        if self.kind == "length":
            out = compare(F.length(text), self.op, F.lit(int(self.values[0])))
        elif self.kind == "matches":
            out = text.rlike(("(?i)" if self.op == "~*" else "") + self.values[0])
        elif numeric or self.kind == "between" or any(isinstance(v, Decimal) for v in self.values):
            try:
                wanted = [F.lit(Decimal(v)).cast("decimal(38,18)") for v in self.values]
            except ArithmeticError:
                return F.lit(None).cast("boolean")
            if self.kind == "in":
                out = num.isin(*wanted) if numeric else text.isin(*[str(v) for v in self.values])
            else:
                out = num.between(*wanted) if self.kind == "between" else compare(num, self.op, wanted[0])
        elif self.kind == "in":
            out = text.isin(*self.values)
        else:
            out = compare(text, self.op, F.lit(self.values[0]))
        return F.when(~null, out)


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while m := TOKEN.match(text, at):
            kind = m.lastgroup
            if kind == "other":
                raise Unverifiable(f"unknown sign {m[kind]}")
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str:
        kind, t = self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("", "")
        return t.upper() if kind == "name" else t

    def next(self, *wanted: str) -> str:
        t = self.peek()
        if wanted and t not in wanted or not t:
            raise Unverifiable(f"{' or '.join(wanted) or 'more'} expected, {t or 'nothing'} found")
        self.at += 1
        return t

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def casts(self) -> None:
        while self.peek() == "::":
            self.next()
            if self.kind() != "name":
                raise Unverifiable("a type expected")
            while self.kind() == "name" and self.peek() not in WORDS:
                self.at += 1
            for left, right in ("()", "[]"):
                if self.peek() == left:
                    while self.next() != right:
                        pass

    def conjunction(self) -> list[Predicate]:
        out = self.factor()
        while self.peek() == "AND":
            self.next()
            out += self.factor()
        return out

    def factor(self) -> list[Predicate]:
        """A predicate, or a conjunction in parentheses: whichever reads on."""
        if self.peek() == "(":
            at = self.at
            try:
                self.next("(")
                out = self.conjunction()
                self.next(")")
                if self.peek() in ("", "AND", ")") or (self.peek(), self.peek(1)) == ("NOT", "VALID"):
                    return out
            except Unverifiable:
                pass
            self.at = at
        return [self.predicate()]

    def operand(self) -> tuple[str, str]:
        """A column, or its length, with any casts and parentheses."""
        if self.peek() == "(":
            self.next()
            out = self.operand()
            self.next(")")
        elif self.peek() in ("LENGTH", "CHAR_LENGTH") and self.peek(1) == "(":
            self.next()
            self.next("(")
            out = ("length", self.operand()[1])
            self.next(")")
        elif self.kind() == "name" and self.peek() not in WORDS:
            name = self.tokens[self.at][1]
            self.at += 1
            out = ("column", name[1:-1].replace('""', '"') if name[0] == '"' else name)
        else:
            raise Unverifiable("a column expected")
        self.casts()
        return out

    def constant(self) -> str | Decimal:
        if self.peek() == "(":
            self.next()
            out = self.constant()
            self.next(")")
        elif self.kind() == "text":
            out = self.next()[1:-1].replace("''", "'")
        elif self.kind() == "number":
            out = Decimal(self.next())
        else:
            raise Unverifiable("a constant expected")
        self.casts()
        return out

    def constants(self, end: str) -> tuple:
        out = [self.constant()]
        while self.peek() == ",":
            self.next()
            out.append(self.constant())
        self.next(end)
        return tuple(out)

    def predicate(self) -> Predicate:
        kind, name = self.operand()
        op = self.next()
        if kind == "length":
            n = self.constant()
            if op not in ("=", "<>", "!=", "<", "<=", ">", ">=") or not str(n).isdigit():
                raise Unverifiable("a comparison of a length expected")
            return Predicate(name, "length", op, (n,))
        if op == "IS":
            if negative := self.peek() == "NOT":
                self.next()
            self.next("NULL")
            return Predicate(name, "not null" if negative else "null")
        if op == "IN":
            self.next("(")
            return Predicate(name, "in", values=self.constants(")"))
        if op == "BETWEEN":
            low = self.constant()
            self.next("AND")
            try:
                return Predicate(name, "between", values=(Decimal(low), Decimal(self.constant())))
            except ArithmeticError:
                raise Unverifiable("numbers expected") from None
        if op == "=" and self.peek() == "ANY":
            self.next()
            self.next("(")
            inner = 0
            while self.peek() == "(":
                self.next()
                inner += 1
            self.next("ARRAY")
            self.next("[")
            values = self.constants("]")
            self.casts()
            for _ in range(inner):
                self.next(")")
                self.casts()
            self.next(")")
            return Predicate(name, "in", values=values)
        if op in ("~", "~*"):
            pattern = self.constant()
            if not isinstance(pattern, str) or re.search(r"\(\?[=!<]|\\[1-9]", pattern):
                raise Unverifiable("the pattern uses what only one dialect has")
            try:
                re.compile(pattern)
            except re.error:
                raise Unverifiable("not a pattern") from None
            return Predicate(name, "matches", op, (pattern,))
        if op in ("=", "<>", "!=", "<", "<=", ">", ">="):
            return Predicate(name, "compare", op, (self.constant(),))
        raise Unverifiable(f"{op} is not understood")


def parse_check(definition: str) -> list[Predicate]:
    """The predicates of a definition, with or without CHECK and NOT VALID around; Unverifiable if it is beyond these."""
    p = Parser(definition)
    if p.peek() == "CHECK":
        p.next()
    out = p.conjunction()
    if p.peek() == "NOT" and p.peek(1) == "VALID":
        p.at += 2
    if p.peek():
        raise Unverifiable(f"{p.peek()} is not understood")
    return out


@dataclass(frozen=True)
class Check:
    name: str
    predicates: tuple[Predicate, ...]

    def failure(self, coerced: dict[str, Column], families: dict[str, str]) -> Column:
        """The description of the first predicate that applies and fails, or null; unmapped columns do not apply."""
        failed = [F.when(~p.holds(coerced[p.column], families[p.column]), F.lit(p.describe())) for p in self.predicates if p.column in coerced]
        return F.coalesce(*failed) if failed else F.lit(None).cast("string")


def compile_checks(table: Table) -> tuple[list[Check], list[tuple[str, str, str]]]:
    """Checks by name, and what cannot be verified here: (name, kind, why)."""
    checks, beyond = [], []
    for c in sorted(table.of_kind("c"), key=lambda c: c.name):
        try:
            checks.append(Check(c.name, tuple(parse_check(c.definition))))
        except Unverifiable as e:
            beyond.append((c.name, "check", str(e)))
    beyond += [(c.name, "exclusion", "exclusion constraints are left to the database") for c in sorted(table.of_kind("x"), key=lambda c: c.name)]
    beyond += [(i.name, "index", "a partial or expression index is left to the database") for i in table.indexes if i.partial or i.expressions]
    return checks, beyond
