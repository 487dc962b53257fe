"""The restricted record grammar: filters, one grouped aggregate, one moving window.

    filter  := and (OR and)*          and := term (AND term)*
    term    := '(' filter ')' | field op
    op      := != <= >= = < > value | LIKE value | IN '(' [value (, value)*] ')' | IS [NOT] NULL
    agg     := sum|avg|min|max|count '(' field | * ')' [by field]
    window  := fn '(' field ')' over N by field [partition field]

Text is parsed into small dataclasses, checked against the record's fields, and turned into Columns; no
SQL text is built from user input. Number fields compare as doubles, every other kind as text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomspark.functions.text import like_ascii_ci

MAX_VALUES = 64
FUNCTIONS = ("sum", "avg", "min", "max", "count")
KINDS = ("string", "number", "date", "enum", "id", "file")


class GrammarError(ValueError):
    """A text that the grammar refuses; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"


@dataclass(frozen=True)
class Compare:
    field: Field
    op: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class IsNull:
    field: Field
    negated: bool


@dataclass(frozen=True)
class Bool:
    op: str
    terms: tuple


@dataclass(frozen=True)
class Aggregate:
    fn: str
    field: Field | None
    by: Field | None

    @property
    def name(self) -> str:
        return f"{self.fn}({self.field.name if self.field else '*'})"


@dataclass(frozen=True)
class Moving:
    fn: str
    field: Field
    rows: int
    order: Field
    partition: Field | None

    @property
    def name(self) -> str:
        return f"{self.fn}({self.field.name})"


def fields_of(df: DataFrame) -> list[Field]:
    """Fields of a DataFrame: the kind in a column's metadata, else what its type suggests."""
    out = []
    for f in df.schema:
        kind = (f.metadata or {}).get("kind")
        if kind not in KINDS:
            kind = "number" if isinstance(f.dataType, T.NumericType) else "date" if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"
        out.append(Field(f.name, kind))
    return out


class _Reader:
    """A position in the source text, with the few things that can come next."""

    def __init__(self, source: str, fields: list[Field]):
        self.s, self.i, self.fields, self.values = source, 0, {f.name: f for f in fields}, 0

    def skip(self) -> None:
        while self.i < len(self.s) and self.s[self.i] in " \t\r\n":
            self.i += 1

    def end(self) -> bool:
        self.skip()
        return self.i >= len(self.s)

    def eat(self, mark: str) -> bool:
        self.skip()
        if self.s.startswith(mark, self.i):
            self.i += len(mark)
            return True
        return False

    def keyword(self, word: str) -> bool:
        self.skip()
        stop = self.i + len(word)
        if self.s[self.i : stop].upper() != word or stop < len(self.s) and re.match(r"[A-Za-z0-9_]", self.s[stop]):
            return False
        self.i = stop
        return True

    def need(self, ok: bool, what: str) -> None:
        if not ok:
            raise GrammarError("UnexpectedToken", f"{what} at {self.i} of {self.s!r}")

    def bare(self, stops: str) -> str:
        self.skip()
        start = self.i
        if start < len(self.s) and self.s[start] in "'\"":
            stop = self.s.find(self.s[start], start + 1)
            self.need(stop >= 0, "an unclosed quote")
            self.i = stop + 1
            return self.s[start + 1 : stop]
        while self.i < len(self.s) and self.s[self.i] not in stops:
            self.i += 1
        self.need(self.i > start, "a word is missing")
        return self.s[start : self.i]

    def field(self, stops: str = " \t\r\n()=!<>,") -> Field:
        name = self.bare(stops)
        if name not in self.fields:
            raise GrammarError("UnknownField", name)
        return self.fields[name]

    def value(self, field: Field) -> str:
        text = self.bare(" \t\r\n,)(")
        self.values += 1
        if self.values > MAX_VALUES:
            raise GrammarError("TooComplex", f"more than {MAX_VALUES} values")
        if field.kind == "number":
            try:
                float(text)
            except ValueError:
                raise GrammarError("UnexpectedToken", f"{text!r} is no number") from None
        return text


def parse_filter(source: str, fields: list[Field]):
    """The tree of a filter."""
    r = _Reader(source, fields)
    if r.end():
        raise GrammarError("EmptyExpression")

    def either():
        terms = [both()]
        while r.keyword("OR"):
            terms.append(both())
        return terms[0] if len(terms) == 1 else Bool("or", tuple(terms))

    def both():
        terms = [term()]
        while r.keyword("AND"):
            terms.append(term())
        return terms[0] if len(terms) == 1 else Bool("and", tuple(terms))

    def term():
        if r.eat("("):
            inner = either()
            r.need(r.eat(")"), "a closing parenthesis is missing")
            return inner
        field = r.field()
        for op in ("!=", "<=", ">=", "=", "<", ">"):
            if r.eat(op):
                return Compare(field, op, (r.value(field),))
        if r.keyword("LIKE"):
            return Compare(field, "like", (r.value(field),))
        if r.keyword("IN"):
            r.need(r.eat("("), "a list is missing")
            values = []
            if not r.eat(")"):
                values.append(r.value(field))
                while r.eat(","):
                    values.append(r.value(field))
                r.need(r.eat(")"), "a closing parenthesis is missing")
            return Compare(field, "in", tuple(values))
        if r.keyword("IS"):
            negated = r.keyword("NOT")
            r.need(r.keyword("NULL"), "NULL is missing")
            return IsNull(field, negated)
        r.need(False, "an operator is missing")

    tree = either()
    r.need(r.end(), "more text")
    return tree


def _call(r: _Reader, star: bool) -> tuple[str, Field | None]:
    name = r.bare(" \t\r\n(").lower()
    if name not in FUNCTIONS:
        raise GrammarError("UnexpectedToken", f"no aggregate {name!r}")
    r.need(r.eat("("), "an opening parenthesis is missing")
    field = None
    if r.eat("*"):
        r.need(star and name == "count", "* is for count only")
    else:
        field = r.field(")")if r.s[r.i : r.i + 1] in "'\"" else r.fields.get(r.bare(")").strip()) or _unknown(r)
    r.need(r.eat(")"), "a closing parenthesis is missing")
    if field and name in ("sum", "avg") and field.kind != "number":
        raise GrammarError("NotANumber", f"{name} of {field.name}, which is {field.kind}")
    return name, field


def _unknown(r: _Reader):
    raise GrammarError("UnknownField", r.s)


def parse_aggregate(source: str, fields: list[Field]) -> Aggregate:
    r = _Reader(source, fields)
    if r.end():
        raise GrammarError("EmptyExpression")
    fn, field = _call(r, star=True)
    by = r.field(" \t\r\n") if r.keyword("BY") else None
    r.need(r.end(), "more text")
    return Aggregate(fn, field, by)


def parse_window(source: str, fields: list[Field]) -> Moving:
    r = _Reader(source, fields)
    if r.end():
        raise GrammarError("EmptyExpression")
    fn, field = _call(r, star=False)
    r.need(r.keyword("OVER"), "OVER is missing")
    rows = r.bare(" \t\r\n")
    r.need(rows.isascii() and rows.isdigit() and 1 <= int(rows) < 1 << 32, "a number of rows is missing")
    r.need(r.keyword("BY"), "BY is missing")
    order = r.field(" \t\r\n")
    partition = r.field(" \t\r\n") if r.keyword("PARTITION") else None
    r.need(r.end(), "more text")
    return Moving(fn, field, int(rows), order, partition)


def text_form(df: DataFrame, name: str) -> Column:
    """The column as the text that comparisons use; timestamps in ISO form."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c if isinstance(kind, T.StringType) else c.cast("string")


def condition(tree, df: DataFrame) -> Column:
    """The filter as a Column over ``df``; three-valued logic is Spark's own."""
    if isinstance(tree, Bool):
        out = condition(tree.terms[0], df)
        for t in tree.terms[1:]:
            out = (out & condition(t, df)) if tree.op == "and" else (out | condition(t, df))
        return out
    if isinstance(tree, IsNull):
        c = F.col(f"`{tree.field.name}`")
        return c.isNotNull() if tree.negated else c.isNull()
    number = tree.field.kind == "number"
    if tree.op == "like":
        return like_ascii_ci(F.col(f"`{tree.field.name}`").cast("string") if number else text_form(df, tree.field.name), tree.values[0])
    c = F.col(f"`{tree.field.name}`").cast("double") if number else text_form(df, tree.field.name)
    values = [float(v) if number else v for v in tree.values]
    if tree.op == "in":
        return c.isin(values) if values else F.lit(False)
    v = F.lit(values[0])
    return {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[tree.op]
