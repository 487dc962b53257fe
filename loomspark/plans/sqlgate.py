"""Read-only SQL and saved, parameterised queries.

A statement is parsed by Spark itself: one statement only, and only if its root is a query or an EXPLAIN.
Parameters are bound as named arguments, never spliced into the text.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from loomspark.plans import dialect as _dialect

#: Roots of plans that only read.
ALLOWED = frozenset(
    "Project Aggregate Sort GlobalLimit LocalLimit Offset Filter Distinct Union Except Intersect Join Window LateralJoin Pivot Unpivot SubqueryAlias Generate "
    "UnresolvedWith WithWindowDefinition UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedOrderBy OneRowRelation ExplainCommand".split()
)


class SqlError(ValueError):
    """A statement or saved query that is refused; ``code`` says why."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def check_read_only(spark: SparkSession, sql: str) -> None:
    """Refuse what is no single query."""
    if not sql.strip():
        raise SqlError("Empty")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlError("Syntax", str(e).split("\n")[0]) from None
    name = plan.getClass().getSimpleName()
    if name not in ALLOWED:
        raise SqlError("NotReadOnly", name)
    if not re.match(r"(?is)\s*(?:(?:--[^\n]*\n|/\*.*?\*/)\s*)*\(*\s*(select|with|explain|values|from|table)\b", sql):
        raise SqlError("NotReadOnly", sql.split()[0])


def run_sql(spark: SparkSession, sql: str, args: dict | None = None, dialect: bool = False) -> DataFrame:
    """The rows of one query; with ``dialect`` its calls are taken as an embedded database's, see ``plans.dialect``."""
    if dialect:
        _dialect.register(spark)
        sql = _dialect.rewrite(sql)
    check_read_only(spark, sql)
    return spark.sql(sql, args=args or {})


@dataclass(frozen=True)
class SavedQuery:
    name: str
    sql: str
    description: str = ""
    params: dict[str, str | None] = field(default_factory=dict)


def valid_name(name: str) -> bool:
    return re.fullmatch(r"(?!\.)[A-Za-z0-9._-]{1,64}", name) is not None


def parse_saved(name: str, body: str) -> SavedQuery:
    """Leading ``--`` lines are the description and ``-- param: name [= default]``; the rest is the query."""
    if not valid_name(name):
        raise SqlError("BadName", name)
    about, params, sql = [], {}, []
    for line in body.splitlines():
        if not sql and (m := re.match(r"\s*--\s?(.*)$", line)):
            p = re.match(r"param:\s*([A-Za-z_]\w*)\s*(?:=\s*(.*?))?\s*$", m[1])
            if p:
                params[p[1]] = p[2]
            elif m[1].strip():
                about.append(m[1].strip())
        elif line.strip() or sql:
            sql.append(line)
    text = "\n".join(sql).strip()
    if text.endswith(";"):
        text = text[:-1].rstrip()
    if not text:
        raise SqlError("Empty", name)
    if not re.match(r"(?i)(select|with|explain)\b", text):
        raise SqlError("NotReadOnly", text.split()[0])
    return SavedQuery(name, text, " ".join(about), params)


def _used(sql: str) -> set[str]:
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*", "", sql)
    return set(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", bare))


def bind(query: SavedQuery, args: dict[str, object]) -> dict[str, object]:
    """Values by name: whole numbers as such, others as texts; missing or undeclared ones are errors."""
    values = {}
    for name in _used(query.sql):
        if name not in query.params:
            raise SqlError("UndeclaredParam", name)
        v = args.get(name, query.params[name])
        if v is None:
            raise SqlError("MissingParam", name)
        values[name] = int(v) if isinstance(v, int) or re.fullmatch(r"[+-]?\d{1,18}", str(v)) else str(v)
    return values


HISTORY = "query string, name string"


def run_logged(spark: SparkSession, sql: str, log: str, name: str = "", args: dict | None = None, dialect: bool = False) -> DataFrame:
    """``run_sql``, with the statement appended to the history in folder ``log`` once it was accepted."""
    from loomspark.sources import history

    out = run_sql(spark, sql, args, dialect)
    history.append(spark, log, query=sql, name=name)
    return out


def run_saved(spark: SparkSession, query: SavedQuery, dialect: bool = False, **args: object) -> DataFrame:
    return run_sql(spark, query.sql, bind(query, args), dialect)


def list_saved(folder: str) -> list[SavedQuery]:
    """The saved queries of a folder on the driver, by name."""
    found = []
    for f in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if f.endswith(".sql") and valid_name(f[:-4]):
            with open(os.path.join(folder, f), encoding="utf-8") as h:
                found.append(parse_saved(f[:-4], h.read()))
    return found
