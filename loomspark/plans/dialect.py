"""Calls of an embedded database's SQL rewritten as Spark's.

A scanner finds calls outside texts, quoted names and comments; each rule makes Spark SQL of a call's arguments,
chosen by name and number of arguments. An aggregate's FILTER and OVER stay with the aggregate.

Two results are defined here and not by the other database: ``group_concat`` lists values in ascending order, and a
shift by months that meets no such day gives the month's last day.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import SparkSession

_SHIFT = """CREATE OR REPLACE TEMPORARY FUNCTION sql_shift(t TIMESTAMP, m STRING) RETURNS TIMESTAMP RETURN CASE
  WHEN lower(trim(m)) = 'start of month' THEN date_trunc('MONTH', t)
  WHEN lower(trim(m)) = 'start of year' THEN date_trunc('YEAR', t)
  WHEN lower(trim(m)) = 'start of day' THEN date_trunc('DAY', t)
  WHEN lower(trim(m)) RLIKE '^[+-]?[0-9]+ (year|month|day|hour|minute|second)s?$' THEN t + make_interval(
    if(lower(m) LIKE '%year%', CAST(split(trim(m), ' ')[0] AS INT), 0), if(lower(m) LIKE '%month%', CAST(split(trim(m), ' ')[0] AS INT), 0), 0,
    if(lower(m) LIKE '%day%', CAST(split(trim(m), ' ')[0] AS INT), 0), if(lower(m) LIKE '%hour%', CAST(split(trim(m), ' ')[0] AS INT), 0),
    if(lower(m) LIKE '%minute%', CAST(split(trim(m), ' ')[0] AS INT), 0), if(lower(m) LIKE '%second%', CAST(split(trim(m), ' ')[0] AS INT), 0)) END"""
_MOMENT = "CREATE OR REPLACE TEMPORARY FUNCTION sql_moment(d STRING) RETURNS TIMESTAMP RETURN if(d = 'now', current_timestamp(), try_cast(d AS TIMESTAMP))"
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}

SCAN = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*\s*\(|[(),]|.", re.S)


def _moment(args: list[str]) -> str:
    out = f"sql_moment(CAST({args[0]} AS STRING))" if args else "current_timestamp()"
    for m in args[1:]:
        out = f"sql_shift({out}, {m})"
    return out


def _strftime(args: list[str]) -> str:
    form = args[0]
    for a, b in _FORMATS.items():
        form = f"replace({form}, '{a}', '{b}')" if not form.startswith("'") else form.replace(a, b)
    return f"date_format({_moment(args[1:])}, {form})"


def _null_wise(name: str) -> Callable[[list[str]], str]:
    return lambda a: f"if({' OR '.join(f'({x}) IS NULL' for x in a)}, NULL, {name}({', '.join(a)}))"


def _concat(args: list[str]) -> str:
    word = re.match(r"(?i)\s*distinct\s+(.*)$", args[0], re.S)
    kind, value = ("collect_set", word[1]) if word else ("collect_list", args[0])
    return f"{kind}(CAST({value} AS STRING))"


#: (name, least and most arguments): the call, and what is put around it with its FILTER and OVER.
RULES: dict[str, tuple[int, int, Callable[[list[str]], str], Callable[[str, list[str]], str] | None]] = {
    "iif": (3, 3, lambda a: f"if({', '.join(a)})", None),
    "total": (1, 1, lambda a: f"sum(CAST({a[0]} AS DOUBLE))", lambda c, a: f"coalesce({c}, 0.0D)"),
    "group_concat": (1, 2, _concat, lambda c, a: f"nullif(array_join(array_sort({c}), {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)}), '')"),
    "min": (2, 99, _null_wise("least"), None),
    "max": (2, 99, _null_wise("greatest"), None),
    "trim": (2, 2, lambda a: f"trim(BOTH {a[1]} FROM {a[0]})", None),
    "ltrim": (2, 2, lambda a: f"trim(LEADING {a[1]} FROM {a[0]})", None),
    "rtrim": (2, 2, lambda a: f"trim(TRAILING {a[1]} FROM {a[0]})", None),
    "printf": (1, 99, lambda a: f"format_string({', '.join(a)})", None),
    "hex": (1, 1, lambda a: f"hex(CAST({a[0]} AS STRING))", None),
    "unicode": (1, 1, lambda a: f"ascii({a[0]})", None),
    "json_extract": (2, 2, lambda a: f"get_json_object({', '.join(a)})", None),
    "date": (0, 99, lambda a: f"date_format({_moment(a)}, 'yyyy-MM-dd')", None),
    "time": (0, 99, lambda a: f"date_format({_moment(a)}, 'HH:mm:ss')", None),
    "datetime": (0, 99, lambda a: f"date_format({_moment(a)}, 'yyyy-MM-dd HH:mm:ss')", None),
    "julianday": (0, 99, lambda a: f"(unix_micros({_moment(a)}) / 86400000000.0D + 2440587.5D)", None),
    "strftime": (1, 99, _strftime, None),
}


def register(spark: SparkSession) -> None:
    """The functions that rewritten statements call."""
    spark.sql(_MOMENT)
    spark.sql(_SHIFT)


def rewrite(sql: str) -> str:
    """The statement with every call of a name in ``RULES`` as Spark's; other text stays as it is."""
    parts = SCAN.findall(sql)
    out, _ = _until(parts, 0, "")
    return "".join(out)


def _until(parts: list[str], at: int, stop: str) -> tuple[list[str], int]:
    """Rewritten parts up to one of ``stop`` at this depth, and where that is."""
    out: list[str] = []
    while at < len(parts):
        p = parts[at]
        if p in tuple(stop):
            return out, at
        if p == "(":
            inner, at = _until(parts, at + 1, ")")
            out += ["(", *inner, ")"]
        elif p.endswith("(") and p[0].isidentifier():
            args, at = _arguments(parts, at + 1)
            name = p[:-1].strip().lower()
            rule = RULES.get(name)
            if rule and rule[0] <= len(args) <= rule[1]:
                call = rule[2](args)
                if rule[3]:
                    tail, at = _suffix(parts, at + 1)
                    call, at = rule[3](call + tail, args), at - 1
                out.append(call)
            else:
                out.append(f"{p}{', '.join(args)})")
        else:
            out.append(p)
        at += 1
    return out, at


def _arguments(parts: list[str], at: int) -> tuple[list[str], int]:
    """The rewritten arguments of a call that begins at ``at``, and where its bracket closes."""
    args: list[str] = []
    while True:
        own, at = _until(parts, at, ",)")
        text = "".join(own)
        if text.strip() or args or at < len(parts) and parts[at] == ",":
            args.append(text.strip() if text.strip() else text)
        if at >= len(parts) or parts[at] == ")":
            return args, at
        at += 1


def _suffix(parts: list[str], at: int) -> tuple[str, int]:
    """FILTER (...) and OVER (...) or OVER name behind an aggregate, and where they end."""
    out = ""
    while True:
        k = at
        while k < len(parts) and parts[k].isspace():
            k += 1
        if k < len(parts) and re.fullmatch(r"(?i)(filter|over)\s*\(", parts[k]):
            inner, end = _until(parts, k + 1, ")")
            out += f" {parts[k]}{''.join(inner)})"
            at = end + 1
        else:
            return out, at
