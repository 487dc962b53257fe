"""Paths: globs as regular expressions, parents, dot segments, suffixes, and folding of roots."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _component(pattern: str) -> str:
    """One path component of a glob as a regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and i < len(pattern):
            out += re.escape(pattern[i])
            i += 1
        elif c == "[" and (stop := pattern.find("]", i + 1 + (pattern[i : i + 1] in ("!", "^")))) > 0:
            body = pattern[i:stop]
            negated = body[:1] in ("!", "^")
            body = body[negated:]
            safe = "".join("\\" + x if x in "\\[]^&~|" else x for x in body)
            out += f"(?![/])[{'^' if negated else ''}{safe}]"
            i = stop + 1
        else:
            out += re.escape(c)
    return out


def glob_regex(pattern: str) -> str:
    """An anchored expression (for Java and Python alike): * and ? stay in a component, ** takes any number, zero too."""

    def rest(parts: list[str]) -> str:
        if not parts:
            return ""
        if parts[0] == "**":
            return ".*" if len(parts) == 1 else "(?:[^/]+/)*" + rest(parts[1:])
        if len(parts) == 1:
            return _component(parts[0])
        return _component(parts[0]) + ("(?:/.*)?" if parts[1:] == ["**"] else "/" + rest(parts[1:]))

    return f"^{rest(pattern.strip('/').split('/'))}$"


def prefix_regex(pattern: str) -> str:
    """An expression for the directories at or below which a path may still match the glob; '' is the root."""

    def rest(parts: list[str]) -> str:
        if not parts:
            return ""
        if parts[0] == "**":
            return ".*"
        return f"(?:{_component(parts[0])}(?:/{rest(parts[1:])})?)?"

    return f"^{rest(pattern.strip('/').split('/'))}$"


def matches_glob(c: Column, pattern: str) -> Column:
    return c.rlike(glob_regex(pattern))


def dirname(c: Column) -> Column:
    """The path up to and with its last slash."""
    return F.regexp_replace(c, "[^/]*$", "")


def basename(c: Column) -> Column:
    return F.regexp_extract(c, "[^/]*$", 0)


def normal(c: Column) -> Column:
    """The path without . and .. segments; null where it climbs above its root."""
    none = F.lit(None).cast("array<string>")
    step = lambda s, x: F.when(s.isNull(), none).when((x == "") | (x == "."), s).when(x == "..", F.when(F.size(s) > 0, F.slice(s, 1, F.size(s) - 1)).otherwise(none)).otherwise(F.array_append(s, x))
    return F.aggregate(F.split(c, "/"), F.expr("cast(array() as array<string>)"), step, lambda s: F.array_join(s, "/"))


def suffixes(c: Column) -> Column:
    """a/b/c: itself, b/c and c."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def fold_roots(roots: list[str]) -> tuple[str, list[str]]:
    """The deepest common directory of several roots and the globs below it that stand for them."""
    if not roots:
        raise ValueError("no root")
    split = [[p for p in r.split("/") if p] for r in dict.fromkeys(r.rstrip("/") for r in roots)]
    if len(split) == 1:
        return "/" + "/".join(split[0]), []
    common = []
    for parts in zip(*split):
        if len(set(parts)) > 1:
            break
        common.append(parts[0])
    if len(common) < 2:
        raise ValueError("the roots have no common directory below the top ones")
    rest = ["/".join(s[len(common) :]) for s in split]
    return "/" + "/".join(common), [] if "" in rest else sorted(f"{r}/**" for r in rest if not any(r != o and r.startswith(o + "/") for o in rest))
