"""Ignore rules: the last matching rule decides, an excluded directory decides for all below it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, SparkSession, functions as F

from loomspark.functions.paths import _component

#: Directories that are never entered, patterns that come before any file's own, and the largest file.
NEVER = (".git", ".jj")
DEFAULTS = ("node_modules/", ".zig-cache/", "zig-out/", "target/", ".venv/", "__pycache__/", ".next/", "dist/", "build/")
LARGEST = 256 * 1024
#: Rule files of a directory; of these a later one overrides an earlier one.
FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    regex: str
    negated: bool
    dirs_only: bool


def parse_rules(text: str, base: str = "") -> list[Rule]:
    """The rules of one ignore file that lies in directory ``base`` ('' is the root)."""
    out = []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        if line.startswith(("\\#", "\\!")):
            line = line[1:]
        dirs_only = line.endswith("/")
        line = line.rstrip("/") if dirs_only else line
        if not line:
            continue
        anchored = "/" in line
        parts = [p for p in line.split("/") if p]
        body = ""
        for k, p in enumerate(parts):
            if p == "**":
                body += ".+" if k == len(parts) - 1 else "(?:[^/]+/)*"
            else:
                body += _component(p) + ("/" if k < len(parts) - 1 else "")
        head = _component(base.strip("/")).replace("\\/", "/") + "/" if base.strip("/") else ""
        out.append(Rule(f"^{head}{'' if anchored else '(?:.*/)?'}{body}$", negated, dirs_only))
    return out


def load_rules(spark: SparkSession, root: str, names: tuple[str, ...] = FILES) -> tuple[str, list[Rule]]:
    """(prefix, rules): the default rules, then those of all rule files from the repository's top down to ``root`` and below.

    Rule files above ``root`` count up to the directory that holds ``.git``; without one none do. Paths are
    matched with the prefix, the way from that directory to ``root``, before them. Files are read through Hadoop's
    file systems; one that is missing, too large or unreadable is skipped. Directories that the rules so far leave
    out are not entered.
    """
    jvm = spark.sparkContext._jvm
    fs = (top := jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rules = default_rules()

    def load(folder: object, base: str) -> None:
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(folder, name)
            try:
                if fs.exists(path) and fs.getFileStatus(path).getLen() <= LARGEST:
                    stream = fs.open(path)
                    try:
                        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
                    finally:
                        stream.close()
                    rules.extend(parse_rules(data.decode(errors="replace"), base))
            except Py4JJavaError:
                continue

    above, at = [], top.getParent()
    while at is not None:
        above.append(at)
        if fs.exists(jvm.org.apache.hadoop.fs.Path(at, ".git")):
            break
        at = at.getParent()
    else:
        above = []
    names_of = [p.getName() for p in above[:-1]][::-1]  # below the outermost
    for k, folder in enumerate(reversed(above)):
        load(folder, "/".join(names_of[:k]))
    prefix = "/".join([*names_of, top.getName()]) if above else ""

    open_ = [(top, prefix)]
    while open_:
        folder, base = open_.pop()
        load(folder, base)
        for x in fs.listStatus(folder):
            own = f"{base}/{x.getPath().getName()}".lstrip("/")
            if x.isDirectory() and x.getPath().getName() not in NEVER and not _left_out(own, rules):
                open_.append((x.getPath(), own))
    return prefix, rules


def _left_out(path: str, rules: list[Rule]) -> bool:
    """Whether the last rule that matches a directory leaves it out."""
    verdict = False
    for r in rules:
        if re.match(r.regex, path):
            verdict = not r.negated
    return verdict


def default_rules() -> list[Rule]:
    return parse_rules("\n".join(DEFAULTS))


def _own(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """What the last matching rule says of a path itself; false without one."""
    verdict = F.lit(False)
    for r in rules:
        hit = path.rlike(r.regex) & is_dir if r.dirs_only else path.rlike(r.regex)
        verdict = F.when(hit, F.lit(not r.negated)).otherwise(verdict)
    return verdict


def ignored(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """Is a path left out: by a rule of its own or through a directory above it."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    parents = F.when(F.size(parts) > 1, above).otherwise(F.expr("cast(array() as array<string>)"))
    never = F.arrays_overlap(parts, F.array(*[F.lit(n) for n in NEVER]))
    return never | F.exists(parents, lambda p: _own(p, F.lit(True), rules)) | _own(path, is_dir, rules)
