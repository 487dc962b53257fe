"""Markdown documents to blocks, chunks and links.

Parsing a document is local to its text, so these run per row in Arrow batches: a document never meets another
one, and nothing is shuffled. Block rules, in order: fenced code, ATX heading, thematic break, table, list or
paragraph; front matter only at the very start and only if closed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

TARGET, MAXIMUM, OVERLAP = 800, 1024, 80

_fence = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_atx = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_rule = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_setext = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_table_line = re.compile(r" {0,3}\|?(?:[ \t]*:?-+:?[ \t]*\|)+(?:[ \t]*:?-+:?[ \t]*)?$")
_item = re.compile(r" {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]|$)")
_html = re.compile(r" {0,3}<(?:!--|[?!]|/?[A-Za-z])")


@dataclass(frozen=True)
class Block:
    kind: str  # frontmatter, heading, code, table, list, paragraph, rule, html
    start: int
    end: int
    level: int = 0
    title: str = ""


def _lines(text: str) -> list[str]:
    """Lines with their ends; only a line feed ends one."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def count_tokens(text: str) -> int:
    """A model-free estimate: a quarter of the bytes, rounded up."""
    return -(-len(text.encode()) // 4)


def _plain(title: str) -> str:
    return re.sub(r"[ \t\n]+", " ", re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", title)).strip()


def blocks(source: str) -> list[Block]:
    """The blocks of a document in order; ``start`` and ``end`` are character offsets."""
    out: list[Block] = []
    lines, at = [], 0
    for raw in _lines(source):
        lines.append((at, at + len(raw), raw.rstrip("\r\n")))
        at += len(raw)
    i = 0
    if lines and lines[0][2].rstrip() == "---":
        close = next((k for k in range(1, len(lines)) if lines[k][2].rstrip() in ("---", "...")), None)
        if close is not None:
            out.append(Block("frontmatter", 0, lines[close][1]))
            i = close + 1
    while i < len(lines):
        start, end, line = lines[i]
        if not line.strip():
            i += 1
        elif m := _fence.match(line):
            k = i + 1
            mark = m[1]
            if "`" in mark and "`" in m[2]:
                k = i
            else:
                while k < len(lines) and not re.match(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[k][2]):
                    k += 1
                k = min(k, len(lines) - 1)
                out.append(Block("code", start, lines[k][1]))
                i = k + 1
                continue
            out.append(Block("paragraph", start, end))
            i += 1
        elif m := _atx.match(line):
            out.append(Block("heading", start, end, len(m[1]), _plain(m[2] or "")))
            i += 1
        elif _rule.match(line):
            out.append(Block("rule", start, end))
            i += 1
        elif "|" in line and i + 1 < len(lines) and _table_line.match(lines[i + 1][2]):
            k = i + 2
            while k < len(lines) and "|" in lines[k][2] and lines[k][2].strip():
                k += 1
            out.append(Block("table", start, lines[k - 1][1]))
            i = k
        else:
            kind = "list" if _item.match(line) else "html" if _html.match(line) else "paragraph"
            k = i + 1
            while k < len(lines) and lines[k][2].strip():
                here = lines[k][2]
                if kind == "paragraph" and (s := _setext.match(here)):
                    title = "\n".join(x[2].strip() for x in lines[i:k])
                    out.append(Block("heading", start, lines[k][1], 1 if s[1][0] == "=" else 2, _plain(title)))
                    break
                if _fence.match(here) or _atx.match(here) or _rule.match(here) or kind == "paragraph" and _item.match(here) and here.strip()[0] in "-+*":
                    k -= 1
                    out.append(Block(kind, start, lines[k][1]))
                    break
                k += 1
            else:
                k -= 1
                out.append(Block(kind, start, lines[k][1]))
            i = k + 1
    return out


def heading_paths(found: list[Block]) -> list[str]:
    """For each block, the headings that it stands under: ``A > B > C``."""
    stack: list[tuple[int, str]] = []
    out = []
    for b in found:
        if b.kind == "heading":
            while stack and stack[-1][0] >= b.level:
                stack.pop()
            stack.append((b.level, b.title))
        out.append(" > ".join(t for _, t in stack if t))
    return out


def _table_head(text: str) -> str:
    cells = [c.strip() for c in text.split("\n", 1)[0].strip().strip("|").split("|")]
    return "[" + " | ".join(cells) + "]"


def _cut(text: str, most: int, count: Callable[[str], int]) -> Iterator[str]:
    """A long line in pieces of at most ``most`` tokens, cut between characters; work in proportion to its length."""
    at, guess = 0, 4 * most
    while at < len(text):
        fits, over = 1, guess
        while over < len(text) - at and count(text[at : at + over]) <= most:
            fits, over = over, 2 * over
        if over >= len(text) - at:
            over = len(text) - at + 1
            if count(text[at:]) <= most:
                fits = over - 1
        while over - fits > 1:
            mid = (fits + over) // 2
            fits, over = (mid, over) if count(text[at : at + mid]) <= most else (fits, mid)
        yield text[at : at + fits]
        at, guess = at + fits, fits + 1


def chunks(source: str, target: int = TARGET, most: int = MAXIMUM, overlap: int = OVERLAP, count: Callable[[str], int] = count_tokens) -> list[tuple[str, int, int, int, str]]:
    """(heading_path, start, end, tokens, text) in order, of at most ``most`` tokens each.

    Blocks are packed greedily to ``target``; a heading closes a chunk that is half full; the last blocks of at most
    ``overlap`` tokens begin the next chunk. A larger block is split at lines, then inside lines; its parts are
    marked as continued, and a table's parts carry its header.
    """
    found = blocks(source)
    body = [(b, p) for b, p in zip(found, heading_paths(found)) if b.kind not in ("frontmatter", "rule")]
    out: list[tuple[str, int, int, int, str]] = []
    held: list[tuple[Block, str, int]] = []
    fresh = False

    def flush(keep: bool) -> None:
        nonlocal held, fresh
        if held and fresh:
            text = source[held[0][0].start : held[-1][0].end].strip("\n")
            out.append((held[0][1] if held[0][0].kind != "heading" or len(held) == 1 else held[0][1], held[0][0].start, held[-1][0].end, count(text), text))
        tail: list[tuple[Block, str, int]] = []
        if keep:
            for x in reversed(held):
                if sum(t for _, _, t in tail) + x[2] > overlap:
                    break
                tail.insert(0, x)
        held, fresh = (tail if len(tail) < len(held) else []), False

    for b, path in body:
        text = source[b.start : b.end].strip("\n")
        n = count(text)
        if n > most:
            flush(False)
            parts: list[str] = []
            for line in _lines(text):
                for piece in _cut(line, most, count) if count(line) > most else (line,):
                    if parts and count(parts[-1] + piece) <= most:
                        parts[-1] += piece
                    else:
                        parts.append(piece)
            at = b.start + source[b.start : b.end].index(text)
            for k, piece in enumerate(parts):
                head = f" {_table_head(text)}" if b.kind == "table" and k else ""
                out.append((path + (f" (cont. {k})" if k else "") + head, at, at + len(piece), count(piece), piece.strip("\n")))
                at += len(piece)
            continue
        total = count(source[held[0][0].start : b.end]) if held else n
        if held and (total > most or total > target and fresh or b.kind == "heading" and fresh and sum(t for _, _, t in held) >= target // 2):
            flush(b.kind != "heading")
            if held and count(source[held[0][0].start : b.end]) > most:
                held = []
        held.append((b, path, n))
        fresh = True
    flush(False)
    return out


# --- links -------------------------------------------------------------------------------------------

_inline = re.compile(r"(?<!!)\[(?:[^\[\]]|\[[^\[\]]*\])*\]\(\s*<?([^()\s<>]+(?:\([^()\s]*\)[^()\s<>]*)*)>?(?:\s+[\"'(][^)]*)?\s*\)")
_wiki = re.compile(r"\[\[([^\[\]|\n]+)(?:\|[^\[\]\n]*)?\]\]")
_uri = re.compile(r"(?<![\w(<\[])([A-Za-z][A-Za-z0-9+.-]*://[^\s<>\"'`\])]+)")
_front = re.compile(r"^(depends_on|related_to|part_of)[ \t]*:[ \t]*(.*)$")
#: Schemes that lead outside, and endings of documents; a file with any other ending is an asset.
EXTERNAL = ("http", "https", "file", "ftp", "data", "mailto")
DOCUMENTS = ("md", "txt", "mdx")


def is_asset(raw: str) -> bool:
    name = raw.split("#", 1)[0].rstrip("/").rsplit("/", 1)[-1]
    _, dot, ending = name.rpartition(".")
    return bool(dot and ending) and ending.lower() not in DOCUMENTS


def classify(raw: str, default: str = "md") -> str:
    """md, wiki, frontmatter (as given), collection_uri, external or asset.

    A scheme without an authority leads outside, whatever it is; one with an authority names a collection.
    """
    if m := re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(//)?", raw):
        if m[1].lower() in EXTERNAL or not m[2]:
            return "external"
        return "asset" if is_asset(raw) else "collection_uri"
    return "asset" if is_asset(raw) else default


def links(source: str) -> list[tuple[str, str]]:
    """(kind, raw target) of a document's links in order; code and inline code hold none."""
    out: list[tuple[str, str]] = []
    for b in blocks(source):
        text = source[b.start : b.end]
        if b.kind == "frontmatter":
            key = None
            for line in _lines(text):
                if m := _front.match(line := line.rstrip("\r\n")):
                    key = m[1]
                    out += [("frontmatter", v) for v in (x.strip(" \t\"'") for x in m[2].strip("[] \t").split(",")) if v]
                elif key and (m := re.match(r"\s+-\s+(.*)$|-\s+(.*)$", line)):
                    v = (m[1] or m[2]).strip(" \t\"'")
                    out += [("frontmatter", v)] if v else []
                else:
                    key = None
        elif b.kind != "code":
            bare = re.sub(r"(`+)(?!`).*?(?<!`)\1(?!`)", lambda m: " " * len(m[0]), text, flags=re.S)
            found = [(m.start(), classify(m[1]), m[1], m.span()) for m in _inline.finditer(bare)]
            found += [(m.start(), "wiki", m[1].strip(), m.span()) for m in _wiki.finditer(bare)]
            taken = [s for *_, s in found]
            for m in _uri.finditer(bare):
                if not any(a <= m.start() < z for a, z in taken):
                    raw = m[1].rstrip(".,;:!?")
                    found.append((m.start(), classify(raw), raw, m.span()))
            out += [(k, raw) for _, k, raw, _ in sorted(found)]
    return out


def meta(source: str) -> dict[str, str]:
    """The ``key: value`` lines of the front matter; lists as comma-joined texts."""
    found = blocks(source)
    if not found or found[0].kind != "frontmatter":
        return {}
    out = {}
    for line in _lines(source[: found[0].end])[1:-1]:
        if m := re.match(r"([A-Za-z_][\w-]*)[ \t]*:[ \t]*(.*)$", line.rstrip("\r\n")):
            v = m[2].strip()
            out[m[1]] = ",".join(x.strip(" \t\"'") for x in v[1:-1].split(",") if x.strip()) if v.startswith("[") and v.endswith("]") else v.strip("\"'")
    return out


def slug(body: str, fallback: str = "memory", most: int = 16) -> str:
    """A file name from a text's first significant characters; letters of any script count."""
    out = re.sub(r"[^\w]+", "-", body.strip().lower(), flags=re.U).strip("-_")
    cut, n = "", 0
    for c in out:
        n += c != "-"
        if n > most:
            break
        cut += c
    return cut.strip("-") or fallback


def memory_file(body: str, **fields: object) -> str:
    """A memory as markdown: front matter and the body."""
    rows = [f"{k}: {'[' + ', '.join(v) + ']' if isinstance(v, (list, tuple)) else v}" for k, v in fields.items() if v not in (None, "", [], ())]
    return "---\n" + "\n".join(rows) + "\n---\n\n" + body.strip() + "\n"


# --- columns -----------------------------------------------------------------------------------------


#: Characters of the texts whose rows are held at once; Spark may send 64 MB of texts in a batch.
PIECE = 1 << 20


def _table(df: DataFrame, key: str, text: str, parse: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(f"`{key}` {dict(df.dtypes)[key]}, idx int, {schema}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, own, rows, held = batch.column(0), batch.column(1), [], [], 0
            for i in range(batch.num_rows):
                source = texts[i].as_py() or ""
                made = parse(source)
                own += [i] * len(made)
                rows += [(n, *r) for n, r in enumerate(made)]
                held += len(source)
                if rows and (held >= PIECE or i == batch.num_rows - 1):
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:])]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(own, pa.int32())), *columns], schema=arrow)
                    own, rows, held = [], [], 0

    return df.select(key, text).mapInArrow(run, kind)


def block_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def parse(t: str) -> list[tuple]:
        found = blocks(t)
        return [(b.kind, b.start, b.end, b.level, b.title, p) for b, p in zip(found, heading_paths(found))]

    return _table(docs, key, text, parse, "kind string, start int, end int, level int, title string, heading_path string")


def chunk_table(docs: DataFrame, key: str = "doc_id", text: str = "text", target: int = TARGET, most: int = MAXIMUM, overlap: int = OVERLAP, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """Chunks of every document; ``count`` tells the tokens of a text, a model's own counter if need be."""
    return _table(docs, key, text, lambda t: chunks(t, target, most, overlap, count), "heading_path string, start int, end int, n_tokens int, text string")


def embed_table(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str = "text", name: str = "embedding", batch: int = 64) -> DataFrame:
    """``chunks`` with a vector of each text from ``embed``, which is given up to ``batch`` texts; null for null.

    ``embed`` is sent to the executors; one that loads a model should do so at its first call.
    """
    schema = StructType([f for f in chunks.schema if f.name != name]).add(name, ArrayType(FloatType()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            there, made = [i for i, t in enumerate(pdf[text]) if t is not None], [None] * len(pdf)
            for a in range(0, len(there), batch):
                own = there[a : a + batch]
                for i, v in zip(own, embed([pdf[text].iloc[i] for i in own])):
                    made[i] = [float(x) for x in v]
            pdf = pdf.drop(columns=[name], errors="ignore")
            pdf[name] = pd.Series(made, index=pdf.index, dtype=object)
            yield pdf

    return chunks.mapInPandas(run, schema)


def link_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _table(docs, key, text, links, "kind string, raw string")


def with_meta(docs: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """Front matter fields as columns, without Python: the block before the second ``---`` line, then a line each."""
    front = F.regexp_extract(text, r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n(?:---|\.\.\.)[ \t]*(?:\r?\n|\z)", 1)
    value = lambda n: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{re.escape(n)}[ \t]*:[ \t]*(.*)$", 1), F.lit(" \t\"'\r")), F.lit(""))
    return docs.withColumns({n: value(n) for n in names})


def normal_list(c):
    """A ``[a, b]`` or ``a, b`` text as an array."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\[|\]$", ""), ","), lambda x: F.trim(x, F.lit(" \t\"'"))), lambda x: x != "")
