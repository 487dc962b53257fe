"""Text expressions: ASCII folding, LIKE, UTF-8 safe cuts, and the mixed-script tokenizer."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The code points written without spaces (kana, ideographs, compatibility ideographs, hangul).
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{AC00}-\x{D7AF}\x{20000}-\x{2FA1F}"
#: Fixed value: bytes of a stored token
MAX_TOKEN = 64


def fold_ascii(c: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def like_ascii_ci(c: Column, pattern: str) -> Column:
    """LIKE with % and _, blind to ASCII case only, and with no escape character."""
    mark = next(m for m in map(chr, range(1, 32)) if m not in pattern)
    folded = pattern.translate(str.maketrans(UPPER, LOWER))
    return F.like(fold_ascii(c), F.lit(folded), F.lit(mark))


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of at most ``limit`` UTF-8 bytes that ends between characters."""
    whole = F.octet_length(c) <= limit
    # at most ``limit`` characters can fit; of these, as many as fit are kept
    chars = F.slice(F.split(F.substring(c, 1, limit), ""), 1, limit)
    step = lambda s, x: F.when((F.octet_length(s["t"]) + F.octet_length(x) <= limit) & s["on"], F.struct(F.concat(s["t"], x).alias("t"), s["on"].alias("on"))).otherwise(F.struct(s["t"].alias("t"), F.lit(False).alias("on")))
    cut = F.aggregate(chars, F.struct(F.lit("").alias("t"), F.lit(True).alias("on")), step, lambda s: s["t"])
    return F.when(whole, c).otherwise(cut)


def runs(c: Column) -> Column:
    """The runs of one script in a text: words, or characters of the scripts without spaces."""
    return F.regexp_extract_all(c, F.lit(f"[{CJK}]+|(?:[0-9A-Za-z]|[\\x{{80}}-\\x{{10FFFF}}&&[^{CJK}]])+"), F.lit(0))


def _is_cjk(t: Column) -> Column:
    return t.rlike(f"^[{CJK}]")


def bigrams(t: Column) -> Column:
    """Overlapping pairs of characters; a single character is itself."""
    n = F.length(t)
    return F.when(n < 2, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2))))


#: What no token holds: ASCII other than letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold_token(t: Column) -> Column:
    """A word folded and cut; ASCII alone, the usual case, needs no table of letters."""
    folded = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(fold_ascii(t))
    return F.when(F.octet_length(t) <= MAX_TOKEN, folded).otherwise(cut_bytes(folded, MAX_TOKEN))


def tokens(c: Column) -> Column:
    """Index tokens in order: folded words of at most ``MAX_TOKEN`` bytes, and bigrams of unspaced scripts.

    Only texts that hold an unspaced script take the path by runs; others are split at what no token holds.
    """
    text = F.coalesce(c, F.lit(""))
    words = F.transform(F.array_remove(F.split(text, GAP), ""), fold_token)
    mixed = F.flatten(F.transform(runs(text), lambda t: F.when(_is_cjk(t), bigrams(t)).otherwise(F.array(fold_token(t)))))
    return F.when(text.rlike(f"[{CJK}]"), mixed).otherwise(words)


_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_unspaced = re.compile("[" + re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), CJK) + "]+")


def cut_text(t: str, limit: int = MAX_TOKEN) -> str:
    """``cut_bytes`` of a Python text."""
    return t.encode()[:limit].decode(errors="ignore")


def token_list(text: str | None) -> list[str]:
    """``tokens`` of a Python text, for building an index in Arrow batches."""
    folded = (text or "").encode(errors="replace").translate(_FOLD).decode()
    words = _words.findall(folded)
    if _unspaced.search(folded):
        parts = []
        for w in words:
            at = 0
            for m in _unspaced.finditer(w):
                parts += [w[at : m.start()]] if m.start() > at else []
                run, at = m[0], m.end()
                parts += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
            parts += [w[at:]] if at < len(w) else []
        words = parts
    return [w if len(w) <= MAX_TOKEN // 4 or len(w.encode()) <= MAX_TOKEN else cut_text(w) for w in words]


def token_count(c: Column) -> Column:
    """A model-free estimate of a text's tokens: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(c) / 4).cast("long")
