"""Hierarchical packing of token sequences into several context sizes.

Each run of documents of an input partition with ``GROUP_TOKENS`` tokens is packed by itself, so there is no
shuffle and memory is bounded by a group, or by the longest document where that is longer. Whole windows of the longest context are cut off a document first; the
rest, shorter than that, is routed to the smallest context size that holds it. Then each tier is packed,
longest first: a window takes the longest piece of its tier and its gap is filled with the largest
pieces that fit from shorter tiers; when none fits, a shorter piece is cut so that the gap closes. What
is left when no shorter piece remains is cut at powers of two. So every sequence's length is a power of
two, the longest context included, and nothing is padded. A group's sequences of one tier are dealt in turn to
as few step groups as keep them within ``STEP_TOKENS`` tokens, so their sizes differ by one sequence at most.

Defined results: a null or empty text is the end token alone; ids may repeat or be null, each row is
packed by itself; an empty table gives no rows; columns beyond doc_id and text are ignored. The string
of a special token in a text becomes that token, as the tokenizers library has it by default. Sequence ids
depend on how the input is split into partitions; the pieces of a document and its tokens do not.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from loomspark.session import table

CONTEXT = 1024
TIERS = (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1)
STEP_TOKENS = 8192
GROUP_TOKENS = 1_000_000
CACHE_WORDS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Encoder:
    """Token ids as little-endian 32-bit bytes, from the ranks of a byte-level BPE vocabulary.

    A space after a character that is no white space always begins a token of the vocabulary's pattern,
    so text is split there and each part's ids are kept; parts recur. A text with a white space before a
    space is encoded whole. ``special`` names strings that are tokens of their own, found before anything else.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        self.special = {s: i.to_bytes(4, "little") for s, i in (special or {}).items()}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.odd = re.compile(r"\s ")

    def whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.plain.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.marks and self.marks.search(text):
            return b"".join(self.special.get(part) or self.ordinary(part) for part in self.marks.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if self.odd.search(text):
            return self.whole(text)
        known, (first, *rest) = self.known, text.split(" ")
        parts = [self.whole(first)] if first else []
        if not first:  # the text begins with a space
            return self.whole(text)
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = known[word] = self.whole(" " + word)
            parts.append(ids)
        return b"".join(parts)


def _pow2(n: int) -> int:
    return 1 << n.bit_length() - 1


def pack_group(tokens: list[bytes], context: int = CONTEXT) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, [(document, start, length)]) for each sequence; ``tokens`` are 4-byte ids, one end token at least."""
    pool: list[list[tuple[int, int]]] = [[] for _ in range(context)]
    mask = 0

    def put(doc: int, start: int, n: int) -> None:
        nonlocal mask
        pool[n].append((doc, start))
        mask |= 1 << n

    def take(most: int) -> tuple[int, int, int] | None:
        nonlocal mask
        n = (mask & (1 << most + 1) - 1).bit_length() - 1
        if n < 1:
            return None
        doc, start = pool[n].pop()
        if not pool[n]:
            mask &= ~(1 << n)
        return doc, start, n

    for doc, ids in enumerate(tokens):
        n = len(ids) // 4
        for start in range(0, n - context + 1, context):
            yield context, [(doc, start, context)]
        if n % context:
            put(doc, n - n % context, n % context)
    for tier in (t for t in TIERS if t <= context):
        while (piece := take(min(tier, context - 1))) is not None:
            if piece[2] <= tier // 2:  # belongs to a shorter tier
                put(*piece)
                break
            window, gap = [piece], tier - piece[2]
            while gap:
                more = take(gap) or take(min(tier, context - 1))
                if more is None:
                    break
                doc, start, n = more
                if n > gap:  # none fits: cut one so that the gap closes
                    put(doc, start + gap, n - gap)
                    n = gap
                window.append((doc, start, n))
                gap -= n
            while gap:  # nothing else is left: cut at powers of two
                total = tier - gap
                keep, part = _pow2(total), []
                if keep == total:
                    break
                rest = keep
                while rest:
                    doc, start, n = window.pop(0)
                    if n > rest:
                        window.insert(0, (doc, start + rest, n - rest))
                        n = rest
                    part.append((doc, start, n))
                    rest -= n
                yield keep, part
                gap += keep
            yield tier if not gap else tier - gap, window


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int] | None = None, end_id: int = 0, context: int = CONTEXT, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """The pieces of all documents, with the sequence and offset of each; see ``SCHEMA``."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, made, steps = Encoder(ranks_path, pattern, special), TaskContext.get().partitionId() << 40, 0
        ids: list = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, steps, held
            packed = list(pack_group(tokens, context))
            counts, dealt, first = Counter(tier for tier, _ in packed), Counter(), {}
            for tier, n in counts.items():
                first[tier], steps = steps, steps + -(-n // max(1, STEP_TOKENS // tier))
            rows = []
            for tier, pieces in packed:
                groups = -(-counts[tier] // max(1, STEP_TOKENS // tier))
                step = (made >> 40 << 40) + first[tier] + dealt[tier] % groups
                dealt[tier] += 1
                offset = 0
                for doc, start, n in pieces:
                    all_ids = tokens[doc]
                    rows.append((ids[doc], start, n, zlib.crc32(all_ids[4 * start : 4 * (start + n)]), len(all_ids) // 4, made, offset, tier, step))
                    offset += n
                made += 1
            ids.clear()
            tokens.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "tier" else pa.int64()) for k, c in zip(names, zip(*rows))], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                tokens.append(encoder.encode(text or "") + end)
                held += len(tokens[-1]) // 4
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def pack_with_public_ranks(docs: DataFrame) -> DataFrame:
    """By the ids that ``byte_bpe_50k.json`` gives, its special tokens included; the ranks are the same vocabulary."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


def op4_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_with_public_ranks(table(spark, sf_dir, "documents"))
