"""Matroska media columns: a muxer for 8-bit samples and a parser from stored bytes to packet tables.

The parser reads variable-length EBML elements (known and unknown sizes), tracks, clusters, SimpleBlocks
and BlockGroups with Xiph, EBML and fixed-size lacing or none, and cues. Its packet table has a row per
frame: track, timestamp in milliseconds, key flag, and the frame's byte range in the stored file. The
muxer stores a payload losslessly as A_PCM/INT/LIT samples of 8 bits, in laced blocks with a cue for each
cluster; reading the byte ranges of the packets in order gives the payload back.

Defined results: a null text is an empty one and gives a single frame of padding; bytes that are not
Matroska or are cut short raise ``MatroskaError`` from ``parse`` and give a null packet list and an
``error`` in ``packet_table``; equal texts give equal files; an empty table gives no rows; ids may repeat
or be null, each row is handled by itself; columns beyond those named are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm.batches import map_columns
from loomspark.session import table

FRAME = 576
RATE = 8000
LACE = 8  # frames in a block
BLOCKS = 32  # blocks in a cluster

#: Element ids of EBML and Matroska.
EBML, DOCTYPE, SEGMENT, INFO, SCALE, TRACKS, ENTRY = 0x1A45DFA3, 0x4282, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
NUMBER, UID, TYPE, CODEC, AUDIO, FREQUENCY, CHANNELS, BITS = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Level-1 elements, which end a cluster of unknown size.
TOP = {CLUSTER, INFO, TRACKS, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


class MatroskaError(ValueError):
    """The bytes are not a whole Matroska file."""


# --- writing -----------------------------------------------------------------------------------------


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], style: str) -> tuple[int, bytes]:
    """Flag bits and the block's data for ``frames``; style: none, xiph, fixed or ebml."""
    if style == "none" or len(frames) == 1:
        if len(frames) != 1:
            raise ValueError("a block without lacing has one frame")
        return 0, frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if style == "fixed":
        if len(set(sizes)) > 1:
            raise ValueError("fixed-size lacing takes frames of one size")
        return 0x04, head + b"".join(frames)
    if style == "xiph":
        return 0x02, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1]) + b"".join(frames)
    made = _size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        made += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return 0x06, head + made + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, per_block: int = LACE, per_cluster: int = BLOCKS, style: str = "fixed") -> bytes:
    """A Matroska file with one PCM track that holds ``payload``, a multiple of ``frame`` bytes."""
    head = element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + element(DOCTYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
    info = element(INFO, _uint(SCALE, 1_000_000) + element(0x4D80, b"loomspark") + element(0x5741, b"loomspark"))
    audio = element(AUDIO, element(FREQUENCY, np.array(RATE, ">f4").tobytes()) + _uint(CHANNELS, 1) + _uint(BITS, 8))
    parts = [info, element(TRACKS, element(ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + element(CODEC, b"A_PCM/INT/LIT") + audio))]
    at, cues, step = sum(map(len, parts)), [], frame * per_block
    for first in range(0, len(payload), step * per_cluster):
        start = first * 1000 // RATE
        blocks = [_uint(TIME, start)]
        for b in range(first, min(first + step * per_cluster, len(payload)), step):
            data = payload[b : b + step]
            flags, body = lace([data[i : i + frame] for i in range(0, len(data), frame)], style if len(data) > frame else "none")
            blocks.append(element(SIMPLE, b"\x81" + (b * 1000 // RATE - start).to_bytes(2, "big") + bytes([0x80 | flags]) + body))
        cues.append(element(POINT, _uint(CUE_TIME, start) + element(POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# --- reading -----------------------------------------------------------------------------------------


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp_ms, key, offset, length); cues: (time_ms, track, file offset of the cluster)."""

    doctype: str = ""
    scale: int = 1_000_000
    tracks: dict = field(default_factory=dict)
    clusters: int = 0
    packets: list = field(default_factory=list)
    cues: list = field(default_factory=list)


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, next position); ``keep`` leaves the length marker in, as ids have it. -1: unknown size."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    raw = int.from_bytes(data[at : at + width], "big")
    if at + width > len(data):
        raise MatroskaError(f"cut short at {at}")
    if keep:
        return raw, at + width
    value = raw & (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def _number(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def _children(data: bytes, at: int, end: int, stop: frozenset | set = frozenset()):
    """(id, body start, body end) of the elements in a range; an unknown size runs to the range's end or an id in ``stop``."""
    while at < end:
        kind, body = vint(data, at, keep=True)
        if kind in stop:
            return
        size, body = vint(data, body)
        if size < 0:
            last = end
            if kind == CLUSTER:
                last = body
                for _, _, last in _children(data, body, end, TOP):
                    pass
        else:
            last = body + size
        if last > end:
            raise MatroskaError(f"element {kind:x} at {at} runs past its parent")
        yield kind, body, last
        at = last


def _block(media: Media, data: bytes, at: int, end: int, base: int, key: bool | None, ticks: float) -> None:
    track, at = vint(data, at)
    if at + 3 > end:
        raise MatroskaError(f"block cut short at {at}")
    when, flags = base + int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    at, style = at + 3, flags >> 1 & 3
    if style == 0:
        sizes = [end - at]
    else:
        n, at = data[at] + 1, at + 1
        if style == 2:
            if (end - at) % n:
                raise MatroskaError(f"fixed-size lace at {at} is uneven")
            sizes = [(end - at) // n] * n
        else:
            sizes = []
            for i in range(n - 1):
                if style == 1:
                    size = 0
                    while data[at] == 255:
                        size, at = size + 255, at + 1
                    size, at = size + data[at], at + 1
                elif i == 0:
                    size, at = vint(data, at)
                else:
                    width = 9 - data[at].bit_length()
                    delta, at = vint(data, at)
                    size = sizes[-1] + delta - (1 << 7 * width - 1) + 1
                sizes.append(size)
            sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError(f"lace sizes at {at} exceed the block")
    stamp, one = when * ticks, media.tracks.get(track, {}).get("ms_per_byte", 0.0)
    for size in sizes:
        media.packets.append((track, round(stamp), bool(flags & 0x80) if key is None else key, at, size))
        stamp, at = stamp + size * one, at + size


def parse(data: bytes) -> Media:
    """The tracks, packets and cues of a Matroska file."""
    media, found = Media(), False
    for kind, at, end in _children(data, 0, len(data)):
        if kind == EBML:
            media.doctype = next((data[a:b].rstrip(b"\0").decode("ascii", "replace") for k, a, b in _children(data, at, end) if k == DOCTYPE), "matroska")
        elif kind == SEGMENT and media.doctype in ("matroska", "webm"):
            found = True
            _segment(media, data, at, end)
    if not found:
        raise MatroskaError("no Matroska segment")
    return media


def _segment(media: Media, data: bytes, start: int, end: int) -> None:
    cues = []
    for kind, at, last in _children(data, start, end):
        ticks = media.scale / 1e6
        if kind == INFO:
            media.scale = next((_number(data, a, b) for k, a, b in _children(data, at, last) if k == SCALE), media.scale)
        elif kind == TRACKS:
            for k, a, b in _children(data, at, last):
                if k == ENTRY:
                    _track(media, data, a, b)
        elif kind == CLUSTER:
            media.clusters += 1
            base = 0
            for k, a, b in _children(data, at, last, TOP):
                if k == TIME:
                    base = _number(data, a, b)
                elif k == SIMPLE:
                    _block(media, data, a, b, base, None, ticks)
                elif k == GROUP:
                    inside = list(_children(data, a, b))
                    key = all(x[0] != REFERENCE for x in inside)
                    for k2, a2, b2 in inside:
                        if k2 == BLOCK:
                            _block(media, data, a2, b2, base, key, ticks)
        elif kind == CUES:
            for k, a, b in _children(data, at, last):
                if k == POINT:
                    time = next((_number(data, x, y) for j, x, y in _children(data, a, b) if j == CUE_TIME), 0)
                    for j, x, y in _children(data, a, b):
                        if j == POSITIONS:
                            own = {i: _number(data, p, q) for i, p, q in _children(data, x, y)}
                            cues.append((round(time * ticks), own.get(CUE_TRACK, 0), start + own.get(CUE_CLUSTER, 0)))
    media.cues += cues


def _track(media: Media, data: bytes, at: int, end: int) -> None:
    own = {k: (a, b) for k, a, b in _children(data, at, end)}
    number = _number(data, *own[NUMBER]) if NUMBER in own else 0
    track = {"type": _number(data, *own[TYPE]) if TYPE in own else 0, "codec": data[slice(*own[CODEC])].decode("ascii", "replace") if CODEC in own else ""}
    if AUDIO in own:
        inner = {k: (a, b) for k, a, b in _children(data, *own[AUDIO])}
        rate = float(np.frombuffer(data[slice(*inner[FREQUENCY])], ">f4" if inner[FREQUENCY][1] - inner[FREQUENCY][0] == 4 else ">f8")[0]) if FREQUENCY in inner else 8000.0
        channels, bits = (_number(data, *inner[k]) if k in inner else d for k, d in ((CHANNELS, 1), (BITS, 0)))
        track |= {"rate": rate, "channels": channels, "bits": bits}
        if track["codec"].startswith("A_PCM") and bits and rate:
            track["ms_per_byte"] = 8000.0 / (rate * channels * bits)
    media.tracks[number] = track


def read_payload(data: bytes, media: Media, track: int = 1) -> bytes:
    """The bytes of a track's packets, in order."""
    return b"".join([data[a : a + n] for t, _, _, a, n in media.packets if t == track])


def features(payload: bytes, media: Media) -> str:
    """A line of what the packets and samples show."""
    x = np.frombuffer(payload, np.uint8)
    last = max((p[1] for p in media.packets), default=0)
    level = np.bincount(x >> 4, minlength=16)
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"matroska tracks={len(media.tracks)} clusters={media.clusters} packets={len(media.packets)} cues={len(media.cues)} last_ms={last} sum={int(x.sum(dtype=np.int64))} crossings={turns} levels={','.join(map(str, level))}"


# --- columns -----------------------------------------------------------------------------------------


def padded(text: str | None, frame: int = FRAME) -> tuple[bytes, int]:
    """The text's bytes with bytes 255 up to a positive multiple of ``frame``, and their number before."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(frame, -(-len(raw) // frame) * frame) - len(raw)), len(raw)


def encode_column(docs: DataFrame, style: str = "fixed") -> DataFrame:
    """doc_id, n_bytes and ``media``: each text's padded bytes as a Matroska file."""

    def run(batch: pa.RecordBatch) -> dict:
        pairs = [padded(t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [n for _, n in pairs], "media": [mux(p, style=style) for p, _ in pairs]}

    return map_columns(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary", rows=128)


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet: id, packet, track, timestamp_ms, key, byte_offset, byte_length; or a row with ``error``."""
    one = "struct<track:long,timestamp_ms:long,key:boolean,byte_offset:long,byte_length:long>"

    def run(batch: pa.RecordBatch) -> dict:
        lists, errors = [], []
        for data in batch.column("media").to_pylist():
            try:
                lists.append([dict(zip(("track", "timestamp_ms", "key", "byte_offset", "byte_length"), p)) for p in parse(data or b"").packets])
                errors.append(None)
            except (MatroskaError, IndexError) as e:
                lists.append(None)
                errors.append(str(e) or "cut short")
        return {"id": batch.column("id"), "packets": lists, "error": errors}

    parsed = map_columns(media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")), run, f"id long, packets array<{one}>, error string", rows=64)
    return parsed.select(F.col("id").alias(id_col), "error", F.posexplode_outer("packets").alias("packet", "p")).select(id_col, "packet", "p.*", "error")


def decode_column(media: DataFrame) -> DataFrame:
    """Read the stored files back: the payload's digests and features, from the packets' byte ranges."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for data in batch.column("media").to_pylist():
            found = parse(data)
            payload = read_payload(data, found)
            for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, found))):
                out[k].append(v)
        return out | {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")}

    return map_columns(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", rows=128)


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_column(encode_column(table(spark, sf_dir, "documents")))
