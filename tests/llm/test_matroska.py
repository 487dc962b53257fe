import hashlib
import zlib

import pytest

from loomspark.llm import matroska as m


@pytest.mark.parametrize("style", ["none", "xiph", "fixed", "ebml"])
@pytest.mark.parametrize("n", [576, 576 * 7, 576 * 300])
def test_round_trip(style, n):
    payload = bytes((i * 7 + i // 251) % 256 for i in range(n))
    data = m.mux(payload, style=style, per_block=1 if style == "none" else 8)
    found = m.parse(data)
    assert m.read_payload(data, found) == payload and len(found.packets) == n // 576
    assert found.tracks[1]["bits"] == 8 and found.tracks[1]["rate"] == 8000
    assert len(found.cues) == found.clusters
    for _, _, at in found.cues:
        assert data[at : at + 4] == m.CLUSTER.to_bytes(4, "big")
    assert [p[1] for p in found.packets] == sorted(p[1] for p in found.packets)


@pytest.mark.parametrize("style", ["xiph", "ebml"])
def test_uneven_laces(style):
    frames = [b"a" * n for n in (1, 255, 600, 0, 3, 40000)]
    flags, body = m.lace(frames, style)
    data = m.element(m.EBML, m.element(m.DOCTYPE, b"webm")) + m.element(m.SEGMENT, m.element(m.CLUSTER, m._uint(m.TIME, 40) + m.element(m.SIMPLE, b"\x82\x00\x05" + bytes([flags]) + body)))
    packets = m.parse(data).packets
    assert [p[4] for p in packets] == [len(f) for f in frames] and {p[:3] for p in packets} == {(2, 45, False)}


def test_unknown_sizes_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    group = m.element(m.GROUP, m.element(m.BLOCK, b"\x81\x00\x00\x00xyz") + m._uint(m.REFERENCE, 1))
    key = m.element(m.GROUP, m.element(m.BLOCK, b"\x81\x00\x09\x00pq"))
    cluster = lambda t, body: m.CLUSTER.to_bytes(4, "big") + unknown + m._uint(m.TIME, t) + body
    data = m.element(m.EBML, m.element(m.DOCTYPE, b"matroska")) + m.SEGMENT.to_bytes(4, "big") + unknown + cluster(0, group) + cluster(1000, key)
    found = m.parse(data)
    assert found.clusters == 2 and [p[:3] for p in found.packets] == [(1, 0, False), (1, 1009, True)]
    assert m.read_payload(data, found) == b"xyzpq"


@pytest.mark.parametrize("data", [b"", b"\x00", b"RIFF....", m.mux(b"\xff" * 576)[:200], m.mux(b"\xff" * 576)[:-3]])
def test_broken_bytes(data):
    with pytest.raises(m.MatroskaError):
        m.parse(data)


def test_query_columns(spark):
    texts = {1: None, 2: "", 3: "a" * 576, 4: "é" * 300, 5: "same", 6: "same", 7: "x" * 400_000}
    df = spark.createDataFrame([(k, v, b"1") for k, v in texts.items()], "doc_id long, text string, media binary")
    rows = {r.doc_id: r for r in m.decode_column(m.encode_column(df)).collect()}
    assert len(rows) == len(texts)
    for k, v in texts.items():
        raw = (v or "").encode()
        pay = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:]))
        assert r.media_bytes > len(pay)
    assert rows[5][3:] == rows[6][3:] and rows[1].feature == rows[2].feature
    table = m.packet_table(m.encode_column(df)).where("doc_id = 4").orderBy("packet").collect()
    assert [t.byte_length for t in table] == [576, 576] and table[0].error is None
    bad = m.packet_table(spark.createDataFrame([(9, b"no"), (10, None)], "doc_id long, media binary")).collect()
    assert all(b.error and b.packet is None for b in bad)
    assert m.decode_column(m.encode_column(df.limit(0))).count() == 0
