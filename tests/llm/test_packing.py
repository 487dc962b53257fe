import random
import zlib

import numpy as np
import pytest

from loomspark.llm.packing import STEP_TOKENS, Encoder, pack_group, pack_with_public_ranks


def check_group(tokens, context=1024):
    seen = {}
    for tier, pieces in pack_group(tokens, context):
        assert tier == sum(n for _, _, n in pieces) <= context
        assert tier & tier - 1 == 0  # a power of two: no padding
        for doc, start, n in pieces:
            assert n > 0
            seen.setdefault(doc, []).append((start, n))
    for doc, ids in enumerate(tokens):
        at = 0
        for start, n in sorted(seen.pop(doc, [])):
            assert start == at
            at += n
        assert at == len(ids) // 4
    assert not seen


@pytest.mark.parametrize("seed", range(30))
def test_each_token_once_and_no_padding(seed):
    r = random.Random(seed)
    check_group([b"\0\0\0\0" * r.choice([1, 2, 3, r.randint(1, 3000), r.randint(500, 1030), 1024, 2048]) for _ in range(r.randint(0, 60))])


def test_split_at_spaces_is_exact():
    import public_tokenizers as P

    e = Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in ["", " ", "a  b", " lead", "tail ", "x\n y", "it's 12 3!? été  \n\n z", "a b 　c d", "one two two", "<|endoftext|> a <|endoftext|>"]:
        assert e.encode(t) == e.whole(t) and e.encode(t) == e.encode(t)


def test_against_the_other_library(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {1: None, 2: "", 3: "the the of", 4: "word " * 3000, 5: "é\n\n  x  y", 6: "the the of", 7: "x <|endoftext|> y", 8: "<|endoftext|><|endoftext|>  a\n <|endoftext|", 9: " <|endoftext|>"}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, length string")
    rows = pack_with_public_ranks(df).collect()
    fills = {}
    for k, v in texts.items():
        ids = (t.encode(v, add_special_tokens=False).ids if v else []) + [0]
        at = 0
        for r in sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start):
            part = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += r.length
            fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids)
    for own in fills.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    steps = {}
    for r in {r.sequence_id: r for r in rows}.values():
        steps.setdefault(r.tier, []).append(r.step_group)
    for tier, own in steps.items():
        sizes = [own.count(g) for g in set(own)]
        assert max(sizes) * tier <= STEP_TOKENS and max(sizes) - min(sizes) <= 4  # over up to four partitions
    assert pack_with_public_ranks(df.limit(0)).count() == 0


def test_ids_of_a_whole_table():
    import json

    import public_tokenizers as P
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = {x["content"]: x["id"] for x in json.load(open(P.path("byte_bpe_50k.json")))["added_tokens"]}
    e = Encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, special)
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    for text, got in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert np.array(got.ids, "<u4").tobytes() == e.encode(text)
