import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from weft.llm import packing
from weft.llm.common import scratch
from weft.llm.tokens import Encoder, default_vocabulary, read_tokens, write_tokens


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PARTS = ["the", " ", "  ", "   ", "\n", "\n\n", "\t", " \n", "it's", "Ünïcode", "<|endoftext|>", ",", ".", "..", "!?", "a,b", " x.", "12", " 3,4", " ", " ", "日本", "😀", "'s", " 'll", "\x00", "word,", "End.", "\r\n", "\u2003", "\u00a0", "\u3000", "\x85", "é", "è.", "÷", "×a", "\x1c", "\u200b", "\u0301", "’", "„wort“", "$$$", "x***"]


def test_encoder_equals_library(plain):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    enc = Encoder(default_vocabulary(), bits=8, most=4000)  # so small that pieces often lose their place and the table is emptied
    for at in range(0, 4000, 50):
        some = texts[at : at + 50]
        ids, places = enc.encode(pa.array(some), None if at % 100 else 7)
        for t, a, b in zip(some, places[:-1], places[1:], strict=True):
            assert ids[a:b].tolist() == plain(t) + ([] if at % 100 else [7]), repr(t)
    assert [x.tolist() for x in enc.encode(pa.array([], pa.string()), 7)] == [[], [0]]


def test_encoder_equals_library_on_documents(plain):
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    ids, places = Encoder(default_vocabulary()).encode(pa.array([texts[0], *texts]).slice(1), 0)
    assert all(ids[a:b].tolist() == [*plain(t), 0] for t, a, b in zip(texts, places[:-1], places[1:], strict=True))


def test_vocabulary_with_another_splitter(tmp_path):
    """Its texts are encoded whole."""
    shape = json.loads(Tokenizer.from_file(default_vocabulary()).to_str())
    shape["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(shape))
    texts, other = ["one two.", "", " three\nfour", "one two."], Tokenizer.from_file(str(tmp_path / "v.json"))
    ids, places = Encoder(str(tmp_path / "v.json")).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, odd, none, plain):
    folder = scratch(spark, "t")
    write_tokens(odd, folder, vocabulary=default_vocabulary(), shards=3)
    rows = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for i, t in rows:
        ids = [*plain(t), 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, read_tokens(spark, folder).collect()), key=lambda r: r[1]) == want
    write_tokens(none, folder := scratch(spark, "t"), vocabulary=default_vocabulary())
    assert read_tokens(spark, folder).count() == 0


def test_best_fit():
    r = random.Random(1)
    for _ in range(200):
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 80))]
        bins = packing.best_fit(lengths, 64)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        fills = [sum(lengths[i] for i in b) for b in bins]
        assert all(f <= 64 for f in fills) and sum(f <= 32 for f in fills) <= 1


@pytest.mark.parametrize("carry", [0, 1024])
def test_pack(spark, odd, none, plain, carry):
    docs = odd.unionByName(spark.range(100, 400).selectExpr("id as doc_id", "repeat('ab cd ', int(id * 7919 % 97)) as text", "'l' as lang", "'' as _text", "id as _id")).repartition(11)
    got = packing.pack(docs, vocabulary=default_vocabulary(), capacity=256, fan_in=3, carry=carry, node_rows=40).collect()
    want = []
    for r in docs.collect():
        ids = np.array([*plain(r.text), 0], "<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(g)[:5] for g in got), key=str) == sorted(want, key=str)
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 256
    if carry:
        assert len(by) <= 1.02 * sum(g.length for g in got) / 256 + 1
    assert packing.pack(none, vocabulary=default_vocabulary()).count() == 0


def test_pack_of_sorted_lengths(spark):
    """Input partitions that hold one length only: 800 or 1200 tokens."""
    docs = spark.range(6000).selectExpr("id as doc_id", "repeat(' the', if(id < 3000, 799, 1199)) as text").repartitionByRange(6, "doc_id")
    got = packing.pack(docs, vocabulary=default_vocabulary(), node_rows=2000).collect()
    lengths = [g.length for g in got]
    assert sorted(lengths) == [800] * 3000 + [1200] * 3000
    assert len({g.sequence_id for g in got}) <= 1.02 * len(packing.best_fit(lengths, 2048))
