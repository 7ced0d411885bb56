import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import packing, tokenfile
from graphloom.llm.tokens import encoder

DOCS = [
    (3, "To thing, and the.\nOf it; a  double"),
    (1, None),
    (2, ""),
    (2, "same id again"),
    (7, "word " * 3000),
    (7, "word " * 3000),
    (5, "Straße ünd  日本語 テキスト <|endoftext|> x"),
    (None, "no id"),
    (-4, "negative"),
]


def plain(text):
    return encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'abcEÀé日1\x1c\x85᠎$!", max_size=40), max_size=6))
def test_words_equal_whole_texts(texts):
    got = encoder().encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    seq, end = tokenfile.EliasFano.from_bytes(raw := tokenfile.EliasFano.of(np.array(values, np.uint64)).to_bytes())
    assert end == len(raw) and seq.all().tolist() == values
    assert [seq[i] for i in range(len(values))] == values


def test_token_file_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in DOCS], "doc_id long, text string, n_tokens string")
    shards = tokenfile.write_tokens(docs)
    rows = tokenfile.read_tokens(shards, with_ids=True).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in DOCS), key=lambda i: (i is not None, i or 0))
    at, want = 0, sorted((i is not None, i or 0, zlib.crc32(np.array(plain(t) + [2], "<u4").tobytes())) for i, t in DOCS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in rows) == want
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    shard = tokenfile.TokenShard(max(shards.collect(), key=lambda r: r.n_docs).path)
    whole = shard.ids(0, shard.n_ids)
    assert np.concatenate([shard.document(i) for i in range(shard.n)]).tolist() == whole.tolist()


def test_token_file_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.read_tokens(tokenfile.write_tokens(none)).count() == 0
    assert packing.pack(packing.cut(none)).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_pack_documents(spark):
    docs = spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, length int")
    rows = packing.pack(packing.cut(docs, with_ids=True)).collect()
    assert check_packing(rows, 1024) >= sum(r.length for r in rows) / 1024
    want = {}
    for i, t in DOCS:
        ids = plain(t) + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            key = (i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("group", [64, 100_000])
def test_pack_is_near_the_bound(spark, group):
    sizes = spark.range(3000).select((F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"), "id")
    rows = packing.pack(sizes, 1024, group=group).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    bound = -(-sum(r.length for r in rows) // 1024)
    assert check_packing(rows, 1024) <= bound * 1.01 + 1


def test_crossover_keeps_every_piece():
    sizes = np.random.default_rng(1).integers(1, 500, 400)
    p = packing.Packer(sizes, 1024, 5)
    child = p.mutate(p.cross(p.decreasing(0.3), p.decreasing(0.5)))
    assert sorted(i for b in child[0] for i in b) == list(range(400))
    assert all(sum(sizes[b]) + r == 1024 and r >= 0 for b, r in zip(*child))
