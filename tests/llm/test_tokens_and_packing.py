import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from genolith.llm import packing, rangecoder, tokenfiles, tokens
from genolith.llm.shared import shared_dir
from genolith.llm.tokens import Encoder, default_path


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(spark, plain, monkeypatch):
    encode = Encoder.of(default_path())
    r = random.Random(1)
    letters = "abAB 'sdtlmvre1²½éÉÀßµªœŒżŻ\t\n.,-!?$<|>=×÷…—漢字İſ́ \xa0\x1c\x85\xad"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["", "<|endoftext|> x", "it's <|startoftext|>", "x" * 5000]
    texts += [row.text for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(50).collect()]
    for t in texts[-300:]:
        assert np.frombuffer(encode(t), "<u4").tolist() == plain(t), repr(t)
    for size in (1 << 21, 300):  # one chunk, many chunks
        monkeypatch.setattr(tokens, "CHUNK", size)
        rows = [own for counts, ids in encode.texts(pa.array(texts)) for own in np.split(ids, np.cumsum(counts)[:-1])]
        assert len(rows) == len(texts)
        for t, own in zip(texts, rows, strict=True):
            assert own.tolist() == plain(t), repr(t)


def test_kept_pieces_are_bounded(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    monkeypatch.setattr(tokens, "CHUNK", 400)
    encode, r = Encoder(default_path()), random.Random(2)
    texts = [" ".join(r.choice(("the", "of", "a")) + r.choice("xyzé'") * r.randint(0, 40) for _ in range(30)) * 2 for _ in range(200)]
    rows = [own for counts, ids in encode.texts(pa.array([*texts, None, ""])) for own in np.split(ids, np.cumsum(counts)[:-1])]
    assert [x.tolist() for x in rows] == [*map(plain, texts), [], []] and 0 < len(encode.kept.keys) <= 50


def test_plan_is_whole_and_tight():
    for s in range(200):
        r = random.Random(s)
        lengths = Counter({r.randint(1, 2048 if s % 2 else 300): r.randint(1, 50) for _ in range(r.randint(1, 60))})
        got = Counter()
        patterns = packing.plan(lengths)
        for p, m in patterns:
            assert sum(p) <= 2048 and m > 0
            for n in p:
                got[n] += m
        assert got == lengths
    # complements of two, three and four
    assert sum(m for _, m in packing.plan({2000: 7, 48: 7})) == 7
    assert sum(m for _, m in packing.plan({2000: 5, 20: 5, 28: 5})) == 5
    assert sum(m for _, m in packing.plan({2000: 5, 10: 5, 17: 5, 21: 5})) == 5


def test_packed_rows(spark, odd, plain):
    long = spark.createDataFrame([(9, "word " * 5000)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(long)
    rows = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    nine = sorted((r for r in rows if r.doc_id == 9), key=lambda r: r.piece)
    assert [r.length for r in nine] == [2048, 2048, 905] and [r.start for r in nine] == [0, 2048, 4096]
    assert np.frombuffer(b"".join(r.ids for r in nine), "<u4").tolist() == [*plain("word " * 5000), 0]
    made = packing.sequences(packing.pack(packing.pieces(docs, with_ids=True))).collect()
    assert sum(len(r.ids) // 4 for r in made) == sum(r.length for r in rows)
    assert packing.pack(packing.pieces(odd.limit(0))).count() == 0


def test_pack_keeps_columns_named_like_its_own(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_CELL", 3)
    names = ("own", "cell", "rank", "shift", "tie", "cells", "row", "n", "__length", "offset")
    cut = spark.createDataFrame([(i % 4, 0, 700 + i % 2, 5, *(f"{c}{i}" for c in names)) for i in range(40)], f"doc_id long, piece int, length long, ids_crc32 long, {', '.join(f'`{c}` string' for c in names)}")
    rows = packing.pack(cut).collect()
    assert {tuple(r[c] for c in names[:-1]) for r in rows} == {tuple(f"{c}{i}" for c in names[:-1]) for i in range(40)}
    places = Counter(r.sequence_id for r in rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == 40 and len(places) == 20 and sum(r.length for r in rows) == 28020


def test_range_coder_round_trip(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(rangecoder, "BLOCK", b := 1500)
    for n in (0, 1, 2, 513, b, b + 1, 2 * b + 7):
        for ids in (rng.integers(0, 49408, n), np.zeros(n, int), rng.integers(0, 3, n), np.arange(n) % 50, rng.integers(0, 20, n) + 65530, rng.integers(0, 1 << 32, n), np.full(n, (1 << 32) - 1), rng.zipf(1.3, n) % rangecoder.PLAIN):
            x = ids.astype(np.uint32)
            raw = rangecoder.write_segment([1, None, -5], np.array([n, 0, 0]), x)
            docs, lengths, back = rangecoder.read_segment(raw)
            assert docs == [1, None, -5] and lengths.tolist() == [n, 0, 0] and back.tolist() == x.tolist()
    with pytest.raises(ValueError, match="ids must be"):
        rangecoder.write_segment([1], np.array([1]), np.array([1 << 32]))


def test_blocks_stand_alone(monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK", b := 3000)
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 40, b), rng.integers(0, 1 << 32, b), rng.zipf(1.5, 700) % 5000]).astype(np.uint32)
    found = rangecoder.Segment(rangecoder.write_segment([1], np.array([len(ids)]), ids))
    assert found.blocks == 3
    for k in (2, 0, 1):
        assert found.block(k).tolist() == ids[k * b : (k + 1) * b].tolist()
        assert rangecoder.decode_block(rangecoder.encode_block(ids[k * b : (k + 1) * b])).tolist() == ids[k * b : (k + 1) * b].tolist()


def test_range_coder_learns_and_checks():
    ids = np.tile(np.arange(40), 3000).astype(np.uint32)
    raw = rangecoder.write_segment([1], np.array([len(ids)]), ids)
    assert len(raw) * 8 < len(ids)
    skewed = np.random.default_rng(3).zipf(1.2, 200_000) % 30_000  # order 0 alone
    counts = np.bincount(skewed)
    share = counts[counts > 0] / len(skewed)
    assert len(rangecoder.write_segment([1], np.array([1]), skewed.astype(np.uint32))) * 8 < len(skewed) * (1.15 * -(share * np.log2(share)).sum() + 1)
    for at in (12, len(raw) - 3):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            rangecoder.read_segment(bytes(bad))


def test_token_files(spark, odd, plain):
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(-3, "minus three words"), (77, "z " * 900)], "doc_id long, text string"))
    to = f"{shared_dir(spark)}/tokens-test"
    tokenfiles.write(docs, to, segment=5)
    rows = sorted(tokenfiles.read(spark, to, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows if r.doc_id is not None] == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None) and rows[0].doc_id is None
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32
        at += r.n_tokens
    want = Counter((d.doc_id, (*plain(d.text), 2)) for d in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    hot = spark.range(0, 4000, 1, 8).selectExpr("7L AS doc_id", "concat('t', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tokenfiles.write(hot, f"{shared_dir(spark)}/tokens-hot")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{shared_dir(spark)}/tokens-hot").select("part").distinct().count() >= 3
    assert Counter(tuple(np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfiles.read(spark, f"{shared_dir(spark)}/tokens-hot", True).collect()) == Counter((*plain(f"t{i}"), 2) for i in range(4000))
    empty = f"{shared_dir(spark)}/tokens-none"
    tokenfiles.write(odd.limit(0), empty)
    assert tokenfiles.read(spark, empty).count() == 0
