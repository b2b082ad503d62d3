"""Token shards: the wavelet matrix against plain lists, and files against encoding whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendspark.llm import token_shards
from trendspark.llm.common import scratch_dir
from trendspark.llm.wavelet import BLOCK, WaveletMatrix

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (5, 1), (1000, 3), (BLOCK, 2), (BLOCK + 1, 300), (3 * BLOCK - 7, 70_000)])
def test_wavelet_matrix(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum((rng.pareto(0.7, n) * 3).astype(np.int64), kinds - 1).astype(np.uint32) * 7 + 1
    m = WaveletMatrix.load(WaveletMatrix.build(ids))
    assert m.n == n and (m.decode() == ids).all()
    for i in rng.integers(0, n, 20) if n else []:
        assert m.access(int(i)) == ids[i]
    for x in [*np.unique(ids)[:3].tolist(), *np.unique(ids)[-2:].tolist(), 0, 2**31]:
        at = np.flatnonzero(ids == x)
        assert m.rank(x) == len(at) and (m.select(x) == at).all()
        for i in (0, n // 2, n):
            assert m.rank(x, i) == int((at < i).sum())
        if len(at):
            assert m.select(x, np.array([len(at) - 1]))[0] == at[-1]
    for i in (-1, n):
        with pytest.raises(IndexError):
            m.access(i)


def test_skewed_planes_are_packed():
    ids = np.where(np.random.default_rng(1).random(500_000) < 0.99, 5, np.arange(500_000) % 4000).astype(np.uint32)
    assert len(WaveletMatrix.build(ids)) < 12 * len(ids) / 8 / 4  # 12 planes of plain bits, four times smaller


def test_pieces_are_as_whole_texts():
    """What is cut at spaces and remembered gives the ids of the whole text, in any mix of spaces, marks and letters."""
    whole, encode, rng = Tokenizer.from_file(BPE), token_shards.Encoder(BPE), random.Random(7)
    assert encode.by_pieces
    bits = [" ", " ", "  ", "\n", " \n", "\n\n", "\t", "\xa0", "　", "\x1c", "\x85", "​", "a", "Foo", "é", "é", "漢字", "don't", "'s", "’ll", "1", "23", "!", "...", "x.", "word,", "ª", "ⅷ", "😀", "İ", "ſ", "<|endoftext|>", "\r\n"]
    for _ in range(20_000):
        x = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert list(np.frombuffer(encode(x), "<u4")) == whole.encode(x, add_special_tokens=False).ids, repr(x)


def test_small_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(token_shards, "PIECES", 3)
    monkeypatch.setattr(token_shards, "WORDS", 2)
    whole, encode = Tokenizer.from_file(BPE), token_shards.Encoder(BPE)
    text = "one two, three four. five one two, six\nseven one " * 5
    assert list(np.frombuffer(encode(text), "<u4")) == whole.encode(text, add_special_tokens=False).ids
    assert len(encode.pieces) + len(encode.pieces.older) <= 3 and len(encode.words) + len(encode.words.older) <= 2


def brute(rows, path, end=0):
    """Documents in order of id (nulls first), their ids one after another."""
    t, out, start = Tokenizer.from_file(path), [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("path", [BPE, WORDS])
def test_documents_come_back(spark, path):
    """Nulls, empty and very long texts, repeated rows, negative ids, clashing names; shards of few ids, and whole documents in each."""
    texts = [None, "", " ", "\n", "one", "one two", "x" * 60_000, "a b " * 20_000, "ß É ñ 漢字 😀 " * 50, *[f"text {i} of many. " * (i % 7) for i in range(60)]]
    rows = [*[(i - 3, t) for i, t in enumerate(texts)], (5, "one two"), (7, "a b " * 20_000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"ids": F.lit("x"), "part": F.lit(1), "__id": F.lit(2), "__text": F.lit("y")}).repartition(5)
    folder = scratch_dir(spark)
    token_shards.write_tokens(docs, folder, path, shard_ids=3000)
    files = spark.read.parquet(folder)
    assert files.count() > 4 and files.select(F.input_file_name()).distinct().count() == files.count()
    got = sorted(token_shards.read_tokens(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    want = brute(rows, path)
    assert [r.doc_id for r in got] == [w[0] for w in want]
    # rows with the same id come in an order of their own
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, r.ids_crc32, list(r.token_ids)) for r in got if r.doc_id != 5) == sorted((d is None, d, n, c, ids) for d, _, n, c, ids in want if d != 5)
    assert [r.start for r in got] == np.r_[0, np.cumsum([r.n_tokens for r in got])[:-1]].tolist()
    flat = [(r.doc_id, p, x) for r in got for p, x in enumerate(r.token_ids)]
    wanted = [0, flat[3][2], flat[-2][2], 50_255]
    assert {(r.token, r.n) for r in token_shards.count_tokens(spark, folder, wanted).collect()} == {(x, sum(t == x for *_, t in flat)) for x in wanted}
    found = sorted(((r.token, r.doc_id, r.place) for r in token_shards.find_tokens(spark, folder, wanted).collect()), key=str)
    assert found == sorted(((x, d, p) for d, p, x in flat if x in wanted), key=str)


def test_no_documents(spark):
    folder = scratch_dir(spark)
    token_shards.write_tokens(spark.createDataFrame([], "doc_id bigint, text string"), folder, BPE)
    assert token_shards.read_tokens(spark, folder).collect() == []
    assert [tuple(r) for r in token_shards.count_tokens(spark, folder, [3]).collect()] == [(3, 0)]


def test_query_on_the_small_table(spark):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_shards.query(spark, "/root/testdata/sf0.001").collect())
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got == [w[:4] for w in brute(rows, BPE)]
