import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helpers import DATA
from shelfmark.llm import blockcoder, bpe, token_store
from shelfmark.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


@pytest.fixture(scope="module")
def small():
    return bpe.Codec(bpe.default_tokenizer(), leaf=8)


@pytest.fixture(scope="module")
def usual():
    return bpe.Codec(bpe.default_tokenizer())


def ids_of(held: bytes) -> list[int]:
    return np.frombuffer(held, "<u4").tolist()


PARTS = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "'ll", "1", ".", " .", "<|endoftext|>", "x" * 30, "　", "\x85", "日本", "\r\n", "\x1c", "\xa0", "😀", "²", "́", "mentation", "Straße", "naïve,", "×", "÷", "ÀȿɎ", "!!!", "don't", "_x", "ʼn", "ƻ", "ǅ", "“", "<|", "|>", "&amp;", " – "]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=4))
def test_encoding_is_the_library_s(library, small, usual, texts):
    for text, held, again in zip(texts, small.encode(texts), usual.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(held) == ids_of(again) == want and small.decode(held).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_encode_whole_texts(name):
    """A file whose pre-tokeniser differs is not cut at blanks."""
    path = os.path.join(os.path.dirname(bpe.default_tokenizer()), name)
    texts = ["the  mentation, of 12 words\n and – more", "", "ééé don't"]
    own, theirs = bpe.Codec(path), Tokenizer.from_file(path)
    assert [ids_of(held) for held in own.encode(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_that_do_not_exist_and_null_ids(spark, small):
    assert small.decode(np.array([262, 60_000, 262], "<u4").tobytes()) == small.decode(np.array([262, 262], "<u4").tobytes())
    rows = spark.createDataFrame([(1, None), (2, bytearray(np.array([262], "<u4").tobytes()))], "doc_id long, ids binary")
    assert [r["text"] for r in bpe.decode(rows).orderBy("doc_id").collect()] == ["", " the"]


def test_long_unsplit_text(library, small):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz"[:n]) for _ in range(3000)) for n in (2, 5, 26)] + ["a" * 2999, "the" * 700, " " * 1500, "0" * 2000, "é" * 900]
    for text, held in zip(texts, small.encode(texts)):
        assert ids_of(held) == library.encode(text, add_special_tokens=False).ids


def test_broken_ids_decode_like_the_library(library, small):
    rnd = random.Random(2)
    for _ in range(50):
        ids = [rnd.randrange(50257) for _ in range(12)]
        assert small.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, texts, library):
    rows = {r["doc_id"]: r for r in QUERIES["op2_bpe"](spark, DATA).collect()}
    for i, t in texts.items():
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and rows[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_edges(edge, empty, library):
    rows = bpe.encode(edge)
    for r in rows.collect():
        if r["doc_id"] in (1, 2):
            assert r["n_tokens"] == 0 and r["decoded"] == ""
    assert rows.count() == 11 and bpe.encode(empty).collect() == []
    back = {r["doc_id"]: r["text"] for r in bpe.decode(rows.select("doc_id", "ids")).collect()}
    assert back[5].startswith("lorem ipsum") and back[7] == "a\n\nb"


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, m, int(n)) for m in (2, 300, 50_257, 65_536) for n in rng.integers(0, 500, 8)] + [np.zeros(700, int), np.tile([1, 2, 3, 50_000], 150), np.full(300, 65_535)]
    coded = blockcoder.encode_blocks(blocks)
    for want, got in zip(blocks, blockcoder.decode_blocks([(len(b), c) for b, c in zip(blocks, coded)])):
        assert (want == got).all()
    again = blockcoder.decode_blocks([(len(b), c) for b, c in zip(blocks, blockcoder.encode_blocks(blocks, 17))], 17)
    assert all((want == got).all() for want, got in zip(blocks, again))
    assert len(coded[-1]) < 60 and len(coded[-2]) < 200  # what repeats costs little
    assert blockcoder.encode_blocks([]) == []


@pytest.mark.parametrize("high", [3, 6000, 1 << 20])
def test_long_blocks_round_trip(high):
    """Blocks as long as in files: counts are taken many times, and rare ids go by the escape."""
    rng = np.random.default_rng(high)
    blocks = [np.minimum(rng.integers(0, high, n), rng.integers(0, high, n)).astype(np.uint32) for n in (8192, 8000, 6145, 6144, 33, 32, 1)]
    for want, got in zip(blocks, blockcoder.decode_blocks([(len(b), c) for b, c in zip(blocks, blockcoder.encode_blocks(blocks))])):
        assert (want == got).all()


def test_store_query(spark, texts, library, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 500)
    rows = sorted(QUERIES["op8_token_store"](spark, DATA).collect())
    at = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_store_edges(spark, edge, empty, tmp_path, library):
    folder = f"file://{tmp_path}/tokens"
    shards = token_store.write_tokens(edge, folder, shard_bytes=40_000)
    assert len(shards) > 1 and sum(s[1] for s in shards) == 11
    rows = sorted(token_store.read_tokens(spark, folder, shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 4, 5, 6, 7, 8, 9, None]
    assert [r["n_tokens"] for r in rows[:2]] == [1, 1] and ids_of(rows[0]["ids"]) == [2]
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])
    assert [r["start"] for r in rows] == starts[:-1].tolist()
    none = token_store.write_tokens(empty, folder + "-none")
    assert none == [] and token_store.read_tokens(spark, folder, none).collect() == []


def test_damage_is_seen():
    writer = token_store.ShardWriter(16)
    for i in range(5):
        writer.add(i, np.arange(40 * i, dtype=np.uint32))
    held = writer.finish()
    assert [(i, len(x)) for i, x in token_store.read_shard(held)] == [(i, 40 * i) for i in range(5)]
    for at in (3, 30, len(held) // 2, len(held) - 8):
        broken = bytearray(held)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(token_store.read_shard(bytes(broken)))
    # a block whose ids don't fit its own checksum, under a sound outer one
    broken = bytearray(held[:-4])
    broken[32] ^= 1
    with pytest.raises(ValueError, match="block"):
        list(token_store.read_shard(bytes(broken) + struct.pack("<I", zlib.crc32(bytes(broken)))))
