"""Ids and decoded texts against the tokenizers library on whole texts."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelspark.llm import chunkbpe as cb
from pixelspark.llm import queries as q

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
SHARED, SMALL = cb.ChunkEncoder(PATH), cb.ChunkEncoder(PATH)
SMALL.TOGETHER = 8
PIECES = ["the", "Words", "ÉTÉ", "é", "ΣΑΣ", "İ", "K", " ", "  ", "\n", "\t", "\xa0", "　", "<|endoftext|>", "<|startoftext|>", "<|END", "'s", "'LL", "don't", "...", "12345", "日本語", "😀", "́", "\x00", "-", "a.b,c", "</w>", "|", "_x_"]


def whole(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    return [(d, len(ids := whole(t)), sha(" ".join(map(str, ids))), sha(LIB.decode(ids, skip_special_tokens=False))) for d, t in rows]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), min_size=1, max_size=5), st.integers(0, 2))
def test_joins_are_repaired(texts, bits):
    encoder = SHARED
    encoder.known.clear()
    old, cb.BITS = cb.BITS, bits  # a cut behind nearly every byte, in words and inside characters
    try:
        assert [x.tolist() for x in encoder.encode([*texts, None, ""])] == [*(whole(t) for t in texts), [], []]
    finally:
        cb.BITS = old


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert next(SMALL.encode([text])).tolist() == whole(text)


def test_chunks_follow_the_content():
    rng = np.random.default_rng(1)
    passage = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 9)))) for _ in range(800))
    a, b = ("some words before it " + passage).encode(), ("other, and longer, words stand before this one " + passage + " end").encode()
    ends = [{e - at for e in cb.chunk_ends(np.frombuffer(t, np.uint8)).tolist() if e - (at := t.index(passage[:50].encode())) > cb.WINDOW} for t in (a, b)]
    assert len(ends[0]) > 8 and ends[0] == {e for e in ends[1] if e <= len(passage)}
    encoder, seen = cb.ChunkEncoder(PATH), []
    inner = encoder._insides
    encoder._insides = lambda stretches: (seen.extend(stretches), inner(stretches))
    next(encoder.encode([a.decode()]))
    first = sum(map(len, seen))
    assert next(encoder.encode([b.decode()])).tolist() == whole(b.decode())
    assert sum(map(len, seen)) - first < first / 3  # the shared chunks are not encoded again


def test_a_join_that_does_not_agree_sends_the_text_whole():
    encoder = cb.ChunkEncoder(PATH)
    encoder.probe = [1, 2, 3]
    text = " ".join(f"words{k * k} of{k}" for k in range(400))
    assert next(encoder.encode([text])).tolist() == whole(text) and any(x is None for x in encoder.known.values())


def test_other_tokenizers_get_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    encoder = cb.ChunkEncoder(path)
    assert not encoder.cuts and next(encoder.encode(["two  spaces\n\nand"])).tolist() == lib.encode("two  spaces\n\nand").ids
    import pyarrow as pa

    assert cb.Decoder(path)(pa.array([[464, 3797], []], pa.list_(pa.int32()))).to_pylist() == ["The cat", ""]


def test_rows(spark):
    rows = [(1, "Some Text, here."), (None, "null id"), (2, None), (3, ""), (1, "Some Text, here."), (4, "word " * 300_000), (5, "x" * 20_000 + " " + "é" * 3_000), (6, " \n ")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, ids int, decoded string")
    got = cb.digests(cb.decode_ids(cb.encode_chunks(df, PATH), PATH)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows), key=repr)
    assert sorted(map(tuple, cb.digests(cb.encode_chunks(df, PATH, decode=True)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert cb.encode_chunks(df.limit(0), PATH).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [320, 49407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in cb.decode_ids(lists, PATH).collect()} == {1: None, 2: "", 3: LIB.decode([320, 49407], skip_special_tokens=False)}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = q.QUERIES["op13_chunk_bpe"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(expected(rows))
