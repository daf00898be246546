"""Ids against the tokenizers library on whole texts; exact round trips; damaged files."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pixelspark.llm import tokenfiles as tf
from pixelspark.llm.common import new_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE, CUTS = Tokenizer.from_file(PATH), tf.Encoder(PATH, None)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab.'s1é|<> \n\t\r\xa0 \x85\x1c", max_size=30))
def test_cut_texts_give_the_ids_of_whole_texts(text):
    got = np.frombuffer(next(CUTS.encode([text])), "<u2").tolist()
    assert got == WHOLE.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "<", "endoftext", "a", "Word", ".", "'s", " ", "  ", "\n", "[x]", "<b>", "</s>", "\u2581"]), max_size=12).map("".join))
def test_added_tokens_inside_texts_keep_their_ids(text):
    got = [np.frombuffer(x, "<u2").tolist() for x in CUTS.encode([text, "plain text", text + " end"])]
    assert got == [WHOLE.encode(t, add_special_tokens=False).ids for t in (text, "plain text", text + " end")]


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="aÀöɏ×÷.'!#s \n\x01", max_size=30))
def test_marks_behind_letters_and_latin_words_give_the_ids_of_whole_texts(text):
    got = np.frombuffer(next(CUTS.encode([text])), "<u2").tolist()
    assert got == WHOLE.encode(text, add_special_tokens=False).ids


def test_the_latest_words_stay_remembered_and_no_more_than_the_limit():
    encoder = tf.Encoder(PATH, None)
    encoder.LIMIT = 100
    for k in range(4):
        text = "common words, common words! " + " ".join("".join(chr(97 + int(c)) for c in str(i)) for i in range(1000 * k, 1000 * k + 90))
        assert np.frombuffer(next(encoder.encode([text])), "<u2").tolist() == WHOLE.encode(text, add_special_tokens=False).ids
        assert {" common", " words", "!"} <= set(encoder.known) and " words!" not in encoder.known and len(encoder.known) <= 100


def test_round_trip(spark):
    rows = [(5, "x  y\n z"), (3, None), (None, "null id"), (4, ""), (3, "twin"), (9, "word " * 30_000), (3, "twin")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    out = new_dir(spark, "t")
    got = tf.read_token_files(tf.write_token_files(df, out, PATH, 2, docs_per_file=2, max_file_mb=1), out).collect()
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tf.encode_round_trip(df.limit(0), PATH).count() == 0


def test_reader_reads_single_documents_and_finds_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(50)], "doc_id long, text string")
    out = str(tmp_path / "f")
    path = tf.write_token_files(df, out, PATH, 2, docs_per_file=1000).first().path
    whole = open(path, "rb").read()
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(whole), read_across_frames=True).read()
    with open(path, "rb") as f:
        reader = tf.Reader(f)
        (one,) = reader.of(17)
        assert one[:-1].tolist() == WHOLE.encode("text number 17", add_special_tokens=False).ids and one[-1] == 2 and reader.of(99) == []
        assert b"".join(reader.ids(k).tobytes() for k in range(50)) == stream
        at = int(reader.starts[17])
    bad = bytearray(whole)
    bad[at + 8] ^= 1
    with pytest.raises(ValueError):
        tf.Reader(bytes(bad)).ids(17)
    tf.Reader(bytes(bad)).ids(16)
    for broken in (whole[:-1], whole[:5], b"", whole + b"x"):
        with pytest.raises(ValueError):
            tf.Reader(broken)
