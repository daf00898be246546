"""Groups and links against the two libraries on whole texts, with overlaps by plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from pixelspark.llm import alignment as al
from pixelspark.llm import queries as q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIRST, SECOND = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
FIRST.encode_special_tokens = True
LEVEL = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
LEVEL |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(LEVEL.values()))}


def plain(text):
    """Ids, groups and links of a whole text, by its definition."""
    if not text:
        return [], [], [], []
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    bytes_a = [bytes(LEVEL[c] for c in FIRST.id_to_token(i)) for i in a]
    bytes_b = [bytes([int(SECOND.id_to_piece(i)[3:5], 16)]) if SECOND.is_byte(i) else SECOND.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
        return [], [], [], []
    ranges = []
    for parts in (bytes_a, bytes_b):
        at, own = 0, []
        for x in parts:
            own.append((at, at + len(x)))
            at += len(x)
        ranges.append(own)
    links = [(a[i], b[j]) for i, x in enumerate(ranges[0]) for j, y in enumerate(ranges[1]) if x[0] < y[1] and y[0] < x[1]]
    ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
    groups = ["|".join(",".join(str(i) for i, (s, e) in zip(ids, r, strict=True) if lo <= s and e <= hi) for ids, r in ((a, ranges[0]), (b, ranges[1]))) for lo, hi in zip([0, *ends], ends, strict=False)]
    return a, b, groups, links


def expected(rows):
    """What the operator returns for rows of (doc_id, text)."""
    own = [(d, *plain(t)) for d, t in rows]
    docs = Counter(p for *_, links in own for p in set(links))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    return [(d, len(a), len(b), len(g), len(ls), sum(docs[p] == most[p[0]] for p in ls), sum(docs[p] for p in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, ls in own]


def order(rows):
    return sorted(map(tuple, rows), key=repr)


PIECES = ["the", "Words", " ", "  ", "\n", "\n\n", "\t", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "▁", "é", "é", "日本語", "😀", "'s", "...", "12345", " ", "\x00", "unbelievably", "-", "ﬁ", "İ", "\x85"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=1, max_size=6))
def test_cuts_give_the_groups_of_whole_texts(texts):
    import pyarrow as pa

    lexicon = al._Lexicon(*al._tokenizers(A, B))
    for t in texts:
        if not t:
            continue
        uneven, pieces = al.cut(pa.array([" " + t], pa.large_string()))
        own = pa.array([al.cut_uneven(" " + t)], pa.list_(pa.large_string())) if uneven[0].as_py() else pieces
        counts, groups, links = lexicon.documents(own)
        a, b, g, ls = plain(t)
        assert counts[0].tolist() == [len(a), len(b), len(g), len(ls)] and groups[0].as_py() == ";".join(g), t
        codes = list(lexicon.number)
        assert sorted(codes[n] for n in al.unpack(links[0]).tolist()) == sorted(x << 32 | y for x, y in ls)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=40), st.lists(st.integers(1, 5), min_size=1, max_size=40))
def test_pointers_end_at_the_last_token_of_their_component(x, y):
    n = max(sum(x), sum(y))
    ends_a, ends_b = (np.array([*(e for e in np.cumsum(z).tolist() if e < n), n]) for z in (x, y))
    label_a, label_b = al.terminals(ends_a, ends_b)
    common = np.intersect1d(ends_a, ends_b)
    assert ends_a[label_a].tolist() == common[np.searchsorted(common, ends_a)].tolist()
    assert ends_a[label_b].tolist() == common[np.searchsorted(common, ends_b)].tolist()


def test_counts_over_the_corpus(spark, monkeypatch):
    rows = [(1, "the cat sat unbelievably"), (2, None), (3, ""), (None, "the cat"), (4, "the cat"), (4, "the cat"), (5, "▁ the"), (6, "  two  spaces\n\nand lines\nhere "), (7, "日本語 😀 <s> <|endoftext|> <0x41>"), (8, " "), (9, "word " * 4000 + "x" * 500), (10, "a\x01b c")]
    df = spark.createDataFrame([(d, t, 0, 1) for d, t in rows], "doc_id long, text string, n_a int, chunk int")
    assert order(al.align_tokenizers(df.repartition(3), A, B).collect()) == order(expected(rows))
    monkeypatch.setattr(al._Lexicon, "LINKS", 5)  # a chunk a slice
    assert order(al.align_tokenizers(df.coalesce(1), A, B).collect()) == order(expected(rows))
    assert al.align_tokenizers(df.limit(0), A, B).collect() == []
    groups = {r.doc_id: r.groups for r in al.token_groups(df.where("doc_id in (1, 2)"), A, B).collect()}
    assert groups == {1: ";".join(plain(rows[0][1])[2]), 2: ""}


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 4000]
    got = al.align_tokenizers(spark.createDataFrame(short, "doc_id long, text string"), A, B)
    assert order(got.collect()) == order(expected(short))
    whole = q.QUERIES["op11_token_alignment"](spark, sf_dir)
    assert whole.count() == len(rows) and whole.where("n_links != n_a + n_b - n_groups").isEmpty()
