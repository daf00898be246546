"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers' tokens cut the bytes of a text into consecutive ranges. Tokens whose ranges overlap belong together, and the connected components are
the shortest stretches that both can start and end. Every token points to the farthest-right token that it overlaps (a token of the first tokenizer where
both end together); doubling these pointers until none moves leads each token to the last one of its component, which labels the group.

A text is cut at single spaces, and around line ends, where neither tokenizer joins pieces; so tokens of different cuts never overlap, and every distinct
cut of a task is encoded and aligned once. The corpus-wide counts of id pairs are summed by Spark: a task counts each pair once, and later asks for
each of its distinct pairs once, however often its documents hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .tokenfiles import Encoder, cut, cut_uneven

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
_CODED = f"{_DOC}, chunk long, links binary, pairs array<long>, docs array<long>"


def _byte_level() -> dict[str, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _ByteTokens:
    """Tokens of a byte-level tokenizer, special tokens' strings being ordinary text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, None, special_as_text=True)
        if not self.encoder.cuts:
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        alphabet, tok = _byte_level(), self.encoder.tokenizer
        size = tok.get_vocab_size()
        names = [tok.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(alphabet[c] for c in x) if all(c in alphabet for c in x) else x.encode() for x in names]

    def __call__(self, cuts: list[str]) -> list[list[int]]:
        self.encoder.known.clear()
        return [np.frombuffer(x, self.encoder.dtype).tolist() for x in self.encoder._ids(cuts)]


class _PieceTokens:
    """Tokens of a sentencepiece model that puts a space before the text and falls back to bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) or len(self.model.encode("\n")) != 2:
            raise ValueError(f"{path} has pieces across a space or a line end")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def __call__(self, cuts: list[str]) -> list[list[int]]:
        # The model itself adds the space that most cuts start with. The others stand behind a line end, which with the added space makes two tokens.
        spaced = [c.startswith(" ") and len(c) > 1 for c in cuts]
        ids = self.model.encode([c[1:] if s else "\n" + c for c, s in zip(cuts, spaced, strict=True)], num_threads=1)
        return [x if s else x[2:] for x, s in zip(ids, spaced, strict=True)]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For two sorted lists of token ends over the same bytes, which both end at the last: the number, among the first list's tokens, of each token's terminal one."""
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)  # the last token that overlaps, of the other list
    to = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])  # where both end together the first list's is the end
    while True:
        further = to[to]
        if (further == to).all():
            return to[:n], to[n:]
        to = further


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of overlapping tokens, as positions in the two lists."""
    starts_a = np.concatenate([[0], ends_a[:-1]])
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a)
    n = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    return a, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[a]


def _joined(values: pa.Array, counts: np.ndarray, by: str) -> pa.Array:
    """Strings of consecutive runs of ``values``, of the given lengths, joined."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, values.cast(pa.large_string())), pa.scalar(by, pa.large_string()))


class _Lexicon:
    """The distinct cuts of a chunk of documents, each encoded and aligned, and the chunk's distinct id pairs."""

    #: Cuts and links of documents after which a task starts a new chunk.
    CUTS, LINKS = 500_000, 40_000_000

    def __init__(self, a: _ByteTokens, b: _PieceTokens):
        self.a, self.b = a, b
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes]) for t in (a, b))
        self.row: dict[str, int] = {}
        self.number: dict[int, int] = {}  # of a pair: first id * 2^32 + second id
        self.counts = np.zeros((0, 4), np.int64)  # first and second tokenizer's tokens, groups, links
        self.sound = np.zeros(0, bool)
        self.pairs, self.starts, self.groups = np.zeros(0, np.int64), np.zeros(1, np.int64), pa.array([], pa.large_string())
        self.docs, self.links = np.zeros(0, np.int64), 0

    @property
    def full(self) -> bool:
        return len(self.row) > self.CUTS or self.links > self.LINKS

    def rows(self, cuts: list[str]) -> np.ndarray:
        """Row numbers of the given distinct cuts, learning those that are new."""
        new = [c for c in cuts if c not in self.row]
        for lo in range(0, len(new), 50_000):
            self._learn(new[lo : lo + 50_000])
        return np.fromiter(map(self.row.__getitem__, cuts), np.int64, len(cuts))

    def _learn(self, new: list[str]) -> None:
        ids = [(x, y) if b"".join(map(self.a.bytes.__getitem__, x)) == (raw := c.encode()) == b"".join(map(self.b.bytes.__getitem__, y)) else None for c, x, y in zip(new, self.a(new), self.b(new), strict=True)]
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new)), strict=True))
        sound = np.array([p is not None for p in ids])
        n_a, n_b = (np.array([len(p[k]) if p else 0 for p in ids], np.int64) for k in (0, 1))
        flat_a, flat_b = (np.fromiter((i for p in ids if p for i in p[k]), np.int64) for k in (0, 1))
        counts = np.stack([n_a, n_b, np.zeros_like(n_a), np.zeros_like(n_a)], 1)
        groups = pa.array([""] * len(new), pa.large_string())
        pairs = np.zeros(0, np.int64)
        if len(flat_a):
            ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
            of_a, of_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
            label_a, label_b = terminals(ends_a, ends_b)
            last, size = np.unique(label_a, return_counts=True)
            parts = [_joined(pa.array(flat), s, ",") for flat, s in ((flat_a, size), (flat_b, np.unique(label_b, return_counts=True)[1]))]
            counts[:, 2] = np.bincount(of_a[last], minlength=len(new))
            groups = _joined(pc.binary_join_element_wise(*parts, pa.scalar("|", pa.large_string())), counts[:, 2], ";")
            a, b = links_of(ends_a, ends_b)
            counts[:, 3] = np.bincount(of_a[a], minlength=len(new))
            distinct, back = np.unique(flat_a[a] << 32 | flat_b[b], return_inverse=True)
            number = np.array([self.number.setdefault(x, len(self.number)) for x in distinct.tolist()], np.int64)
            pairs = number[back]
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts[:, 3])])
        self.counts, self.sound, self.pairs = np.concatenate([self.counts, counts]), np.concatenate([self.sound, sound]), np.concatenate([self.pairs, pairs])
        self.groups = pa.concat_arrays([self.groups, groups])
        self.docs = np.concatenate([self.docs, np.zeros(len(self.number) - len(self.docs), np.int64)])

    def documents(self, pieces: pa.ListArray) -> tuple[np.ndarray, pa.Array, list[bytes]]:
        """Of documents given as their cuts: the four counts, the groups and the packed links; those that have none are zero and empty."""
        coded = pieces.flatten().dictionary_encode()
        row = self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        bounds = pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
        doc = np.repeat(np.arange(len(pieces)), np.diff(bounds))
        sound = np.bincount(doc[~self.sound[row]], minlength=len(pieces)) == 0
        row, doc = row[sound[doc]], doc[sound[doc]]
        counts = np.stack([np.bincount(doc, self.counts[row, k], minlength=len(pieces)) for k in range(4)], 1).astype(np.int64)
        groups = self.groups.take(pa.array(row[filled := self.counts[row, 0] > 0]))
        joined = _joined(groups, np.bincount(doc[filled], minlength=len(pieces)), ";")
        n = self.counts[row, 3]
        at = np.arange(n.sum()) + np.repeat(self.starts[row] - np.cumsum(n) + n, n)
        key = np.sort(np.repeat(doc, n) << 32 | self.pairs[at])
        first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        self.docs += np.bincount(key[first] & 0xFFFFFFFF, minlength=len(self.docs))
        self.links += len(key)
        return counts, joined, [pack(x & 0xFFFFFFFF) for x in np.split(key, np.cumsum(counts[:-1, 3]))]


def pack(numbers: np.ndarray) -> bytes:
    """Sorted numbers below 2^32, repeats included, as the compressed bytes of their differences, first all low bytes, then the next."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(numbers, prepend=0).astype("<u4").view("u1").reshape(-1, 4).T.tobytes()) if len(numbers) else b""


def unpack(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.int64)
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "u1").reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


_pairs_of: dict[tuple[str, str], tuple[_ByteTokens, _PieceTokens]] = {}


def _tokenizers(path_a: str, path_b: str) -> tuple[_ByteTokens, _PieceTokens]:
    if (path_a, path_b) not in _pairs_of:
        _pairs_of[path_a, path_b] = _ByteTokens(path_a), _PieceTokens(path_b)
    return _pairs_of[path_a, path_b]


def _coded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row a document, and one a chunk with its distinct pairs and the number of its documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        lexicon = _Lexicon(*_tokenizers(path_a, path_b))

        def rows(n: int, **columns) -> pa.RecordBatch:
            schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("chunk", pa.int64()), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
            arrays = [columns.get(f.name, pa.nulls(n, f.type)) for f in schema]
            return pa.record_batch([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)

        def flush() -> pa.RecordBatch:
            pairs = np.fromiter(lexicon.number, np.int64, len(lexicon.number))
            one = pa.array([0, len(pairs)], pa.int32())
            return rows(1, chunk=pa.array([part << 24 | seq]), pairs=pa.ListArray.from_arrays(one, pa.array(pairs)), docs=pa.ListArray.from_arrays(one, pa.array(lexicon.docs)))

        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for lo, hi in _slices(texts):
                if lexicon.full:
                    yield flush()
                    lexicon, seq = _Lexicon(*_tokenizers(path_a, path_b)), seq + 1
                part_texts = pc.fill_null(texts.slice(lo, hi - lo), "")
                spaced = pc.if_else(pc.equal(part_texts, ""), part_texts, pc.binary_replace_slice(part_texts, 0, 0, " "))
                uneven, pieces = cut(spaced)
                kinds = uneven.to_numpy(zero_copy_only=False)
                ids = batch.column("doc_id").slice(lo, hi - lo)
                for odd in (False, True):
                    take = np.flatnonzero(kinds == odd)
                    if len(take):
                        own = pa.array([cut_uneven(x) for x in spaced.take(pa.array(take)).to_pylist()], pa.list_(pa.large_string())) if odd else pieces.take(pa.array(take))
                        counts, groups, links = lexicon.documents(own)
                        named = {c: pa.array(counts[:, k]) for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                        yield rows(len(take), doc_id=ids.take(pa.array(take)), **named, groups=groups, chunk=pa.array([part << 24 | seq] * len(take)), links=pa.array(links, pa.binary()))
        if lexicon.row:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _CODED)


def _slices(texts: pa.Array, together: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes; a longer text is one of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + together, "right")))
        yield lo, hi
        lo = hi


def token_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups``: for each document the two tokenizers' ids in their groups, as ``a1,a2|b1;a3|b2,b3``.

    ``path_a`` is a byte-level tokenizer, which gets a space before the text; ``path_b`` a sentencepiece model, which adds one itself. A text that is null or
    empty, or whose bytes one of them does not keep (as U+2581, which the model reads as a space), has no tokens: zeros and an empty string. Repeated rows and
    ids give a row each, an empty table none; other columns are not used. A long text is one row of its task.
    """
    return _coded(docs, path_a, path_b, id_col, text_col).where("pairs is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``token_groups``, with the groups as a digest ``groups_sha256`` (empty where there are no tokens), and with what the whole corpus says of the links.

    An id pair's count is the number of documents, repeated rows each, that hold it linked. ``n_best``: links whose count is the highest of their first id, ties
    included; ``count_sum``: the counts of all links. Documents stay in their chunks; each chunk asks for its distinct pairs once, so what is shuffled
    are pairs of chunks and the documents' packed link numbers. Two tables are written to the shared folder and stay until the result is read.
    """
    coded = _coded(docs, path_a, path_b, id_col, text_col)
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise(F.lit(""))
    coded = materialize(coded.select(*(c for c in coded.columns if c != "groups"), digest.alias("groups_sha256")), "aligned")
    asked = coded.where("pairs is not null").select("chunk", F.posexplode(F.arrays_zip("pairs", "docs")).alias("number", "z")).select("chunk", "number", F.col("z.pairs").alias("pair"), F.col("z.docs").alias("docs"))
    counts = materialize(asked.groupBy("pair").agg(F.sum("docs").alias("count")), "pair-counts")
    first = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(first).agg(F.max("count").alias("most"))
    told = counts.select(first, "pair", "count").join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("chunk", "number", "pair").join(told, "pair").select("chunk", "number", "count", "best")
    own = coded.where("pairs is null").drop("pairs", "docs").withColumnRenamed("chunk", "own_chunk")

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """One chunk: its documents and what is known of its pairs."""
        number = answers.column("number").to_numpy()
        count, best = np.zeros(number.max(initial=-1) + 1, np.int64), np.zeros(number.max(initial=-1) + 1, np.int64)
        count[number], best[number] = answers.column("count").to_numpy(), answers.column("best").to_numpy()
        n_best, total = [], []
        for packed in rows.column("links"):
            at = unpack(packed.as_py())
            n_best.append(int(best[at].sum()))
            total.append(int(count[at].sum()))
        columns = {c: rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": rows.column("groups_sha256")}
        return pa.table(columns)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("own_chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)
