"""BPE encoding by content-defined chunks, and decoding.

A rolling hash over the last ``WINDOW`` bytes ends a chunk wherever its top bits are zero, so documents that share a passage share its chunks, wherever
the passage stands. The inside of a chunk, from its first white space to its last, is encoded once a worker and remembered. At a join the
ends of two chunks form a broken word; it is re-encoded from the last white space before the join to the first behind it, and where a chunk holds no white space
the stretch runs on into the next. Its ids must agree exactly with the surroundings: between two probe words it has to give the probes' own ids on either side
(white space ends whatever the tokenizer looks at). A text with a stretch that does not agree is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Bytes that the rolling hash looks at, and the bits of it that are zero at a cut: a chunk of 256 bytes on average.
WINDOW, BITS = 16, 8
_GEAR = ((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(29)).astype(np.uint32)
_WORD = re.compile(r"([A-Za-z]+)([!-&(-/:;=?@\[-`{}~]*)")
_PROBE = "word"


def rolling_hash(raw: np.ndarray) -> np.ndarray:
    """At each byte the hash of it and the 15 before it, each shifted by its distance; sums of 1, 2, 4 and 8 bytes double."""
    h, width = _GEAR[raw], 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def chunk_ends(raw: np.ndarray) -> np.ndarray:
    """Positions behind the bytes that end a chunk."""
    return np.flatnonzero(rolling_hash(raw) >> np.uint32(32 - BITS) == 0) + 1


class ChunkEncoder:
    """Texts -> ids, with a memory of at most about ``REMEMBER`` bytes of chunks and joins, and ``WORDS`` words, in a worker."""

    REMEMBER, WORDS = 16 << 20, 250_000
    #: Bytes of text that are cut together; a longer text is cut at white space into parts of this size.
    TOGETHER = 4 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str("x y  z\n1 .\n\n' s é 's") if self.tokenizer.pre_tokenizer else [(" ", None)]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = not any(re.search(r"\s|Ġ|Ċ", p) for p, _ in pieces) and not any(re.search(r"\s", a) or not _marks(a) for a in added) and self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.probe = self.tokenizer.encode(_PROBE, add_special_tokens=False).ids
        self.known: dict[bytes, np.ndarray | None] = {}
        self.size, self.words = 0, {"": b""}

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Each text's ids, in order; a null text has none."""
        part, size = [], 0
        for t in texts:
            raw = (t or "").encode()
            if size and size + len(raw) > self.TOGETHER:
                yield from self._encode(part)
                part, size = [], 0
            part.append(raw)
            size += len(raw)
        yield from self._encode(part)

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        if not self.cuts:
            return [self._whole(t) for t in texts]
        out = []
        blocks = [self._blocks(t) for t in texts]
        ids = iter(self._together([b for own in blocks for b in own]))
        for t, own in zip(texts, blocks, strict=True):
            parts = [next(ids) for _ in own]
            out.append(self._whole(t) if any(p is None for p in parts) else parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.int32)]))
        return out

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.int32)

    def _blocks(self, text: bytes) -> list[bytes]:
        """A text of more than ``TOGETHER`` bytes in parts that start at white space."""
        out, at = [], 0
        while len(text) - at > self.TOGETHER:
            end = max(text.rfind(b" ", at + 1, at + self.TOGETHER), text.rfind(b"\n", at + 1, at + self.TOGETHER))
            if end <= at:
                ends = [e for e in (text.find(b" ", at + self.TOGETHER), text.find(b"\n", at + self.TOGETHER)) if e > 0]
                end = min(ends, default=len(text))
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def _together(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Each text's ids, or None where a join does not agree."""
        if sum(map(len, texts)) > 2 * self.TOGETHER and len(texts) > 1:
            half = len(texts) // 2
            return self._together(texts[:half]) + self._together(texts[half:])
        whole = b"".join(texts)
        raw = np.frombuffer(whole, np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        cut = chunk_ends(raw)
        doc = np.searchsorted(ends, cut, "right")
        inside = doc < len(texts)
        cut, doc = cut[inside], doc[inside]
        far = cut - starts[doc] >= WINDOW  # before that the hash has seen the text before
        cut, doc = cut[far], doc[far]
        white = np.flatnonzero((raw == 32) | (raw == 10))
        at = np.searchsorted(white, cut)  # the first white space at or behind the cut
        left = np.maximum(np.concatenate([[-1], white])[at], starts[doc])
        right = np.minimum(np.concatenate([white, [len(raw)]])[at], ends[doc])
        points = np.unique(np.concatenate([starts, ends, left, right]))
        joins = set(left.tolist())  # where a stretch around a join starts; the other stretches are the insides of chunks
        bounds = points.tolist()
        own = [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self._learn({s for a, s in zip(bounds[:-1], own, strict=True) if a in joins}, set(own))
        ids = [self.known[s] for s in own]
        bad = {k for k, x in enumerate(ids) if x is None}
        first, last = np.searchsorted(points, starts), np.searchsorted(points, ends)
        out: list[np.ndarray | None] = []
        lengths = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
        flat = np.concatenate([np.zeros(0, np.int32), *(x for x in ids if x is not None)])
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            out.append(None if bad and bad & set(range(a, b)) else flat[lengths[a] : lengths[b]])
        return out

    def _learn(self, joins: set[bytes], stretches: set[bytes]) -> None:
        if self.size > self.REMEMBER:
            self.known.clear()
            self.size = 0
        new = list(stretches.difference(self.known))
        self.size += sum(map(len, new))
        if len(self.words) > self.WORDS:
            self.words = {"": b""}
        for lo in range(0, len(new), 50_000):
            self._insides(new[lo : lo + 50_000])
        again = [s for s in new if s in joins]
        for lo in range(0, len(again), 20_000):
            part = again[lo : lo + 20_000]
            n = len(self.probe)
            for s, e in zip(part, self.tokenizer.encode_batch_fast([f"{_PROBE} {s.decode()} {_PROBE}" for s in part], add_special_tokens=False), strict=True):
                got = e.ids
                self.known[s] = np.array(got[n:-n], np.int32) if got[:n] == self.probe == got[-n:] else None

    def _insides(self, stretches: list[bytes]) -> None:
        """Encode stretches between white space: the library sees each distinct word once."""
        column = pc.replace_substring(pa.array(stretches, pa.large_binary()).cast(pa.large_string()), "\n", " ")
        split = pc.split_pattern(column, " ")
        coded = split.flatten().dictionary_encode()
        ids = self._words(coded.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), np.int32)
        each = coded.indices.to_numpy()
        n = lengths[each]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(ends[-1]) + np.repeat(starts[each] - ends[:-1], n)]
        bounds = ends[split.offsets.to_numpy()].tolist()
        self.known.update(zip(stretches, (out[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:], strict=True)), strict=True))

    def _words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.words]
        rest, tokenize = [], self.tokenizer.model.tokenize
        plain: dict[str, bytes] = {}

        def piece(x: str) -> bytes:  # ASCII letters, or marks, are one piece each
            if x not in plain:
                plain[x] = array("i", [t.id for t in tokenize(x)]).tobytes()
            return plain[x]

        for w in new:
            m = _WORD.fullmatch(w)
            if m:
                self.words[w] = piece(m[1].lower()) + (piece(m[2]) if m[2] else b"")
            else:
                rest.append(w)
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.words[w] = array("i", e.ids).tobytes()
        return [self.words[w] for w in words]


def _marks(added: str) -> bool:
    """Whether an added token can't occur in a word that is looked up as letters and marks: such words hold no ``<``, ``>`` or ``|``."""
    return bool(re.search(r"[<>|]", added))


class Decoder:
    """Lists of ids -> texts, as the library's ``decode(ids, skip_special_tokens=False)``. Without a decoder of its own a tokenizer's tokens are joined by spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.names = pa.array([tokenizer.id_to_token(i) for i in range(size)], pa.large_string())
        self.tokenizer = tokenizer if tokenizer.decoder is not None else None

    def __call__(self, ids: pa.ListArray) -> pa.Array:
        if self.tokenizer is not None:
            return pa.array([self.tokenizer.decode(x, skip_special_tokens=False) for x in ids.to_pylist()], pa.large_string())
        flat = ids.flatten()
        offsets = pa.array(ids.offsets.to_numpy().astype(np.int64) - ids.offsets[0].as_py())
        return pc.binary_join(pa.LargeListArray.from_arrays(offsets, self.names.take(flat)), pa.scalar(" ", pa.large_string()))


_coders: dict[tuple[type, str], ChunkEncoder | Decoder] = {}


def _coder(kind: type, path: str):
    """One for each worker process, which keeps it from task to task."""
    if (kind, path) not in _coders:
        _coders[kind, path] = kind(path)
    return _coders[kind, path]


def encode_chunks(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """``doc_id, ids``, and with ``decode`` the text ``decoded`` from those ids in the same task: each document's ids (array<int>), exactly those that the tokenizers library gives for the whole text without special tokens added.

    Null and empty texts have an empty array. Repeated rows and ids, null ids included, give a row each; an empty table gives none; other columns are not used.
    A long text is cut at white space into parts of 4 MB. A tokenizer that looks beyond white space gets whole texts. There is no shuffle: a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder = _coder(ChunkEncoder, tokenizer_path)
            ids = list(encoder.encode(batch.column("text").to_pylist()))
            bounds = np.cumsum([0, *map(len, ids)])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            columns = [batch.column("doc_id"), lists]
            if decode:
                columns.append(_coder(Decoder, tokenizer_path)(lists).cast(pa.string()))
            yield pa.record_batch(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "doc_id long, ids array<int>, decoded string" if decode else "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded``: each list of ids with its text. A null list is null, an empty one the empty text; an id outside the vocabulary raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            text = _coder(Decoder, tokenizer_path)(pc.fill_null(ids, pa.scalar([], ids.type)))
            yield pa.record_batch([batch.column("doc_id"), ids, pc.if_else(ids.is_valid(), text, None).cast(pa.string())], names=["doc_id", "ids", "decoded"])

    small_batches(tokens.sparkSession)
    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: the ids in decimal, joined by one space, and the decoded text."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
