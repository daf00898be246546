"""Token-id files: independent zstandard frames with a trailing seek table.

A file is a valid zstandard stream. Each document is one frame of little-endian ids (``uint16`` where the vocabulary fits, else ``uint32``).
Two skippable frames follow. The first (magic 0x184D2A50) holds this format's own index: the id width and the documents' ids. The last
(magic 0x184D2A5E) is the seek table of the public seekable format: compressed size, decompressed size and a 32-bit checksum (low bits of
XXH64 of the decompressed bytes) per frame, then the frame count, a descriptor byte and 0x8F92EAB1. A reader loads the two tails and
then decompresses only the frames that are asked for.

Texts are encoded by the tokenizers library. The byte-level pre-tokenizer never lets a piece span a single space between two other
characters, so a text is cut there (and at line ends where no white characters meet). Arrow cuts many texts at once and numbers the distinct cuts, each of which is
encoded once per worker; the ids, gathered by those numbers, are those of the whole text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import uuid
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_dir, small_batches

INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Two white characters that meet, or the character that marks cuts.
_UNEVEN = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}|\x01"
#: A run of ASCII marks behind a Latin letter, at the end of a cut, is a piece of its own.
_MARKED = re.compile(r"(.*[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([!-/:-@\[-`{-~]+)", re.DOTALL)
#: The same before a cut, for RE2.
_MARKED_CUT = r"([A-Za-z\x{00c0}-\x{00d6}\x{00d8}-\x{00f6}\x{00f8}-\x{024f}])([!-/:-@\[-`{-~]+)(\x01|$)"
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: One piece.
_LETTERS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: The character that stands for each byte in byte-level form.
_BYTE_LEVEL = "".join(chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256))


def cut(column: pa.Array, marks: bool = False) -> tuple[pa.Array, pa.ListArray]:
    """Which texts are uneven (two white characters meet), and the cuts of the others: before each space and around each line end. An uneven text has one empty cut.

    With ``marks``, marks that end a cut behind a letter are a cut of their own, so that there are fewer distinct ones.
    """
    uneven = pc.match_substring_regex(column, _UNEVEN)
    marked = pc.replace_substring(pc.replace_substring(pc.if_else(uneven, "", column), " ", "\x01 "), "\n", "\x01\n\x01")
    if marks:
        marked = pc.replace_substring_regex(marked, _MARKED_CUT, "\\1\x01\\2\\3")
    return uneven, pc.split_pattern(marked, "\x01")


def cut_uneven(text: str) -> list[str]:
    """The cuts of any text: before each space between two characters that are not white."""
    first, *rest = _CUT.split(text)
    return [first, *(" " + x for x in rest)]


class Encoder:
    """Texts -> ids as bytes; remembers at most about ``LIMIT`` cuts, and beyond that those of the latest texts only, among them the frequent ones.

    A tokenizer that is not a plain byte-level one gets whole texts, and so does any tokenizer a text that holds one of its added tokens.
    With ``special_as_text`` the strings of special tokens are ordinary text.
    """

    LIMIT = 200_000
    #: Characters of text that are encoded together, or one longer text.
    TOGETHER = 1_000_000

    def __init__(self, path: str, end_id: int | None, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.dtype = np.dtype("<u2") if max(self.tokenizer.get_vocab_size(), end_id or 0) < 1 << 16 else np.dtype("<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {}
        parts = json.loads(self.tokenizer.to_str())
        level = parts["pre_tokenizer"] or {}
        self.added = [t["content"] for t in parts["added_tokens"] if not (special_as_text and t["special"])]
        self.cuts = level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level["add_prefix_space"] and parts["normalizer"] is None and parts["truncation"] is None and parts["model"]["type"] == "BPE" and sys.byteorder == "little"

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids with the end id, in order. A null text is empty."""
        part, size = [], 0
        for t in texts:
            part.append(t or "")
            size += len(part[-1])
            if size >= self.TOGETHER:
                yield from self._encode(part)
                part, size = [], 0
        yield from self._encode(part)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self._whole(texts)
        whole = [i for i, t in enumerate(texts) if any(x in t for x in self.added)]
        if whole:
            done = dict(zip(whole, self._whole([texts[i] for i in whole]), strict=True))
            rest = iter(self._encode([t for i, t in enumerate(texts) if i not in done]))
            return [done[i] if i in done else next(rest) for i in range(len(texts))]
        uneven, pieces = cut(pa.array(texts, pa.large_string()), marks=True)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        ids = self._ids(distinct)
        if len(self.known) > self.LIMIT:
            self.known = dict(zip(distinct, ids, strict=True))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(ids), self.dtype)
        each = coded.indices.to_numpy()
        counts = lengths[each]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = flat[np.arange(ends[-1]) + np.repeat(starts[each] - ends[:-1], counts)]
        bounds = ends[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        done = [out[a:b].tobytes() + self.end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for i in np.flatnonzero(uneven.to_numpy(zero_copy_only=False)).tolist():
            done[i] = b"".join(self._ids(cut_uneven(texts[i]))) + self.end
        return done

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, cuts: list[str]) -> list[bytes]:
        new, words, rest = set(cuts).difference(self.known), [], []
        marked = [(u, *m.groups()) for u in new if not u[-1:].isalnum() and (m := _MARKED.fullmatch(u))]
        if marked:
            new = new.difference(u for u, _, _ in marked).union(*((x, y) for _, x, y in marked)).difference(self.known)
        for u in new:
            (words if _LETTERS.fullmatch(u) else rest).append(u)
        tokenize = self.tokenizer.model.tokenize
        for lo in range(0, len(words), 20_000):
            part, ids, ends = words[lo : lo + 20_000], [], [0]
            for u in part:
                ids += [t.id for t in tokenize(charmap_decode(u.encode(), "strict", _BYTE_LEVEL)[0])]
                ends.append(len(ids))
            raw, ends = np.array(ids, self.dtype).tobytes(), (np.array(ends) * self.dtype.itemsize).tolist()
            self.known.update((u, raw[a:b]) for u, a, b in zip(part, ends[:-1], ends[1:], strict=True))
        for lo in range(0, len(rest), 20_000):
            part = rest[lo : lo + 20_000]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[u] = array(self.code, e.ids).tobytes()
        for u, x, y in marked:
            self.known[u] = self.known[x] + self.known[y]
        return list(map(self.known.__getitem__, cuts))


_encoders: dict[tuple, Encoder] = {}


def _encoder(path: str, end_id: int | None) -> Encoder:
    """One for each worker process, which keeps it from task to task."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _filesystem(uri: str):
    """A pyarrow file system and path for local, mounted and object stores."""
    from pyarrow import fs

    if not urlsplit(uri).scheme:
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


class _Writer:
    """One open file; written under another name and moved when complete, so that a repeated task leaves the same files."""

    def __init__(self, uri: str, dtype: np.dtype, level: int):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.temp = f"{os.path.dirname(self.path)}/_{uuid.uuid4().hex}"
        self.out, self.dtype = self.fs.open_output_stream(self.temp), dtype
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.seek, self.ids, self.present, self.tokens, self.size = bytearray(), [], [], 0, 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.seek += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.ids.append(doc_id or 0)
        self.present.append(doc_id is not None)
        self.tokens += len(raw) // self.dtype.itemsize
        self.size += len(frame)

    def close(self) -> tuple[int, int]:
        n = len(self.ids)
        index = struct.pack("<BI", self.dtype.itemsize, n) + np.array(self.ids, "<i8").tobytes() + np.array(self.present, "u1").tobytes()
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = bytes(self.seek) + struct.pack("<IBI", n, 0x80, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.temp, self.path)
        return n, self.tokens


class Reader:
    """Random access to one file, given as bytes or as a seekable binary file. Raises ValueError on a damaged file or frame."""

    def __init__(self, source):
        self.get = (lambda a, b: source[a:b]) if isinstance(source, (bytes, memoryview)) else lambda a, b: source.seek(a) * 0 * b or source.read(b - a)
        total = len(source) if isinstance(source, (bytes, memoryview)) else source.seek(0, 2)
        if total < 9:
            raise ValueError("not a token file: too short")
        n, flags, magic = struct.unpack("<IBI", self.get(total - 9, total))
        table = 9 + 12 * n
        if magic != FOOTER_MAGIC or not flags & 0x80 or total < table + 8:
            raise ValueError("not a token file: no seek table")
        rows = np.frombuffer(self.get(total - table, total - 9), "<u4").reshape(n, 3)
        head, size = struct.unpack("<II", self.get(total - table - 8, total - table))
        if head != SEEK_MAGIC or size != table:
            raise ValueError("damaged seek table")
        self.starts = np.concatenate([[0], np.cumsum(rows[:, 0], dtype=np.int64)])
        self.sizes, self.sums = rows[:, 1], rows[:, 2]
        index = self.get(int(self.starts[-1]), total - table - 8)
        head, size = struct.unpack("<II", index[:8])
        if head != INDEX_MAGIC or size != len(index) - 8 or struct.unpack("<I", index[9:13])[0] != n:
            raise ValueError("damaged index")
        self.dtype = np.dtype(f"<u{index[8]}")
        self.doc_ids = np.frombuffer(index[13 : 13 + 8 * n], "<i8")
        self.present = np.frombuffer(index[13 + 8 * n :], "u1").astype(bool)
        self.zstd = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.sizes)

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        frame = self.get(int(self.starts[k]), int(self.starts[k + 1]))
        try:
            raw = self.zstd.decompress(frame, max_output_size=int(self.sizes[k]) or 1)
        except zstandard.ZstdError as e:
            raise ValueError(f"damaged frame {k}") from e
        if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"checksum of frame {k} differs")
        return np.frombuffer(raw, self.dtype)

    def of(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document that bears this doc_id."""
        return [self.ids(int(k)) for k in np.flatnonzero(self.present & (self.doc_ids == doc_id))]


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int | None = 2, docs_per_file: int = 8192, max_file_mb: int = 256, level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents in ascending id order; returns the manifest ``(part, piece, path, n_docs, n_tokens)``.

    Documents are dealt by ranges of id, one sorted range a task; a range fills one file, or further pieces once ``max_file_mb`` are written.
    Null ids come first; rows with equal ids are ordered by text. An empty table writes no file.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(1, -(-d.count() // docs_per_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, writer, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            encoder = _encoder(tokenizer_path, end_id)
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                if writer is None:
                    path = f"{out_dir}/ids-{part:06d}-{piece:04d}.zst"
                    writer = _Writer(path, encoder.dtype, level)
                writer.add(doc_id, raw)
                if writer.size >= max_file_mb << 20:
                    done.append((part, piece, path, *writer.close()))
                    writer, piece = None, piece + 1
            pa.default_memory_pool().release_unused()
        if writer is not None:
            done.append((part, piece, path, *writer.close()))
        columns = list(zip(*done, strict=True)) or [[]] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "piece", "path", "n_docs", "n_tokens"])

    ranged = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(run, "part int, piece int, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """Decode every file: ``doc_id, start, n_tokens, ids_crc32`` for each document, ``start`` counting the ids of all documents before it."""
    spark = manifest.sparkSession
    order = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                reader = Reader(memoryview(content.as_buffer()).toreadonly())
                counts, sums = [], []
                for k in range(len(reader)):
                    ids = reader.ids(k)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                counts = np.array(counts, np.int64)
                ids = pa.array(reader.doc_ids, pa.int64(), mask=~reader.present)
                yield pa.record_batch([pa.array([name] * len(reader)), ids, pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(sums, pa.int64())], names=["name", "doc_id", "at", "n_tokens", "ids_crc32"])

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(out_dir).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    rows = files.mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, **options) -> DataFrame:
    """Write ``docs`` to files in the shared folder and return what the files hold, one row a document (see ``read_token_files``).

    Null and empty texts hold the end id alone. Repeated rows are written as often as they occur. Other columns are not used.
    """
    out_dir = new_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, out_dir, tokenizer_path, end_id, **options), out_dir)
