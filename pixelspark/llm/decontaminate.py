"""Benchmark decontamination by the q-gram lemma.

Texts and benchmark items are normalised (lower case, ASCII punctuation deleted, white space runs to one space) and compared character by character. An item of m characters that
occurs in a text with at most k edits shares at least m + 1 - q - k*q of its q-grams with it, all on diagonals at most k apart. Each item has the longest q, up to
``Q``, that keeps this bound positive for its whole budget of edits. Shared q-grams are counted in bands of 2(k + 1) diagonals that overlap by half, so one
band holds them all. Bands that reach the bound are aligned: the least edit distance between the whole item and any stretch of the band's text decides.

q-grams are looked up in a text with one byte a character: characters beyond ASCII share 128 bytes, which may add candidates and loses none; alignment sees the characters themselves.

The benchmark is dealt by hash into slices of about ``SLICE_MB``; a slice is what tasks receive at once, and every slice is compared with every text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import small_batches

Q, SLICE_MB = 8, 8
#: Characters of text looked at together; longer texts are cut into stretches that overlap by more than any match.
STRETCH = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = string.punctuation.encode()
_BLANKS = bytes(32 if i < 33 or i == 127 else i for i in range(256))


def normalised(text: str | None) -> str:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_BLANKS, _PUNCTUATION).split()).decode("utf-8", "surrogatepass")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def folded(text: str) -> bytes:
    """One byte a character, never 0 in a normalised text."""
    if text.isascii():
        return text.encode()
    c = _codes(text)
    return np.where(c < 128, c, 128 | (c & 127)).astype(np.uint8).tobytes()


def _grams(data: bytes) -> np.ndarray:
    """The eight bytes at every position of ``data``, as an integer; the last ones reach into zeros."""
    padded = data + bytes(8)
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


class _Grams:
    """The q-grams of the items that have this q."""

    def __init__(self, q: int, items: list[tuple[int, bytes]]):
        self.q, self.mask = q, np.uint64((1 << 8 * q) - 1)
        self.own = {j: _grams(n)[: len(n) - q + 1] & self.mask for j, n in items}
        grams = np.concatenate(list(self.own.values()))
        at = np.concatenate([np.arange(len(g)) for g in self.own.values()])
        of = np.repeat(np.array(list(self.own), np.int64), [len(g) for g in self.own.values()])
        order = np.argsort(grams, kind="stable")
        self.at, self.of = at[order], of[order]
        self.grams, self.first, self.count = np.unique(grams[order], return_index=True, return_counts=True)
        bits = int(np.clip(np.ceil(np.log2(16 * len(self.grams) + 2)), 16, 27))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.grams * _ODD) >> self.shift] = True

    def shared(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the item and place in the text of every q-gram that they share."""
        pos = np.flatnonzero(self.seen[(grams * _ODD) >> self.shift])
        g = np.minimum(np.searchsorted(self.grams, grams[pos]), len(self.grams) - 1)
        real = self.grams[g] == grams[pos]
        pos, g = pos[real], g[real]
        n = self.count[g]
        rows = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.of[rows], self.at[rows], np.repeat(pos, n)


class Index:
    """A slice of the benchmark, ready for ``matches``. Items without text match nothing."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float):
        kept = [(i, n) for i, t in items if (n := normalised(t))]
        self.ids, self.items = [i for i, _ in kept], [n for _, n in kept]
        self.m = np.array([len(n) for n in self.items], np.int64)
        self.k = np.floor(self.m * rate + 1e-9).astype(np.int64)
        q = np.clip(self.m // (self.k + 1), 1, Q)
        self.bound = np.maximum(1, self.m + 1 - (self.k + 1) * q)
        self.groups = [_Grams(int(x), [(j, folded(self.items[j])) for j in np.flatnonzero(q == x).tolist()]) for x in np.unique(q)]
        self.longest = int((self.m + 2 * self.k).max(initial=0)) + 2

    def matches(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text number, item number, distance, start, end)``: the best occurrence of each item in each text."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        piece: list[tuple[int, int, str]] = []
        size = 0
        for number, text in enumerate(texts):
            for lo in range(0, max(1, len(text)), STRETCH):
                part = text[lo : lo + STRETCH + self.longest]
                piece.append((number, lo, part))
                size += len(part)
                if size >= STRETCH:
                    self._stretch(piece, best)
                    piece, size = [], 0
        if piece:
            self._stretch(piece, best)
        return ((*key, *found) for key, found in best.items())

    def _stretch(self, piece: list[tuple[int, int, str]], best: dict) -> None:
        gap = b"\x00" * Q  # no q-gram of an item crosses it
        data = gap.join(folded(p) for _, _, p in piece)
        starts = np.cumsum([0, *(len(p) + Q for _, _, p in piece)])
        every = _grams(data)
        for group in self.groups:
            grams = every & group.mask
            item, at, pos = group.shared(grams)
            band = (pos - at) // (self.k[item] + 1)
            reach = np.int64(len(data) + self.longest + 2) * 2
            keys = np.concatenate([item * reach + band, item * reach + band - 1]) + reach // 2
            keys, counts = np.unique(keys, return_counts=True)
            item, band = keys // reach, keys % reach - reach // 2
            hit = counts >= self.bound[item]
            for j, b in zip(item[hit].tolist(), band[hit].tolist(), strict=True):
                m, k = int(self.m[j]), int(self.k[j])
                a, z = b * (k + 1) - k, (b + 2) * (k + 1) + m + k
                if np.isin(group.own[j], grams[max(0, a) : z]).sum() < self.bound[j]:  # repeats in the text count once for each place of the item
                    continue
                for s in range(max(0, int(np.searchsorted(starts, a, "right")) - 1), len(piece)):
                    if starts[s] >= z:
                        break
                    number, lo, part = piece[s]
                    x, y = max(0, a - int(starts[s])), min(len(part), z - int(starts[s]))
                    if y > x and best.get((number, j), (1,))[0] > 0 and (found := align(self.items[j], part[x:y], k)):
                        found = found[0], lo + x + found[1], lo + x + found[2]
                        if (number, j) not in best or found < best[number, j]:
                            best[number, j] = found


def align(item: str, region: str, k: int) -> tuple[int, int, int] | None:
    """``(distance, start, end)`` of the stretch of ``region`` nearest to the whole ``item``, if at most k edits apart; of equal ones the first to end.

    The region is a band of a few k wider than the item, so the whole rows computed here are the band.
    """
    p = region.find(item)
    if p >= 0:
        return 0, p, p + len(item)
    if k == 0 or len(region) < len(item) - k:
        return None
    r = _codes(region)
    steps = np.arange(len(r) + 1)
    row, begin = np.zeros(len(r) + 1, np.int64), steps.copy()
    for i, c in enumerate(_codes(item), 1):
        replace = np.concatenate([[i], row[:-1] + (r != c)])
        delete = row + 1
        up = np.where(replace <= delete, replace, delete)
        origin = np.where(replace <= delete, np.concatenate([[0], begin[:-1]]), begin)
        low = np.minimum.accumulate(up - steps)
        source = np.maximum.accumulate(np.where(up - steps == low, steps, 0))  # where the run of insertions begins
        row, begin = low + steps, origin[source]
        if row.min() > k:
            return None
    end = int(row.argmin())
    return (int(row[end]), int(begin[end]), end) if row[end] <= k else None


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[Row]]:
    b = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // (SLICE_MB << 20)))
    for i in range(n):
        yield b.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()  # about SLICE_MB


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, distance, start, end``: one row for each document and each benchmark item that it holds with at most ``rate`` edits a character (rounded down; short items allow none).

    start and end count characters of the normalised text. Null and empty texts and items match nothing. Repeated rows of either table give repeated rows, null ids stay
    null, an empty table gives no rows; other columns are not used. Narrow in the documents: no shuffle.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for rows in _slices(benchmark, item_col, item_text_col):
        items = [(r.item_id, r.text) for r in rows]

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, rate)
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(ids[t], index.ids[j], *rest) for t, j, *rest in sorted(index.matches([normalised(x.as_py()) for x in batch.column("text")]))]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "start", "end"])

        part = d.mapInArrow(run, "doc_id long, item_id long, distance long, start long, end long")
        out = part if out is None else out.union(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all their columns. Narrow: no shuffle."""
    small_batches(docs.sparkSession)
    text_at = docs.columns.index(text_col)
    for rows in _slices(benchmark, item_col, item_text_col):
        items = [(r.item_id, r.text) for r in rows]

        def run(batches: Iterator[pa.RecordBatch], items: list = items) -> Iterator[pa.RecordBatch]:
            index = Index(items, rate)
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for t, *_ in index.matches([normalised(x.as_py()) for x in batch.column(text_at)]):
                    keep[t] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
