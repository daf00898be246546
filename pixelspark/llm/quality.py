"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass turns every whole text into a row of statistics. The trees are fitted on at most ``SAMPLE`` labelled rows, the first by a hash of the id, whose
statistics alone come to the driver. Statistics are binned at quantiles; each node's split is found from histograms of gradients. Fitted trees
are flat arrays of feature, threshold, children and value, and all rows walk them together, one level a step.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SAMPLE, BINS, TREES, DEPTH, RATE, L2, LEAST = 20_000, 64, 120, 4, 0.1, 1.0, 8

_KINDS = np.zeros(256, np.int64)  # letter, upper case, digit, space, line end, other white, sentence marks, other punctuation, control, beyond ASCII
for _i, _s in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", b".,;:?'-", b"!\"#$%&()*+/<=>@[\\]^_`{|}~", (*range(9), *range(14, 32), 127), range(128, 256))):
    for _b in _s:
        _KINDS[_b] = _i
FEATURES = 26


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text; all zeros for a null or empty one."""
    if not text:
        return [0.0] * FEATURES
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, counts, 10) / len(raw)
    share = counts[counts > 0] / len(raw)
    words, lines = raw.split(), raw.split(b"\n")
    n = len(words) or 1
    seen = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    filled = [x for x in lines if x]
    common = seen.most_common(1)[0][1] if seen else 0
    return [
        *kinds, np.log1p(len(raw)), float(-(share * np.log2(share)).sum()), counts[33:48].max() / len(raw), counts[58:127].max() / len(raw), len(words) / len(raw), lengths.mean(), lengths.std(),
        np.log1p(lengths.max()), len(seen) / n, common / n, sum(map(eq, words, words[1:])) / n, len(set(filled)) / (len(filled) or 1), np.log1p(len(raw) / len(lines)), (lengths <= 2).mean(), counts[46] / n, np.log1p(n),
    ]


class Trees:
    """Boosted trees for a 0/1 label."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        self.parts: list[list[tuple]] = []
        if len(y) and 0 < y.sum() < len(y):
            self._fit(x, y)
        flat = [n for part in self.parts for n in part]
        self.roots = np.cumsum([0, *map(len, self.parts)])[:-1]
        base = np.repeat(self.roots, [len(p) for p in self.parts]) if self.parts else np.empty(0, np.int64)
        self.feature = np.array([n[0] for n in flat], np.int64)
        self.threshold = np.array([n[1] for n in flat])
        self.left = np.array([n[2] for n in flat], np.int64) + base
        self.right = np.array([n[3] for n in flat], np.int64) + base
        self.value = np.array([n[4] for n in flat])

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
        f = x.shape[1]
        cell = binned + np.arange(f) * BINS
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            part: list[tuple] = []
            level = [(np.arange(len(y)), self._add(part))]
            for depth in range(DEPTH + 1):
                after = []
                for rows, me in level:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    value = -RATE * gs / (hs + L2)
                    split = None
                    if depth < DEPTH and len(rows) >= 2 * LEAST:
                        at = cell[rows].ravel()
                        cut = lambda w: np.cumsum(np.bincount(at, np.repeat(w, f), f * BINS).reshape(f, BINS), axis=1)  # noqa: E731, B023
                        gl, hl, nl = cut(g[rows]), cut(h[rows]), cut(np.ones(len(rows)))
                        gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                        gain[(nl < LEAST) | (len(rows) - nl < LEAST)] = -1
                        best = int(gain.argmax())
                        if gain.flat[best] > 1e-6:
                            split = divmod(best, BINS)
                    if split is None:
                        part[me] = (0, 0.0, me, me, value)
                        score[rows] += value
                        continue
                    j, b = split
                    low = binned[rows, j] <= b
                    left, right = self._add(part), self._add(part)
                    part[me] = (j, edges[j][b], left, right, 0.0)
                    after += [(rows[low], left), (rows[~low], right)]
                level = after
            self.parts.append(part)

    @staticmethod
    def _add(part: list) -> int:
        part.append(())
        return len(part) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def document_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and ``stats array<double>``."""
    fields = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(t.as_py()) for t in batch.column("_text")], pa.list_(pa.float64()))
            yield pa.record_batch([*(batch.column(c) for c in keep), stats], names=[*keep, "stats"])

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*keep, F.col(f"`{text_col}`").alias("_text")).mapInArrow(run, f"{columns}, stats array<double>")


def held_out_rows(id_col: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, label)``; rows held out and labels other than 0 and 1 are left out. Only the sampled texts are read by Python."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    y = y.filter(~held_out_rows(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    rows = document_statistics(docs.join(F.broadcast(y), "doc_id"), ["doc_id", "y"])  # broadcast: at most ``sample`` pairs of numbers
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "stats").limit(sample).toPandas()
    x = np.stack(rows["stats"]) if len(rows) else np.zeros((0, FEATURES))
    return Trees(x, rows["y"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row for each document: ``doc_id, held_out, score, predicted``.

    Null and empty texts are scored by the statistics 0. Without labels of both kinds every score is the smoothed share of label 1. Repeated rows give repeated rows
    (and weigh as often in fitting), null ids are never held out nor labelled, an empty table gives no rows; other columns are not used.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trees = fit(d, labels, sample=sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, FEATURES)
            yield pa.record_batch([batch.column("doc_id"), pa.array(trees.predict(x))], names=["doc_id", "score"])

    out = d.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that score below ``threshold``; all their columns. Narrow: the texts are never shuffled."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    trees = fit(d, labels, sample=sample)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)]).reshape(-1, FEATURES)
            yield batch.filter(pa.array(trees.predict(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
