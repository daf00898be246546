"""Language identification by a convolutional network over bytes, trained and applied in numpy.

A lower-cased text is cut into windows of 128 bytes. Bytes are embedded; filters over 2, 3 and 4 bytes run along a window, each keeps its largest response (max
pooling), and a softmax over the learned languages follows. A text's logits are the mean of its windows' logits, weighted by their bytes.

Training uses at most ``PER_LANG`` texts of each language, the first by a hash of the id, and from each three windows at hashed places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

PER_LANG, PLACES, WIDTH, EMBED, FILTERS, EPOCHS, BATCH, STEP = 1500, 3, 128, 6, {2: 8, 3: 12, 4: 16}, 6, 128, 0.01
_SPAN = max(FILTERS)
_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether any character is of Unicode's categories L."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a whole text, zero-padded, and the number of bytes in each."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // WIDTH))
    out = np.zeros(n * WIDTH, np.uint8)
    out[: len(raw)] = raw
    sizes = np.full(n, WIDTH)
    sizes[-1] = len(raw) - (n - 1) * WIDTH
    return out.reshape(n, WIDTH), sizes


class ByteConv:
    """The network. ``langs`` are in code point order; without languages nothing can be predicted."""

    def __init__(self, langs: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        self.langs = sorted(langs)
        f = sum(FILTERS.values())
        self.p = {
            "embed": r.normal(0, 0.5, (256, EMBED)).astype(np.float32), "conv": r.normal(0, 0.3, (_SPAN * EMBED, f)).astype(np.float32), "shift": np.zeros(f, np.float32),
            "out": r.normal(0, 0.1, (f, len(langs))).astype(np.float32), "bias": np.zeros(len(langs), np.float32),
        }
        self.mask = np.ones((_SPAN * EMBED, f), np.float32)  # narrower filters do not see the last bytes of the span
        at = 0
        for width, n in FILTERS.items():
            self.mask[width * EMBED :, at : at + n] = 0
            at += n
        self.p["conv"] *= self.mask

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.p["embed"][x]
        n, length = len(x), WIDTH - _SPAN + 1
        s = e.strides
        patches = np.lib.stride_tricks.as_strided(e, (n, length, _SPAN * EMBED), (s[0], s[1], s[2])).reshape(n * length, -1)
        response = (patches @ self.p["conv"]).reshape(n, length, -1)
        return patches, response, response.max(axis=1)

    def logits(self, x: np.ndarray, part: int = 512) -> np.ndarray:
        out = [np.maximum(self._pooled(x[a : a + part])[2] + self.p["shift"], 0) @ self.p["out"] + self.p["bias"] for a in range(0, len(x), part)]
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighted cross-entropy of windows ``x`` with language numbers ``y``, by parameter."""
        patches, response, top = self._pooled(x)
        hidden = np.maximum(top + self.p["shift"], 0)
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(len(y)), y] -= 1
        z *= (weight[y] / len(y))[:, None]
        g = {"out": hidden.T @ z, "bias": z.sum(axis=0)}
        back = (z @ self.p["out"].T) * (hidden > 0)
        g["shift"] = back.sum(axis=0)
        at = response.argmax(axis=1)  # window, filter -> place
        chosen = patches.reshape(len(x), -1, _SPAN * EMBED)[np.arange(len(x))[:, None], at]
        g["conv"] = np.einsum("nfp,nf->pf", chosen, back) * self.mask
        to = (back[:, :, None] * self.p["conv"].T[None]).reshape(len(x), back.shape[1], _SPAN, EMBED)
        seen = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(_SPAN)]
        g["embed"] = np.zeros((256, EMBED), back.dtype)
        np.add.at(g["embed"], seen, to)
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 0) -> ByteConv:
        """Adam on cross-entropy, each language weighing the same."""
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        weight = (len(y) / np.maximum(1, np.bincount(y, minlength=len(self.langs))) / len(self.langs)).astype(np.float32)
        for _ in range(EPOCHS):
            for rows in np.array_split(r.permutation(len(x)), -(-len(x) // BATCH)):
                t += 1
                for k, d in self.gradients(x[rows], y[rows], weight).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d * d
                    self.p[k] = (self.p[k] - STEP * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability; ``("und", 0.0)`` for a text that is null or has no letter."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        for i, t in enumerate(texts):
            if t and self.langs and has_letter(t):  # one text at a time: a matrix product's last bits depend on what else is in it
                x, weight = windows(t)
                z = (self.logits(x) * weight[:, None]).astype(np.float64).sum(axis=0) / weight.sum()
                p = np.exp(z - z.max())
                p /= p.sum()
                out[i] = (self.langs[int(p.argmax())], min(1.0, float(p.max())))
        return out


def held_out_rows(id_col, folds: int = 3, fold: int = 1):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> ByteConv:
    """Train on ``docs(doc_id, text, lang)``, rows held out and null languages left out. What reaches the driver is bounded by ``per_lang`` times the number of languages."""
    size = F.greatest(F.length("text") - WIDTH, F.lit(0)) + 1
    place = lambda i: F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(i)), size).cast("int") + 1, WIDTH)
    d = docs.filter(~held_out_rows(F.col("doc_id"))).filter("lang is not null and length(text) > 0")
    # a language's smallest hashes lie below a bound that follows from its count, so that no more than a few times ``per_lang`` rows of it meet in a task
    often = d.groupBy("lang").agg(F.count("*").alias("c")).withColumnRenamed("lang", "of_lang")
    rank = F.xxhash64("doc_id")
    below = (rank / F.lit(2.0**64) + 0.5) * F.col("c") <= F.lit(2.0 * per_lang + 50)
    d = d.join(F.broadcast(often), F.col("lang") == F.col("of_lang")).filter(below)  # a row for each language
    d = d.select("lang", F.array(*(place(i) for i in range(PLACES))).alias("parts"), rank.alias("rank"))
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "parts"))).filter(F.col("n") <= per_lang)
    rows = d.select("lang", "parts", "rank").orderBy("rank", "lang", "parts").collect()
    net = ByteConv(sorted({r.lang for r in rows}))
    number = {x: i for i, x in enumerate(net.langs)}
    pairs = [(windows(p)[0][0], number[r.lang]) for r in rows for p in r.parts if has_letter(p)]
    return net.fit(np.stack([x for x, _ in pairs]), np.array([y for _, y in pairs])) if pairs else net


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> DataFrame:
    """One row for each document: ``doc_id, held_out, lang_pred, score``.

    Null, empty and letterless texts are ``und`` with score 0, as are all texts if no language can be learned. Repeated rows give repeated rows, null ids are never
    held out, an empty table gives no rows; other columns are not used. Narrow but for the training sample.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    net = fit(d, per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = net.predict(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = d.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out_rows(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
