"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds its distinct k-word shingles, each a 64-bit hash. The top bits of a hash name one of 128 buckets; each bucket
keeps its smallest remainder as a register of 6 bits (leading zeros) and 10 bits (the mantissa behind the first one). Empty buckets
borrow from a fixed, pseudo-random order of buckets, so short texts have full sketches too. Bands of four compressed registers are the
candidate buckets. Every member of a bucket is compared with its centre: the Jaccard estimate, corrected for registers that collide by chance, must come within
five standard errors of the threshold, and the full sets then decide.

Copies (equal sets) fold into the smallest doc_id first and never meet as pairs. What shares a bucket and is still in different components
meets again by its rarest shingles, without regard to estimates: two sets this similar have their first common shingle, rarest first, near the front of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialize, small, small_batches, words
from .linking import connect_buckets, ordered

BUCKETS, ROWS, MANTISSA = 128, 4, 10
#: Standard errors by which an estimate may fall short before full sets decide.
MARGIN = 5.0
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, so that sums of word hashes spread over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered for the frequent ones; at most ``LIMIT`` entries (what is forgotten is hashed again)."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def shingle_set(text: str | None, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles; the whole sequence as one shingle if it has fewer words; empty without words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - k + 1)
    out = np.full(n, np.uint64(min(k, len(w))), np.uint64)
    for i in range(min(k, len(w))):
        out = out * _ODD + h[i : i + n]
    return np.unique(_mixed(out))


def _probe_order() -> np.ndarray:
    """For each bucket, all buckets in a fixed pseudo-random order."""
    return np.argsort(_mixed(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * _ODD).reshape(BUCKETS, BUCKETS), axis=1)


_PROBE = _probe_order()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """128 registers (uint16) of a non-empty sorted array of hashes."""
    shift = np.uint64(64 - 7)
    bucket = (hashes >> shift).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] << np.uint64(7)) | np.uint64(64)  # a one behind the last real bit ends the count of zeros
    lead = 63 - np.floor(np.log2(rest.astype(np.longdouble))).astype(np.int64)
    tail = ((rest << (lead + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out = np.zeros(BUCKETS, np.int64)
    out[bucket[first]] = (lead << MANTISSA) | tail
    have = np.zeros(BUCKETS, bool)
    have[bucket[first]] = True
    if not have.all():
        lack = np.flatnonzero(~have)
        order = _PROBE[lack]
        out[lack] = out[order[np.arange(len(lack)), have[order].argmax(axis=1)]]
    return out.astype("<u2")


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            n, sig, regs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k, cache)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                regs.append(sketch(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(regs, pa.binary())], schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(batch), 512):  # sets take more room than texts
                sets = [shingle_set(t.as_py(), k, cache).view(np.int64) for t in texts[at : at + 512]]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.record_batch([ids[at : at + 512], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], schema=schema)

    return run


def _estimate(a: str, b: str):
    """Share of equal registers, less those expected to be equal by chance."""
    at = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    same = F.size(F.filter(at, lambda i: F.col(a).substr(2 * i + 1, F.lit(2)) == F.col(b).substr(2 * i + 1, F.lit(2)))) / F.lit(float(BUCKETS))
    ratio = F.least("a_n", "b_n") / F.greatest("a_n", "b_n")
    chance = F.lit(0.169919487159739093975315012348630288992889 * 2.0**-MANTISSA) * 4 * ratio / F.pow(1 + ratio, 2)
    return (same - chance) / (1 - chance)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets; component_id is the smallest doc_id reachable.
    Null, empty and white-space texts have n_shingles 0 and are linked with nothing (component_id = doc_id). A repeated row is a copy of itself
    with the same ids. An empty table gives no rows. Other columns of ``docs`` are not used, whatever their names.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    all_rows = materialize(d.mapInArrow(_sketches(k), "doc_id long, n_shingles long, sig binary, sketch binary"), "sketches")
    groups = all_rows.filter("sig is not null").groupBy("sig", "n_shingles", "sketch").agg(F.min("doc_id").alias("id")).filter("id is not null")
    groups = materialize(groups.withColumnRenamed("n_shingles", "n"), "groups")
    reps = groups.select("id", "n", "sketch")
    bands = F.array(*(F.xxhash64(F.lit(i), F.substring("sketch", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BUCKETS // ROWS)))
    margin = F.lit(MARGIN) * F.sqrt(F.lit(percent / 100 * (1 - percent / 100)) / F.least("a_n", "b_n", F.lit(BUCKETS)))
    made = []

    def full_sets(ids: DataFrame) -> DataFrame:
        ids = materialize(ids.select(F.col("id").alias("doc_id")), "ids")
        sets = materialize(d.join(small(ids), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, hashes array<long>").dropDuplicates(["doc_id"]), "sets")
        made.extend([ids, sets])
        return sets

    def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return full.filter(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b")
        likely = likely.filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent).filter(_estimate("a_sketch", "b_sketch") >= percent / 100 - margin).select("a", "b")
        likely = materialize(likely, "likely")
        made.append(likely)
        return linked(likely, full_sets(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()))

    def settle(open_ids: DataFrame, _: DataFrame) -> DataFrame:
        """All links between open documents of different components, whatever their sketches.

        Shingles that documents of one component alone hold count as places only. The others are ranked, the rarest first; a link's first common shingle stands where the
        rest of both documents has room for the overlap they need. The most held component's members of a shingle meet the others only, not one another.
        A bitmap of a document's ranked shingles bounds the overlap from above before sets are fetched.
        """
        open_ids = materialize(open_ids.join(open_ids.groupBy("comp").agg(F.count("*").alias("peers")), "comp"), "open-ids")
        sets = full_sets(open_ids)
        each = open_ids.join(sets.select(F.col("doc_id").alias("id"), "hashes"), "id").select("id", "comp", "peers", F.size("hashes").alias("n"), F.explode("hashes").alias("g"))
        often = each.groupBy("g").agg(F.count("*").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("g", "c")
        own = Window.partitionBy("id")
        bit = lambda w: F.when(F.col("g").bitwiseAND(F.lit(192)) == w * 64, F.expr("shiftleft(1L, cast(g & 63 as int))")).otherwise(F.lit(0))
        ranked = each.join(often, "g").withColumn("total", F.count("*").over(own)).withColumn("left", F.col("total") - F.row_number().over(own.orderBy("c", "g")) + 1)
        for w in range(4):
            ranked = ranked.withColumn(f"m{w}", F.bit_or(bit(w)).over(own))
        front = materialize(ranked.filter(F.col("left") * 100 >= F.col("n") * percent).drop("c"), "fronts")
        leads = front.groupBy("g").agg(F.max(F.struct("peers", "comp")).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("g", F.col("lead.comp").alias("lead"))
        x, y = front.join(leads, "g").filter("comp <> lead").alias("x"), front.alias("y")
        lacks = lambda s, t: sum((F.bit_count(F.col(f"{s}.m{w}").bitwiseAND(F.bitwise_not(f"{t}.m{w}"))) for w in range(4)), F.lit(0))
        most = F.least("x.left", "y.left", F.col("x.total") - lacks("x", "y"), F.col("y.total") - lacks("y", "x"))
        once = (F.col("y.comp") == F.col("x.lead")) | (F.col("x.id") < F.col("y.id"))
        on = (F.col("x.g") == F.col("y.g")) & (F.col("x.comp") != F.col("y.comp")) & once & (most * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)
        pairs = materialize(x.join(y, on).select(*ordered(F.col("x.id"), F.col("y.id"))).distinct(), "rare-pairs")
        made.extend([open_ids, front, pairs])
        return linked(pairs, sets)

    labels = connect_buckets(reps.select(F.explode(bands).alias("key"), "id"), verify, settle)
    by_sig = groups.join(labels, "id", "left").select("sig", F.coalesce("comp", "id").alias("component_id"))
    discard(*made)
    out = all_rows.drop("sketch").join(by_sig, "sig", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, the one of smallest id, of each group of near duplicates; all their columns.

    Repeated rows of a kept document all stay; documents without words are no one's duplicate and stay, as do documents without an id.
    """
    gone = free_name(docs, "gone")
    found = materialize(near_duplicates(docs, k, percent, id_col, text_col).filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone")
    return docs.join(small(found), F.col(f"`{id_col}`").cast("long") == F.col(gone), "left_anti")
