"""Exact top-k inner products by KD-trees per shard.

Vectors become integers, floor(scale * x). A coarse KD-tree, fitted on a bounded sample of at most ``SAMPLE`` vectors, deals every vector to one of at most ``SHARDS``
regions; a region's bounding box is measured over all its vectors. A region is cut by a hash of the id into pieces of about ``PIECE`` vectors, each packed
as one KD-tree with median splits and tight boxes; so a hot region or a vector that repeats many times spreads over many pieces.

A box bounds the inner product of a query with every vector inside: sum over components of max(q*lo, q*hi). First each query visits its best region only;
the k-th best score found there is carried along, and second it visits just those other regions whose bound reaches it. Inside a piece, nodes
are visited best bound first until the bound falls below the k-th score so far. A bound equal to it is still visited, as ties go to the smaller id.
Queries travel in packed blocks, so a task's memory depends neither on the number of queries nor on the number of vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SAMPLE, SHARDS, PIECE, LEAF, BLOCK = 20_000, 4096, 2048, 128, 256
#: Integer components stay below this.
LARGEST = 2.0**52


@contextmanager
def _batches_of(spark, rows: int):
    """Arrow batches of at most so many rows, for rows that hold packed blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, dim)


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(vec_id, dim, v)`` with v the packed int64 components. Rows whose id or vector is null, empty or holds a null or non-finite component are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("x"), strict=True):
                if vec_id is None or not x.is_valid or len(x) == 0 or x.values.null_count:
                    continue
                a = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(a).all():
                    if np.abs(scale * a).max() >= LARGEST or float(np.abs(np.floor(scale * a)).max()) ** 2 * len(a) >= 2.0**63:
                        raise ValueError("a component is too large for integer scores")
                    out.append((vec_id, len(a), np.floor(scale * a).astype("<i8").tobytes()))
            ids, dims, raws = zip(*out, strict=True) if out else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["vec_id", "dim", "v"])

    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return d.mapInArrow(run, "vec_id long, dim int, v binary")


def _coarse_tree(sample: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the split component and value of each node: the widest component, at its median."""
    groups, levels = [sample], []
    for _ in range(depth):
        axis, value, after = [], [], []
        for g in groups:
            a = int(np.argmax(np.ptp(g, axis=0))) if len(g) else 0
            m = np.median(g[:, a]) if len(g) else 0.0
            axis.append(a)
            value.append(m)
            after += [g[g[:, a] <= m], g[g[:, a] > m]] if len(g) else [g, g]
        levels.append((np.array(axis), np.array(value)))
        groups = after
    return levels


def _region(v: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(v), np.int64)
    for axis, value in levels:
        node = 2 * node + (v[np.arange(len(v)), axis[node]] > value[node])
    return node


def _bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest inner product of each query with anything in each box."""
    q, lo, hi = (x.astype(np.float64) for x in (q, lo, hi))
    return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T


def build_tree(ids: np.ndarray, v: np.ndarray) -> dict:
    """Median splits down to ``LEAF`` vectors; ``first, last`` of each node, its children (or -1) and its tight box."""
    order, first, last, left, right, lo, hi = np.argsort(ids, kind="stable"), [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        me, part = len(first), v[order[a:b]]
        low, high = part.min(axis=0), part.max(axis=0)
        for x, y in ((first, a), (last, b), (left, -1), (right, -1), (lo, low), (hi, high)):
            x.append(y)
        axis = int(np.argmax(high - low))
        if b - a > LEAF and high[axis] > low[axis]:
            mid = (a + b) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid - a)]
            left[me], right[me] = node(a, mid), node(mid, b)
        return me

    node(0, len(ids))
    return {"ids": ids[order], "v": v[order], "first": first, "last": last, "left": left, "right": right, "lo": np.array(lo), "hi": np.array(hi)}


def search(tree: dict, qid: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the at most k best vectors, best first, that reach ``floor``; ties to smaller ids; the query's own id left out."""
    wide = float(np.abs(q).max(initial=0)) * float(np.abs(tree["v"]).max(initial=0)) * len(q) >= 2.0**52
    exact = tree["v"] if wide else tree.setdefault("float", tree["v"].astype(np.float64))
    p = q if wide else q.astype(np.float64)
    bound = _bounds(q[None, :], tree["lo"], tree["hi"])[0]
    slack = abs(bound) * 1e-9 if wide else 0 * bound
    bound = bound + slack
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    heap = [(-bound[0], 0)]
    while heap and -heap[0][0] >= floor:
        _, n = heapq.heappop(heap)
        if tree["left"][n] >= 0:
            for c in (tree["left"][n], tree["right"][n]):
                if bound[c] >= floor:
                    heapq.heappush(heap, (-bound[c], c))
            continue
        a, b = tree["first"][n], tree["last"][n]
        score = (exact[a:b] @ p).astype(np.int64)
        ids = tree["ids"][a:b]
        use = (score >= floor) & (ids != qid)
        if use.any():
            best_ids, best = np.concatenate([best_ids, ids[use]]), np.concatenate([best, score[use]])
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
            if len(best) == k:
                floor = max(floor, best[-1])
    return best_ids, best


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``is_query`` (a condition on the id column), the k best other rows by integer inner product.

    Ties go to the smaller vec_id. Rows with a null id, or with a vector that is null, empty or has a null or non-finite component, take no part. Vectors of another
    length than a query's are not compared with it. Rows that share a vec_id are one another's own rows; of such queries the smallest vector asks.
    Components so large that a score could leave the range of a long raise an error. An empty table gives no rows; other columns are not used.
    """
    spark = vectors.sparkSession
    base = materialize(integer_vectors(vectors, id_col, vector_col, scale), "vectors")
    per_dim = {r.dim: r.n for r in base.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()}  # a handful of lengths
    parts = [_top_k_of(base.filter(F.col("dim") == dim), dim, n, is_query, k, id_col) for dim, n in per_dim.items()]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _top_k_of(base: DataFrame, dim: int, count: int, is_query: Column, k: int, id_col: str) -> DataFrame:
    spark = base.sparkSession
    regions = min(SHARDS, max(1, count // (2 * PIECE)))
    depth = int(np.ceil(np.log2(regions)))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()
    levels = _coarse_tree(np.stack([np.frombuffer(x, "<i8") for x in sample["v"]]), depth)

    def boxes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            v = _unpack(b"".join(batch.column("v").to_pylist()), dim)
            node = _region(v, levels)
            for r in np.unique(node):
                own = v[node == r]
                n, lo, hi = found.get(r, (0, own[0], own[0]))
                found[r] = n + len(own), np.minimum(lo, own.min(axis=0)), np.maximum(hi, own.max(axis=0))
        rows = [(int(r), n, lo.tolist(), hi.tolist()) for r, (n, lo, hi) in found.items()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["region", "n", "lo", "hi"])

    box = base.select("v").mapInArrow(boxes_of, "region long, n long, lo array<long>, hi array<long>")
    ends = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(dim)]
    box = box.groupBy("region").agg(F.sum("n").alias("n"), *ends).toPandas().sort_values("region")  # at most SHARDS rows
    names = box["region"].to_numpy()
    lo, hi = (box[[f"{c}{i}" for i in range(dim)]].to_numpy() for c in ("lo", "hi"))
    pieces = dict(zip(names.tolist(), (-(-box["n"] // PIECE)).tolist(), strict=True))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unpack(b"".join(batch.column("v").to_pylist()), dim)
            node = _region(v, levels) if len(v) else np.empty(0, np.int64)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False).astype(np.uint64)
            mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            piece = (mixed % np.array([pieces[r] for r in node.tolist()], np.uint64) if len(v) else ids).astype(np.int64)
            yield pa.record_batch([pa.array(node), pa.array(piece), batch.column("vec_id"), batch.column("v")], names=["region", "piece", "vec_id", "v"])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        return pd.DataFrame({"region": [first["region"]], "ids": [group["vec_id"].to_numpy("<i8").tobytes()], "vs": [b"".join(group["v"])]})

    placed = base.mapInArrow(place, "region long, piece long, vec_id long, v binary")
    packed = materialize(placed.groupBy("region", "piece").applyInPandas(pack, "region long, ids binary, vs binary"), "pieces")
    queries = base.withColumnRenamed("vec_id", id_col).filter(is_query).withColumnRenamed(id_col, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(queries, "queries")

    def ask(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, len(whole), BLOCK):
                    batch = whole.slice(at, BLOCK)
                    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
                    v = _unpack(b"".join(batch.column("v").to_pylist()), dim)
                    reach = _bounds(v, lo, hi)
                    reach = reach + np.abs(reach) * 1e-12
                    best = reach.argmax(axis=1)
                    floor = np.array([-np.inf if x is None else float(x) for x in batch.column("floor").to_pylist()])
                    for r in range(len(names)):
                        use = (best != r) & (reach[:, r] >= floor) if second else best == r
                        if use.any():
                            yield pa.record_batch([pa.array([int(names[r])]), pa.array([ids[use].astype("<i8").tobytes()], pa.binary()), pa.array([v[use].tobytes()], pa.binary()), pa.array([floor[use].tobytes()], pa.binary())], names=["region", "q_ids", "q_vs", "floors"])

        return run

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = build_tree(np.frombuffer(row["ids"], "<i8"), _unpack(row["vs"], dim))
                out_q, out_v, out_s = [], [], []
                for qid, q, floor in zip(np.frombuffer(row["q_ids"], "<i8"), _unpack(row["q_vs"], dim), np.frombuffer(row["floors"]), strict=True):
                    ids, scores = search(tree, qid, q, k, floor)
                    out_q.append(np.full(len(ids), qid))
                    out_v.append(ids)
                    out_s.append(scores)
                yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_q, out_v, out_s)], names=["query_id", "vec_id", "score"])

    def visit(q: DataFrame, second: bool, name: str) -> DataFrame:
        asked = q.mapInArrow(ask(second), "region long, q_ids binary, q_vs binary, floors binary")
        pairs = packed.join(asked, "region").select("ids", "vs", "q_ids", "q_vs", "floors")
        with _batches_of(spark, 32):
            return materialize(pairs.mapInArrow(answer, "query_id long, vec_id long, score long"), name)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    with _batches_of(spark, BLOCK):
        near = visit(queries.withColumn("floor", F.lit(None).cast("long")), False, "first-visit")
        kth = near.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        far = visit(queries.join(kth, "vec_id", "left").select("vec_id", "v", "floor"), True, "second-visit")
    both = near.union(far).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return both.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
