"""Whitening of embeddings on their distinct vectors.

Components become integers, floor(scale * c) + shift. Equal integer vectors are one group with its count as weight; sums, covariance and whitening are
computed once a distinct vector, and the rows take their group's result by a digest of the vector. Vectors that hold a two-hundredth of all rows or more,
which are two hundred at most, are looked up by broadcast, the others by a shuffled join.

The mean is the exact rational S/n: whole part and remainder are taken off one after the other, so centred components are exact to the last bit of a double.
The covariance is a weighted product of centred blocks, one matrix a task, added up row by row in tasks of their own; only dimension x dimension numbers
come to the driver, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A vector that holds at least one in so many rows is looked up by broadcast.
HOT = 200
#: Eigenvalues below this share of the largest count as zero: there the vectors do not vary, and nothing can be whitened.
FLAT = 1e-11


def _integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """``vec_id, dim, x`` of every row that takes part."""
    c = F.col("c")
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("c"))
    d = d.where(c.isNotNull() & (F.size("c") > 0)).where(F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    too_large = F.raise_error(F.lit("a component is too large to become an integer")).cast("long")
    x = F.transform("c", lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale) + shift).otherwise(too_large))
    return d.select("vec_id", F.size("c").alias("dim"), x.alias("x"))


def _digest(x: str):
    return F.unhex(F.sha2(F.array_join(F.col(x).cast("array<string>"), ","), 256))


def _blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """For each vector length of each batch: the length, its rows, and their vectors as a matrix."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch if (dims == dim).all() else batch.take(pa.array(np.flatnonzero(dims == dim)))
            values = own.column(column).flatten().to_numpy()
            yield dim, own, values.reshape(len(own), -1)


def _exact_sums(groups: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each vector length: the number of rows and the exact sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for dim, own, x in _blocks(batches, "x"):
            w = own.column("weight").to_numpy()
            if float(np.abs(x).max()) * float(w.sum()) >= 2.0**62:
                x, w = x.astype(object), w.astype(object)
            part = w @ x
            n, old = total.get(dim, (0, [0] * dim))
            total[dim] = n + int(w.sum()), [a + int(b) for a, b in zip(old, part, strict=True)]
        rows = [(dim, k, n, Decimal(v)) for dim, (n, values) in total.items() for k, v in enumerate(values)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)), strict=True)], names=["dim", "k", "n", "total"])

    out: dict[int, tuple[int, list[int]]] = {}
    parts = groups.select("dim", "weight", "x").mapInArrow(run, "dim int, k int, n long, total decimal(38,0)")
    for r in parts.groupBy("dim", "k").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim", "k").collect():  # a row a component
        out.setdefault(r.dim, (r.n, []))[1].append(int(r.total))
    return out


def _matrices(table: DataFrame, column: str, make: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """For each vector length the sum over blocks of ``make(dim, weights, vectors)``, a matrix; every row of it is added up in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, own, v in _blocks(batches, column):
            part = make(dim, own.column("weight").to_numpy(), v)
            total[dim] = total[dim] + part if dim in total else part
        rows = [(dim, k, row.tolist()) for dim, m in total.items() for k, row in enumerate(m)]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.float64())), strict=True)], names=["dim", "k", "part"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": rows["dim"].iloc[:1], "k": rows["k"].iloc[:1], "part": [np.sum(np.stack(rows["part"].to_list()), axis=0)]})

    parts = table.select("dim", "weight", column).mapInArrow(run, "dim int, k int, part array<double>")
    out: dict[int, list] = {}
    for r in parts.groupBy("dim", "k").applyInPandas(add, "dim int, k int, part array<double>").orderBy("dim", "k").collect():  # dimension x dimension numbers
        out.setdefault(r.dim, []).append(r.part)
    return {dim: np.array(rows) for dim, rows in out.items()}


class _Fit:
    """Mean, components and eigenvalues of the vectors of one length."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([s // n for s in sums], np.int64)
        self.left = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.left / self.n

    def decompose(self, product: np.ndarray, most: int) -> None:
        e, q = np.linalg.eigh(product / self.n)
        e, q = e[::-1], q[:, ::-1]
        k = min(most, int((e > FLAT * max(e[0], 0)).sum())) if e[0] > 0 else 0
        q = q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])  # the largest entry is positive
        self.turn = q[:, :k] / np.sqrt(e[:k])
        self.explained = (e[:k] / np.trace(product / self.n)).tolist()

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n*x - S)^2, exact; None beyond the range of a long."""
        off = x - self.whole
        if (float(np.abs(off).max(initial=0)) + 1) ** 2 * float(self.n) ** 2 * x.shape[1] < 2.0**62:
            return ((self.n * off - self.left) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.left.tolist(), strict=True)) for row in off.tolist()]
        return [v if v < 1 << 63 else None for v in exact]


def whiten_vectors(vectors: DataFrame, most: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error``: each vector on at most ``most`` whitened principal components of all vectors.

    ``whitened`` and ``explained`` (eigenvalue over trace) are arrays by falling eigenvalue; ``n`` the number of vectors; ``deviation`` the exact sum of (n*x - S)^2, null
    beyond the range of a long; ``identity_error`` the largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out; a finite entry of 2^52/scale or more raises an error. A null or
    repeated id is kept as it is, repeated rows count as often as they occur. Directions in which the vectors do not vary (eigenvalue below 1e-11 of the largest)
    have no component, so a table of one vector has empty arrays. Vectors of each length are a fit of their own. An empty table gives no rows; other columns are not used.
    """
    spark = vectors.sparkSession
    rows = _integers(vectors, id_col, vector_col, scale, shift)
    groups = materialize(rows.groupBy("dim", "x").agg(F.count("*").alias("weight")).withColumn("key", _digest("x")), "distinct-vectors")
    fits = {dim: _Fit(n, sums) for dim, (n, sums) in _exact_sums(groups).items()}

    def product(dim: int, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        c = fits[dim].centred(x)
        return (c * w[:, None]).T @ c

    for dim, m in _matrices(groups, "x", product).items():
        fits[dim].decompose(m, most)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, own, x in _blocks(batches, "x"):
            z = fits[dim].centred(x) @ fits[dim].turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.record_batch([own.column("dim"), own.column("key"), own.column("weight"), lists, pa.array(fits[dim].deviation(x), pa.int64())], names=["dim", "key", "weight", "whitened", "deviation"])

    turned = materialize(groups.mapInArrow(turn, "dim int, key binary, weight long, whitened array<double>, deviation long"), "whitened")
    means = {dim: m[0] / fits[dim].n for dim, m in _matrices(turned, "whitened", lambda dim, w, z: (w @ z)[None, :]).items()}

    def spread(dim: int, w: np.ndarray, z: np.ndarray) -> np.ndarray:
        c = z - means[dim]
        return (c * w[:, None]).T @ c

    errors = {dim: float(np.abs(m / fits[dim].n - np.eye(len(m))).max(initial=0)) for dim, m in _matrices(turned, "whitened", spread).items()}
    facts = spark.createDataFrame([(dim, f.n, f.explained, errors.get(dim, 0.0)) for dim, f in fits.items()], "dim int, n long, explained array<double>, identity_error double")
    turned = turned.join(F.broadcast(facts), "dim")  # a row a vector length
    hot = F.col("weight") * HOT >= F.col("n")
    keyed = materialize(rows.select("vec_id", "dim", _digest("x").alias("key")), "vector-keys")
    frequent = F.broadcast(turned.where(hot))  # at most HOT rows a vector length
    out = keyed.join(frequent, ["dim", "key"]).unionByName(keyed.join(frequent.select("dim", "key"), ["dim", "key"], "left_anti").join(turned.where(~hot), ["dim", "key"]))
    return out.select("vec_id", "n", "deviation", "whitened", "explained", "identity_error")


def component_rows(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "z")
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", each)
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("z.whitened").alias("whitened"), F.col("z.explained").alias("explained"), "identity_error")
