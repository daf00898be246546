"""Groups of rows as NumPy arrays, many of them in one call of Python.

Rows are dealt by their keys and sorted inside each partition, so a group's rows follow one another; what a task holds at a time is one Arrow batch and the group that crosses its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that goes back to Spark, or one larger group.
ROWS = 65_536


def _changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    moved = np.zeros(max(0, batch.num_rows - 1), bool)
    for k in keys:
        code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy()
        moved |= code[1:] != code[:-1]
    return np.flatnonzero(moved) + 1


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each group; groups follow one another in ``batches``. The slices of a group that crosses batches are joined once, when it ends."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield whole()
            held = []
        ends = [0, *_changes(batch, keys).tolist(), batch.num_rows]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield whole()
                held = []
    if held:
        yield whole()


def lines_of(group: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """A column of equally long arrays as one two-dimensional array."""
    return group.column(column).flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)


def scanline_array(plane: np.ndarray) -> pa.Array:
    h, w = plane.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (h + 1) * w, w, dtype=np.int32) if w else np.zeros(h + 1, np.int32)), pa.array(np.ascontiguousarray(plane, np.float64).reshape(-1)))


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[..., list[pa.RecordBatch]], schema: str, dealt: bool = False, together: int = 0) -> DataFrame:
    """``fn(rows of a group) -> batches`` for every group of ``keys``, its rows in ``order``. ``dealt``: the plan below keeps a group's rows in one partition already, as a window over some of the keys does.
    ``together``: ``fn`` gets a list of groups that have that many bytes or were the last, for functions that treat many small ones at once.

    The literal keeps the exchange. Spark leaves one out that a join by the same keys below makes needless, but does not keep that join's partitions where it then broadcasts a side, so groups came in pieces.
    """

    def made_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        held, weight = [], 0
        for group in groups(batches, keys):
            if not together:
                yield fn(group)
                continue
            held.append(group)
            weight += group.nbytes
            if weight >= together:
                yield fn(held)
                held, weight = [], 0
        if held:
            yield fn(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, size = [], 0
        for made in made_of(batches):
            done += made
            size += sum(b.num_rows for b in made)
            if size >= ROWS:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                done, size = [], 0
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return (df if dealt else df.repartition(*keys, F.lit(0))).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def repeated(group: pa.RecordBatch, column: str, n: int) -> pa.Array:
    """The group's value of a column, n times."""
    one = group.column(column)
    return pa.repeat(one[0], n) if one[0].is_valid else pa.nulls(n, one.type)
