"""Neighbourhood work in bands: each image is cut into bands of rows, every row goes to the bands whose padded range needs it, and NumPy sees one padded band at a time.

One shuffle, with a copy factor of about 1 + 2 * radius / band; a large image spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import reflected
from .planes import lines_of, map_groups, repeated, scanline_array

#: Bytes of padded bands' rows that are stacked.
STACK = 1 << 20
#: How NumPy names the two borders.
PAD = {"reflect": "reflect", "replicate": "edge"}


def padded_columns(block: np.ndarray, radius: int, border: str) -> np.ndarray:
    """Pad left and right; a mirror that must fold more than once is folded as often as needed."""
    n = block.shape[1]
    i = np.arange(-radius, n + radius)
    if border == "replicate":
        i = np.clip(i, 0, n - 1)
    elif n == 1:
        i[:] = 0
    else:
        i = np.mod(i, 2 * (n - 1))
        i = np.where(i < n, i, 2 * (n - 1) - i)
    return block[:, i]


def halo_map(scanlines: DataFrame, fn: Callable[[np.ndarray], np.ndarray], radius: int, border: str = "reflect", band: int | None = None, joint: tuple[str, ...] | None = None, stacked: bool = False) -> DataFrame:
    """``fn(padded band) -> central rows`` on every plane of ``image_id, channel, y, v``.

    The padded band has ``radius`` more rows and columns on each side. With ``joint`` (channel names) fn gets and returns arrays of shape (channels, rows, columns), and with ``stacked`` many bands of
    one size at once, of shape (channels, bands, rows, columns): small images cost a share of a call.
    """
    band = band or max(64, 4 * radius)
    keys = ["image_id"] if joint else ["image_id", "channel"]
    heights = scanlines.groupBy("image_id").agg((F.max("y") + 1).alias("height"))
    rows = scanlines.join(heights, "image_id")
    outside = F.concat(F.sequence(F.lit(-radius), F.lit(-1)), F.transform(F.sequence(F.lit(0), F.lit(radius - 1)), lambda i: i + F.col("height"))) if radius else F.array().cast("array<int>")
    source = (lambda p: F.greatest(F.lit(0), F.least(p, F.col("height") - 1))) if border == "replicate" else (lambda p: reflected(p, F.col("height")))
    near_edge = (F.col("y") <= radius) | (F.col("y") >= F.col("height") - 1 - radius)
    places = F.concat(F.array("y"), F.when(near_edge, F.filter(outside, lambda p: source(p) == F.col("y"))).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("p", F.explode(places))
    last = F.floor((F.col("height") - 1) / band)
    first_band, last_band = F.greatest(F.lit(0), F.floor((F.col("p") - radius) / band)), F.least(last, F.floor((F.col("p") + radius) / band))
    rows = rows.withColumn("band", F.explode(F.sequence(first_band.cast("int"), last_band.cast("int"))))

    names = list(joint) if joint else None

    def cut(group: pa.RecordBatch) -> tuple[int, int, np.ndarray]:
        at = group.column("band")[0].as_py() * band
        n = min(band, group.column("height")[0].as_py() - at)
        p, v = group.column("p").to_numpy(), lines_of(group)
        inside = (p >= at - radius) & (p < at + n + radius)
        if names:
            channel = np.array(group.column("channel").to_pylist(), object)
            return at, n, np.stack([padded_columns(v[inside & (channel == name)], radius, border) for name in names])
        return at, n, padded_columns(v[inside], radius, border)

    def shown(group: pa.RecordBatch, at: int, n: int, out: np.ndarray) -> list[pa.RecordBatch]:
        made = []
        for i, plane in enumerate(out if names else out[None]):
            channel = pa.repeat(names[i], n) if names else repeated(group, "channel", n)
            made.append(pa.record_batch([repeated(group, "image_id", n), channel, pa.array(np.arange(at, at + n, dtype=np.int32)), scanline_array(plane)], names=["image_id", "channel", "y", "v"]))
        return made

    def run(group: pa.RecordBatch) -> list[pa.RecordBatch]:
        at, n, block = cut(group)
        return shown(group, at, n, np.asarray(fn(block), np.float64))

    def run_stacked(groups: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        made, sizes = [], {}
        for group in groups:
            at, n, block = cut(group)
            sizes.setdefault(block.shape, []).append((group, at, n, block))
        for same in sizes.values():
            out = np.asarray(fn(np.stack([block for *_, block in same], axis=1)), np.float64)
            for k, (group, at, n, _) in enumerate(same):
                made += shown(group, at, n, out[:, k])
        return made

    if stacked and not names:
        raise ValueError("bands are stacked by channels")
    rows = rows.select("image_id", "channel", "height", "band", "p", F.col("v").cast("array<double>"))
    return map_groups(rows, [*keys, "band"], ["channel", "p"], run_stacked if stacked else run, "image_id long, channel string, y int, v array<double>", together=STACK * stacked)


def apply_channels(scanlines: DataFrame, fn: Callable[..., np.ndarray], **kw) -> DataFrame:
    """A user's single-plane function on each whole plane (an image has at most four million pixels); see ``halo_map`` for functions of a bounded neighbourhood."""

    def run(group: pa.RecordBatch) -> list[pa.RecordBatch]:
        out = np.asarray(fn(lines_of(group), **kw), np.float64)
        columns = [repeated(group, "image_id", len(out)), repeated(group, "channel", len(out)), pa.array(np.arange(len(out), dtype=np.int32)), scanline_array(out)]
        return [pa.record_batch(columns, names=["image_id", "channel", "y", "v"])]

    return map_groups(scanlines.select("image_id", "channel", "y", F.col("v").cast("array<double>")), ["image_id", "channel"], ["y"], run, "image_id long, channel string, y int, v array<double>")
