"""Histograms, distributions, entropy. All bin before the shuffle, so partial aggregation sends at most one row a bin and task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import luminance as luma


def bin_of(v: str | Column, bins: int = 256, low: float = 0.0, high: float = 256.0) -> Column:
    """Number of the bin; the last one is closed at ``high``. Null outside and for NaN."""
    v = F.col(v) if isinstance(v, str) else v
    inside = (v >= low) & (v <= high) & ~F.isnan(v)
    return F.when(inside, F.least(F.floor((v - low) / F.lit((high - low) / bins)), F.lit(bins - 1)).cast("int"))


def histogram(samples: DataFrame, bins: int = 256, value_range: tuple[float, float] = (0.0, 256.0), fill: bool = False) -> DataFrame:
    """``image_id, channel, bin, lo, hi, n``; empty bins appear only with ``fill``."""
    low, high = value_range
    h = samples.withColumn("bin", bin_of("v", bins, low, high)).filter("bin is not null").groupBy("image_id", "channel", "bin").agg(F.count("*").alias("n"))
    if fill:
        every = samples.select("image_id", "channel").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        h = every.join(h, ["image_id", "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    width = (high - low) / bins
    return h.select("image_id", "channel", "bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), "n")


def scanline_histogram(scanlines: DataFrame, bins: int = 256, value_range: tuple[float, float] = (0.0, 256.0)) -> DataFrame:
    """``histogram`` of scanline arrays: NumPy counts a batch of lines at once, and only counts leave it."""
    low, high = value_range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.dictionary_encode(batch.column("image_id"), null_encoding="encode")
            channels = pc.dictionary_encode(batch.column("channel"), null_encoding="encode")
            line = ids.indices.to_numpy().astype(np.int64) * len(channels.dictionary) + channels.indices.to_numpy()
            lengths = pc.fill_null(pc.list_value_length(batch.column("v")), 0).to_numpy()
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null is NaN here
            with np.errstate(invalid="ignore"):
                inside = (v >= low) & (v <= high)
            cell = np.minimum(np.floor((v[inside] - low) / ((high - low) / bins)).astype(np.int64), bins - 1)
            keys, n = np.unique(np.repeat(line, lengths)[inside] * bins + cell, return_counts=True)
            of, cell = np.divmod(keys, bins)
            first, second = np.divmod(of, max(1, len(channels.dictionary)))
            columns = [ids.dictionary.take(pa.array(first)), channels.dictionary.take(pa.array(second)), pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64))]
            yield pa.record_batch(columns, names=["image_id", "channel", "bin", "n"])

    counts = scanlines.select("image_id", "channel", "v").mapInArrow(run, "image_id long, channel string, bin int, n long").groupBy("image_id", "channel", "bin").agg(F.sum("n").alias("n"))
    width = (high - low) / bins
    return counts.select("image_id", "channel", "bin", (low + F.col("bin") * width).alias("lo"), (low + (F.col("bin") + 1) * width).alias("hi"), "n")


def combined_histogram(samples: DataFrame, channels: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    """Each channel's counts and, as channel ``Total``, the sum over ``channels``, in one grouping-sets pass."""
    if not channels:
        raise ValueError("no channel to combine")
    d = samples.filter(F.col("channel").isin(*channels)).withColumn("bin", bin_of("v")).filter("bin is not null")
    g = d.groupingSets([["image_id", "channel", "bin"], ["image_id", "bin"]], "image_id", "channel", "bin").agg(F.count("*").alias("n"))
    return g.select("image_id", F.coalesce("channel", F.lit("Total")).alias("channel"), "bin", "n")


def luminance_histogram(pixels: DataFrame) -> DataFrame:
    """Blended per pixel, then counted."""
    return histogram(pixels.select("image_id", F.lit("Y").alias("channel"), luma().alias("v")))


def catalog_histograms(pixels: DataFrame) -> DataFrame:
    """R, G, B, luminance ``Y`` and ``Total`` (of R, G, B alone) of each image: one pass over the pixels and one shuffle of counts."""
    bins = F.array(*(F.struct(F.lit(n).alias("channel"), bin_of(v).alias("bin")) for n, v in (("R", "r"), ("G", "g"), ("B", "b"), ("Y", luma()))))
    counts = pixels.select("image_id", F.explode(bins).alias("e")).filter("e.bin is not null").groupBy("image_id", "e.channel", "e.bin").agg(F.count("*").alias("n"))
    shown = F.when(F.col("channel") == "Y", F.array("channel")).otherwise(F.array("channel", F.lit("Total")))
    return counts.select("image_id", F.explode(shown).alias("channel"), "bin", "n").groupBy("image_id", "channel", "bin").agg(F.sum("n").alias("n"))


def histogram_pdf(samples: DataFrame) -> DataFrame:
    whole = Window.partitionBy("image_id", "channel")
    n = samples.groupBy("image_id", "channel").agg(F.count("*").alias("total"))
    return histogram(samples).join(n, ["image_id", "channel"]).select("image_id", "channel", "bin", (F.col("n") / F.col("total")).alias("p"), F.sum("n").over(whole).alias("counted"))


def compare_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two images' histograms side by side, zero where a bin is missing."""
    h = histogram(a).select("channel", "bin", F.col("n").alias("n_a")).join(histogram(b).select("channel", "bin", F.col("n").alias("n_b")), ["channel", "bin"], "full")
    return h.select("channel", "bin", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def value_distribution(samples: DataFrame, low: int = -128, high: int = 255) -> DataFrame:
    """Share of each integer value, clipped to [low, high]."""
    v = F.greatest(F.lit(low), F.least(F.lit(high), F.col("v").cast("int")))
    n = samples.groupBy("image_id", "channel", v.alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("image_id", "channel")))


def entropy(samples: DataFrame) -> DataFrame:
    """Bits per value over the distinct values of each image."""
    n = samples.groupBy("image_id", "v").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("image_id"))
    return n.withColumn("p", p).groupBy("image_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("bits"))


def near_zero_fraction(samples: DataFrame, t: float = 2) -> DataFrame:
    return samples.groupBy("image_id").agg((100 * F.avg(F.when(F.abs("v") <= t, 1.0).otherwise(0.0))).alias("percent"))


def prefix_histogram(samples: DataFrame) -> DataFrame:
    """For each image row y, the counts of rows 0 to y of every bin that occurs in the image."""
    counts = samples.withColumn("bin", bin_of("v")).filter("bin is not null").groupBy("image_id", "channel", "y", "bin").agg(F.count("*").alias("n"))
    rows, bins = samples.select("image_id", "channel", "y").distinct(), counts.select("image_id", "channel", "bin").distinct()
    grid = rows.join(bins, ["image_id", "channel"]).join(counts, ["image_id", "channel", "y", "bin"], "left")
    so_far = Window.partitionBy("image_id", "channel", "bin").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return grid.select("image_id", "channel", "y", "bin", F.sum(F.coalesce("n", F.lit(0))).over(so_far).alias("n"))
