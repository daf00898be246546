"""Separating, merging and transforming channels. Pixels: ``image_id, y, x, r, g, b``; samples: ``image_id, channel, y, x, v``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color

CELL = ("image_id", "y", "x")


def split_channels(pixels: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One row for each channel of each pixel; ``names`` maps columns to channel names."""
    names = names or {"r": "R", "g": "G", "b": "B"}
    parts = ", ".join(f"'{name}', {column}" for column, name in names.items())
    return pixels.select(*CELL, F.expr(f"stack({len(names)}, {parts}) as (channel, v)")).select("image_id", "channel", "y", "x", "v")


def merge_channels(samples: DataFrame, names: tuple[str, ...] = ("R", "G", "B")) -> DataFrame:
    merged = samples.groupBy(*CELL).pivot("channel", list(names)).agg(F.first("v"))
    return merged.select(*CELL, *(F.col(n).alias(n.lower()) for n in names))


def channel_as_grayscale(samples: DataFrame) -> DataFrame:
    return samples.withColumn("v", color.displayed("v"))


def channel_as_color(pixels: DataFrame, channel: str) -> DataFrame:
    """The chosen channel clipped and truncated, the others zero."""
    return pixels.select(*CELL, *((color.displayed(c) if c == channel.lower() else F.lit(0)).alias(c) for c in "rgb"))


def quantize(pixels: DataFrame) -> DataFrame:
    return pixels.select(*CELL, *(color.quantized(c).alias(c) for c in "rgb"))


def luminance(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", F.lit("Y").alias("channel"), "y", "x", color.luminance().alias("v"))


def rgb_to_ycbcr(pixels: DataFrame) -> DataFrame:
    """``yy, cb, cr``; pixels outside [0, 255] are an error of their image (see ``validate_images`` with limits) and are left out here."""
    inside = F.least("r", "g", "b") >= 0
    y, cb, cr = color.ycbcr()
    return pixels.filter(inside & (F.greatest("r", "g", "b") <= 255)).select(*CELL, y.alias("yy"), cb.alias("cb"), cr.alias("cr"))


def to_gray8(pixels: DataFrame) -> DataFrame:
    return quantize(pixels).select(*CELL, color.gray8().alias("v"))


def gray8_lines(lines: DataFrame) -> DataFrame:
    """``image_id, y, v``: the gray bytes of each image line, from ``image_id, y, r, g, b`` of arrays. Nothing is shuffled, and no sample becomes a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, g, b = (np.rint(np.clip(batch.column(c).flatten().to_numpy(zero_copy_only=False), 0, 255)).astype(np.int32) for c in "rgb")
            gray = ((r * 9798 + g * 19235 + b * 3735 + 16384) >> 15).astype(np.uint8)
            offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("r")).to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.record_batch([batch.column("image_id"), batch.column("y"), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(gray)])], names=["image_id", "y", "v"])

    doubles = (F.col(c).cast("array<double>").alias(c) for c in "rgb")
    return lines.select("image_id", "y", *doubles).mapInArrow(run, "image_id long, y int, v binary")


def rgb_to_lab8(pixels: DataFrame) -> DataFrame:
    level, a, b = color.lab8()
    return pixels.select(*CELL, level.alias("l"), a.alias("a"), b.alias("b"))


def lab8_to_rgb(lab: DataFrame) -> DataFrame:
    r, g, b = color.rgb_of_lab8("l", "a", "b")
    return lab.select(*CELL, r.alias("r"), g.alias("g"), b.alias("b"))


def color_difference(pixels: DataFrame) -> DataFrame:
    """Reversible: (R - G, G, B - G) as integers."""
    q = quantize(pixels)
    return q.select(*CELL, (F.col("r") - F.col("g")).alias("r"), "g", (F.col("b") - F.col("g")).alias("b"))


def inverse_color_difference(pixels: DataFrame) -> DataFrame:
    return pixels.select(*CELL, (F.col("r") + F.col("g")).alias("r"), "g", (F.col("b") + F.col("g")).alias("b"))


def zigzag(samples: DataFrame) -> DataFrame:
    return samples.withColumn("v", color.zigzag(F.col("v").cast("long")))


def unzigzag(samples: DataFrame) -> DataFrame:
    return samples.withColumn("v", color.unzigzag(F.col("v").cast("long")))


def byte_planes(samples: DataFrame) -> DataFrame:
    """Four rows a sample: ``plane`` 0 (lowest) to 3 and its byte."""
    planes = F.array(*(F.shiftrightunsigned(F.col("v").cast("long"), 8 * p).bitwiseAND(F.lit(255)).cast("int") for p in range(4)))
    return samples.select("image_id", "channel", "y", "x", F.posexplode(planes).alias("plane", "byte"))


def amplified_diff(a: DataFrame, b: DataFrame, factor: float = 4.0) -> DataFrame:
    """Clipped, truncated factor * abs(a - b) of the samples of two images."""
    keys = ["image_id", "channel", "y", "x"]
    return a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "q"), keys).select(*keys, color.displayed(F.abs(F.col("p") - F.col("q")) * factor).alias("v"))


def normalize_spectrum(samples: DataFrame, keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """Into [0, 1] by the least and greatest value over ``keys`` (channels share them); zeros where flat."""
    ends = samples.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(0.0)
    return samples.join(ends, list(keys)).withColumn("v", scaled).drop("lo", "hi")


def stretch_chroma(ycbcr: DataFrame, gain: float = 5.0) -> DataFrame:
    return ycbcr.select(*CELL, "yy", *((128 + (F.col(c) - 128) * gain).alias(c) for c in ("cb", "cr")))


def crop(df: DataFrame, y0: int, x0: int, height: int, width: int) -> DataFrame:
    inside = F.col("y").between(y0, y0 + height - 1) & F.col("x").between(x0, x0 + width - 1)
    return df.filter(inside).withColumn("y", F.col("y") - y0).withColumn("x", F.col("x") - x0)


def channel_subset(samples: DataFrame, channels: tuple[str, ...]) -> DataFrame:
    """One or two of R, G, B."""
    if not 1 <= len(set(channels)) <= 2 or set(channels) - set("RGB"):
        raise ValueError("choose one or two of R, G, B")
    return samples.filter(F.col("channel").isin(*channels))


def stack_color_spaces(pixels: DataFrame) -> DataFrame:
    """R, G, B and Y, Cb, Cr samples of each image in one table."""
    return split_channels(pixels).unionByName(split_channels(rgb_to_ycbcr(pixels), {"yy": "Y", "cb": "Cb", "cr": "Cr"}))


def remove_mean(samples: DataFrame) -> DataFrame:
    """Each plane less its mean."""
    return samples.withColumn("v", F.col("v") - F.avg("v").over(Window.partitionBy("image_id", "channel")))
