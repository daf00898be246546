"""Reading image files, generated images, scanline tables, BMP encoding and validation."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PIXELS = 4_000_000


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(scanlines, quarantine)`` of a folder of image files.

    scanlines: ``image_id, origin, channel, y, v``; BGR bytes become R, G and B, an alpha channel is dropped, gray is repeated. quarantine: ``origin, error`` of unreadable files.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*").withColumn("image_id", F.xxhash64("origin"))
    bad = raw.filter("height < 0").select("origin", F.lit("unreadable image").alias("error"))

    def rows(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                for name, c in zip("RGB", (2, 1, 0) if r.nChannels >= 3 else (0, 0, 0), strict=True):
                    yield pd.DataFrame({"image_id": r.image_id, "origin": r.origin, "channel": name, "y": np.arange(r.height, dtype=np.int32), "v": list(a[:, :, c].astype(np.float64))})

    good = raw.filter("height > 0").select("image_id", "origin", "height", "width", "nChannels", "data")
    return good.mapInPandas(rows, "image_id long, origin string, channel string, y int, v array<double>"), bad


def to_scanlines(samples: DataFrame) -> DataFrame:
    """``image_id, channel, y, x, v`` -> ``image_id, channel, y, v array``, in order of x."""
    line = F.array_sort(F.collect_list(F.struct("x", "v")))
    return samples.groupBy("image_id", "channel", "y").agg(F.transform(line, lambda p: p["v"]).alias("v"))


def to_samples(scanlines: DataFrame) -> DataFrame:
    return scanlines.select("image_id", "channel", "y", F.posexplode("v").alias("x", "v"))


def write_scanlines(scanlines: DataFrame, path: str, buckets: int = 16) -> None:
    """Store display values (clipped, then truncated), in folders by a hash bucket of the image."""
    shown = F.transform("v", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("short"))
    scanlines.select("image_id", "channel", "y", shown.alias("v"), F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int").alias("bucket")).write.partitionBy("bucket").parquet(path)


def read_scanlines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("image_id", "channel", "y", F.col("v").cast("array<double>").alias("v"))


def save_scanlines(scanlines: DataFrame, table: str, path: str | None = None, buckets: int = 16, dealt: bool = False) -> DataFrame:
    """Store scanlines as a table bucketed by image and sorted by image, channel and line, one file a bucket, and return the table.

    Two such tables of as many buckets are joined by line, and grouped by image, without an exchange. The one exchange is here, and none with ``dealt``: lines that were read from such a table and
    changed in place lie right already. Choose ``buckets`` so that one holds about a gigabyte. Values are display values (clipped, then truncated), kept as shorts.
    """
    v = F.col("v")
    clipped = F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), x)).cast("short"))
    shown = F.when((F.array_min(v) >= 0) & (F.array_max(v) <= 255), v.cast("array<short>")).otherwise(clipped)  # most lines need no clipping
    lines = scanlines.select("image_id", "channel", "y", shown.alias("v"))
    writer = (lines if dealt else lines.repartition(buckets, "image_id")).write.bucketBy(buckets, "image_id").sortBy("image_id", "channel", "y").format("parquet")
    (writer.option("path", f"{path}/{table}") if path else writer).saveAsTable(table)
    return scanlines.sparkSession.table(table)


def _grid(spark: SparkSession, n: int, size: int) -> DataFrame:
    cell = spark.range(n * size * size)
    return cell.select(F.expr(f"id div {size * size}").alias("image_id"), F.expr(f"cast((id % {size * size}) div {size} as int)").alias("y"), F.expr(f"cast(id % {size} as int)").alias("x"))


def gen_gradient_circle(spark: SparkSession, n: int, size: int = 256) -> DataFrame:
    """Red grows to the right, green downwards, blue falls along the diagonal; a white disc (border excluded) right of and above the centre."""
    x, y, unit = F.col("x").cast("double"), F.col("y").cast("double"), 255.0 / max(size - 1, 1)
    disc = (x - size * 0.7) * (x - size * 0.7) + (y - size * 0.3) * (y - size * 0.3) < (size * 0.15) ** 2
    put = lambda v: F.when(disc, F.lit(255.0)).otherwise(v)
    return _grid(spark, n, size).select("image_id", "y", "x", put(x * unit).alias("r"), put(y * unit).alias("g"), put(255 - (x * unit + y * unit) / 2).alias("b"))


def gen_stripes(spark: SparkSession, n: int, size: int = 256) -> DataFrame:
    """Vertical stripes, 255 where a sine of period 8 is positive; green is red moved eight columns to the right, blue is constant."""
    wave = lambda x: F.when(F.sin(x * math.pi / 4) > 0, 255.0).otherwise(0.0)
    return _grid(spark, n, size).select("image_id", "y", "x", wave(F.col("x").cast("double")).alias("r"), wave(F.pmod(F.col("x") - 8, F.lit(size)).cast("double")).alias("g"), F.lit(128.0).alias("b"))


def gen_radial(spark: SparkSession, n: int, size: int = 256) -> DataFrame:
    """Clipped distance from the centre as green, its complement as red, blue constant."""
    c = size / 2
    d = F.least(F.lit(255.0), F.sqrt((F.col("y") - c) * (F.col("y") - c) + (F.col("x") - c) * (F.col("x") - c)) / c * 255)
    return _grid(spark, n, size).select("image_id", "y", "x", (255 - d).alias("r"), d.alias("g"), F.lit(180.0).alias("b"))


def validate_images(pixels: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``image_id, height, width, n_px, valid, error``: complete, finite, at most MAX_PIXELS and, if limits are given, in range. Bad images are reported, not raised."""
    values = [F.col(c) for c in "rgb"]
    bad = sum((F.isnan(v) | v.isNull() | (F.abs(v) == float("inf"))).cast("int") for v in values)
    agg = pixels.groupBy("image_id").agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count("*").alias("n_px"), F.sum(bad).alias("bad"), F.min(F.least(*values)).alias("low"), F.max(F.greatest(*values)).alias("high"),
    )
    error = F.when(F.col("n_px") != F.col("height").cast("long") * F.col("width"), "incomplete").when(F.col("n_px") > MAX_PIXELS, "too large").when(F.col("bad") > 0, "not finite")
    if low is not None:
        error = error.when((F.col("low") < low) | (F.col("high") > high), "out of range")
    return agg.withColumn("error", error).select("image_id", "height", "width", "n_px", F.col("error").isNull().alias("valid"), "error")


def split_valid(pixels: DataFrame, low: float | None = None, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pixels of sound images, quarantine)`` after ``validate_images``; quarantine: ``image_id, error``."""
    bad = validate_images(pixels, low, high).filter("not valid").select("image_id", "error")
    return pixels.join(bad, "image_id", "left_anti"), bad


def encode_bmp(pixels: DataFrame) -> DataFrame:
    """``image_id, bmp``: 24-bit BMP, rows from the bottom, padded to four bytes, behind a header of 54 bytes. Values are clipped and truncated."""
    shown = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col(c))).cast("int")
    byte = lambda c: F.lpad(F.hex(shown(c)), 2, "0")
    cell = pixels.select("image_id", "y", "x", F.concat(byte("b"), byte("g"), byte("r")).alias("cell"))
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "cell"))), lambda e: e["cell"]), "")
    rows = cell.groupBy("image_id", "y").agg(row.alias("row"), F.count("*").alias("width"))
    rows = rows.select("image_id", (-F.col("y")).alias("up"), "width", F.unhex(F.concat("row", F.repeat(F.lit("00"), (F.col("width") % 4).cast("int")))).alias("row"))
    body = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("up", "row"))).alias("rows"), F.max("width").cast("int").alias("width"), F.count("*").cast("int").alias("height"))

    @F.pandas_udf("binary")
    def pack(lines: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        out = []
        for r, w, h in zip(lines, width, height, strict=True):
            data = b"".join(bytes(x["row"]) for x in r)
            out.append(struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(data), 0, 0, 54, 40, w, h, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data)
        return pd.Series(out)

    return body.select("image_id", pack("rows", "width", "height").alias("bmp"))
