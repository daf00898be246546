"""Comparisons, energies, correlations and per-image statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import quantized
from .planes import lines_of, scanline_array

CELL = ["image_id", "channel", "y", "x"]


def compare_images(a: DataFrame, b: DataFrame) -> DataFrame:
    """``image_id, max_abs, mean_abs, mse, psnr, identical`` of two versions of each image, as samples; PSNR is infinite for equal ones."""
    d = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "q"), CELL).withColumn("d", F.col("p").cast("double") - F.col("q"))
    m = d.groupBy("image_id").agg(F.max(F.abs("d")).alias("max_abs"), F.avg(F.abs("d")).alias("mean_abs"), F.avg(F.col("d") * F.col("d")).alias("mse"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse")))
    return m.select("image_id", "max_abs", "mean_abs", "mse", psnr.alias("psnr"), (F.col("max_abs") == 0).alias("identical"))


def compare_scanlines(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same from scanline tables: joins one row a line, and the differences are folded inside the arrays. Without an exchange if both are bucketed by image (``save_scanlines``)."""
    d = a.withColumnRenamed("v", "p").join(b.withColumnRenamed("v", "q"), ["image_id", "channel", "y"]).withColumn("d", F.zip_with("p", "q", lambda x, y: F.abs(x - y).cast("double")))
    return _from_differences(d)


def compare_stored(spark: SparkSession, first: str, second: str) -> DataFrame:
    """The same of two tables of ``save_scanlines`` with as many buckets, joined and grouped where they lie.

    Spark keeps an exchange below a join by image, channel and line of tables that lie by image alone, unless it is told that a part of the keys will do; that setting is made in a session
    of its own, which shares the tables, so the caller's settings stay as they are.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return compare_scanlines(own.table(first), own.table(second).hint("merge"))


def compare_versions(scanlines: DataFrame, first: str, second: str) -> DataFrame:
    """The same of two array columns of one scanline table: nothing is joined, and each line's differences are summed before they are shuffled."""
    return _from_differences(scanlines.withColumn("d", F.zip_with(first, second, lambda x, y: F.abs(x - y).cast("double"))))


def _from_differences(d: DataFrame) -> DataFrame:
    fold = lambda f: F.aggregate("d", F.lit(0.0), f)
    s = d.groupBy("image_id").agg(F.max(F.array_max("d")).alias("max_abs"), F.sum(fold(lambda t, x: t + x)).alias("a"), F.sum(fold(lambda t, x: t + x * x)).alias("s"), F.sum(F.size("d")).alias("n"))
    s = s.select("image_id", "max_abs", (F.col("a") / F.col("n")).alias("mean_abs"), (F.col("s") / F.col("n")).alias("mse"))
    psnr = F.when(F.col("mse") == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(255.0 * 255.0) / F.col("mse")))
    return s.select("image_id", "max_abs", "mean_abs", "mse", psnr.alias("psnr"), (F.col("max_abs") == 0).alias("identical"))


def shapes(df: DataFrame) -> DataFrame:
    return df.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def check_same_shape(a: DataFrame, b: DataFrame) -> DataFrame:
    """``image_id, status``: same, differs, or missing on one side."""
    p, q = shapes(a).withColumnsRenamed({"height": "h1", "width": "w1"}), shapes(b).withColumnsRenamed({"height": "h2", "width": "w2"})
    status = F.when(F.col("h1").isNull(), "missing in first").when(F.col("h2").isNull(), "missing in second").when((F.col("h1") == F.col("h2")) & (F.col("w1") == F.col("w2")), "same").otherwise("differs")
    return p.join(q, "image_id", "full").select("image_id", status.alias("status"))


def dedupe_jobs(inputs: DataFrame, done: DataFrame, settings: str) -> DataFrame:
    """Rows of ``inputs(image_id, data)`` whose content and settings are not among the keys of ``done(job_key)``, with their key."""
    key = F.sha2(F.concat(F.col("data"), F.lit(f"|{settings}").cast("binary")), 256)
    return inputs.withColumn("job_key", key).join(done.select("job_key"), "job_key", "left_anti")


def channel_energy(samples: DataFrame) -> DataFrame:
    return samples.groupBy("image_id", "channel").agg(F.sum(F.col("v") * F.col("v")).alias("energy"))


def energy_share(samples: DataFrame) -> DataFrame:
    """Spectral energy of each channel and its share; by Parseval it is the number of pixels times the sum of squares, so no transform is needed. 0 where there is none."""
    e = samples.groupBy("image_id", "channel").agg((F.count("*") * F.sum(F.col("v") * F.col("v"))).alias("energy"))
    total = F.sum("energy").over(Window.partitionBy("image_id"))
    return e.withColumn("share", F.when(total > 0, F.col("energy") / total).otherwise(0.0))


def centered_energy_share(samples: DataFrame) -> DataFrame:
    """Energy about the mean, in percent of the image's."""
    e = samples.groupBy("image_id", "channel").agg((F.var_pop("v") * F.count("*")).alias("energy"))
    total = F.sum("energy").over(Window.partitionBy("image_id"))
    return e.withColumn("percent", F.when(total > 0, 100 * F.col("energy") / total).otherwise(0.0))


def channel_correlation(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.corr("r", "g").alias("rg"), F.corr("g", "b").alias("gb"))


def gray_world(pixels: DataFrame, strength: float = 1.0) -> DataFrame:
    """Tint balance: every channel's mean moves towards their common mean by a gain within [0.5, 2]."""
    means = pixels.groupBy("image_id").agg(*(F.avg(c).alias(f"m{c}") for c in "rgb"))
    common = (F.col("mr") + F.col("mg") + F.col("mb")) / 3
    gain = lambda c: F.greatest(F.lit(0.5), F.least(F.lit(2.0), common / F.greatest(F.col(f"m{c}"), F.lit(1.0))))
    gains = means.select("image_id", *(gain(c).alias(f"k{c}") for c in "rgb"))
    return pixels.join(gains, "image_id").select("image_id", "y", "x", *(quantized(F.col(c) * (1 - strength) + F.col(c) * F.col(f"k{c}") * strength).alias(c) for c in "rgb"))


def percentile_stretch(lab: DataFrame, strength: float = 1.0) -> DataFrame:
    """``image_id, y, x, l, a, b``: lightness between its 1st and 99th percentile goes to the full range, blended by ``strength``; untouched where they coincide.

    The exact percentiles come from the 256-value histogram of each image by running counts, so no task holds an image's values.
    """
    counts = lab.groupBy("image_id", "l").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("l")
    counts = counts.select("image_id", "l", F.sum("n").over(upto).alias("upto"), F.sum("n").over(Window.partitionBy("image_id")).alias("total"))

    def at(q: float):
        place = (F.col("total") - 1) * F.lit(q)
        value = lambda k: F.min(F.when(F.col("upto") > k, F.col("l")))
        return value(F.floor(place)), value(F.ceil(place)), F.max(place - F.floor(place))

    cols = []
    for name, q in (("lo", 0.01), ("hi", 0.99)):
        below, above, part = at(q)
        cols.append((below + (above - below) * part).alias(name))
    ends = counts.groupBy("image_id").agg(*cols)
    wide = F.col("hi") > F.col("lo")
    stretched = F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col("l") - F.col("lo")) * 255.0 / (F.col("hi") - F.col("lo"))))
    out = F.when(wide, quantized(F.col("l") * (1 - strength) + stretched * strength)).otherwise(F.col("l").cast("int"))
    return lab.join(ends, "image_id").select("image_id", "y", "x", out.alias("l"), "a", "b")


def size_report(archives: DataFrame) -> DataFrame:
    """Raw and archived bytes and their ratio over a table of archives."""
    s = archives.agg(F.count("*").alias("images"), F.sum("raw_bytes").alias("raw_bytes"), F.sum("archive_bytes").alias("archive_bytes"))
    return s.withColumn("ratio", F.col("raw_bytes") / F.col("archive_bytes"))


def area_resize(samples: DataFrame, max_side: int = 128) -> DataFrame:
    """Thumbnail whose longer side is at most ``max_side``: each target cell is the mean of the source area it covers, weighted by overlap."""
    s = samples.join(shapes(samples), "image_id")
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("height", "width"))
    s = s.withColumn("th", F.greatest(F.lit(1), F.rint(F.col("height") * scale).cast("int"))).withColumn("tw", F.greatest(F.lit(1), F.rint(F.col("width") * scale).cast("int")))

    def cover(i: str, n: str, t: str):
        first, last = F.expr(f"cast({i} * {t} div {n} as int)"), F.expr(f"cast((({i} + 1) * {t} - 1) div {n} as int)")
        return F.sequence(first, last)

    part = lambda i, n, t, to: F.least((F.col(i) + 1) * F.col(t), (F.col(to) + 1) * F.col(n)) - F.greatest(F.col(i) * F.col(t), F.col(to) * F.col(n))
    s = s.withColumn("ty", F.explode(cover("y", "height", "th"))).withColumn("tx", F.explode(cover("x", "width", "tw")))
    s = s.withColumn("w", (part("y", "height", "th", "ty") * part("x", "width", "tw", "tx")).cast("double"))
    return s.groupBy("image_id", "channel", F.col("ty").alias("y"), F.col("tx").alias("x")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def _thumbnail_rows(batch: pa.RecordBatch, max_side: int) -> Iterator[pa.RecordBatch]:
    """What the lines of a batch add to each line of their thumbnails: ``image_id, channel, y, sums, n``, the sums of values by covered area and the area."""
    height, width = batch.column("height").to_numpy().astype(np.int64), pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64)
    scale = np.minimum(1.0, max_side / np.maximum(height, width))
    th, tw = (np.maximum(1, np.rint(n * scale)).astype(np.int64) for n in (height, width))
    image, channel = (pc.dictionary_encode(batch.column(c), null_encoding="encode").indices.to_numpy() for c in ("image_id", "channel"))
    plane = np.cumsum(np.concatenate([[0], (np.diff(image) != 0) | (np.diff(channel) != 0)]))
    for w, t in np.unique(np.stack([width, tw], 1), axis=0).tolist():
        rows = np.flatnonzero((width == w) & (tw == t))
        own, h, n = batch.take(pa.array(rows)), height[rows], th[rows]
        x, to = np.arange(w)[:, None], np.arange(t)
        across = lines_of(own) @ np.maximum(0, np.minimum((x + 1) * t, (to + 1) * w) - np.maximum(x * t, to * w)).astype(float)
        y = own.column("y").to_numpy().astype(np.int64)
        first, last = y * n // h, ((y + 1) * n - 1) // h  # a line lies in one line of the thumbnail or in two
        line, ty = np.concatenate([np.arange(len(y)), np.flatnonzero(last > first)]), np.concatenate([first, last[last > first]])
        part = np.minimum((y[line] + 1) * n[line], (ty + 1) * h[line]) - np.maximum(y[line] * n[line], ty * h[line])
        order = np.lexsort((ty, plane[rows][line]))
        line, ty, part = line[order], ty[order], part[order]
        at = np.flatnonzero(np.concatenate([[True], (np.diff(ty) != 0) | (np.diff(plane[rows][line]) != 0)]))
        pick, sums = pa.array(line[at]), np.add.reduceat(across[line] * part[:, None], at, axis=0)
        yield pa.record_batch([own.column("image_id").take(pick), own.column("channel").take(pick), pa.array(ty[at].astype(np.int32)), scanline_array(sums), pa.array(np.add.reduceat(part, at) * w)], names=["image_id", "channel", "y", "sums", "n"])


def area_resize_lines(scanlines: DataFrame, max_side: int = 128) -> DataFrame:
    """``area_resize`` of whole lines, as samples. Where lines carry their image's ``height``, only lines of thumbnails are shuffled: lines are summed where they lie, once a batch."""
    if "height" not in scanlines.columns:
        scanlines = scanlines.join(scanlines.groupBy("image_id").agg((F.max("y") + 1).alias("height")), "image_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from _thumbnail_rows(batch, max_side)

    parts = scanlines.select("image_id", "channel", "y", F.col("v").cast("array<double>").alias("v"), F.col("height").cast("int").alias("height")).mapInArrow(run, "image_id long, channel string, y int, sums array<double>, n long")
    s = parts.groupBy("image_id", "channel", "y").agg(F.collect_list("sums").alias("s"), F.sum("n").alias("n"))
    total = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return s.select("image_id", "channel", "y", F.posexplode(total).alias("x", "t"), "n").select(*CELL, (F.col("t") / F.col("n")).alias("v"))


def spectrum_previews(samples: DataFrame, max_side: int = 128, center: bool = False) -> DataFrame:
    """Thumbnails for spectra on one scale: ``image_id, channel, y, x, v, bound``. With ``center`` every plane loses its mean; ``bound``, shared by an image's planes, is the greatest sum of absolute values of a plane, 1 at least."""
    from .channels import remove_mean

    t = area_resize(samples, max_side)
    if center:
        t = remove_mean(t)
    sums = t.groupBy("image_id", "channel").agg(F.sum(F.abs("v")).alias("s")).groupBy("image_id").agg(F.greatest(F.lit(1.0), F.max("s")).alias("bound"))
    return t.join(sums, "image_id").select(*CELL, "v", "bound")
