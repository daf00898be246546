"""Repeatable noise: every draw is a hash of seed and place, so it does not depend on partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import quantized


def hash_uniform(seed: str | int, *columns: str | Column) -> Column:
    """In (0, 1): the first 32 bits of the MD5 of the seed and the columns."""
    named = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns]
    n = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *named).cast("binary")), 1, 8), 16, 10).cast("double")
    return (n + 0.5) / F.lit(2.0**32)


def add_gaussian_noise(samples: DataFrame, sigma: float, seed: int = 42) -> DataFrame:
    """Normal noise by the Box-Muller transform, clipped and rounded."""
    if not (math.isfinite(sigma) and sigma >= 0):
        raise ValueError("the amount of noise is finite and not negative")
    place = ("image_id", "y", "x", "channel")
    normal = F.sqrt(-2 * F.ln(hash_uniform(f"{seed}a", *place))) * F.cos(2 * math.pi * hash_uniform(f"{seed}b", *place))
    return samples.withColumn("v", quantized(quantized("v") + sigma * normal))


def add_salt_pepper(pixels: DataFrame, percent: float, seed: int = 42) -> DataFrame:
    """One draw a pixel: half of ``percent`` become black, half white, in all channels."""
    if not 0 <= percent <= 100:
        raise ValueError("the percentage is within [0, 100]")
    d = pixels.withColumn("u", hash_uniform(seed, "image_id", "y", "x"))
    put = lambda c: F.when(F.col("u") < percent / 200, 0).when(F.col("u") < percent / 100, 255).otherwise(quantized(c))
    return d.select("image_id", "y", "x", *(put(c).alias(c) for c in "rgb"))


def add_gaussian_noise_numpy(pixels: DataFrame, sigma: float, seed: int = 42) -> DataFrame:
    """The same with NumPy's generator, which fills an image in order, so one task takes one image."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "x"])
        v = np.rint(np.clip(g[["r", "g", "b"]].to_numpy(float), 0, 255))
        v = np.rint(np.clip(v + np.random.default_rng(seed).normal(0, sigma, v.shape), 0, 255)).astype(np.int32)
        return pd.DataFrame({"image_id": g["image_id"], "y": g["y"], "x": g["x"], "r": v[:, 0], "g": v[:, 1], "b": v[:, 2]})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id long, y int, x int, r int, g int, b int")


def noise_lab(pixels: DataFrame, sigma: float = 25.0, percent: float = 10.0, size: int = 5, h: float = 15.0, seed: int = 42) -> DataFrame:
    """``image_id, noise, method, psnr`` against the clean image: two noises, untreated and by three methods."""
    from ..sources.images import to_samples, to_scanlines
    from .channels import quantize, split_channels
    from .filters import gaussian_denoise, median_blur, nl_means
    from .metrics import compare_images

    clean, out = split_channels(quantize(pixels)), None
    for noise, noisy in (("gaussian", add_gaussian_noise(clean, sigma, seed)), ("salt and pepper", split_channels(add_salt_pepper(pixels, percent, seed)))):
        lines = to_scanlines(noisy.withColumn("v", F.col("v").cast("double")))
        for method, result in (("none", noisy), ("median", to_samples(median_blur(lines, size))), ("gaussian", to_samples(gaussian_denoise(lines, size))), ("nl-means", to_samples(nl_means(lines, h)))):
            part = compare_images(clean, result).select("image_id", F.lit(noise).alias("noise"), F.lit(method).alias("method"), "psnr")
            out = part if out is None else out.unionByName(part)
    return out
