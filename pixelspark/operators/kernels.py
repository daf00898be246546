"""Small convolution kernels: their weights as NumPy arrays and as tables, their statistics and frequency responses."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights of the 8-bit Gaussian whose sigma follows from its size (fixed values; other sizes follow the formula).
SMALL_GAUSSIANS = {3: [1, 2, 1], 5: [1, 4, 6, 4, 1], 7: [1, 3.5, 7, 9, 7, 3.5, 1], 9: [4, 13, 30, 51, 60, 51, 30, 13, 4]}


def gaussian_1d(sigma: float, size: int = 0) -> np.ndarray:
    """Normalised; the automatic size is the odd number at or above 8 sigma + 1, rounded."""
    n = size or (round(8 * sigma + 1) | 1)
    w = np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * sigma * sigma))
    return w / w.sum()


def gaussian_of_size(size: int) -> np.ndarray:
    if size in SMALL_GAUSSIANS:
        w = np.array(SMALL_GAUSSIANS[size], float)
        return w / w.sum()
    return gaussian_1d(0.3 * ((size - 1) / 2 - 1) + 0.8, size)


def _derivative(size: int, order: int) -> np.ndarray:
    w = np.ones(1)
    for _ in range(size - 1 - order):
        w = np.convolve(w, [1.0, 1.0])
    for _ in range(order):
        w = np.convolve(w, [-1.0, 1.0])
    return w


def laplacian(size: int) -> np.ndarray:
    """Size 1: the five-point stencil; odd sizes from 3: sum of the two Sobel second derivatives."""
    if size not in range(1, 16, 2):
        raise ValueError("the Laplacian's size is odd and at most 15")
    if size == 1:
        return np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])
    smooth, second = _derivative(size, 0), _derivative(size, 2)
    return np.outer(smooth, second) + np.outer(second, smooth)


def _delta(n: int) -> np.ndarray:
    d = np.zeros((n, n))
    d[n // 2, n // 2] = 1
    return d


def box_kernel(ksize: int) -> np.ndarray:
    return np.full((ksize, ksize), 1 / ksize**2)


def gaussian_kernel(sigma: float, ksize: int = 0) -> np.ndarray:
    g = gaussian_1d(sigma, ksize)
    return np.outer(g, g)


def unsharp_kernel(sigma: float, amount: float) -> np.ndarray:
    g = gaussian_kernel(sigma)
    return (1 + amount) * _delta(len(g)) - amount * g


def laplacian_kernel(ksize: int, scale: float) -> np.ndarray:
    k = laplacian(ksize)
    return _delta(len(k)) - scale * k


KERNELS = {"box": box_kernel, "gaussian": gaussian_kernel, "unsharp": unsharp_kernel, "laplacian": laplacian_kernel}


def filter_kernel(name: str, **params) -> np.ndarray:
    if name not in KERNELS:
        raise ValueError(f"unknown filter {name!r}; choose from {sorted(KERNELS)}")
    return KERNELS[name](**params)


def kernel_table(spark: SparkSession, name: str, **params) -> DataFrame:
    """``filter, dy, dx, w``."""
    k = filter_kernel(name, **params)
    r = len(k) // 2
    rows = [(name, y - r, x - r, float(k[y, x])) for y in range(len(k)) for x in range(len(k))]
    return spark.createDataFrame(rows, "filter string, dy int, dx int, w double")


def write_kernel_csv(kernel: DataFrame, path: str) -> None:
    kernel.orderBy("dy", "dx").coalesce(1).write.option("header", True).csv(path)


def kernel_stats(kernel: DataFrame) -> DataFrame:
    centre = F.max(F.when((F.col("dy") == 0) & (F.col("dx") == 0), F.col("w")))
    return kernel.groupBy("filter").agg((F.max("dx") * 2 + 1).alias("size"), F.sum("w").alias("sum_w"), F.min("w").alias("min_w"), F.max("w").alias("max_w"), centre.alias("centre_w"))


def frequency_response(spark: SparkSession, weights: DataFrame, n: int = 512) -> DataFrame:
    """``filter, k, magnitude`` of 1-D kernels ``filter, i, w`` padded with zeros to n, for k = 0 .. n / 2."""
    k = spark.range(n // 2 + 1).select(F.col("id").cast("int").alias("k"))
    turn = 2 * math.pi / n * (F.col("k") * F.col("i") % n)
    sums = weights.join(F.broadcast(k)).groupBy("filter", "k").agg(F.sum(F.col("w") * F.cos(turn)).alias("re"), F.sum(F.col("w") * F.sin(turn)).alias("im"))  # k has n / 2 + 1 rows
    return sums.select("filter", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("magnitude"))
