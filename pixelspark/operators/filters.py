"""Linear and rank filters on samples (relational, short windows) and on scanlines (banded, any size)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import quantized, reflected
from ..sources.images import to_samples, to_scanlines
from .halo import halo_map
from .kernels import gaussian_1d, gaussian_of_size, laplacian
from .metrics import CELL, compare_images, shapes


#: Distinct values of a band up to which medians run on histograms.
MANY_LEVELS = 512


def _padded(samples: DataFrame, axis: str, size: str, radius: int) -> DataFrame:
    """Every sample at its own place ``p`` on the axis and at the border places that mirror it."""
    outside = F.concat(F.sequence(F.lit(-radius), F.lit(-1)), F.transform(F.sequence(F.lit(0), F.lit(radius - 1)), lambda i: i + F.col(size)))
    edge = (F.col(axis) <= radius) | (F.col(axis) >= F.col(size) - 1 - radius)
    places = F.concat(F.array(axis), F.when(edge, F.filter(outside, lambda p: reflected(p, F.col(size)) == F.col(axis))).otherwise(F.array().cast("array<int>")))
    return samples.withColumn("p", F.explode(places))


def box_blur(samples: DataFrame, ksize: int) -> DataFrame:
    """k x k mean, mirrored border: two passes of moving averages."""
    if ksize < 1 or ksize % 2 == 0:
        raise ValueError("the box size is odd")
    r = ksize // 2
    if r == 0:
        return samples
    s = samples.join(shapes(samples), "image_id")
    for axis, other, size in (("x", "y", "width"), ("y", "x", "height")):
        around = Window.partitionBy("image_id", "channel", other).orderBy("p").rowsBetween(-r, r)
        s = _padded(s, axis, size, r).withColumn("v", F.avg("v").over(around)).filter(F.col("p") == F.col(axis)).drop("p")
    return s.select(*CELL, "v")


def laplacian_sharpen_small(samples: DataFrame, ksize: int = 3, scale: float = 1.0) -> DataFrame:
    """v - scale * Laplacian for sizes 1 and 3 by lag and lead, mirrored border."""
    s = samples.join(shapes(samples), "image_id")

    def beside(column: str, axis: str, other: str, size: str):
        w = Window.partitionBy("image_id", "channel", other).orderBy(axis)
        before, after = F.lag(column).over(w), F.lead(column).over(w)
        one = F.col(size) == 1
        return F.when(one, F.col(column)).otherwise(F.coalesce(before, after)), F.when(one, F.col(column)).otherwise(F.coalesce(after, before))

    if ksize not in (1, 3):
        raise ValueError("sizes 1 and 3 only; larger ones go through laplacian_sharpen")
    left, right = beside("v", "x", "y", "width")
    s = s.withColumn("sides", left + right)
    if ksize == 1:
        up, down = beside("v", "y", "x", "height")
        value = F.col("sides") + up + down - 4 * F.col("v")
    else:
        up, down = beside("sides", "y", "x", "height")
        value = 2 * (up + down) - 8 * F.col("v")
    return s.withColumn("lap", value).select(*CELL, (F.col("v") - scale * F.col("lap")).alias("v"))


def kernel_terms(samples: DataFrame, kernel: DataFrame) -> DataFrame:
    """Every term of every output sample: ``image_id, channel, y, x, dy, dx, value, weight, product``; the kernel is broadcast (k * k rows of three numbers)."""
    s = samples.join(shapes(samples), "image_id")
    out = s.select(*CELL, "height", "width").join(F.broadcast(kernel.select("dy", "dx", "w")))
    out = out.withColumn("sy", reflected(F.col("y") + F.col("dy"), F.col("height"))).withColumn("sx", reflected(F.col("x") + F.col("dx"), F.col("width")))
    source = samples.select("image_id", "channel", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("v").alias("value"))
    terms = out.join(source, ["image_id", "channel", "sy", "sx"])
    return terms.select(*CELL, "dy", "dx", "value", F.col("w").alias("weight"), (F.col("value") * F.col("w")).alias("product"))


def convolve_small(samples: DataFrame, kernel: DataFrame) -> DataFrame:
    """Correlation with a small kernel table, mirrored border."""
    return kernel_terms(samples, kernel).groupBy(*CELL).agg(F.sum("product").alias("v"))


def _correlated(block: np.ndarray, k: np.ndarray) -> np.ndarray:
    r, h, w = len(k) // 2, block.shape[0] - len(k) + 1, block.shape[1] - len(k) + 1
    return sum(k[i, j] * block[i : i + h, j : j + w] for i in range(2 * r + 1) for j in range(2 * r + 1) if k[i, j])


def convolve(scanlines: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Correlation with any odd kernel, mirrored border."""
    return halo_map(scanlines, lambda b: _correlated(b, kernel), len(kernel) // 2)


def _separable(w: np.ndarray):
    n = len(w)

    def run(b: np.ndarray) -> np.ndarray:
        rows = sum(w[i] * b[:, i : i + b.shape[1] - n + 1] for i in range(n))
        return sum(w[i] * rows[i : i + b.shape[0] - n + 1] for i in range(n))

    return run


def gaussian_blur(scanlines: DataFrame, sigma: float, ksize: int = 0) -> DataFrame:
    w = gaussian_1d(sigma, ksize)
    return halo_map(scanlines, _separable(w), len(w) // 2)


def unsharp_mask(scanlines: DataFrame, sigma: float, amount: float) -> DataFrame:
    """x + amount * (x - blurred x)."""
    w = gaussian_1d(sigma)
    r, blur = len(w) // 2, _separable(w)
    inner = lambda b: b[r : b.shape[0] - r, r : b.shape[1] - r]
    return halo_map(scanlines, lambda b: inner(b) + amount * (inner(b) - blur(b)), r)


def laplacian_sharpen(scanlines: DataFrame, ksize: int = 3, scale: float = 1.0) -> DataFrame:
    k = laplacian(ksize)
    r = len(k) // 2
    return halo_map(scanlines, lambda b: b[r : b.shape[0] - r, r : b.shape[1] - r] - scale * _correlated(b, k), r)


def median_blur_small(samples: DataFrame) -> DataFrame:
    """3 x 3 median with replicated border: every sample is sent to the nine outputs that see it."""
    s = samples.join(shapes(samples), "image_id")
    clamp = lambda i, n: F.greatest(F.lit(0), F.least(i, F.col(n) - 1))
    grid = F.array(*(F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    out = s.withColumn("o", F.explode(grid)).select(*CELL, clamp(F.col("y") + F.col("o.dy"), "height").alias("sy"), clamp(F.col("x") + F.col("o.dx"), "width").alias("sx"))
    source = samples.select("image_id", "channel", F.col("y").alias("sy"), F.col("x").alias("sx"), "v")
    return out.join(source, ["image_id", "channel", "sy", "sx"]).groupBy(*CELL).agg(F.median("v").alias("v"))


def running_median(b: np.ndarray, size: int) -> np.ndarray:
    """Median of every size x size window of a plane.

    The distinct values of the plane are numbered. A step to the next line of windows takes one line out of the histograms of columns and one in; along the line, a window's histogram gains one
    column's and loses another's. So the work for a
    place grows with the number of levels, 256 for display values, and not with the window. Planes of more than ``MANY_LEVELS`` values select in each window instead.
    """
    levels, code = np.unique(b, return_inverse=True)
    code = code.reshape(b.shape)
    h, w = b.shape[0] - size + 1, b.shape[1] - size + 1
    n, half = len(levels), size * size // 2 + 1
    if n > MANY_LEVELS:  # real-valued planes: ranks of windows by selection instead of histograms as wide as the plane
        view = np.lib.stride_tricks.sliding_window_view(b, (size, size))
        return np.stack([np.partition(v.reshape(w, -1), half - 1, axis=1)[:, half - 1] for v in view])
    columns = np.zeros((b.shape[1], n), np.int32)
    place = np.arange(b.shape[1])
    for y in range(size):
        np.add.at(columns, (place, code[y]), 1)
    out = np.empty((h, w), b.dtype)
    for y in range(h):
        sums = np.cumsum(columns, axis=0)
        windows = sums[size - 1 :].copy()
        windows[1:] -= sums[: w - 1]
        out[y] = levels[(np.cumsum(windows, axis=1) >= half).argmax(axis=1)]
        if y + 1 < h:
            columns[place, code[y]] -= 1
            columns[place, code[y + size]] += 1
    return out


def median_blur(scanlines: DataFrame, size: int) -> DataFrame:
    """size x size median with replicated border; running histograms, so a larger window takes no longer (see ``running_median``)."""
    if size not in (3, 5, 7, 9, 11):
        raise ValueError("median sizes are 3, 5, 7, 9 and 11")
    return halo_map(scanlines, lambda b: running_median(b, size), size // 2, border="replicate")


def gaussian_denoise(scanlines: DataFrame, size: int) -> DataFrame:
    """Gaussian whose sigma follows from its size, on quantised values, quantised again; within one level of fixed-point versions."""
    w = gaussian_of_size(size)
    run = _separable(w)
    return halo_map(scanlines, lambda b: np.rint(np.clip(run(np.rint(np.clip(b, 0, 255))), 0, 255)), size // 2)


def _lab(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    m = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = np.tensordot(m, c, 1) / np.array([0.950456, 1, 1.088754]).reshape(3, *[1] * (rgb.ndim - 1))
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    return np.stack([116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])])


def _rgb(lab: np.ndarray) -> np.ndarray:
    fy = (lab[0] + 16) / 116
    f = np.stack([fy + lab[1] / 500, fy, fy - lab[2] / 200])
    xyz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787) * np.array([0.950456, 1, 1.088754]).reshape(3, *[1] * (lab.ndim - 1))
    m = np.array([[3.240479, -1.537150, -0.498535], [-0.969256, 1.875991, 0.041556], [0.055648, -0.204043, 1.057311]])
    c = np.maximum(np.tensordot(m, xyz, 1), 0)
    return np.where(c > 0.0031308, 1.055 * c ** (1 / 2.4) - 0.055, 12.92 * c) * 255


def nl_means(scanlines: DataFrame, h: float, patch: int = 7, search: int = 21) -> DataFrame:
    """Non-local means over R, G, B: lightness alone and the two colour axes together, weights exp(-d^2 / h^2) of mean squared patch distances. Strength 0 changes nothing but rounding. Own definition."""
    if not 0 <= h <= 100 or patch % 2 == 0 or search % 2 == 0 or min(patch, search) < 1:
        raise ValueError("the strength is within [0, 100], patch and search sizes are odd")
    if h == 0:
        return scanlines.select("image_id", "channel", "y", F.transform("v", lambda x: quantized(x).cast("double")).alias("v"))
    pr, sr = patch // 2, search // 2

    def smooth(planes: np.ndarray, scale: float) -> np.ndarray:
        rows, cols = planes.shape[-2] - 2 * (pr + sr), planes.shape[-1] - 2 * (pr + sr)
        base = planes[..., sr : sr + rows + 2 * pr, sr : sr + cols + 2 * pr]
        s = np.zeros((*base.shape[1:-2], rows + 2 * pr + 1, cols + 2 * pr + 1))
        total, out = np.zeros((*base.shape[1:-2], rows, cols)), np.zeros((*base.shape[:-2], rows, cols))
        for dy in range(2 * sr + 1):
            for dx in range(2 * sr + 1):
                moved = planes[..., dy : dy + rows + 2 * pr, dx : dx + cols + 2 * pr]
                d = ((base - moved) ** 2).mean(axis=0)
                d.cumsum(-2).cumsum(-1, out=s[..., 1:, 1:])
                near = (s[..., patch:, patch:] - s[..., :-patch, patch:] - s[..., patch:, :-patch] + s[..., :-patch, :-patch]) / patch**2
                w = np.exp(-np.maximum(near, 0) / (scale * scale))
                total += w
                out += w * moved[..., pr : pr + rows, pr : pr + cols]
        return out / total

    def run(b: np.ndarray) -> np.ndarray:
        lab = _lab(np.rint(np.clip(b, 0, 255)))
        return np.rint(np.clip(_rgb(np.concatenate([smooth(lab[:1] * 2.55, h) / 2.55, smooth(lab[1:], h)])), 0, 255))

    return halo_map(scanlines, run, pr + sr, band=52, joint=("R", "G", "B"), stacked=True)


def channel_filter(samples: DataFrame, only: str, fn) -> DataFrame:
    """``fn`` on the samples of one channel, the others as they are."""
    return fn(samples.filter(F.col("channel") == only)).select(*CELL, "v").unionByName(samples.filter(F.col("channel") != only).select(*CELL, "v"))


def compare_per_channel_and_merged(samples: DataFrame, fn) -> DataFrame:
    """Filter channel by channel and all at once; they agree if every difference is below 1e-8."""
    apart = None
    for c in "RGB":
        part = fn(samples.filter(F.col("channel") == c))
        apart = part if apart is None else apart.unionByName(part)
    return compare_images(apart, fn(samples)).select("image_id", "max_abs", "mean_abs", (F.col("max_abs") < 1e-8).alias("matches"))


#: Filter -> its function on scanlines and its parameters as (least, greatest, default); whole numbers are odd.
FILTERS = {
    "box": (lambda s, ksize: to_scanlines(box_blur(to_samples(s), ksize)), {"ksize": (1, 31, 7)}), "gaussian": (lambda s, sigma: gaussian_blur(s, sigma), {"sigma": (0.1, 15.0, 3.0)}),
    "unsharp": (lambda s, sigma, amount: unsharp_mask(s, sigma, amount), {"sigma": (0.1, 15.0, 2.0), "amount": (0.0, 5.0, 1.5)}),
    "laplacian": (lambda s, ksize, scale: laplacian_sharpen(s, ksize, scale), {"ksize": (1, 15, 3), "scale": (0.0, 5.0, 1.0)}),
}


def filter_settings(name: str, **given: float) -> dict[str, float]:
    """All parameters of a filter, given or by default. Unknown filters and parameters, and values of the wrong kind or out of range, raise ValueError."""
    if name not in FILTERS:
        raise ValueError(f"unknown filter {name!r}; choose from {sorted(FILTERS)}")
    known, out = FILTERS[name][1], {}
    if extra := set(given) - set(known):
        raise ValueError(f"{name} has no parameter {sorted(extra)}; its parameters are {sorted(known)}")
    for key, (least, most, default) in known.items():
        v = given.get(key, default)
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not least <= v <= most:
            raise ValueError(f"{key} of {name} is a number from {least} to {most}")
        if isinstance(default, int) and (v != int(v) or int(v) % 2 == 0):
            raise ValueError(f"{key} of {name} is odd")
        out[key] = int(v) if isinstance(default, int) else float(v)
    return out


def filter_named(name: str):
    """A filter and its parameters as (least, greatest, default). The filter takes samples or scanlines, and returns the same; its parameters are checked (see ``filter_settings``)."""
    filter_settings(name)
    run, parameters = FILTERS[name]

    def apply(image: DataFrame, **given: float) -> DataFrame:
        settings = filter_settings(name, **given)
        return to_samples(run(to_scanlines(image), **settings)) if "x" in image.columns else run(image, **settings)

    return apply, parameters
