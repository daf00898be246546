"""Inpainting and the restoration pipeline. Images that a gate rejects come back as a table of reasons."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import quantized
from ..sources.images import split_valid, to_samples, to_scanlines
from .channels import lab8_to_rgb, merge_channels, quantize, rgb_to_lab8, split_channels, to_gray8
from .filters import nl_means
from .frequency import remove_periodic_lines
from .metrics import gray_world, percentile_stretch, shapes
from .morphology import PIXEL, mask_coverage, mask_union, scratch_mask, white_stripe_mask
from .regions import mask_regions, mask_runs


def _march(cells: dict, unknown: set, radius: int) -> dict:
    """Fill ``unknown`` places from ``cells`` (place -> colours), nearest to the border first (fast marching, after Telea 2004)."""
    t = {p: 0.0 for p in cells} | {p: 1e6 for p in unknown}
    value, known = dict(cells), set(cells)
    near = [(0.0, p) for p in cells if any((p[0] + a, p[1] + b) in unknown for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))]
    heapq.heapify(near)
    steps = ((0, 1), (1, 0), (0, -1), (-1, 0))
    disc = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if 0 < a * a + b * b <= radius * radius]

    def slope(table, p, axis, default):
        d = (1, 0) if axis == 0 else (0, 1)
        lo, hi = (p[0] - d[0], p[1] - d[1]), (p[0] + d[0], p[1] + d[1])
        if lo in known and hi in known:
            return (table[hi] - table[lo]) / 2
        if hi in known:
            return table[hi] - table[p]
        if lo in known:
            return table[p] - table[lo]
        return default

    def arrival(p):
        best = 1e6
        for v in ((0, -1), (0, 1)):
            for h in ((-1, 0), (1, 0)):
                a, b = (t.get((p[0] + s[0], p[1] + s[1]), 1e6) if (p[0] + s[0], p[1] + s[1]) in known else 1e6 for s in (v, h))
                lo, hi = min(a, b), max(a, b)
                best = min(best, lo + 1 if hi - lo >= 1 else (a + b + np.sqrt(2 - (a - b) ** 2)) / 2)
        return best

    while near:
        _, p = heapq.heappop(near)
        known.add(p)
        for a, b in steps:
            q = (p[0] + a, p[1] + b)
            if q not in t or q in known or q in value:
                continue
            t[q] = arrival(q)
            gt = np.array([slope(t, q, 0, 0.0), slope(t, q, 1, 0.0)])
            total, weight = np.zeros(3), 0.0
            for dy, dx in disc:
                r = (q[0] + dy, q[1] + dx)
                if r not in known:
                    continue
                back = np.array([-dy, -dx], float)
                size = np.hypot(dy, dx)
                direction = max(abs(float(back @ gt)) / size, 1e-6)
                w = direction / size**2 / (1 + abs(t[r] - t[q]))
                g = (slope(value, r, 0, 0.0), slope(value, r, 1, 0.0))
                total += w * (value[r] + g[0] * back[0] + g[1] * back[1])
                weight += w
            value[q] = total / weight if weight else value[p]
            heapq.heappush(near, (t[q], q))
    return {p: value[p] for p in unknown if p in value}


def inpaint(pixels: DataFrame, mask: DataFrame, radius: int = 3) -> DataFrame:
    """Fill masked pixels from their surroundings, a damaged region at a time; own definition.

    What fills a pixel lies at most ``radius`` + 1 lines and columns away, so holes further apart than that do not see each other. Each region and a ring around it leave for Python by
    themselves, and regions of one image spread over tasks; the result is that of marching through the whole image. Masked pixels outside the image are ignored; an image
    that is masked all over stays as it is.
    """
    if not 1 <= radius <= 15:
        raise ValueError("the radius is from 1 to 15")
    reach = radius + 1
    holes = mask_regions(mask, reach)
    span = lambda c: F.sequence(F.col(c) - reach, F.col(c) + reach)
    runs = mask_runs(mask, reach).groupBy("image_id", "y", "run").agg(F.max("x").alias("last"))
    named = runs.join(holes.select("image_id", "y", F.col("x").alias("run"), "region"), ["image_id", "y", "run"])
    wide = named.select("image_id", "region", F.explode(span("y")).alias("y"), (F.col("run") - reach).alias("a"), (F.col("last") + reach).alias("b"))
    ring = wide.select("image_id", "region", "y", F.explode(F.sequence("a", "b")).alias("x")).distinct()
    need = pixels.join(ring, PIXEL).join(holes.withColumn("hole", F.lit(True)), [*PIXEL, "region"], "left")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        hole = g["hole"].fillna(False).to_numpy(bool)
        places = list(zip(g["y"].tolist(), g["x"].tolist(), strict=True))
        colours = g[["r", "g", "b"]].to_numpy(float)
        filled = _march({p: c for p, c, x in zip(places, colours, hole, strict=True) if not x}, {p for p, x in zip(places, hole, strict=True) if x}, radius)
        rows = [(g["image_id"].iloc[0], *p, *np.clip(c, 0, 255)) for p, c in filled.items()]
        return pd.DataFrame(rows, columns=["image_id", "y", "x", "nr", "ng", "nb"])

    fill = need.select(*PIXEL, "region", "r", "g", "b", "hole").groupBy("image_id", "region").applyInPandas(run, "image_id long, y int, x int, nr double, ng double, nb double")
    return pixels.join(fill, PIXEL, "left").select(*PIXEL, *(F.coalesce(F.rint(f"n{c}").cast("int"), F.col(c).cast("int")).alias(c) for c in "rgb"))


def _gated(pixels: DataFrame, mask: DataFrame, limit: float, reason: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    bad = mask_coverage(mask, shapes(pixels), limit).filter("rejected").select("image_id", F.lit(reason).alias("error"))
    return pixels.join(bad, "image_id", "left_anti"), mask.join(bad, "image_id", "left_anti"), bad


def remove_scratches(pixels: DataFrame, threshold: int = 30, size: int = 11, dark: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pixels, mask, rejected)``: images with more than a tenth of their pixels marked are rejected."""
    q = quantize(pixels)
    good, mask, bad = _gated(q, scratch_mask(to_gray8(q), threshold, size, dark), 0.1, "scratch mask covers over 10 percent")
    return inpaint(good, mask), mask, bad


def remove_stripes(pixels: DataFrame, threshold: int = 5, strength: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    if not 1 <= threshold <= 100 or not 0 <= strength <= 1:
        raise ValueError("the threshold is from 1 to 100 and the strength within [0, 1]")
    q = quantize(pixels)
    good, mask, bad = _gated(q, white_stripe_mask(to_gray8(q), threshold), 0.35, "stripe mask covers over 35 percent")
    both = good.join(inpaint(good, mask).withColumnsRenamed({c: f"n{c}" for c in "rgb"}), PIXEL)
    return both.select(*PIXEL, *(quantized((1 - strength) * F.col(c) + strength * F.col(f"n{c}")).alias(c) for c in "rgb")), mask, bad


def restore_photo(
    pixels: DataFrame, *, lines: bool = False, line_mode: str = "stripes", line_threshold: int = 5, line_strength: float = 0.8, period: float = 12.0, scratches: bool = False, scratch_threshold: int = 30, scratch_size: int = 11,
    repair_dark: bool = False, denoise: bool = False, noise_strength: float = 7.0, tint: bool = False, tint_strength: float = 0.6, contrast: bool = False, contrast_strength: float = 0.6,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(pixels, mask, rejected)``: lines, scratches, noise, tint, contrast, in this order, each only if asked for.

    Images that are incomplete, not finite or of more than four million pixels go to ``rejected`` before any work on them.
    """
    if not all(0 <= s <= 1 for s in (line_strength, tint_strength, contrast_strength)) or not 0 <= noise_strength <= 20 or period < 2:
        raise ValueError("strengths are within [0, 1], noise within [0, 20], the period at least 2")
    if not 1 <= scratch_threshold <= 255 or scratch_size not in (3, 5, 7, 11, 15, 21) or line_mode not in ("stripes", "periodic") or not 1 <= line_threshold <= 100:
        raise ValueError("invalid scratch or line settings")
    sound, broken = split_valid(pixels)
    work = quantize(sound)
    spark = work.sparkSession
    mask = spark.createDataFrame([], "image_id long, y int, x int")
    bad = broken
    through = lambda f: merge_channels(to_samples(f(to_scanlines(split_channels(work).withColumn("v", F.col("v").cast("double"))))))
    if lines and line_mode == "stripes":
        work, found, lost = remove_stripes(work, line_threshold, line_strength)
        mask, bad = mask_union(mask, found), bad.union(lost)
    elif lines:
        work = quantize(through(lambda s: remove_periodic_lines(s, period, line_strength)))
    if scratches:
        work, found, lost = remove_scratches(work, scratch_threshold, scratch_size, repair_dark)
        mask, bad = mask_union(mask, found), bad.union(lost)
    if denoise and noise_strength:
        work = quantize(through(lambda s: nl_means(s, noise_strength)))
    if tint and tint_strength:
        work = gray_world(work, tint_strength)
    if contrast and contrast_strength:
        work = lab8_to_rgb(percentile_stretch(rgb_to_lab8(work), contrast_strength))
    return work, mask, bad
