"""Reversible integer Haar wavelets on samples and the lossless archive built on them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import unzigzag, zigzag
from ..sources.images import to_scanlines
from .metrics import CELL, shapes
from .planes import lines_of, map_groups, repeated

#: Fixed values of the archive: big-endian magic, width, height, levels, CRC-32 of the pixels.
MAGIC, HEADER = b"IWV1", ">4sIIBI"
MAX_PIXELS = 4_000_000


def _checked(levels: int) -> int:
    if not isinstance(levels, int) or isinstance(levels, bool) or not 1 <= levels <= 8:
        raise ValueError("levels is an integer from 1 to 8")
    return levels


def _low(n: str, level: int) -> Column:
    """Size of the low band after ``level`` halvings, rounded up."""
    return F.shiftright(F.col(n) + ((1 << level) - 1), level)


def _lines_by_image(samples: DataFrame) -> DataFrame:
    """Lines with their image's size. The window keeps an image's rows in one partition, and nothing after it has to shuffle."""
    lines = to_scanlines(samples.select(*CELL, F.col("v").cast("long").alias("v")).repartition("image_id"))
    image = Window.partitionBy("image_id")
    return lines.select("image_id", "channel", "y", "v", (F.max("y").over(image) + 1).alias("height"), F.max(F.size("v")).over(image).alias("width"))


def _lift(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(averages, details)`` of neighbouring rows; an odd last row is an average by itself."""
    s, odd = a[0::2].copy(), a[1::2]
    d = odd - s[: len(odd)]
    s[: len(odd)] += d >> 1
    return s, d


def _drop(s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The rows that ``_lift`` took apart."""
    out = np.empty((len(s) + len(d), *s.shape[1:]), np.int64)
    out[0::2] = s
    out[0::2][: len(d)] -= d >> 1
    out[1::2] = out[0::2][: len(d)] + d
    return out


def _half(n: int, level: int) -> int:
    return (n + (1 << level) - 1) >> level


def haar_forward(samples: DataFrame, levels: int = 4) -> DataFrame:
    """Integer lifting, rows then columns of the low region, level by level; odd tails end the low band.

    The 2 ** levels lines that share a line of the last low band hold all their coefficients of every level among themselves. They come together once, and no level shuffles anything:
    each lifts pairs inside its lines, then pairs of lines, and sets the three finished bands aside.
    """
    _checked(levels)

    def run(group: pa.RecordBatch) -> list[pa.RecordBatch]:
        g, height, width = (group.column(c)[0].as_py() for c in ("g", "height", "width"))
        now, bands = lines_of(group).astype(np.int64), []
        for level in range(1, levels + 1):
            lo, hi = (x.T for x in _lift(now.T))
            (now, lh), (hl, hh) = _lift(lo), _lift(hi)
            top, down, right = g << (levels - level), _half(height, level), _half(width, level)
            bands += [(top, right, hl), (down + top, 0, lh), (down + top, right, hh)]
        bands.append((g, 0, now))
        y = np.concatenate([np.repeat(np.arange(a, a + v.shape[0]), v.shape[1]) for a, _, v in bands])
        x = np.concatenate([np.tile(np.arange(b, b + v.shape[1]), v.shape[0]) for _, b, v in bands])
        v = np.concatenate([v.ravel() for _, _, v in bands])
        return [pa.record_batch([repeated(group, "image_id", len(v)), repeated(group, "channel", len(v)), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(v)], names=[*CELL, "v"])]

    lines = _lines_by_image(samples).withColumn("g", F.shiftright("y", levels))
    return map_groups(lines, ["image_id", "channel", "g"], ["y"], run, "image_id long, channel string, y int, x int, v long", dealt=True)


def haar_inverse(coeffs: DataFrame, levels: int = 4) -> DataFrame:
    """The samples of ``haar_forward``'s coefficients. Lines are cut into their bands where they lie; what makes up 2 ** levels lines then comes together, as on the way there."""
    _checked(levels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            image, channel, ys, heights, widths = (batch.column(c).to_pylist() for c in ("image_id", "channel", "y", "height", "width"))
            offsets, values = batch.column("v").offsets.to_numpy(), batch.column("v").values.to_numpy()
            for i, (y, height, width) in enumerate(zip(ys, heights, widths, strict=True)):
                line = values[offsets[i] : offsets[i + 1]]
                if y < _half(height, levels):
                    rows.append((i, y, levels, 0, y, line[: _half(width, levels)]))
                for k in range(1, levels + 1):
                    down, right, end = _half(height, k), _half(width, k), _half(width, k - 1)
                    if y >= _half(height, k - 1):
                        break
                    if y >= down:
                        rows += [(i, (y - down) >> (levels - k), k, 2, y - down, line[:right]), (i, (y - down) >> (levels - k), k, 3, y - down, line[right:end])]
                    else:
                        rows.append((i, y >> (levels - k), k, 1, y, line[right:end]))
            at, g, k, band, r, parts = zip(*rows, strict=True) if rows else [()] * 6
            ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
            yield pa.record_batch([pa.array([image[i] for i in at], pa.int64()), pa.array([channel[i] for i in at], pa.string()), *(pa.array(c, pa.int32()) for c in (g, k, band, r)), lists], names=["image_id", "channel", "g", "k", "band", "r", "v"])

    def run(group: pa.RecordBatch) -> list[pa.RecordBatch]:
        code = group.column("k").to_numpy() * 4 + group.column("band").to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        bands = {int(code[a]): lines_of(group.slice(a, b - a)).astype(np.int64) for a, b in zip(ends[:-1], ends[1:], strict=True)}
        now = bands[levels * 4]
        for k in range(levels, 0, -1):
            hl = bands.get(k * 4 + 1, np.zeros((len(now), 0), np.int64))
            none = [np.zeros((0, n), np.int64) for n in (now.shape[1], hl.shape[1])]
            lo, hi = _drop(now, bands.get(k * 4 + 2, none[0])), _drop(hl, bands.get(k * 4 + 3, none[1]))
            now = _drop(lo.T, hi.T).T
        n, top = now.size, group.column("g")[0].as_py() << levels
        y, x = np.indices(now.shape, dtype=np.int32)
        return [pa.record_batch([repeated(group, "image_id", n), repeated(group, "channel", n), pa.array(y.ravel() + np.int32(top)), pa.array(x.ravel()), pa.array(now.ravel())], names=[*CELL, "v"])]

    pieces = _lines_by_image(coeffs).mapInArrow(cut, "image_id long, channel string, g int, k int, band int, r int, v array<long>")
    return map_groups(pieces, ["image_id", "channel", "g"], ["k", "band", "r"], run, "image_id long, channel string, y int, x int, v long", dealt=True)


def subband_stats(coeffs: DataFrame, levels: int = 2) -> DataFrame:
    """``image_id, level, band, n, energy, entropy``: LL of the last level, and HL, LH, HH (low or high in x, then y) of each; entropy in bits of the band's distribution of values.

    Equal values of a band are counted before they are shuffled.
    """
    d = coeffs.join(shapes(coeffs), "image_id")
    level, band = F.lit(levels), F.lit("LL")
    for k in reversed(range(1, levels + 1)):  # the first level is asked first
        right, down = F.col("x") >= _low("width", k), F.col("y") >= _low("height", k)
        level = F.when(right | down, k).otherwise(level)
        band = F.when(right & down, "HH").when(right, "HL").when(down, "LH").otherwise(band)
    counts = d.groupBy("image_id", level.alias("level"), band.alias("band"), "v").agg(F.count("*").alias("c"))
    v, c = F.col("v").cast("double"), F.col("c")
    sums = counts.groupBy("image_id", "level", "band").agg(F.sum("c").alias("n"), F.sum(v * v * c).alias("energy"), F.sum(c * F.log2(c)).alias("s"))
    return sums.select("image_id", "level", "band", "n", "energy", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))


def pixel_crc(rgb: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(rgb, np.uint8).tobytes())


def wavelet_compress(pixels: DataFrame, levels: int = 4, effort: int = 9) -> DataFrame:
    """``image_id, height, width, levels, crc, archive, raw_bytes, archive_bytes`` of quantised pixels.

    Colour difference and Haar run as Spark groupings; one task then packs one image (at most four million pixels): zigzag, four byte planes, zlib.
    """
    from .channels import color_difference, quantize, split_channels

    coeffs = haar_forward(split_channels(color_difference(pixels)), levels).select(*CELL, zigzag(F.col("v")).alias("z"))
    wide = coeffs.groupBy("image_id", "y", "x").pivot("channel", ["R", "G", "B"]).agg(F.first("z")).withColumnsRenamed({c: f"z{c}" for c in "RGB"})
    both = wide.join(quantize(pixels), ["image_id", "y", "x"])

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["y", "x"])
        h, w = int(g["y"].max()) + 1, int(g["x"].max()) + 1
        crc = pixel_crc(g[["r", "g", "b"]].to_numpy())
        z = g[["zR", "zG", "zB"]].to_numpy(np.int64)
        planes = b"".join((z >> 8 * p & 255).astype(np.uint8).tobytes() for p in range(4))
        archive = struct.pack(HEADER, MAGIC, w, h, levels, crc) + zlib.compress(planes, effort)
        return pd.DataFrame({"image_id": [g["image_id"].iloc[0]], "height": [h], "width": [w], "levels": [levels], "crc": [crc], "archive": [archive], "raw_bytes": [h * w * 3], "archive_bytes": [len(archive)]})

    return both.groupBy("image_id").applyInPandas(pack, "image_id long, height int, width int, levels int, crc long, archive binary, raw_bytes long, archive_bytes long")


def _unpacked(archive: bytes) -> tuple[np.ndarray, int, int, str | None]:
    """``(zigzag values (H, W, 3), levels, crc, error)``."""
    none = np.zeros((0, 0, 3), np.int64)
    if len(archive) < struct.calcsize(HEADER):
        return none, 0, 0, "truncated header"
    magic, w, h, levels, crc = struct.unpack_from(HEADER, archive)
    if magic != MAGIC:
        return none, 0, 0, "wrong magic"
    if not (w and h and w * h <= MAX_PIXELS and 1 <= levels <= 8):
        return none, 0, 0, "bad dimensions"
    z = zlib.decompressobj()
    try:
        data = z.decompress(archive[struct.calcsize(HEADER) :], w * h * 12 + 1)
    except zlib.error:
        return none, 0, 0, "damaged stream"
    if len(data) != w * h * 12 or not z.eof or z.unused_data:
        return none, 0, 0, "wrong length"
    planes = np.frombuffer(data, np.uint8).reshape(4, h, w, 3).astype(np.int64)
    return sum(planes[p] << 8 * p for p in range(4)), levels, crc, None


def wavelet_decompress(archives: DataFrame, levels: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pixels, quarantine)`` of ``image_id, archive``: exact pixels of sound archives; ``image_id, error`` of the others (a CRC that differs included).

    An archive's header holds its number of levels; with ``levels``, archives of any other number are among the others.
    """

    def unpack(batches):
        for pdf in batches:
            for image_id, archive in zip(pdf["image_id"], pdf["archive"], strict=True):
                z, found, crc, error = _unpacked(bytes(archive))
                if error is None and levels is not None and found != levels:
                    error = "another number of levels"
                if error:
                    yield pd.DataFrame({"image_id": [image_id], "channel": [None], "y": [None], "x": [None], "z": [None], "crc": [None], "levels": [None], "error": [error]})
                    continue
                y, x = np.indices(z.shape[:2], dtype=np.int32)
                for c, name in enumerate("RGB"):
                    yield pd.DataFrame({"image_id": image_id, "channel": name, "y": y.ravel(), "x": x.ravel(), "z": z[:, :, c].ravel(), "crc": crc, "levels": found, "error": None})

    rows = archives.select("image_id", "archive").mapInPandas(unpack, "image_id long, channel string, y int, x int, z long, crc long, levels int, error string")
    good = rows.filter("error is null")
    coeffs = good.select(*CELL, "levels", unzigzag(F.col("z")).alias("v"))
    counts = [levels] if levels is not None else sorted(r.levels for r in good.select("levels").distinct().collect()) or [1]  # at most eight numbers
    samples = None
    for n in counts:
        part = haar_inverse(coeffs.filter(F.col("levels") == n).drop("levels"), n)
        samples = part if samples is None else samples.unionByName(part)
    p = samples.groupBy("image_id", "y", "x").pivot("channel", ["R", "G", "B"]).agg(F.first("v"))
    pixels = p.select("image_id", "y", "x", (F.col("R") + F.col("G")).cast("int").alias("r"), F.col("G").cast("int").alias("g"), (F.col("B") + F.col("G")).cast("int").alias("b"))
    byte = lambda c: F.lpad(F.hex(F.col(c).bitwiseAND(F.lit(255))), 2, "0")
    joined = lambda rows, part: F.array_join(F.transform(rows, lambda e: e[part]), "")
    cells = pixels.select("image_id", "y", "x", F.concat(byte("r"), byte("g"), byte("b")).alias("cell"), F.least("r", "g", "b").alias("lo"), F.greatest("r", "g", "b").alias("hi"))
    lines = cells.groupBy("image_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "cell"))).alias("cells"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = lines.select("image_id", "y", joined("cells", "cell").alias("row"), "lo", "hi").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = F.crc32(F.unhex(joined("rows", "row")))
    sums = whole.select("image_id", found.alias("found"), "lo", "hi").join(good.groupBy("image_id").agg(F.first("crc").alias("crc")), "image_id")
    broken = sums.filter("found <> crc or lo < 0 or hi > 255").select("image_id", F.lit("checksum differs").alias("error"))
    bad = rows.filter("error is not null").select("image_id", "error").unionByName(broken)
    return pixels.join(broken, "image_id", "left_anti"), bad


def verify_lossless(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """``image_id, identical`` of two pixel tables."""
    from .channels import split_channels
    from .metrics import compare_images

    return compare_images(split_channels(original), split_channels(decoded)).select("image_id", "identical")
