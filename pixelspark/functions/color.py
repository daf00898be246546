"""Column expressions for colours and for the reversible integer transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped(v: str | Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))


def displayed(v: str | Column) -> Column:
    """Clip, then truncate: the cast of display and storage."""
    return clipped(v).cast("int")


def quantized(v: str | Column) -> Column:
    """Clip, then round half to even: the cast of processing."""
    return F.rint(clipped(v)).cast("int")


def luminance(r="r", g="g", b="b") -> Column:
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return 0.299 * r + 0.587 * g + 0.114 * b


def ycbcr(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """Full-range BT.601, clipped."""
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    rows = ((0.299, 0.587, 0.114, 0.0), (-0.168736, -0.331264, 0.5, 128.0), (0.5, -0.418688, -0.081312, 128.0))
    return tuple(clipped(p * r + q * g + s * b + o) for p, q, s, o in rows)


def gray8(r="r", g="g", b="b") -> Column:
    """Eight-bit gray in 15-bit fixed point."""
    r, g, b = (F.col(c).cast("int") for c in (r, g, b))
    return F.shiftright(r * 9798 + g * 19235 + b * 3735 + 16384, 15)


def lab8(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    """Eight-bit CIELAB (D65) of sRGB in [0, 255]: L * 255 / 100, a + 128, b + 128, rounded half to even."""

    def linear(c: Column) -> Column:
        c = c / 255.0
        return F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92)

    lr, lg, lb = (linear(F.col(c).cast("double")) for c in (r, g, b))
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    level = F.when(y > 0.008856, 116 * F.pow(y, F.lit(1 / 3)) - 16).otherwise(903.3 * y)
    return quantized(level * 255 / 100), quantized(500 * (f(x) - f(y)) + 128), quantized(200 * (f(y) - f(z)) + 128)


def rgb_of_lab8(l8="l", a8="a", b8="b") -> tuple[Column, Column, Column]:
    """Back to sRGB in [0, 255], rounded; within one level of the input of ``lab8`` for most colours."""
    level, a, b = F.col(l8) * 100 / 255, F.col(a8) - 128, F.col(b8) - 128
    fy = F.when(level > 903.3 * 0.008856, (level + 16) / 116).otherwise(7.787 * level / 903.3 + 16 / 116)
    y = F.when(level > 903.3 * 0.008856, F.pow((level + 16) / 116, F.lit(3.0))).otherwise(level / 903.3)
    back = lambda t: F.when(t > 0.206893, F.pow(t, F.lit(3.0))).otherwise((t - 16 / 116) / 7.787)
    x, z = back(fy + a / 500) * 0.950456, back(fy - b / 200) * 1.088754
    rows = ((3.240479, -1.537150, -0.498535), (-0.969256, 1.875991, 0.041556), (0.055648, -0.204043, 1.057311))
    gamma = lambda c: F.when(c > 0.0031308, 1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055).otherwise(12.92 * c) * 255
    return tuple(quantized(gamma(F.greatest(F.lit(0.0), p * x + q * y + s * z))) for p, q, s in rows)


def zigzag(c: Column) -> Column:
    return F.when(c >= 0, 2 * c).otherwise(-2 * c - 1)


def unzigzag(z: Column) -> Column:
    return F.shiftright(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def reflected(i: Column, n: Column) -> Column:
    """Index of the border that mirrors without repeating the edge; valid for any distance."""
    m = F.pmod(i, F.greatest(2 * (n - 1), F.lit(1)))
    return F.when(n == 1, 0).when(m < n, m).otherwise(2 * (n - 1) - m).cast("int")
