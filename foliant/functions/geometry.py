"""Boxes and colours as column expressions. Boxes are in points with y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) != 0


def mid(a: Column, b: Column) -> Column:
    return (a + b) / 2


def is_centred(x0: Column, x1: Column, width: Column, tolerance: float) -> Column:
    """Whether a box's middle is strictly within the tolerance of the page's."""
    return F.abs(mid(x0, x1) - width / 2) < tolerance


def rgb(color: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue (0-255) of ``#rrggbb``."""
    return tuple(F.conv(F.substring(color, k, 2), 16, 10).cast("int") for k in (2, 4, 6))


def is_near_white(color: Column, least: int = 240) -> Column:
    return F.least(*rgb(color)) >= least


def saturation(color: Column) -> Column:
    """(max - min) / max of the channels, 0 for black."""
    high, low = F.greatest(*rgb(color)), F.least(*rgb(color))
    return F.when(high > 0, (high - low) / high).otherwise(0.0)


def color_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((F.pow(x - y, F.lit(2)) for x, y in zip(rgb(a), rgb(b), strict=True)), F.lit(0.0)))


def luminance(color: Column) -> Column:
    """Relative luminance of a colour."""
    linear = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    r, g, b = rgb(color)
    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
