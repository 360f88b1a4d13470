"""Row-array functions: rolls, pads, pole rows, upsampling and contractions of array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def roll(x: Column, shift: int, width: int) -> Column:
    """Elements moved right by shift, around the end."""
    shift %= width
    return F.concat(F.slice(x, width - shift + 1, shift), F.slice(x, 1, width - shift)) if shift else x


def ghost_row(x: Column, width: int) -> Column:
    """The row beyond a pole: the same latitude half a turn away; an odd width averages its two nearest turns."""
    if width % 2 == 0:
        return roll(x, width // 2, width)
    return F.zip_with(roll(x, width // 2, width), roll(x, width // 2 + 1, width), lambda a, b: (a + b) * 0.5)


def circular_pad(x: Column, pad: int, width: int) -> Column:
    return F.concat(F.slice(x, width - pad + 1, pad), x, F.slice(x, 1, pad))


def replicate_pad(x: Column, pad: int) -> Column:
    return F.concat(F.array_repeat(F.element_at(x, 1), pad), x, F.array_repeat(F.element_at(x, -1), pad))


def upsample_circular(x: Column, width: int) -> Column:
    """Twice the columns by linear interpolation (weights 1/4 and 3/4) around the circle."""

    def value(i: Column) -> Column:
        k = F.floor(i / 2).cast("int")
        side = F.when(i % 2 == 0, k - 1).otherwise(k + 1)
        return F.get(x, k) * 0.75 + F.get(x, F.pmod(side, F.lit(width)).cast("int")) * 0.25

    return F.transform(F.sequence(F.lit(0), F.lit(2 * width - 1)), value)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))
