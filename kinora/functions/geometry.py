"""Box and image geometry as column expressions. Division of a side truncates towards zero, rounding is half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, ...]:
    """The box inside the image, at least one pixel in either direction."""
    left, top = (F.greatest(F.lit(0), F.least(side - 1, at)) for side, at in ((width, x1), (height, y1)))
    return left, top, F.greatest(left + 1, F.least(width, x2)), F.greatest(top + 1, F.least(height, y2))


def padded(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, share: float = 0.15) -> tuple[Column, ...]:
    """The box widened on each side by a share of its size, then clamped."""
    px, py = ((far - near).cast("double") * share for near, far in ((x1, x2), (y1, y2)))
    px, py = px.cast("int"), py.cast("int")
    return clamped(x1 - px, y1 - py, x2 + px, y2 + py, width, height)


def scaled(x: Column, scale: Column) -> Column:
    return (x.cast("double") * scale).cast("int")


def detector_size(width: Column, height: Column, longest: int) -> tuple[Column, Column, Column]:
    """Width and height as the detector gets them, and the factor back to the original."""
    side = F.greatest(width, height).cast("double")
    factor = F.lit(float(longest)) / side
    fits = side <= longest
    new = [F.when(fits, s).otherwise(F.greatest(F.lit(1), F.bround(s.cast("double") * factor).cast("int"))) for s in (width, height)]
    return new[0], new[1], F.when(fits, F.lit(1.0)).otherwise(F.lit(1.0) / factor)
