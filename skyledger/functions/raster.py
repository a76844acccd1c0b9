"""Column functions of pixels: scaling, validity, ratios and the maps between grid and world."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scene classes that hide the ground: saturated, shadow, medium and high cloud, cirrus, snow.
EXCLUDED_CLASSES = (1, 3, 8, 9, 10, 11)
SCENE_CLASSES = 12


def physical(dn: Column, scale: float = 1e-4, offset: float = -0.1) -> Column:
    """The physical value of a stored number."""
    return dn * F.lit(scale) + F.lit(offset)


def valid(dn: Column, mask: Column, nodata: float = 0.0) -> Column:
    """Masked in, not nodata, and a number."""
    return F.coalesce(mask & (dn != nodata) & ~F.isnan(dn.cast("double")), F.lit(False))


def ratio_valid(a: Column, b: Column, both: Column) -> Column:
    """Whether ``(a - b) / (a + b)`` may be taken."""
    return F.coalesce(both & ~F.isnan(a) & ~F.isnan(b) & (a >= 0) & (b >= 0) & (a + b > 1e-6), F.lit(False))


def normalized_difference(a: Column, b: Column, ok: Column) -> Column:
    """``(a - b) / (a + b)`` in single precision, kept as double; null where not ``ok``."""
    return F.when(ok, F.try_divide(a - b, a + b)).cast("float").cast("double")


def clear(scene_class: Column, ok: Column) -> Column:
    """Valid and not of a hiding class."""
    return F.coalesce(ok & ~scene_class.isin(*EXCLUDED_CLASSES), F.lit(False))


def center_x(c: Column, a: Column, col: Column) -> Column:
    return c + a * (col + 0.5)


def center_y(f: Column, e: Column, row: Column) -> Column:
    return f + e * (row + 0.5)


def source_index(world: Column, origin: Column, step: Column) -> Column:
    """The row or column of a grid that holds a world coordinate."""
    return F.floor((world - origin) / step)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))
