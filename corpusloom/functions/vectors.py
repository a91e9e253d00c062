"""Column expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit vector as floats; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)).cast("float"))


def largest(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))


def quantize(v: Column, scale: Column) -> Column:
    """Whole steps of ``scale``, halves up, within -127 to 127."""
    step = lambda x: F.floor(x.cast("double") / scale + 0.5)
    return F.transform(v, lambda x: F.greatest(F.least(step(x), F.lit(127)), F.lit(-127)).cast("tinyint"))
