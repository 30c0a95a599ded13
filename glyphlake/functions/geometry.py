"""Points, rectangles and affine matrices as column expressions.

Coordinates are 32-bit floats with the origin at the bottom left.  Spark widens a float in some
operations, so every result is cast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Page size in points where a page names none.
DEFAULT_SIZE = (595.0, 842.0)


def f32(c: Column) -> Column:
    return c.cast("float")


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The rectangle with a corner and a size, as struct x0, y0, x1, y1."""
    return F.struct(f32(x).alias("x0"), f32(y).alias("y0"), f32(x + w).alias("x1"), f32(y + h).alias("y1"))


def width(r: Column) -> Column:
    return f32(r["x1"] - r["x0"])


def height(r: Column) -> Column:
    return f32(r["y1"] - r["y0"])


def identity() -> Column:
    return matrix([F.lit(v) for v in (1, 0, 0, 1, 0, 0)])


def matrix(parts: Sequence[Column]) -> Column:
    return F.array(*(f32(p) for p in parts))


def transform_point(m: Column, x: Column, y: Column) -> Column:
    """The image of a point, as struct x, y."""
    of = lambda i, j, k: f32(f32(m[i] * f32(x)) + f32(m[j] * f32(y)) + m[k])
    return F.struct(of(0, 2, 4).alias("x"), of(1, 3, 5).alias("y"))


def concat(m: Column, n: Column) -> Column:
    """The matrix that applies ``n`` first and ``m`` to the result."""
    dot = lambda row, i: f32(m[row] * n[i]) + f32(m[row + 2] * n[i + 1])
    shift = lambda row: f32(m[row] * n[4]) + f32(m[row + 2] * n[5]) + m[row + 4]
    return matrix([dot(0, 0), dot(1, 0), dot(0, 2), dot(1, 2), shift(0), shift(1)])


def product(matrices: Column) -> Column:
    """The product of an array of matrices, the last one applied first."""
    return F.aggregate(matrices, identity(), concat)


def bounds() -> list[Column]:
    """Aggregates for the box around rectangles x0, y0, x1, y1; all zero around none."""
    return [F.coalesce(f(c), F.lit(0.0).cast("float")).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]


def mean_scale(m: Column) -> Column:
    """How much a matrix enlarges on average over its axes, 0.01 at least."""
    axis = lambda a, b: F.sqrt((m[a] * m[a] + m[b] * m[b]).cast("double"))
    return f32(F.greatest((axis(0, 1) + axis(2, 3)) * 0.5, F.lit(0.01).cast("double")))


def page_size(w: Column, h: Column) -> Column:
    """A page's width and height; the default where either is missing or not positive."""
    good = (w > 0) & (h > 0)
    return F.struct(*(f32(F.when(good, v).otherwise(F.lit(d))).alias(n) for v, d, n in ((w, DEFAULT_SIZE[0], "width"), (h, DEFAULT_SIZE[1], "height"))))


def number(v: Column) -> Column:
    """A numeric operand given as text; 0 for anything else."""
    return F.coalesce(v.try_cast("float"), F.lit(0.0).cast("float"))
