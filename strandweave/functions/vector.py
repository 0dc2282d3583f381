"""Vector columns (ARRAY of FLOAT or DOUBLE), evaluated in the JVM, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null where a side is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def unit(a: Column) -> Column:
    """The vector over its length, in doubles; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def mirrored(v: Column, rows: int, cols: int) -> Column:
    """A two-map feature vector (each rows x cols, row-major) of the picture flipped left to right.

    The first map's columns are reversed. The second holds differences between horizontal neighbours, so it
    changes its sign and moves by a column; the edge column is repeated.
    """
    size = rows * cols

    def at(i: Column) -> Column:
        m, rest = F.floor(i / size), i % size
        r, c = F.floor(rest / cols), rest % cols
        first = F.element_at(v, (r * cols + (cols - 1 - c) + 1).cast("int"))
        back = F.least(F.lit(cols - 1), F.lit(cols) - c)
        second = -F.element_at(v, (F.lit(size) + r * cols + back + 1).cast("int"))
        return F.when(m == 0, first).otherwise(second)

    return F.transform(F.sequence(F.lit(0), F.lit(2 * size - 1)), at)
