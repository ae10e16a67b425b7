"""Vector expressions over ``array<double>`` columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_vector(values: Column) -> Column:
    """Widen a numeric array to doubles, so that products do not round."""
    return values.cast("array<double>")


def flatten_vector(rows: Column) -> Column:
    """Nested arrays of numbers as one vector."""
    return as_vector(F.flatten(rows))


def dot(a: Column, b: Column) -> Column:
    """Dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector has no direction and gives nulls."""
    length = norm(a)
    return F.transform(a, lambda x: F.try_divide(x, length))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the two unit vectors, dividing once instead of per element."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def text_key(text: Column) -> Column:
    """Content key of a text: equal texts share a key and so are encoded once."""
    return F.sha2(text, 256)


def moments(vector: Column) -> Column:
    """Aggregate: mean, variance and count per dimension in one pass.

    The aggregate merges partial results, so a group of any size is combined
    on the map side and none is ever collected.
    """
    return Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(vector))


def mean_vector(m: Column) -> Column:
    """Mean vector out of ``moments``."""
    return vector_to_array(m["mean"])


def variance_vector(m: Column) -> Column:
    """Population variance per dimension out of ``moments``."""
    n = m["count"].cast("double")
    return F.transform(vector_to_array(m["variance"]), lambda v: v * (n - 1.0) / n)


def spread(m: Column) -> Column:
    """Mean over the dimensions of the population variance."""
    v = variance_vector(m)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)


def as_matrix(column, unit: bool = False, width: int | None = None):
    """Arrow list column, inside a task, as rows of doubles, or of unit vectors.

    Vectors of different lengths are an error, or of another than ``width``.
    """
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.min_max(pc.list_value_length(column)).as_py()
    if lengths["min"] != lengths["max"]:
        raise ValueError(f"vectors of {lengths['min']} to {lengths['max']} dimensions in one column")
    if width is not None and lengths["min"] not in (None, width):
        raise ValueError(f"vectors of {lengths['min']} dimensions, queries of {width} dimensions")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1 if len(column) else width or 0)
    if unit:
        with np.errstate(invalid="ignore"):
            rows = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
    return rows
