"""Vector arithmetic as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """JavaScript's Math.round: halves go up."""
    return F.floor(c + 0.5)


def round4(vector: Column) -> Column:
    """Every element at four decimals, halves of the multiplied value up. What
    has no decimals stays as it is: numbers from 2^52 on, infinities, NaN."""

    def one(x: Column) -> Column:
        scaled = x.cast("double") * 10000
        return F.when(F.abs(scaled) >= 2.0**52, scaled / F.lit(10000.0)).otherwise((round_half_up(scaled) / F.lit(10000.0)).cast("double"))

    return F.transform(vector, one)


def rounded4(values: np.ndarray) -> np.ndarray:
    """The same of numbers in a task."""
    scaled = values * 10000
    return np.where(np.abs(scaled) >= 2.0**52, scaled, np.floor(scaled + 0.5)) / 10000.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector is zero, an error if the lengths
    differ. ``norm_b`` spares the norm of a vector that is the same in all rows."""
    na, nb = norm(a), norm(b) if norm_b is None else norm_b
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), na * nb))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension")).cast("double")).otherwise(value)
