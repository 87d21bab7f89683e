"""Helpers for vectors held as ARRAY<DOUBLE>; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col


def as_double(v: Column | str) -> Column:
    return col(v).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A column referenced inside a lambda may be inlined by the optimizer and then recomputed for
    every element; a lambda variable cannot.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(v: Column | str) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def sum_squares(v: Column | str) -> Column:
    return F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x * x)


def mean(v: Column | str) -> Column:
    return total(v) / F.size(col(v))


def scale(v: Column | str, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(col(v), lambda x: x * f))


def centre(v: Column | str) -> Column:
    return let(mean(v), lambda m: F.transform(col(v), lambda x: x - m))


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def vector_sum(v: Column | str) -> Column:
    """Element-wise sum as an aggregate with map-side combine."""
    return vector_to_array(Summarizer.sum(array_to_vector(col(v))))


def vector_mean(v: Column | str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(col(v))))


def vector_std(v: Column | str) -> Column:
    return vector_to_array(Summarizer.std(array_to_vector(col(v))))
