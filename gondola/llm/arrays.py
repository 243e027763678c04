"""Array expressions whose cost grows in proportion to the array; Spark's aggregate copies an array that it extends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a chunk: within it a running value is appended to an array of at most so many.
CHUNK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; an expression that a lambda refers to is computed for each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """0 and then the running value after each element; quadratic, so for short arrays."""
    first = F.array(F.lit(0))
    return F.aggregate(values, first, lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))


def running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Running values of an int array under an associative operation with 0 as its neutral element, the sum by default: one
    for each element, itself included. Chunks are scanned by themselves, then their totals, chunk by chunk again."""
    totals = lambda parts: F.transform(parts, lambda part: F.element_at(part, -1))

    def chunks(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(CHUNK))
        return F.transform(starts, lambda i: _scan(F.slice(xs, i + 1, F.lit(CHUNK)), merge))

    def added(parts: Column, before: Column) -> Column:
        """Scans without their leading 0, each merged with what comes before its chunk."""
        whole = F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda part, b: F.transform(F.slice(part, F.lit(2), F.lit(CHUNK)), lambda x: merge(b, x)))
        return F.flatten(whole)

    def top(low: Column) -> Column:
        return let(let(totals(low), chunks), lambda high: let(_scan(totals(high), merge), lambda before: added(high, before)))

    scanned = lambda xs: let(chunks(xs), lambda low: let(F.concat(F.array(F.lit(0)), top(low)), lambda before: added(low, before)))
    return let(values, lambda xs: F.when(F.size(xs) > 0, scanned(xs)).otherwise(xs))
