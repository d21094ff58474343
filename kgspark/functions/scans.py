"""Ordered work inside one array: prefix scans, searches in sorted arrays and greedy runs.

A fold that appends to its own result copies that result at every element. The functions here need
about log2(n) passes over the array instead and hold nothing that grows from element to element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind

_POWERS = tuple(1 << k for k in range(31))  # an array has fewer than 2**31 elements


def _powers_below(n: Column) -> Column:
    return F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n)


def prefix_scan(items: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """``items`` with every element combined with all before it.

    ``combine(earlier, later)`` is associative and returns the type of the elements. Each pass combines every
    element with the one 1, 2, 4, … places before it. NULL stays NULL, an empty array stays empty.
    """

    def run(array: Column) -> Column:
        def double(acc: Column, shift: Column) -> Column:
            return F.transform(acc, lambda x, i: F.when(i < shift, x).otherwise(combine(F.get(acc, i - shift), x)))

        return F.aggregate(_powers_below(F.size(array)), array, double)

    return bind(items, run)


def first_above(ascending: Column, bound: Column, strict: bool = True) -> Column:
    """0-based place of the first element over ``bound`` (not below it, if not ``strict``); the size if none is.

    A binary search; ``ascending`` is a column or a lambda variable, so that it is not computed again.
    """
    size = F.size(ascending)
    down = F.reverse(F.array(*[F.lit(p) for p in _POWERS]))

    def halve(at: Column, stride: Column) -> Column:
        value = F.get(ascending, at + stride - 1)
        passed = value <= bound if strict else value < bound
        return F.when((stride <= size - at) & passed, at + stride).otherwise(at)

    return F.aggregate(down, F.lit(0), halve)


def chain(pointers: Column) -> Column:
    """The places 0, p[0], p[p[0]], … below the array's size; every pointer lies ahead of its place.

    After each pass the list of places is twice as long and the pointers lead twice as far.
    """

    def run(array: Column) -> Column:
        size = F.size(array)

        def double(acc: Column, _: Column) -> Column:
            jump = lambda at: F.coalesce(F.get(acc["p"], at), size)
            more = F.filter(F.transform(acc["s"], jump), lambda at: at < size)
            return F.struct(F.concat(acc["s"], more).alias("s"), F.transform(acc["p"], jump).alias("p"))

        start = F.struct(F.array(F.lit(0)).alias("s"), array.alias("p"))
        places = F.aggregate(F.concat(F.array(F.lit(1)), _powers_below(size)), start, double, lambda acc: acc["s"])
        return F.when(size > 0, places).when(size == 0, F.array().cast("array<int>"))

    return bind(pointers, run)


def runs(starts: Column, size: Column) -> Column:
    """Starts of runs to ARRAY<STRUCT<start, end>>: 0-based, the end excluded."""

    def run(array: Column) -> Column:
        return F.transform(
            array, lambda s, i: F.struct(s.alias("start"), F.coalesce(F.get(array, i + 1), size).alias("end"))
        )

    return bind(starts, run)


def greedy_runs(weights: Column, limit: int, between: Column) -> Column:
    """Neighbours join a run while its weights, with ``between`` for every joint, stay within ``limit``.

    Returns ARRAY<STRUCT<start, end>>. An element over the limit is a run of its own, and so is one
    without weight that begins a run: nothing is joined to it.
    """
    # With w + between for every element, a run weighs the difference of two sums less one joint.
    sums = prefix_scan(F.transform(weights, lambda w: w.cast("long") + between), lambda a, b: a + b)

    def run(array: Column) -> Column:
        def following(total: Column, i: Column) -> Column:
            before = F.coalesce(F.get(array, i - 1), F.lit(0).cast("long"))
            return F.when(total - before == between, i + 1).otherwise(
                F.greatest(i + 1, first_above(array, before + limit + between))
            )

        return runs(chain(F.transform(array, following)), F.size(array))

    return bind(sums, run)
