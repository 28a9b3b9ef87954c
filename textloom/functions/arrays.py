"""Arrays as values of expressions: names for what is used often, and running results in near-linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where the body uses it inside other lambdas. A column that
    is used twice is written into the plan twice; this names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running result of ``join`` (a sum or a maximum of values from 0) over an array of long, by blocks of
    the square root of its size: appending to an array in a fold would copy it for every element."""
    zero = F.lit(0).cast("long")

    def of(v: Column, size: Column) -> Column:
        fold = lambda first, n: F.aggregate(F.slice(v, first + 1, n), zero, join)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: fold(k * size, size))
        before = lambda whole: F.transform(whole, lambda _, k: F.aggregate(F.slice(whole, 1, k), zero, join))
        inside = lambda i: fold(i - i % size, i % size + 1)
        return let(let(blocks, before), lambda first: F.transform(v, lambda _, i: join(F.get(first, ((i - i % size) / size).cast("int")), inside(i))))

    some = lambda v: F.when(F.size(v) > 0, let(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda size: of(v, size))).otherwise(v)
    return let(values, some)
