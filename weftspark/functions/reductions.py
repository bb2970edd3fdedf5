"""Update-assignments to a tensor element from many iterations, as aggregates.

`/=` depends on the order of its writers and has no aggregate: it is a
projection (functions.scalar.ASSIGN) for a single writer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """+="""
    return F.sum(x.cast("bigint"))


def total_double(x: Column) -> Column:
    return F.sum(x.cast("double"))


def less(x: Column) -> Column:
    """-=, to be added to the first value."""
    return F.sum(-x.cast("bigint"))


def product(x: Column) -> Column:
    """*=: exact in BIGINT; a group whose product is beyond 62 bits raises.

    Signs and zeros are counted; only factors of 2 or more are gathered, of
    which a group without overflow has 62 at most.
    """
    x = x.cast("bigint")
    sign = F.when(F.sum((x < 0).cast("bigint")) % 2 == 1, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    size = F.aggregate(F.collect_list(F.when(F.abs(x) > 1, F.abs(x))), F.lit(1).cast("bigint"), lambda a, b: a * b)
    return F.when(F.count(x) == 0, F.lit(1).cast("bigint")).when(F.max((x == 0).cast("int")) == 1, F.lit(0).cast("bigint")).otherwise(sign * size)


def every(x: Column) -> Column:
    """&="""
    return F.bool_and(x != 0).cast("bigint")


def some(x: Column) -> Column:
    """|="""
    return F.bool_or(x != 0).cast("bigint")


def first_by(x: Column, order: Column) -> Column:
    """The first match of a loop that then leaves off."""
    return F.min_by(x, order)


def last_by(x: Column, order: Column) -> Column:
    """What the last writer leaves."""
    return F.max_by(x, order)


REDUCTIONS = {"+=": total, "-=": less, "*=": product, "&=": every, "|=": some, "min=": F.min, "max=": F.max}
