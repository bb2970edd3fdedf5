"""Scalar operators of index-notation programs, as columns.

Whole numbers are computed as BIGINT, so nothing wraps; division truncates
toward zero, the remainder has the dividend's sign, and comparisons and logic
give 0 or 1. Logical operators take any number, 0 being false. Assigning
variants (and_assign, or_assign) are logical, the plain ones (bit_and, bit_or)
are bitwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Operand = Column | int | float


def _c(x: Operand) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _big(x: Operand) -> Column:
    return _c(x).cast("bigint")


def _flag(x: Column) -> Column:
    return x.cast("bigint")


def add(a: Operand, b: Operand) -> Column:
    return _big(a) + _big(b)


def subtract(a: Operand, b: Operand) -> Column:
    return _big(a) - _big(b)


def multiply(a: Operand, b: Operand) -> Column:
    return _big(a) * _big(b)


def divide(a: Operand, b: Operand) -> Column:
    return F.call_function("div", _big(a), _big(b))


def divide_double(a: Operand, b: Operand) -> Column:
    """Floating-point division; by 0 it raises, as divide() does."""
    return _c(a).cast("double") / _c(b).cast("double")


def modulo(a: Operand, b: Operand) -> Column:
    return _big(a) % _big(b)


def eq(a: Operand, b: Operand) -> Column:
    return _flag(_c(a) == _c(b))


def int_eq(a: Operand, b: Operand) -> Column:
    return _flag(_c(a).cast("int") == _c(b).cast("int"))


def ne(a: Operand, b: Operand) -> Column:
    return _flag(_c(a) != _c(b))


def ge(a: Operand, b: Operand) -> Column:
    return _flag(_c(a) >= _c(b))


def le(a: Operand, b: Operand) -> Column:
    return _flag(_c(a) <= _c(b))


def gt(a: Operand, b: Operand) -> Column:
    return _flag(_c(a) > _c(b))


def lt(a: Operand, b: Operand) -> Column:
    return _flag(_c(a) < _c(b))


def logical_and(a: Operand, b: Operand) -> Column:
    return _flag((_c(a) != 0) & (_c(b) != 0))


def logical_or(a: Operand, b: Operand) -> Column:
    return _flag((_c(a) != 0) | (_c(b) != 0))


def bit_and(a: Operand, b: Operand) -> Column:
    return _big(a).bitwiseAND(_big(b))


def bit_or(a: Operand, b: Operand) -> Column:
    return _big(a).bitwiseOR(_big(b))


def second(a: Operand, b: Operand) -> Column:
    return _c(b)


def increment(a: Operand) -> Column:
    return _big(a) + 1


def post_increment(a: Operand) -> tuple[Column, Column]:
    """The value before, and the new value."""
    return _big(a), _big(a) + 1


BINARY: dict[str, Callable[[Operand, Operand], Column]] = {f.__name__: f for f in (add, subtract, multiply, divide, modulo, eq, int_eq, ne, ge, le, gt, lt, logical_and, logical_or, bit_and, bit_or, second)}
UNARY: dict[str, Callable[[Operand], Column]] = {"increment": increment}

#: What x OP= y leaves in x.
ASSIGN: dict[str, Callable[[Operand, Operand], Column]] = {"=": second, "+=": add, "-=": subtract, "*=": multiply, "/=": divide, "&=": logical_and, "|=": logical_or}
