"""Index notation: `Z[m,n] += A[m,k] * B[k,n] - 3 * C[n]`, lowered to joins and one aggregation.

An index is affine in variables (`I[q+s]`, `I[2*p+r-1]`), their tiles (`A[i/4]`,
`A[i%4]`) and elements of other tensors (`X[B[i]]`, a gather). Each factor
becomes a relation over its variables: all but one variable of an affine index
run over their extents (as rows of an exploded range), the last is solved for,
and solutions out of range go. A gathered element is a variable of its own,
bound by a join with the tensor that holds it (filled up with zeros). Factors are then joined on the variables they share, terms are put
together, the output's indices are the grouping keys, and Catalyst picks the
joins. Extents come from the shapes of factors with plain indices, or are given.
Whatever the notation doesn't have raises ValueError.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark import storage
from weftspark.functions.reductions import REDUCTIONS
from weftspark.model import Tensor


@dataclass(frozen=True)
class Tile:
    """A variable divided by a number, or (rest) what remains."""

    var: str
    by: int
    rest: bool

    def of(self, value: Column) -> Column:
        return value % self.by if self.rest else F.floor(value / self.by).cast("int")


@dataclass(frozen=True)
class Access:
    name: str
    index: tuple[Affine, ...]

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for a in self.index for v in a.variables))


@dataclass(frozen=True)
class Affine:
    """Sum of coefficient * (variable, tile or gathered element), plus a constant."""

    terms: tuple[tuple[str | Tile | Access, int], ...]
    constant: int

    @staticmethod
    def parse(text: str) -> Affine:
        return _Reader(text).whole(_Reader.affine)

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for b, _ in self.terms for v in ([b] if isinstance(b, str) else [b.var] if isinstance(b, Tile) else b.variables)))


@dataclass(frozen=True)
class Term:
    scale: int
    factors: tuple[Access, ...]


class _Reader:
    """Reads a statement from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0
        self.words = re.findall(r"min=|max=|[-+*&|]=|\w+|\S", text)

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at] in wanted:
            self.at += 1
            return self.words[self.at - 1]
        return None

    def need(self, what: str, pattern: str) -> str:
        if self.at >= len(self.words) or not re.fullmatch(pattern, self.words[self.at]):
            raise ValueError(f"{self.text!r}: {what} expected at word {self.at + 1}")
        self.at += 1
        return self.words[self.at - 1]

    def next_is(self, pattern: str) -> bool:
        return self.at < len(self.words) and re.fullmatch(pattern, self.words[self.at]) is not None

    def whole(self, rule):
        out = rule(self)
        if self.at < len(self.words):
            raise ValueError(f"{self.text!r}: {self.words[self.at]!r} is not understood")
        return out

    def signed(self, rule) -> list[tuple[int, object]]:
        """Parts between + and -, with their signs."""
        out = [(-1 if self.take("-") else 1, rule())]
        while sign := self.take("+", "-"):
            out.append((-1 if sign == "-" else 1, rule()))
        return out

    def statement(self) -> tuple[Access, str, list[Term]]:
        left = self.access()
        op = self.need("an update", r"min=|max=|[-+*&|]=")
        return left, op, [Term(sign * k, f) for sign, (k, f) in self.signed(self.product)]

    def product(self) -> tuple[int, tuple[Access, ...]]:
        scale, factors = 1, []
        while True:
            if self.next_is(r"\d+"):
                scale *= int(self.need("a number", r"\d+"))
            else:
                factors.append(self.access())
            if not self.take("*"):
                return scale, tuple(factors)

    def access(self) -> Access:
        name, index = self.need("a name", r"[A-Za-z_]\w*"), []
        if self.take("[") and not self.take("]"):
            index.append(self.affine())
            while self.take(","):
                index.append(self.affine())
            self.need("]", r"\]")
        return Access(name, tuple(index))

    def affine(self) -> Affine:
        terms, constant = {}, 0
        for sign, (k, base) in self.signed(self.index_part):
            if base is None:
                constant += sign * k
            else:
                terms[base] = terms.get(base, 0) + sign * k
        return Affine(tuple((b, k) for b, k in terms.items() if k), constant)

    def index_part(self) -> tuple[int, str | Tile | Access | None]:
        k, base = 1, None
        while True:
            if self.next_is(r"\d+"):
                k *= int(self.need("a number", r"\d+"))
            elif base is None:
                base = self.base()
            else:
                raise ValueError(f"{self.text!r}: an index has no products of variables")
            if not self.take("*"):
                return k, base

    def base(self) -> str | Tile | Access:
        at, name = self.at, self.need("a variable", r"[A-Za-z_]\w*")
        if self.next_is(r"\["):
            self.at = at
            return self.access()
        if op := self.take("/", "%"):
            by = int(self.need("a number", r"\d+"))
            if by < 1:
                raise ValueError(f"{self.text!r}: tiles of no size")
            return Tile(name, by, op == "%")
        return name


def parse(text: str) -> tuple[Access, str, list[Term]]:
    """Output, reduction, and terms of a statement."""
    return _Reader(text).whole(_Reader.statement)


def access(text: str) -> Access:
    return _Reader(text).whole(_Reader.access)


def without_gathers(factors: tuple[Access, ...], number: Iterator[int]) -> tuple[list[Access], list[tuple[Access, str]]]:
    """Factors whose gathered elements are variables, and what binds these."""
    plain, bound, todo = [], [], [(f, None) for f in factors]
    while todo:
        f, name = todo.pop(0)
        index = []
        for a in f.index:
            terms = []
            for b, k in a.terms:
                if isinstance(b, Access):
                    todo.append((b, f"_g{next(number)}"))
                    b = todo[-1][1]
                terms.append((b, k))
            index.append(Affine(tuple(terms), a.constant))
        if name is None:
            plain.append(Access(f.name, tuple(index)))
        else:
            bound.append((Access(f.name, tuple(index)), name))
    return plain, bound


def extents(factors: list[Access], tensors: dict[str, Tensor], given: dict[str, int]) -> dict[str, int]:
    """Size of each variable: given, from a plain index, or what an affine or tile index leaves for its only unknown."""
    out = dict(given)
    pairs = [(a, size) for f in factors for a, size in zip(f.index, tensors[f.name].shape, strict=True)]
    for a, size in pairs:
        if len(a.terms) == 1 and isinstance(a.terms[0][0], str) and a.terms[0][1] == 1 and not a.constant:
            v = a.terms[0][0]
            if v not in given:
                out[v] = min(out.get(v, size), size)
    for a, size in pairs:
        if len(a.terms) == 1 and isinstance(t := a.terms[0][0], Tile) and not t.rest and a.terms[0][1] == 1 and not a.constant:
            out.setdefault(t.var, size * t.by)
    for a, size in pairs:
        if any(isinstance(b, Tile) for b, _ in a.terms):
            continue
        unknown = [(v, k) for v, k in a.terms if v not in out]
        if len(unknown) == 1 and all(k > 0 for _, k in a.terms):
            reach = a.constant + sum(k * (out[v] - 1) for v, k in a.terms if v in out)
            out[unknown[0][0]] = max(0, (size - 1 - reach) // unknown[0][1] + 1)
    missing = {v for a, _ in pairs for v in a.variables} - set(out)
    if missing:
        raise ValueError(f"the extents of {sorted(missing)} must be given")
    return out


def _run(df: DataFrame, var: str, size: int, first: Column | None = None, step: int = 1) -> DataFrame:
    """df with a row for each value of a variable."""
    if size < 1:
        return df.withColumn(var, F.lit(0)).where("false")
    return df.withColumn(var, F.explode(F.sequence(F.lit(0) if first is None else first, F.lit(size - 1), F.lit(step))))


def relation(f: Access, tensor: Tensor, sizes: dict[str, int], value: str) -> DataFrame:
    """Rows (variables, value) of one factor."""
    df = tensor.df.select(*[F.col(c).alias(f"_i{k}") for k, c in enumerate(tensor.index)], F.col(tensor.value).alias(value))
    known: set[str] = set()
    # plain indices first: they bind variables without widening anything
    for k, a in sorted(enumerate(f.index), key=lambda x: (len(x[1].terms), any(isinstance(b, Tile) for b, _ in x[1].terms))):
        left = F.col(f"_i{k}").cast("int") - a.constant
        if len(a.terms) == 1 and isinstance(t := a.terms[0][0], Tile) and a.terms[0][1] == 1 and t.var not in known:
            # all values whose quotient or remainder the index is
            lowest, step = (left, t.by) if t.rest else (left * t.by, 1)
            df = df.where((left >= 0) & (lowest < sizes[t.var]) & ((left < t.by) if t.rest else F.lit(True)))
            last = F.lit(sizes[t.var] - 1) if t.rest else F.least(F.lit(sizes[t.var] - 1), lowest + (t.by - 1))
            df = df.withColumn(t.var, F.explode(F.sequence(lowest, last, F.lit(step))))
            known.add(t.var)
            continue
        for b, c in a.terms:
            if isinstance(b, Tile):
                if b.var not in known:
                    df = _run(df, b.var, sizes[b.var])
                    known.add(b.var)
                left = left - b.of(F.col(b.var)) * c
        plain = [(v, c) for v, c in a.terms if isinstance(v, str)]
        free = [(v, c) for v, c in plain if v not in known]
        for v, c in plain:
            if v in known:
                left = left - F.col(v) * c
        if not free:
            df = df.where(left == 0)
            continue
        for v, c in free[1:]:
            df = _run(df, v, sizes[v])
            left = left - F.col(v) * c
            known.add(v)
        v, c = free[0]
        df = df.withColumn("_left", left).where(F.col("_left") % c == 0)
        df = df.withColumn(v, (F.col("_left") / c).cast("int")).drop("_left").where(F.col(v).between(0, sizes[v] - 1))
        known.add(v)
    return df.select(*f.variables, value)


def sized(rows: DataFrame, variables: set[str], sizes: dict[str, int]) -> DataFrame:
    """A side of a join with a hint: it may be broadcast only if the extents of its variables say that it is small.

    Spark's estimate is that of what a side was made from, before its loops.
    """
    most = math.prod(sizes.get(v, 1 << 40) for v in variables)
    return F.broadcast(rows) if most * 8 * (len(variables) + 1) <= storage.BROADCAST_BYTES else rows.hint("merge")


def einsum(statement: str, tensors: dict[str, Tensor], given: dict[str, int] | None = None, double: bool = False) -> Tensor:
    """The output tensor of a statement. given: extents that no shape tells.

    A statement runs over all its variables: a term that lacks one is added
    once for each of its values. Several terms need += or -=, as an entry that
    one term's tensors lack is 0.
    """
    left, op, terms = parse(statement)
    if any(isinstance(b, Access) for a in left.index for b, _ in a.terms):
        raise ValueError(f"{statement!r}: the output's index is gathered")
    if len(terms) > 1 and op not in ("+=", "-="):
        raise ValueError(f"{statement!r}: {op} of several terms")
    number = itertools.count()
    lowered = [(t.scale, *without_gathers(t.factors, number)) for t in terms]
    sizes = extents([f for _, factors, bound in lowered for f in [*factors, *(b for b, _ in bound)]], tensors, given or {})
    nest = dict.fromkeys([v for a in left.index for v in a.variables] + [v for _, factors, bound in lowered for f in [*factors, *(b for b, _ in bound)] for v in f.variables if not v.startswith("_g")])
    outer = {v for a in left.index for v in a.variables}
    if unknown := [v for v in nest if v not in sizes]:
        raise ValueError(f"{statement!r}: the extents of {unknown} must be given")
    kind = "double" if double else "bigint"
    names = tuple(f"{a.terms[0][0]}" if len(a.terms) == 1 and isinstance(a.terms[0][0], str) and not a.constant else f"i{k}" for k, a in enumerate(left.index))
    parts = []
    for scale, factors, bound in lowered:
        rows, have = None, set()
        for i, (f, name) in enumerate([*((f, None) for f in factors), *bound]):
            one = relation(f, tensors[f.name].dense() if name else tensors[f.name], sizes, f"_v{i}")
            if name:
                one = one.withColumnRenamed(f"_v{i}", name).withColumn(name, F.col(name).cast("int"))
            own = [*f.variables, *([name] if name else [])]
            shared = [v for v in own if v in have]
            if rows is not None and shared:
                rows, one = sized(rows, have, sizes), sized(one, set(own), sizes)
            rows = one if rows is None else rows.join(one, shared) if shared else rows.crossJoin(one)
            have |= set(own)
        value = F.lit(scale).cast(kind)
        for i in range(len(factors)):
            value = value * F.col(f"_v{i}").cast(kind)
        if rows is None:
            rows = next(iter(tensors.values())).df.sparkSession.range(1)
        for v in nest:
            if v not in have and v in outer:
                rows = _run(rows, v, sizes[v])
            elif v not in have and len(terms) > 1:
                value = value * sizes[v]
        keys = []
        for name, a in zip(names, left.index, strict=True):
            e = F.lit(a.constant)
            for b, c in a.terms:
                e = e + (F.col(b) if isinstance(b, str) else b.of(F.col(b.var))) * c
            keys.append(e.cast("int").alias(name))
        parts.append(rows.select(*keys, value.alias("_x")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    value = F.col("_x")
    reduced = (F.sum(value) if double and op == "+=" else REDUCTIONS[op](value)).alias("v")
    most = lambda b: sizes[b] - 1 if isinstance(b, str) else min(b.by, sizes[b.var]) - 1 if b.rest else (sizes[b.var] - 1) // b.by
    shape = tuple(a.constant + sum(c * most(b) for b, c in a.terms) + 1 for a in left.index)
    return Tensor(every.groupBy(*names).agg(reduced), names, shape)
