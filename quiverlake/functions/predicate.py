"""Filters as small trees of comparisons, checked against a schema on the driver and compiled to Spark expressions.

Two null logics: "two" (a null never fulfils a comparison, and NOT turns that around, so NOT (c = 1) keeps nulls) and "three"
(SQL's own). Equality under NOT becomes a null-safe comparison, which Parquet scans take as a pushed filter.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.info import PropertyGroup
from ..plans.types import VID


class Expression:
    def __and__(self, other: Expression) -> Expression:
        return And((self, other))

    def __or__(self, other: Expression) -> Expression:
        return Or((self, other))

    def __invert__(self) -> Expression:
        return self.inner if isinstance(self, Not) else Not(self)


@dataclass(frozen=True)
class Property(Expression):
    name: str


@dataclass(frozen=True)
class Literal(Expression):
    value: object


@dataclass(frozen=True)
class Compare(Expression):
    op: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class And(Expression):
    parts: tuple[Expression, ...]

    def __post_init__(self):
        object.__setattr__(self, "parts", _flat(And, self.parts))


@dataclass(frozen=True)
class Or(Expression):
    parts: tuple[Expression, ...]

    def __post_init__(self):
        object.__setattr__(self, "parts", _flat(Or, self.parts))


@dataclass(frozen=True)
class Not(Expression):
    inner: Expression


@dataclass(frozen=True)
class IsNull(Expression):
    of: Property


def _flat(kind: type, parts: Iterable[Expression]) -> tuple[Expression, ...]:
    out: list[Expression] = []
    for p in parts:
        out.extend(p.parts if isinstance(p, kind) else [p])
    if not out:
        raise ValueError("no part")
    return tuple(out)


def _side(x: object) -> Expression:
    return x if isinstance(x, Expression) else Literal(x)


def prop(name: str) -> Property:
    return Property(name)


def eq(a, b) -> Compare:
    return Compare("=", _side(a), _side(b))


def ne(a, b) -> Compare:
    return Compare("!=", _side(a), _side(b))


def lt(a, b) -> Compare:
    return Compare("<", _side(a), _side(b))


def le(a, b) -> Compare:
    return Compare("<=", _side(a), _side(b))


def gt(a, b) -> Compare:
    return Compare(">", _side(a), _side(b))


def ge(a, b) -> Compare:
    return Compare(">=", _side(a), _side(b))


def is_null(name: str) -> IsNull:
    return IsNull(Property(name))


def not_null(name: str) -> Not:
    return Not(IsNull(Property(name)))


def columns_of(e: Expression) -> set[str]:
    if isinstance(e, Property):
        return {e.name}
    if isinstance(e, Compare):
        return columns_of(e.left) | columns_of(e.right)
    if isinstance(e, (And, Or)):
        return set().union(*map(columns_of, e.parts))
    if isinstance(e, Not):
        return columns_of(e.inner)
    return columns_of(e.of) if isinstance(e, IsNull) else set()


def check_group(e: Expression, group: PropertyGroup) -> None:
    """A filter on one group's scan names that group's properties alone."""
    if lost := columns_of(e) - set(group.names):
        raise KeyError(f"the group lacks {sorted(lost)}")


_INTEGERS = {T.IntegerType: 31, T.LongType: 63}
_MIRROR = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def _check_literal(value: object, kind: T.DataType, name: str) -> None:
    """No coercion: the literal's type is the column's."""
    ok = False
    if isinstance(value, bool):
        ok = isinstance(kind, T.BooleanType)
    elif isinstance(value, int):
        ok = type(kind) in _INTEGERS and -(1 << _INTEGERS[type(kind)]) <= value < 1 << _INTEGERS[type(kind)]
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("literals are finite")
        ok = isinstance(kind, (T.FloatType, T.DoubleType))
    elif isinstance(value, str):
        ok = isinstance(kind, T.StringType)
    elif isinstance(value, dt.datetime):
        if value.microsecond % 1000:
            raise ValueError("instants have millisecond precision")
        ok = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
    elif isinstance(value, dt.date):
        ok = isinstance(kind, T.DateType)
    if not ok:
        raise TypeError(f"{value!r} isn't a literal for {name}, which is {kind.simpleString()}")


def compile_filter(e: Expression, schema: T.StructType, nulls: str = "two") -> Column:
    """A Boolean column; unknown, ambiguous or ill-typed names are errors before anything runs."""
    if nulls not in ("two", "three"):
        raise ValueError("nulls is 'two' or 'three'")

    def kind_of(p: Property) -> T.DataType:
        found = [f.dataType for f in schema.fields if f.name == p.name]
        if len(found) != 1:
            raise KeyError(f"{len(found)} columns are named {p.name}")
        return found[0]

    def value(x: Expression) -> Column:
        if isinstance(x, Property):
            kind_of(x)
            return F.col(f"`{x.name}`")
        if isinstance(x, Literal):
            return F.lit(x.value)
        raise TypeError("comparisons are between properties and literals")

    def compare(c: Compare) -> tuple[str, Column, Column, list[Column]]:
        left, right, op = c.left, c.right, c.op
        if isinstance(left, Literal):
            left, right, op = right, left, _MIRROR[op]
        if not isinstance(left, Property):
            raise TypeError("a comparison names a property")
        kind = kind_of(left)
        if isinstance(right, Literal):
            _check_literal(right.value, kind, left.name)
            lit = F.lit(right.value)
            return op, value(left), lit.cast(kind) if not isinstance(kind, T.StringType) else lit, [value(left)]
        if kind_of(right) != kind:
            raise TypeError(f"{left.name} and {right.name} differ in type")
        return op, value(left), value(right), [value(left), value(right)]

    plain = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    opposite = {"<": ">=", "<=": ">", ">": "<=", ">=": "<", "!=": "="}

    def build(x: Expression, wanted: bool) -> Column:
        """x is wanted to be true, or false; nulls of a comparison count as false in two-valued logic."""
        if isinstance(x, And) or isinstance(x, Or):
            both = isinstance(x, And) == (wanted or nulls == "three")
            parts = [build(p, wanted) for p in x.parts]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if both else out | p
            return out if wanted or nulls == "two" else out
        if isinstance(x, Not):
            return build(x.inner, not wanted) if nulls == "two" else ~build(x.inner, True)
        if isinstance(x, IsNull):
            c = value(x.of)
            return c.isNull() if wanted else c.isNotNull()
        if isinstance(x, Compare):
            op, a, b, may = compare(x)
            if nulls == "three" or wanted:
                return plain[op](a, b)
            missing = may[0].isNull()
            for m in may[1:]:
                missing = missing | m.isNull()
            if op == "=" and len(may) == 1:
                return ~a.eqNullSafe(b)
            return missing | (a != b if op == "=" else plain[opposite[op]](a, b))
        raise TypeError("a filter is made of comparisons, null tests, AND, OR and NOT")

    return build(e, True)


def filter_rows(df: DataFrame, e: Expression, nulls: str = "two") -> DataFrame:
    return df.where(compile_filter(e, df.schema, nulls))


def matching_ids(df: DataFrame, e: Expression, within: DataFrame | None = None, nulls: str = "two") -> DataFrame:
    """Ascending ids of the vertices that fulfil e; within: ids of an earlier result, to intersect with."""
    ids = filter_rows(df, e, nulls).select(VID)
    if within is not None:
        ids = ids.join(within.select(VID).distinct(), VID, "left_semi")
    return ids.orderBy(VID)


def chunks_of(ids: DataFrame, chunk_size: int) -> DataFrame:
    """The vertex chunks that hold any of the ids."""
    return ids.select(F.floor(F.col(VID) / chunk_size).cast("long").alias("chunk")).distinct().orderBy("chunk")


def valid(df: DataFrame, column: str) -> DataFrame:
    """df with whether a property is there."""
    return df.withColumn("valid", F.col(f"`{column}`").isNotNull())
