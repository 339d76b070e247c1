"""Sequences are arrays: paths, slices, filters, existential comparison, sequence aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def any_op(op: str, left: Column, right: Column) -> Column:
    """left op-any right: true if some pair of items compares; null operands give null, empty ones false."""
    f = OPS[op]
    found = F.coalesce(F.arrays_overlap(left, right), F.lit(False)) if op == "=" else F.exists(left, lambda x: F.exists(right, lambda y: F.coalesce(f(x, y), F.lit(False))))
    return F.when(left.isNotNull() & right.isNotNull(), found)


def any_value(op: str, items: Column, value: Column) -> Column:
    """items op-any value, for one value."""
    return F.exists(items, lambda x: F.coalesce(OPS[op](x, value), F.lit(False)))


def slice_step(items: Column, low: int | None = None, high: int | None = None) -> Column:
    """items[low:high]: from 0, both ends included, either may be left out."""
    return F.filter(items, lambda _, i: (i >= (low or 0)) & (i <= high if high is not None else F.lit(True)))


def filter_step(items: Column, keep: Callable[[Column, Column], Column]) -> Column:
    """items[keep]: keep gets the element and its place."""
    return F.filter(items, keep)


def keys(m: Column, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    return F.map_keys(F.map_filter(m, keep) if keep else m)


def values(m: Column, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    return F.map_values(F.map_filter(m, keep) if keep else m)


def field_step(items: Column, name: str) -> Column:
    """A field of each record of an array."""
    return F.transform(items, lambda x: x.getField(name))


def size(c: Column) -> Column:
    return F.when(c.isNotNull(), F.size(c))


def exists(c: Column) -> Column:
    """Whether a path gives any item; null gives null."""
    return F.when(c.isNotNull(), F.size(c) > 0)


def seq_concat(*parts: Column) -> Column:
    return F.concat(*parts) if parts else F.array()


def seq_transform(items: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(items, f)


def _holds_null(items: Column) -> Column:
    return F.exists(items, lambda x: x.isNull())


def seq_count(items: Column) -> Column:
    """Null if an item is null; 0 if there is none."""
    return F.when(~_holds_null(items), F.size(items))


def seq_sum(items: Column, kind: str | None = None) -> Column:
    """Nulls left out. Whole numbers give a long, floating-point ones a double; decimals are summed in the kind that is named."""
    real = F.filter(items, lambda x: x.isNotNull())
    if kind:
        return F.when(F.size(real) > 0, F.aggregate(real, F.lit(0).cast(kind), lambda a, x: (a + x).cast(kind)))
    zero = F.lit(0).cast("bigint") * F.element_at(real, 1)
    return F.when(F.size(real) > 0, F.aggregate(real, zero, lambda a, x: a + x))


def seq_avg(items: Column, kind: str | None = None) -> Column:
    real = F.filter(items, lambda x: x.isNotNull())
    return seq_sum(items, kind) / F.nullif(F.size(real), F.lit(0))


def seq_sum_i(items: Column, kind: str | None = None) -> Column:
    """Nulls left out, as in seq_sum."""
    return seq_sum(items, kind)


def seq_avg_i(items: Column, kind: str | None = None) -> Column:
    return seq_avg(items, kind)


def seq_count_i(items: Column) -> Column:
    """Items that are not null."""
    return F.size(F.filter(items, lambda x: x.isNotNull()))


def seq_min(items: Column) -> Column:
    return F.when(~_holds_null(items), F.array_min(items))


def seq_max(items: Column) -> Column:
    return F.when(~_holds_null(items), F.array_max(items))


def seq_min_i(items: Column) -> Column:
    """Nulls left out."""
    return F.array_min(items)


def seq_max_i(items: Column) -> Column:
    return F.array_max(items)


def seq_distinct(items: Column) -> Column:
    """In the order of first occurrence."""
    return F.array_distinct(items)


def seq_sort(items: Column) -> Column:
    """Nulls come last."""
    return F.array_sort(items)
