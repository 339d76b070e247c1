"""Joins of table hierarchies, nested tables and unnesting; Spark picks the physical join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inner(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    return left.join(right, on, "inner")


def left_outer(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """ON is not optional."""
    return left.join(right, on, "left")


@dataclass
class Nested:
    """A table of a hierarchy: its alias, its key (which begins with its parent's), its descendants."""

    alias: str
    df: DataFrame
    key: tuple[str, ...]
    children: list[Nested] = field(default_factory=list)

    def named(self) -> DataFrame:
        return self.df.select(*(F.col(c).alias(f"{self.alias}_{c}") for c in self.df.columns))

    def columns(self) -> list[str]:
        return [f"{self.alias}_{c}" for c in self.df.columns]


def nested_tables(root: Nested, ancestors: Sequence[Nested] = ()) -> DataFrame:
    """NESTED TABLES: ancestors are left-joined; branches of descendants are united, not multiplied.

    Each row of a branch comes with its parents and nulls for all other branches; a row without any
    child comes once. Columns are named alias_column.
    """
    out = _branches(root)
    for a in ancestors:
        out = out.join(a.named(), [out[f"{root.alias}_{k}"] == F.col(f"{a.alias}_{k}") for k in a.key], "left")
    return out


def _branches(node: Nested) -> DataFrame:
    own = node.named()
    if not node.children:
        return own
    on = lambda other, right: [F.col(f"{node.alias}_{k}") == right[f"{other}_{k}"] for k in node.key]
    trees = [(c, _branches(c)) for c in node.children]
    alone = reduce(lambda df, t: df.join(t[1].select(*(F.col(f"{t[0].alias}_{k}") for k in node.key)).distinct(), on(t[0].alias, t[1]), "left_anti"), trees, own)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*(own.join(t, on(c.alias, t)) for c, t in trees), alone])


def let(df: DataFrame, **values: Column) -> DataFrame:
    """FROM t, expr AS $name: a value that is computed once for each row and bound to a name."""
    return df.withColumns(values)


def unnest(df: DataFrame, items: Column, name: str) -> DataFrame:
    """FROM t, items AS $name: rows without an item give none."""
    return df.withColumn(name, F.explode(items))


def unnest_map(df: DataFrame, entries: Column, key: str, value: str) -> DataFrame:
    return df.select("*", F.explode(entries).alias(key, value))
