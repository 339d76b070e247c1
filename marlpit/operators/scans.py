"""Reads by key, key prefix, index and hierarchy: filters that Catalyst pushes into the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def _prefix(key: Sequence[str], values: Sequence) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(key, values, strict=False)], F.lit(True))


def get(df: DataFrame, key: Sequence[str], values: Sequence) -> DataFrame:
    """The row with that primary key."""
    return df.where(_prefix(key, values)).limit(1)


def multi_get(df: DataFrame, key: Sequence[str], prefix: Sequence, keys_only: bool = False) -> DataFrame:
    """All rows, or keys, under a key prefix."""
    found = df.where(_prefix(key, prefix))
    return found.select(*key) if keys_only else found


def multi_get_batch(df: DataFrame, key: Sequence[str], parents: DataFrame, keys_only: bool = False) -> DataFrame:
    """All rows, or keys, under any of many parent keys (columns of parents, named as in df). Spark sends short lists to all tasks by their size."""
    found = df.join(parents, list(parents.columns), "left_semi")
    return found.select(*key) if keys_only else found


def index_scan(df: DataFrame, index: Sequence[str], equal: Sequence = (), low=None, high=None, direction: str = "forward", keys_only: Sequence[str] | None = None) -> DataFrame:  # noqa: ANN001
    """Equality on the first index columns and a range on the next, in index order (forward, reverse or unordered)."""
    cond = _prefix(index, equal)
    if low is not None:
        cond &= F.col(index[len(equal)]) >= low
    if high is not None:
        cond &= F.col(index[len(equal)]) <= high
    found = df.where(cond)
    if direction != "unordered":
        found = found.orderBy(*(F.col(c).asc_nulls_last() if direction == "forward" else F.col(c).desc_nulls_first() for c in index))
    return found.select(*keys_only) if keys_only else found


def with_depth(parent: DataFrame, children: dict[str, DataFrame], key: Sequence[str], depth: str = "PARENT_AND_DESCENDANTS") -> DataFrame:
    """Keys of a parent table and its descendants: which levels, by name of the table; a name with a dot is a grandchild's or deeper."""
    known = ("CHILDREN_ONLY", "DESCENDANTS_ONLY", "PARENT_AND_CHILDREN", "PARENT_AND_DESCENDANTS")
    if depth not in known:
        raise ValueError(f"depth is one of {known}")
    levels = [parent.select(F.lit("parent").alias("level"), *key)] if depth.startswith("PARENT") else []
    levels += [c.select(F.lit(n).alias("level"), *key) for n, c in children.items() if "DESCENDANTS" in depth or "." not in n]
    return reduce(DataFrame.unionByName, levels)


def multi_get_table(df: DataFrame, key: Sequence[str], prefix: Sequence, ancestors: dict[str, DataFrame] | None = None, children: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows of a table, its ancestors and its descendants under a key prefix, as (table, row); ancestors hold the first key columns."""
    tables = {**(ancestors or {}), "target": df, **(children or {})}
    out = []
    for name, t in tables.items():
        own = [k for k in key if k in t.columns]
        out.append(t.where(_prefix(own, prefix)).select(F.lit(name).alias("table"), F.to_json(F.struct(*t.columns)).alias("row")))
    return reduce(DataFrame.unionByName, out)


def element_scan(df: DataFrame, items: Column, holds: Callable[[Column], Column]) -> DataFrame:
    """Rows with an array item, or map value, for which holds is true: each once, however many of its items are found."""
    return df.where(F.exists(items, lambda x: F.coalesce(holds(x), F.lit(False))))


def entry_scan(df: DataFrame, entries: Column, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows with a map entry (key, value) for which holds is true, each once."""
    return df.where(F.size(F.map_filter(entries, lambda k, v: F.coalesce(holds(k, v), F.lit(False)))) > 0)


def order_by(df: DataFrame, *keys: str | Column, desc: Sequence[bool] = (), nulls: Sequence[str] = ()) -> DataFrame:
    """ASC puts nulls last, DESC first, unless nulls says otherwise. Keys that are arrays, maps or records are an error."""
    out = []
    for i, k in enumerate(keys):
        if isinstance(k, str) and isinstance(df.schema[k].dataType, ArrayType | MapType | StructType):
            raise ValueError(f"can't order by {k}, which holds several items")
        c = F.col(k) if isinstance(k, str) else k
        down = i < len(desc) and desc[i]
        where = nulls[i] if i < len(nulls) and nulls[i] else ("first" if down else "last")
        out.append(getattr(c, f"{'desc' if down else 'asc'}_nulls_{where}")())
    return df.orderBy(*out)


def page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if limit is None else df.limit(limit)
