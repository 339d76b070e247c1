"""Changes of tables as rewrites: each returns the new table, and counts or rows where asked for."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def bulk_load(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The first row of each key by order; the others are duplicates. Tasks keep one row of each key before the shuffle."""
    return _one(rows, key, order, F.min_by)


def _one(rows: DataFrame, key: Sequence[str], order: Column | None, pick: Callable[[Column, Column], Column]) -> DataFrame:
    """One row of each key: the first or last by order; without an order, by all columns as text, so that the result is always the same."""
    rest = [c for c in rows.columns if c not in key]
    whole = F.struct(*rest) if rest else F.lit(True)
    by = F.to_json(whole) if order is None and rest else F.lit(0) if order is None else order
    out = rows.withColumn("_by", by).groupBy(*key).agg(pick(whole, F.col("_by")).alias("_r"))
    return out.select(*(F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in rows.columns))


def duplicates(rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def with_defaults(table: DataFrame, rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns of table: a column that they lack, or whose value is null, takes its default, or null."""
    value = lambda c: F.coalesce(F.col(c), defaults[c]) if c in rows.columns and c in defaults else F.col(c) if c in rows.columns else defaults.get(c, F.lit(None))
    return rows.select(*(value(c).cast(table.schema[c].dataType).alias(c) for c in table.columns))


def inserted(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT ... RETURNING: the rows that are added. Of several new rows of one key the first by order is."""
    new = _one(rows, key, order, F.min_by)
    return with_defaults(table, new, defaults or {}).join(table.select(*key), list(key), "left_anti").select(*table.columns)


def insert(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Adds rows whose key is new (also putIfAbsent). Of several new rows of one key the first by order is added."""
    return table.unionByName(inserted(table, rows, key, order, defaults))


def upsert(table: DataFrame, rows: DataFrame, key: Sequence[str], order: Column | None = None) -> DataFrame:
    """Replaces rows of the same key and adds the others. Of several new rows of one key the last by order counts."""
    new = _one(rows.select(*table.columns) if order is None else rows, key, order, F.max_by)
    return table.join(new.select(*key), list(key), "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def put_if_present(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return upsert(table, rows.join(table.select(*key), list(key), "left_semi"), key)


def put_if_version(table: DataFrame, rows: DataFrame, key: Sequence[str], version: Column) -> DataFrame:
    """Replaces rows whose present version is the expected one (rows.expected)."""
    now = table.withColumn("_version", version).select(*key, "_version")
    ok = rows.join(now, list(key)).where(F.col("expected") == F.col("_version")).select(*table.columns)
    return upsert(table, ok, key)


def update(table: DataFrame, where: Column, **changes: Column) -> DataFrame:
    """SET: every change sees the old row."""
    return table.select(*(F.when(F.coalesce(where, F.lit(False)), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns))


Step = str | Callable[[Column], Column] | None


def at_path(value: Column, path: Sequence[Step], change: Callable[[Column], Column]) -> Column:
    """value with change applied to everything that the path selects; the old item is what change gets ($).

    Steps: a name (a field of a record), "[]" (all items of an array), "{}" (all values of a map), ("key", k) (an entry of a
    map, if it is there), or a function (the items of an array for which it is true).
    """
    if not path:
        return change(value)
    step, rest = path[0], path[1:]
    if callable(step):
        return F.transform(value, lambda x: F.when(F.coalesce(step(x), F.lit(False)), at_path(x, rest, change)).otherwise(x))
    if step == "[]":
        return F.transform(value, lambda x: at_path(x, rest, change))
    if step == "{}":
        return F.transform_values(value, lambda _, v: at_path(v, rest, change))
    if isinstance(step, tuple):
        return F.transform_values(value, lambda k, v: F.when(k == step[1], at_path(v, rest, change)).otherwise(v))
    return F.when(value.isNotNull(), value.withField(step, at_path(value[step], rest, change)))


def update_paths(table: DataFrame, where: Column, *clauses: tuple[str, Sequence[Step], Callable[[Column], Column]]) -> DataFrame:
    """UPDATE with clauses (column, path, change) that apply in order, each to what the one before has left."""
    hit = F.coalesce(where, F.lit(False))
    rows = table.withColumn("_hit", hit)
    for column, path, change in clauses:
        rows = rows.withColumn(column, F.when(F.col("_hit"), at_path(F.col(column), path, change)).otherwise(F.col(column)))
    return rows.drop("_hit").select(*table.columns)


def num_rows_updated(table: DataFrame, where: Column) -> DataFrame:
    """NumRowsUpdated of an update."""
    return table.agg(F.count_if(F.coalesce(where, F.lit(False))).alias("NumRowsUpdated"))


def array_add(items: Column, item: Column, pos: int | None = None) -> Column:
    """ADD: at a place from 0, at the end without one."""
    return F.array_append(items, item) if pos is None else F.array_insert(items, pos + 1 if pos >= 0 else 1, item)


def map_put(m: Column, more: Column) -> Column:
    """PUT: the new entries win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(more), k)), more)


def map_remove(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def array_remove_at(items: Column, pos: int) -> Column:
    return F.filter(items, lambda _, i: i != pos)


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what is deleted); rows for which where is null stay."""
    hit = F.coalesce(where, F.lit(False))
    return table.where(~hit), table.where(hit)


def delete_if_version(table: DataFrame, keys: DataFrame, key: Sequence[str], version: Column) -> DataFrame:
    """The table without the rows whose present version is the expected one (keys.expected)."""
    now = table.withColumn("_version", version).select(*key, "_version")
    gone = now.join(keys.select(*key, "expected"), list(key)).where(F.col("expected") == F.col("_version")).select(*key)
    return table.join(gone, list(key), "left_anti").select(*table.columns)


def multi_delete(table: DataFrame, key: Sequence[str], prefix: Sequence, low=None, high=None) -> DataFrame:  # noqa: ANN001
    """The table without the rows under a key prefix, with a range on the next key column."""
    hit = reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(key, prefix, strict=False)], F.lit(True))
    if low is not None:
        hit &= F.col(key[len(prefix)]) >= low
    if high is not None:
        hit &= F.col(key[len(prefix)]) <= high
    return delete(table, hit)[0]


def merge_patch(target: object, patch: object) -> object:
    """RFC 7386: null removes a key, objects merge, all else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


@F.pandas_udf(StringType())
def json_merge(doc: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON MERGE ... WITH PATCH on JSON texts; a null of either, and a document that is no JSON, give null; a patch that is no object is an error."""

    def one(d: str | None, p: str | None) -> str | None:
        if d is None or p is None:
            return None
        what = json.loads(p)
        if not isinstance(what, dict):
            raise ValueError("the patch of a whole document must be an object")
        try:
            old = json.loads(d)
        except ValueError:
            return None
        return json.dumps(merge_patch(old, what), sort_keys=True, separators=(",", ":"))

    return pd.Series([one(d, p) for d, p in zip(doc, patch, strict=True)], dtype=object)


def identity(rows: DataFrame, name: str, start: int = 1, step: int = 1, always: bool = True) -> DataFrame:
    """Values for an identity column: unique, rising (or falling, by step), with gaps, without a global sort.

    always=False: GENERATED BY DEFAULT, where a value that is given stays.
    """
    made = F.monotonically_increasing_id() * F.lit(step) + F.lit(start)
    return rows.withColumn(name, F.coalesce(F.col(name).cast("long"), made) if not always and name in rows.columns else made)
