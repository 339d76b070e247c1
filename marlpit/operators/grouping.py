"""Aggregates whose results differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_items(items: Column) -> Column:
    """count() over a sequence: every item that is not null."""
    return F.coalesce(F.sum(F.size(F.filter(items, lambda x: x.isNotNull()))), F.lit(0)).cast("long")


def array_collect(c: Column, distinct: bool = False) -> Column:
    """Drops nulls; sorted, so that results do not depend on the order of rows."""
    return F.array_sort((F.collect_set if distinct else F.collect_list)(c))


def collect_regroup(arrays: Column) -> Column:
    """Merges partial arrays."""
    return F.array_sort(F.flatten(F.collect_list(arrays)))


def count_numbers(v: Column) -> Column:
    """What avg() divides by: VARIANT items that are numbers; numbers within strings are none."""
    return F.count_if(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
