"""JSON as VARIANT: null, JSON null and a missing path stay apart; canonical keys for grouping and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order within the nulls.
EMPTY, JSON_NULL, SQL_NULL, VALUE = 0, 1, 2, -1


def parse_json(s: Column) -> Column:
    return F.parse_json(s)


def path(v: Column, where: str, kind: str = "string") -> Column:
    """The value at a path, null if it is missing or of another kind."""
    return F.try_variant_get(v, where, kind)


def null_kind(v: Column, where: str) -> Column:
    """Which of the three nothings stands at the path, or VALUE."""
    at = F.try_variant_get(v, where, "variant")
    return F.when(v.isNull(), SQL_NULL).when(at.isNull(), EMPTY).when(F.is_variant_null(at), JSON_NULL).otherwise(VALUE)


def canonical(v: Column, where: str = "$") -> Column:
    """A struct that can be grouped and sorted: kind of null, rank of the kind of value, number (also exact where 38 digits hold it), text."""
    at = F.try_variant_get(v, where, "variant")
    kind = F.schema_of_variant(at)
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    rank = F.when(number, 0).when(kind == "STRING", 1).when(kind == "BOOLEAN", 2).otherwise(3)
    return F.struct(
        null_kind(v, where).alias("nothing"), F.when(null_kind(v, where) == VALUE, rank).alias("kind"),
        F.when(number, F.try_variant_get(at, "$", "double")).alias("number"), F.when(number, F.try_variant_get(at, "$", "decimal(38,12)")).alias("exact"), F.when(~number & (null_kind(v, where) == VALUE), F.try_variant_get(at, "$", "string")).alias("text"),
    )


def number_avg(v: Column, where: str) -> Column:
    """avg() over JSON: the sum of the numbers by their count; null without any."""
    return number_sum(v, where) / F.nullif(F.count_if(canonical(v, where)["kind"] == 0), F.lit(0))


def _extreme(v: Column, where: str, pick) -> Column:  # noqa: ANN001
    key = canonical(v, where)
    atomic = (key["nothing"] == VALUE) & (key["kind"] < 3)
    return pick(F.when(atomic, F.try_variant_get(v, where, "string")), F.when(atomic, key))


def item_min(v: Column, where: str) -> Column:
    """min() over JSON: numbers come before strings and these before booleans; nulls, arrays and objects are skipped. As text."""
    return _extreme(v, where, F.min_by)


def item_max(v: Column, where: str) -> Column:
    return _extreme(v, where, F.max_by)


def is_of_type(v: Column, kind: str) -> Column:
    """IS OF TYPE for one JSON item."""
    found = F.schema_of_variant(v)
    known = {"number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "string": "^STRING$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "map": "^OBJECT"}
    return found.rlike(known[kind])


def number_sum(v: Column, where: str) -> Column:
    """sum() over JSON, exact for numbers of at most 26 digits before and 12 after the point: items that are no numbers are skipped."""
    return F.sum(F.when(canonical(v, where)["kind"] == 0, F.try_variant_get(v, where, "decimal(38,12)")))
