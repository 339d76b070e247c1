"""Types of values: casts by rule, promotion of operands, comparisons of single items, and tests of type.

Items without a fixed type are VARIANT values, so numbers, strings, booleans and JSON null stay apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
#: Numbers from narrow to wide. An operand is promoted to the wider of two.
NUMBERS = ("integer", "long", "float", "double", "number")
SPARK = {"integer": "int", "long": "bigint", "float": "float", "double": "double", "number": "decimal(38,10)", "string": "string", "boolean": "boolean", "timestamp": "timestamp"}


def cast(c: Column, source: str, target: str) -> Column:
    """CAST: null stays null, what can't be cast is an error. Timestamps and longs are milliseconds since 1970 of each other."""
    if source == target:
        return c
    if source == "timestamp" and target in ("long", "number"):
        return F.unix_millis(c.cast("timestamp")).cast(SPARK[target])
    if source in ("integer", "long") and target == "timestamp":
        return F.timestamp_millis(c.cast("bigint"))
    if source == "json":
        return F.when(F.is_variant_null(c), F.raise_error(F.lit(f"JSON null is no {target}"))).otherwise(F.variant_get(c, "$", "string" if target == "timestamp" else SPARK[target])) if target != "timestamp" else F.variant_get(c, "$", "string").cast("timestamp")
    allowed = {
        **{n: {*NUMBERS, "string"} for n in NUMBERS},
        "string": {*NUMBERS, "boolean", "timestamp"}, "boolean": {"string"}, "timestamp": {"string"},
    }
    if target not in allowed.get(source, ()):
        raise ValueError(f"can't cast {source} to {target}")
    if source == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c.cast(SPARK[target])


def to_json(items: Column) -> Column:
    """CAST(... AS ARRAY(JSON)): each item as a VARIANT."""
    return F.transform(items, lambda x: F.parse_json(F.to_json(F.struct(x.alias("x")))).cast("variant"))


def promoted(a: Column, kind_a: str, b: Column, kind_b: str) -> tuple[Column, Column] | None:
    """Both operands in a common type: the wider number, or a timestamp where one is a string. None if they can't be compared."""
    if kind_a in NUMBERS and kind_b in NUMBERS:
        wide = SPARK[max(kind_a, kind_b, key=NUMBERS.index)]
        return a.cast(wide), b.cast(wide)
    if kind_a == kind_b:
        return a, b
    if {kind_a, kind_b} == {"timestamp", "string"}:
        return a.cast("timestamp"), b.cast("timestamp")
    return None


def compare(op: str, a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    """A comparison of typed operands: null operands give null, operands of types that can't be compared are only unequal."""
    both = promoted(a, kind_a, b, kind_b)
    if both is None:
        return F.when(a.isNotNull() & b.isNotNull(), F.lit(op == "!="))
    return OPS[op](*both)


def single(items: Column) -> Column:
    """The only item of a sequence, null for an empty one; more than one are an error."""
    return F.when(F.size(items) > 1, F.raise_error(F.lit("an operand has more than one item"))).when(F.size(items) == 1, F.element_at(items, 1))


def compare_items(op: str, a: Column, b: Column) -> Column:
    """A comparison of two arrays of VARIANT items, each of at most one: null arrays give null.

    Two empty operands are equal, an empty and another one are unequal. JSON null equals only JSON null. Numbers
    are compared by value, strings and booleans with their own kind; items of different kinds are only unequal.
    """
    x, y = single(a), single(b)
    kx, ky = kind_of(x), kind_of(y)
    by = lambda t: OPS[op](F.try_variant_get(x, "$", t), F.try_variant_get(y, "$", t))
    same = F.when(kx == "number", F.coalesce(by("decimal(38,10)"), by("double"))).when(kx == "string", by("string")).when(kx == "boolean", by("boolean")).when(kx == "null", F.lit(op in ("=", "<=", ">="))).otherwise(F.lit(op == "!="))
    empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(a.isNull() | b.isNull(), None).when(empty, F.lit(op in ("=", "<=", ">="))).when((F.size(a) == 0) | (F.size(b) == 0) | (kx != ky), F.lit(op == "!=")).otherwise(same)


def kind_of(v: Column) -> Column:
    """number, string, boolean, null, array, map, timestamp or other."""
    s = F.schema_of_variant(v)
    return F.when(F.is_variant_null(v), "null").when(s.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s.rlike("^ARRAY"), "array").when(s.rlike("^OBJECT"), "map").when(s.rlike("^TIMESTAMP"), "timestamp").when(v.isNotNull(), "other")


def is_of_type(items: Column, *targets: tuple[str, str], only: bool = False) -> Column:
    """IS OF TYPE: whether the array of VARIANT items conforms to one of the targets (kind, quantifier: one of '', '?', '+', '*').

    The kinds integer, long and double are numbers that can be held so; with only, a number's own kind must be the target. A
    null array gives null.
    """
    n = F.size(items)
    fits = {"": n == 1, "?": n <= 1, "+": n >= 1, "*": F.lit(True)}

    def item(x: Column, kind: str) -> Column:
        if kind == "any":
            return F.lit(True)
        if kind == "jsonatomic":
            return kind_of(x).isin("number", "string", "boolean", "null")
        if kind in ("integer", "long", "double"):
            schema = F.schema_of_variant(x)
            whole = schema == "BIGINT"
            small = whole & F.coalesce(F.try_variant_get(x, "$", "int").isNotNull(), F.lit(False))
            exact = {"integer": small, "long": whole & ~small, "double": schema.rlike("^(DOUBLE|FLOAT|DECIMAL)")}
            wide = {"integer": small, "long": whole, "double": exact["double"]}
            return (exact if only else wide)[kind]
        return kind_of(x) == kind

    def all_are(kind: str) -> Column:
        return F.forall(items, lambda x: F.coalesce(item(x, kind), F.lit(False)))

    conforms = [fits[q] & all_are(k) for k, q in targets]
    out = conforms[0]
    for more in conforms[1:]:
        out = out | more
    return F.when(items.isNotNull(), out)


def in_sequence(c: Column, values: Sequence | Column) -> Column:
    """c IN $values[]: false for an empty list; null if c is null, or if it is not found and the list holds null."""
    if isinstance(values, Column):
        return F.when(F.size(values) == 0, F.lit(False)).otherwise(F.array_contains(values, c))
    return c.isin(*values) if values else F.lit(False)


def negative(c: Column) -> Column:
    """Unary minus."""
    return F.negative(c)


def field_by_name(v: Column, name: Column) -> Column:
    """A field step with a computed name: an entry of a map, null if it is not there."""
    return F.try_element_at(v, name)


def json_field_by_name(text: Column, name: Column) -> Column:
    """The same on a JSON text; its result is text."""
    return F.call_function("get_json_object", text, F.concat(F.lit("$."), name))
