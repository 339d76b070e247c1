"""String functions: positions count from 0, in code points; arguments are cast to string."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _s(c: Column) -> Column:
    return c.cast("string")


def substring(s: Column, pos: Column | int, length: Column | int | None = None) -> Column:
    """Null if pos is negative or not within s; empty if length is below 1."""
    s, pos = _s(s), pos if isinstance(pos, Column) else F.lit(pos)
    n = F.char_length(s) if length is None else (length if isinstance(length, Column) else F.lit(length))
    return F.when((pos >= 0) & (pos < F.char_length(s)), F.when(n < 1, F.lit("")).otherwise(F.substring(s, pos + 1, F.greatest(n, F.lit(0)))))


def concat(*parts: Column) -> Column:
    """Null counts as empty unless all parts are null."""
    none = reduce(lambda a, b: a & b, [p.isNull() for p in parts])
    return F.when(~none, F.concat_ws("", *map(_s, parts)))


def trim(s: Column, where: str = "both", char: str = " ") -> Column:
    """Takes off the first character of char; an empty one trims nothing; an unknown side gives null."""
    if where not in ("leading", "trailing", "both"):
        return F.lit(None).cast("string")
    if not char:
        return _s(s)
    c = re.escape(char[0])
    sides = [f"^({c})+"] * (where != "trailing") + [f"({c})+$"] * (where != "leading")
    return F.regexp_replace(_s(s), "|".join(sides), "")


def ltrim(s: Column) -> Column:
    return F.ltrim(_s(s))


def rtrim(s: Column) -> Column:
    return F.rtrim(_s(s))


def upper(s: Column) -> Column:
    return F.upper(_s(s))


def lower(s: Column) -> Column:
    return F.lower(_s(s))


def length(s: Column) -> Column:
    return F.char_length(_s(s))


def contains(s: Column, part: Column) -> Column:
    return F.contains(_s(s), _s(part))


def starts_with(s: Column, part: Column) -> Column:
    return F.startswith(_s(s), _s(part))


def ends_with(s: Column, part: Column) -> Column:
    return F.endswith(_s(s), _s(part))


def index_of(s: Column, search: Column | str, pos: Column | int = 0) -> Column:
    """-1 if there is none; an empty search is found at 0; a negative pos counts as 0."""
    s, search = _s(s), search if isinstance(search, Column) else F.lit(search)
    pos = F.greatest(pos if isinstance(pos, Column) else F.lit(pos), F.lit(0))
    return F.when(s.isNull() | search.isNull(), None).when(search == "", 0).otherwise(F.call_function("locate", search, s, pos + 1) - 1)


def replace(s: Column, search: Column, new: Column | None = None) -> Column:
    """Without new the found parts are deleted."""
    return F.replace(_s(s), _s(search), F.lit("") if new is None else _s(new))


def reverse(s: Column) -> Column:
    return F.reverse(_s(s))


def random_uuid() -> Column:
    return F.expr("uuid()")


#: Constructs that the pattern language leaves out.
FORBIDDEN = re.compile(r"\(\?[=!<]|\\[0-9kbBGzZ]|[*+?}]\+|\\p\{In")


def regex_like(s: Column, pattern: str, flags: str = "") -> Column:
    """Full match. Flags: s (dot matches line ends), i, x, l (literal); others are an error."""
    if bad := set(flags) - set("sixldum"):
        raise ValueError(f"unknown flags {sorted(bad)}")
    if "l" in flags:
        pattern = r"\Q" + pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
    elif m := FORBIDDEN.search(pattern):
        raise ValueError(f"not in the pattern language: {m[0]}")
    inline = "".join(f for f in flags if f in "sixmdu")
    return _s(s).rlike((f"(?{inline})" if inline else "") + rf"\A(?:{pattern})\z")
