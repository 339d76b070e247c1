"""Statements with external variables: values are bound, not pasted."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Strings, quoted names and comments stay as they are; $name and ? are variables outside of them.
PART = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*(?!\+).*?\*/|(?P<hint>/\*\+.*?\*/)|\$(?P<name>\w+)|(?P<mark>\?)", re.DOTALL)
DECLARE = re.compile(r"^\s*declare\b(?:\s*\$\w+[^;]*;)+", re.IGNORECASE)


def prepared(spark: SparkSession, sql: str, *marks: object, **values: object) -> DataFrame:
    """A statement with $x by name or ? by place; its ``declare $x type;`` lines and index hints are dropped."""
    given = dict(values)
    seen = 0

    def put(m: re.Match) -> str:
        nonlocal seen
        if m["hint"]:
            return " "
        if m["name"]:
            return f":{m['name']}"
        if m["mark"]:
            seen += 1
            if seen > len(marks):
                raise ValueError("more ? than values")
            given[f"_{seen}"] = marks[seen - 1]
            return f":_{seen}"
        return m[0]

    return spark.sql(PART.sub(put, DECLARE.sub("", sql)), args=given)
