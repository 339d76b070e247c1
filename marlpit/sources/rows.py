"""Row formats: key/value text, JSON, CSV and vertical output; JSON collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType


def key_value(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, value) as text: the key's parts joined by /, and the row as JSON."""
    return df.select(F.concat_ws("/", F.lit(""), *(F.col(k).cast("string") for k in key)).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns only."""
    if bad := [f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType | StructType | VariantType)]:
        raise ValueError(f"complex columns can't be written as CSV: {bad}")
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def json_text(df: DataFrame, pretty: bool = False) -> Column:
    """A row of df as JSON."""
    return F.to_json(F.struct(*df.columns), {"pretty": "true"} if pretty else {})


def csv_text(df: DataFrame) -> Column:
    """A row of df as a line of CSV."""
    return F.to_csv(F.struct(*df.columns))


def line_text(df: DataFrame) -> Column:
    """A row of df as 'column: value' lines."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL"))) for c in df.columns))


def to_json_rows(df: DataFrame, pretty: bool = False) -> DataFrame:
    return df.select(json_text(df, pretty).alias("json"))


def to_lines(df: DataFrame) -> DataFrame:
    """Vertical output: one text for each row."""
    return df.select(line_text(df).alias("lines"))


def read_collection(spark: SparkSession, path: str, key: dict[str, str]) -> DataFrame:
    """A JSON collection: the key's columns and the whole document as VARIANT. One document a line."""
    doc = spark.read.text(path).select(F.try_parse_json("value").alias("doc"))
    return doc.select(*(F.try_variant_get("doc", f"$.{k}", t).alias(k) for k, t in key.items()), "doc")
