"""Row properties in a reserved struct column _meta, and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8


def expiry(at: Column, ttl_days: int | None = None, ttl_hours: int | None = None) -> Column:
    """The first full day, or hour, at which a row written at that time has lived so long; never without both."""
    if ttl_hours is not None:
        return F.timestamp_millis(F.unix_millis(F.date_trunc("hour", at)) + F.lit((ttl_hours + 1) * 3_600_000))
    if ttl_days is not None:
        return F.timestamp_millis(F.unix_millis(F.date_trunc("day", at)) + F.lit((ttl_days + 1) * 86_400_000))
    return F.lit(None).cast("timestamp")


def set_ttl(df: DataFrame, where: Column, now: Column, ttl_days: int | None = None, ttl_hours: int | None = None, default_days: int | None = None) -> DataFrame:
    """UPDATE ... SET TTL n DAYS or HOURS, or USING TABLE DEFAULT (neither): only rows for which where is true change."""
    days = default_days if ttl_days is None and ttl_hours is None else ttl_days
    hit = F.coalesce(where, F.lit(False))
    changed = F.col("_meta").withField("expires_at", expiry(now, days, ttl_hours)).withField("modified_at", now)
    return df.withColumn("_meta", F.when(hit, changed).otherwise(F.col("_meta")))


def with_meta(df: DataFrame, key: list[str], at: Column, ttl_days: int | None = None, metadata: Column | None = None) -> DataFrame:
    """df with creation, modification and expiration time, a version of the row's contents, and metadata (a JSON text) that the writer sets."""
    expires = expiry(at, ttl_days)
    return df.withColumn("_meta", F.struct(at.alias("created_at"), at.alias("modified_at"), expires.alias("expires_at"), F.md5(F.to_json(F.struct(*df.columns))).alias("version"), (F.lit(None) if metadata is None else metadata).cast("string").alias("user")))


def creation_time() -> Column:
    return F.col("_meta.created_at")


def modification_time() -> Column:
    return F.col("_meta.modified_at")


def expiration_time() -> Column:
    return F.coalesce(F.col("_meta.expires_at"), F.timestamp_seconds(F.lit(0)))


def millis(t: Column) -> Column:
    return F.unix_millis(t)


def remaining_days(now: Column) -> Column:
    """-1 for rows that do not expire."""
    left = F.unix_millis("_meta.expires_at") - F.unix_millis(now)
    return F.coalesce(F.floor(left / 86_400_000), F.lit(-1)).cast("int")


def remaining_hours(now: Column) -> Column:
    left = F.unix_millis("_meta.expires_at") - F.unix_millis(now)
    return F.coalesce(F.floor(left / 3_600_000), F.lit(-1)).cast("int")


def live(df: DataFrame, now: Column) -> DataFrame:
    """Rows that have not expired."""
    return df.where(F.col("_meta.expires_at").isNull() | (F.col("_meta.expires_at") > now))


def version() -> Column:
    return F.col("_meta.version")


def row_metadata(path: str | None = None) -> Column:
    """The metadata of a row, or what a JSON path finds in it."""
    return F.get_json_object("_meta.user", path) if path else F.col("_meta.user")


def partition(key: list[str], n: int) -> Column:
    """Placement by a hash of the shard key, from 1."""
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int") + 1


def shard(key: list[str], partitions: int, shards: int) -> Column:
    """The shard of a row's partition, from 1."""
    return F.pmod(partition(key, partitions) - 1, F.lit(shards)) + 1


def index_storage_size(key: list[str], columns: list[str]) -> Column:
    """The size of the row's entry in an index: the indexed columns and the primary key."""
    return row_storage_size([*columns, *(k for k in key if k not in columns)])


def row_storage_size(columns: list[str]) -> Column:
    return F.octet_length(F.to_json(F.struct(*columns)))


def geo_is_geometry(g: Column) -> Column:
    """Whether a JSON text is a geometry: its type is known, and what it must hold is there."""
    kind = F.get_json_object(g, "$.type")
    number = lambda path: F.get_json_object(g, path).try_cast("double").isNotNull()
    depth = {"Point": "", "MultiPoint": "[0]", "LineString": "[0]", "Polygon": "[0][0]", "MultiLineString": "[0][0]", "MultiPolygon": "[0][0][0]"}
    found = [(kind == k) & number(f"$.coordinates{d}[0]") & number(f"$.coordinates{d}[1]") for k, d in depth.items()]
    found.append((kind == "GeometryCollection") & F.get_json_object(g, "$.geometries").startswith("["))
    out = found[0]
    for f in found[1:]:
        out = out | f
    return F.coalesce(out, F.lit(False))


def geo_distance(a: Column, b: Column) -> Column:
    """Metres between two GeoJSON points; -1 if one is no point, null if one is null."""
    place = lambda g, i: F.radians(F.get_json_object(g, f"$.coordinates[{i}]").try_cast("double"))
    half = lambda x: F.pow(F.sin(x / 2), 2)
    h = half(place(b, 1) - place(a, 1)) + F.cos(place(a, 1)) * F.cos(place(b, 1)) * half(place(b, 0) - place(a, 0))
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(2 * EARTH_M * F.asin(F.sqrt(h)), F.lit(-1.0)))
