"""Change streams: subscription by table, last-write-wins state, upserts, tumbling buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlpit.operators import dml


def subscribe(spark: SparkSession, path: str, schema: str, tables: Sequence[str] = ()) -> DataFrame:
    """A stream of put and delete operations in Parquet files; with tables, only theirs."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.where(F.col("table").isin(*tables)) if tables else stream


def last_write_wins(changes: DataFrame, key: Sequence[str], time: str = "ts", region: str = "region") -> DataFrame:
    """The change of each key with the latest time; ties go to the larger region. Partial maxima are taken before the shuffle."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(time, region)).alias("r"))
    return last.select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def apply_changes(table: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """The table after put and delete operations (op), of which the last of each key counts."""
    last = last_write_wins(changes, key)
    puts = last.where("op = 'put'").select(*table.columns)
    return dml.upsert(table.join(last.where("op = 'delete'").select(*key), list(key), "left_anti"), puts, key)


def bucket_counts(events: DataFrame, width: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling buckets; on a stream, events later than the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    w = F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("bucket"), "event_type", "n", "total")


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a Parquet folder once through; it resumes from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
