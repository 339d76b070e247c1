"""Helpers that the operators share: the shared scratch folder, tables kept in it, and Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A folder of our own is made only where the setting is absent, as in tests on local[n].
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = _OWN["dir"] = tempfile.mkdtemp(prefix="spark-ckpt-")
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_clear)
    _MADE.append((spark, path))
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority as Spark itself resolves it, so that executors open the same place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _clear() -> None:
    for spark, name in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:
            break
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before; the folder is the cluster's to clear then
            return


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_file(df: DataFrame, name: str) -> str:
    """df written to the shared folder; the place as tasks open it."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return qualified(df.sparkSession, path)


def read_shared(uri: str, rows: int) -> Iterator[pa.RecordBatch]:
    """Within a task: the rows of a shared file in batches of at most `rows`, in the same order in every task."""
    fs, base = pafs.FileSystem.from_uri(uri)
    for info in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows)


def kept_in_buckets(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Like kept(), in buckets of a column: what is grouped or joined by that column is not shuffled again."""
    spark = df.sparkSession
    name = f"kept_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    _TABLES.append((spark, name))
    return spark.table(name)


def in_blocks(df: DataFrame, text: str, size: int, block: str, row: str, odd: F.Column | None = None) -> DataFrame:
    """df written in blocks of about `size` bytes of text and bucketed by block, with the number of the block and one of the row.

    A block has rows of one partition only, so nothing is shuffled; blocks of rows where `odd` is 1 have odd numbers.
    """
    spark = df.sparkSession
    schema = StructType([*df.schema.fields, StructField(block, LongType()), StructField(row, LongType())])
    own = F.lit(0) if odd is None else odd
    # small partitions are read together, so that blocks are full
    bytes_ = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    df = df.coalesce(max(1, -(-bytes_ // (size if odd is None else 2 * size))))
    keys = df.withColumns({block: F.spark_partition_id().cast("long") * (1 << 24) + own, row: F.monotonically_increasing_id()})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(2, dtype=np.int64)  # bytes so far in even and odd blocks
        for batch in batches:
            if not batch.num_rows:
                continue
            n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64  # so that empty rows count too
            key = batch.column(block).to_numpy()
            at = np.zeros(len(n), dtype=np.int64)
            for side in (0, 1):
                mine = key & 1 == side
                at[mine] = (done[side] + np.cumsum(n[mine]) - n[mine]) // size
                done[side] += n[mine].sum()
            yield batch.set_column(batch.schema.get_field_index(block), block, pa.array(key + 2 * at))

    return kept_in_buckets(keys.mapInArrow(number, schema), block, parts(spark))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_key(column: str = "doc_id") -> F.Column:
    """A null id counts as an id smaller than all others."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(2**63)))


def bounded_sample(df: DataFrame, most: int, eligible: F.Column, *keys: str) -> DataFrame:
    """At most `most` different eligible rows, those with the smallest hashes of their keys; null rows of eligible are none.

    Rows above a cutoff of the hash are left out where they are read, so little more than `most` rows leave the tasks.
    """
    share = min(1.0, 4 * most / max(1, df.count()))
    hashed = df.withColumn("_h", F.xxhash64(*keys))
    while True:
        below = F.col("_h") < int(-(2**63) + share * 2**64) if share < 1 else F.lit(True)
        rows = hashed.where(below & F.coalesce(eligible, F.lit(False)))
        found = kept(rows.groupBy("_h").agg(F.min(F.struct(*df.columns)).alias("r")), "sample")
        if share == 1 or found.limit(most).count() == most:
            return found.orderBy("_h").limit(most).select("r.*")
        share = min(1.0, 8 * share)


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
