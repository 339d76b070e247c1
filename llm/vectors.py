"""Exact top-k search by vector-approximation files (operator 6).

Every vector has an approximation: one cell number (a byte) for each component. The cells are a file of their own; its rows
are scanned alone, in one job for all queries, which tasks read in blocks of bounded size. The cells' edges give a lower and an
upper bound of each inner product; a row stays a candidate of a query where its upper bound reaches the k-th best lower bound. Exact
vectors are then read for the candidates only, those with the best bounds first; the others of a query are read where
their bound reaches the k-th best exact score, so that the result is certain.

Scores of vectors of whole numbers are sums of 64-bit integers; bounds are floating-point numbers with room for their rounding.

Cases: vectors that are null, empty, of another length than the query, or that hold null or non-finite components take no
part; ties go to the smaller id; equal vectors are scored once and only their k + 1 smallest ids are kept, as no query can
return a larger one; an empty table gives an empty result; rows with the same id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import kept, map_arrow, read_shared, shared_file

QUERIES = 1_024  # queries read at once
CELLS = 256  # of each component
SCAN = 2_048  # rows whose cells are scanned at once
FIRST = 4  # times k candidates of a query are read in the first round
SALTS = 64


def finite(column: str) -> F.Column:
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~bad


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """vec and the k + 1 smallest ids that have it; each task first keeps its own smallest."""
    some = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    first = some.groupBy("vec", "salt").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    return first.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    size = batch.column("size").to_numpy()
    for d in np.unique(size).tolist():
        yield d, batch.filter(pa.array(size == d))


def spans(pool: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Smallest and largest value of each component, for each length of vectors: a row of each task goes into the result."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, x.min(0).tolist(), x.max(0).tolist()) for d, part in _by_length(batch) for x in [_matrix(part.column("vec"))]]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in (1, 2))], ["size", "low", "high"])

    ends = map_arrow(pool.select("size", "vec"), each, "size int, low array<double>, high array<double>")
    by = ends.select("size", F.posexplode(F.arrays_zip("low", "high")).alias("at", "x")).groupBy("size", "at").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect()
    out = {}
    for d in {r["size"] for r in by}:
        own = sorted((r["at"], r["low"], r["high"]) for r in by if r["size"] == d)
        out[d] = np.array([r[1] for r in own]), np.array([r[2] for r in own])
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, whole_numbers: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k largest inner products, never with its own id.

    vectors and queries: id long, vec array<double>. With whole_numbers the components are integers and scores are long.
    """
    spark = vectors.sparkSession
    number = "long" if whole_numbers else "double"
    vectors, queries = (df.select("id", "vec").where(finite("vec") & F.col("id").isNotNull()) for df in (vectors, queries))
    pool = kept(distinct_vectors(vectors, k).withColumns({"vid": F.monotonically_increasing_id(), "size": F.size("vec")}), "vectors")
    ends = spans(pool)
    step = {d: np.where(high > low, (high - low) / CELLS, 1.0) for d, (low, high) in ends.items()}
    asked = queries.dropDuplicates(["id", "vec"]).withColumns({"qid": F.monotonically_increasing_id(), "size": F.size("vec")})
    asked = kept(asked, "queries")
    uri = shared_file(asked.select("qid", "id", "vec", "size"), "query-blocks")

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for d, part in _by_length(batch):
            code = np.clip(((_matrix(part.column("vec")) - ends[d][0]) / step[d]).astype(np.int64), 0, CELLS - 1).astype(np.uint8)
            out += zip(part.column("vid").to_pylist(), part.column("ids").to_pylist(), [d] * len(code), [c.tobytes() for c in code], strict=True)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in ((0, pa.int64()), (1, pa.list_(pa.int64())), (2, pa.int32()), (3, pa.binary()))], ["vid", "ids", "size", "cells"])

    file = kept(map_arrow(pool, cells, "vid long, ids array<long>, size int, cells binary"), "cells")

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for d, part in _by_length(batch):
            cell = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, d)
            low, high = ends[d]
            floor = low + cell * step[d]
            vid, ids = part.column("vid").to_numpy(), part.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            many = np.array([len(i) for i in ids])
            for block in read_shared(uri, QUERIES):
                block = block.filter(pa.array(block.column("size").to_numpy() == d))
                if not block.num_rows:
                    continue
                q, own = _matrix(block.column("vec")), block.column("id").to_numpy()
                # rounding moves an edge, and a sum, by less than this share of what is summed up
                slack = 1e-9 * (np.abs(q) @ np.maximum(np.abs(low), np.abs(high) + np.abs(step[d])))[:, None] + 1e-9
                base = q @ floor.T
                upper = base + np.maximum(q, 0) @ step[d][:, None] + slack
                lower = base + np.minimum(q, 0) @ step[d][:, None] - slack
                # a row whose only id is the query's is no answer
                alone = (first[None] == own[:, None]) & (many == 1)[None]
                lower[alone] = upper[alone] = -np.inf
                m = min(k, lower.shape[1])
                least = np.partition(lower, -m, axis=1)[:, -m] if lower.shape[1] >= k else np.full(len(q), -np.inf)
                a, b = np.nonzero((upper >= least[:, None]) & ~alone)
                yield pa.RecordBatch.from_arrays([pa.array(block.column("qid").to_numpy()[a]), pa.array(vid[b]), pa.array(lower[a, b]), pa.array(upper[a, b])], ["qid", "vid", "lower", "upper"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN):
                yield from scan(batch.slice(at, SCAN))

    bounds = kept(file.select("vid", "ids", "size", "cells").mapInArrow(scanned, "qid long, vid long, lower double, upper double"), "bounds")
    own = Window.partitionBy("qid")
    # each row stands for at least one answer, so the k-th best lower bound is surely reached by k answers
    least = bounds.withColumn("n", F.row_number().over(own.orderBy(F.col("lower").desc()))).where(F.col("n") == k).select("qid", F.col("lower").alias("least"))
    near = bounds.join(least, "qid", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("qid", "vid", "upper")
    ordered = kept(near.withColumn("n", F.row_number().over(own.orderBy(F.col("upper").desc(), "vid"))), "candidates")

    def exact(some: DataFrame) -> DataFrame:
        """query_id, vec_id, score of candidates: k + 1 ids of each vector at most, without the query's own."""

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = np.zeros(batch.num_rows, np.int64 if whole_numbers else np.float64)
            size = batch.column("size").to_numpy()
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                x, q = (_matrix(batch.column(c).take(pa.array(at))) for c in ("vec", "qvec"))
                score[at] = (x.astype(np.int64) * q.astype(np.int64)).sum(1) if whole_numbers else (x * q).sum(1)
            return pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("query_id"), batch.column("ids"), pa.array(score)], ["qid", "query_id", "ids", "score"])

        rows = some.select("qid", "vid").join(pool.select("vid", "ids", "vec", "size"), "vid").join(asked.select("qid", F.col("id").alias("query_id"), F.col("vec").alias("qvec")), "qid")
        found = map_arrow(rows, each, f"qid long, query_id long, ids array<long>, score {number}")
        return found.select("qid", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")

    best = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)
    top = kept(best(exact(ordered.where(F.col("n") <= FIRST * k))), "first")
    worst = top.groupBy("qid").agg(F.min("score").alias("worst"), F.count("*").alias("found"))
    more = ordered.where(F.col("n") > FIRST * k).join(worst, "qid").where((F.col("found") < k) | (F.col("upper") >= F.col("worst")))
    both = top.drop("rank").unionByName(exact(more))
    by_id = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # queries of one id and several vectors share one list, in which an answer counts once with its best score
    merged = best(both).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
