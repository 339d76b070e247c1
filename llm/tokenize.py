"""Byte-level BPE by overlapping chunks (operator 9).

A text is cut into chunks that overlap; each chunk is pre-tokenised on its own, neighbours are stitched at a place in the
overlap where both have a pre-token boundary, and the pieces between such places are encoded in parallel. Decoding concatenates
raw bytes. A text of one chunk has no seam: it is its only piece, and is encoded where it is read.

Cases: a null text is an empty one (no ids); repeated rows give repeated results; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import map_arrow, parts

CHUNK = 32_768  # characters of a chunk
OVERLAP = 1_024  # characters that a chunk reads of the next one
_ENCODERS: dict[tuple[str, str], tiktoken.Encoding] = {}
_SPLIT: dict[str, regex.Pattern] = {}


def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """One encoder a Python worker, read from the rank file."""
    if (path, pattern) not in _ENCODERS:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens of text start."""
    if pattern not in _SPLIT:
        _SPLIT[pattern] = regex.compile(pattern)
    return [m.start() for m in _SPLIT[pattern].finditer(text)]


def _ids(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    return np.array(enc.encode_ordinary(text), dtype="<u4")


def chunked(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk number and its text with the overlap, for texts of over one chunk; in one pass over each text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts_ = [text[a : a + chunk + overlap] for a in range(0, len(text), chunk)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(parts_)), pa.array(range(len(parts_)), pa.int32()), pa.array(parts_, pa.string())], ["key", "no", "part"])

    return docs.select("key", "text").mapInArrow(each, "key string, no int, part string").repartition(parts(docs.sparkSession), "key", "no")


def pieces_of(docs: DataFrame) -> DataFrame:
    """key, number and text of the pieces between the cuts of docs (key, text, cuts)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, at in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "cuts")), strict=True):
                ends = [0, *(at or []), len(text)]
                own = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own)), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.string())], ["key", "no", "piece"])

    return docs.mapInArrow(each, "key string, no int, piece string").repartition(parts(docs.sparkSession), "key", "no")


def cuts(chunks: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, and the ordered places at which its text can be cut: boundaries on which both neighbours agree."""

    def ends(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {"key": [], "at": [], "side": []}
        for key, no, part in zip(*(batch.column(c).to_pylist() for c in ("key", "no", "part")), strict=True):
            found = np.array(boundaries(part, pattern), dtype=np.int64)
            # A cut stands before a space that follows something else: a piece that ends there splits as it does in the whole text.
            ok = [i for i in found.tolist() if 0 < i < len(part) and part[i] == " " and not part[i - 1].isspace()]
            for side, low, base in ((0, chunk, no * chunk), (1, 0, no * chunk)):
                if side and not no:
                    continue
                rows["at"] += (own := [base + i for i in ok if low < i < low + overlap - 64])
                rows["key"] += [key] * len(own)
                rows["side"] += [side + 2 * (no + 1 - side)] * len(own)
        return pa.RecordBatch.from_pydict(rows, pa.schema([("key", pa.string()), ("at", pa.int64()), ("side", pa.int64())]))

    found = map_arrow(chunks, ends, "key string, at long, side long")
    both = found.groupBy("key", F.floor(F.col("side") / 2).alias("seam"), "at").agg(F.count("*").alias("n")).where("n = 2")
    return both.groupBy("key", "seam").agg(F.min("at").alias("at")).groupBy("key").agg(F.sort_array(F.collect_list("at")).alias("cuts"))


def encode_decode(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded].

    ids: little-endian unsigned 32-bit integers, decoded: bytes; both only with keep_ids.
    """
    extra = ", ids binary, decoded binary" if keep_ids else ""
    schema = f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields += [("ids", pa.binary()), ("decoded", pa.binary())] if keep_ids else []

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path, pattern)
        out: list[list] = [[] for _ in fields]
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = _ids(enc, text)
            back = enc.decode_bytes(ids.tolist())
            row = [doc, len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()]
            for col, v in zip(out, [*row, ids.tobytes(), back][: len(fields)], strict=True):
                col.append(v)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

    short = map_arrow(base.where(F.length("text") <= chunk), digest, schema)

    # The key tells apart rows that share an id; equal texts of one id give equal results.
    long = base.where(F.length("text") > chunk).withColumn("key", F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)))
    one = long.dropDuplicates(["key"])
    at = cuts(chunked(one, chunk, overlap), pattern, chunk, overlap)
    pieces = pieces_of(one.join(at, "key", "left").select("key", "text", "cuts"))

    @F.pandas_udf("binary")
    def encoded(piece: pd.Series) -> pd.Series:
        enc = encoder(path, pattern)
        return piece.map(lambda x: _ids(enc, x).tobytes())

    @F.pandas_udf("binary")
    def decoded(ids: pd.Series) -> pd.Series:
        enc = encoder(path, pattern)
        return ids.map(lambda x: enc.decode_bytes(np.frombuffer(x, dtype="<u4").tolist()))

    both = pieces.select("key", "no", encoded("piece").alias("ids")).select("key", "no", "ids", decoded("ids").alias("raw"))
    joined = both.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "ids", "raw"))).alias("p"))

    @F.pandas_udf("binary")
    def run_together(pieces: pd.Series) -> pd.Series:
        return pieces.map(b"".join)

    joined = joined.select("key", run_together(F.col("p.ids")).alias("ids"), run_together(F.col("p.raw")).alias("decoded"))
    result = long.select("doc_id", "key").join(joined, "key").select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids", "decoded"] if keep_ids else []))
    return short.unionByName(result)
