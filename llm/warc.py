"""WARC archives of pages, and capture histories by external index merge (operator 7).

Pages are written as gzip members of WARC/1.1 files in the shared folder; each file is a capture run
sorted by URL key, time and page. Reading the files back gives their index, whose partitions Spark sorts and writes
as runs by ranges of the key; loser trees merge the runs of each range lazily from their files into globally
ordered histories.

Cases: a null payload is an empty one; of equal payloads the smallest page id is the response, whatever
the URL; rows of one page id are judged each by its own payload, and repeated rows keep their type; a null page id counts as smallest and is read back
as null; a null URL has an empty key; an empty table gives an empty result. A task that runs again
writes new files, and only the files that the finished tasks report are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import posixpath
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, kept, parts, qualified, scratch

INDEX = "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, position long, length long"
NO_TIME = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """The URL key: host labels from the top down, then path and query."""
    if not url:
        return ""
    try:
        parts_ = urlsplit(url.strip())
        host = parts_.hostname or ""
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (parts_.path or "/") + (f"?{parts_.query}" if parts_.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's digest


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """pid, key (of the payload) and first (the page that it revisits), once for each page and payload that revisits another page."""
    own = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("pid"), F.coalesce("html", F.lit("")).alias("html"))
    own = own.where(F.octet_length("html") >= least).select("pid", F.unhex(F.sha2("html", 256)).alias("key"))
    first = own.groupBy("key").agg(F.min("pid").alias("first"), F.max("pid").alias("last")).where("first < last").drop("last")
    return own.join(first, "key").where("pid <> first").select("pid", "key", "first").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes page_id, url, html (and captured, if there is such a column) and returns the archives' names."""
    time = F.coalesce(F.col("captured").cast("string"), F.lit(NO_TIME)) if "captured" in pages.columns else F.lit(NO_TIME)
    rows = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(-(2**63))).alias("pid"), "url", F.coalesce("html", F.lit("")).alias("html"), time.alias("captured"))
    # As strings, so that pandas does not turn nullable ids into floating-point numbers.
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256))).join(roles(pages, least), ["pid", "key"], "left").drop("key").withColumn("first", F.col("first").cast("string"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A run is one batch of rows: what is sorted at once stays small however large the partition is.
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for frame in frames:
            if frame.empty:
                continue
            frame["key"] = [surt(u) for u in frame["url"]]
            frame = frame.sort_values(["key", "captured", "pid"], kind="stable")
            name = f"run-{uuid.uuid4().hex}.warc.gz"
            with fs.open_output_stream(posixpath.join(base, name), compression=None) as out:
                for r in frame.itertuples():
                    out.write(gzip.compress(record(r.pid, r.url, r.captured, r.html, None if pd.isna(r.first) else int(r.first)), 1, mtime=0))
            yield pd.DataFrame({"archive": [name], "records": [len(frame)]})

    return rows.mapInPandas(write, "archive string, records long")


def record(pid: int, url: str | None, captured: str, html: str, first: int | None) -> bytes:
    """One WARC record; a revisit has no payload of its own but tells its digest and length."""
    payload = html.encode("utf-8", "surrogatepass")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{pid}>",
        f"WARC-Date: {captured}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(payload) if first is None else 0}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + (payload if first is None else b"") + b"\r\n\r\n"




def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One sorted index run for each archive; digests and lengths are those of the payload that was read."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for frame in frames:
            for name in frame["archive"]:
                rows = []
                with fs.open_input_stream(posixpath.join(base, name), compression=None) as f:
                    stream = Members(f)
                    for at, length, h, payload in stream:
                        pid = int(h["WARC-Record-ID"][10:-1])
                        own = h["WARC-Type"] == "response"
                        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if own and digest(payload) != said:
                            raise ValueError(f"{name} at {at}: the payload does not have its digest")
                        first = None if own else int(h["WARC-Refers-To"][10:-1])
                        url = h.get("WARC-Target-URI")
                        rows.append((surt(url), h["WARC-Date"], pid if pid > -(2**63) else None, url, len(payload) if own else int(h["WARC-Payload-Length"]), said, h["WARC-Type"], first if first is None or first > -(2**63) else None, name, at, length))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    return archives.mapInPandas(read, INDEX)


class Members:
    """The gzip members of a stream, one at a time."""

    def __init__(self, stream: io.RawIOBase, piece: int = 1 << 20) -> None:
        self.stream, self.piece = stream, piece

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        import zlib

        at, rest = 0, b""
        while True:
            d, raw, used = zlib.decompressobj(31), [], 0
            rest = rest or self.stream.read(self.piece)
            if not rest:
                return
            while not d.eof:
                if not rest and not (rest := self.stream.read(self.piece)):
                    raise EOFError("an archive ends within a record")
                raw.append(d.decompress(rest))
                used += len(rest) - len(d.unused_data)
                rest = d.unused_data
            head, _, body = b"".join(raw).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            yield at, used, fields, body[: int(fields["Content-Length"])]
            at += used


def loser_tree(runs: list[Iterable]) -> Iterator:
    """Merges sorted runs, holding one item of each: inner nodes hold the losers of their matches, the winner climbs from the leaf that moved."""
    k = len(runs)
    rest = [iter(r) for r in runs]
    heads = [next(r, None) for r in rest]

    def before(a: int, b: int) -> bool:
        """Whether run a's head comes out before run b's; -1 stands for a run that beats all."""
        if a < 0 or b < 0:
            return a < 0
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k
    winner = -1

    def climb(run: int) -> int:
        at = (run + k) // 2
        while at:
            if before(losers[at], run):
                losers[at], run = run, losers[at]
            at //= 2
        return run

    for run in range(k - 1, -1, -1):
        winner = climb(run)
    while k and heads[winner] is not None:
        yield heads[winner]
        heads[winner] = next(rest[winner], None)
        winner = climb(winner)


NAMES = [c.split()[0] for c in INDEX.split(", ")]
ORDER = ["url_key", "captured", "page_id", "archive", "position"]
READ = 1_024  # rows of a run that are held at once
FAN_IN = 128  # runs merged at once; more of them take another pass
SAMPLE = 5_000  # keys from which the ranges are taken


def _place(row: tuple) -> tuple:
    """The order of captures; a null page id is the smallest."""
    key, captured, page, archive, at = (row[NAMES.index(c)] for c in ORDER)
    return key, captured, -(2**63) if page is None else page, archive, at


def _merged(fs: pafs.FileSystem, files: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of sorted Parquet files in their common order; each file is read READ rows at a time."""

    def rows(name: str) -> Iterator[tuple]:
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(READ, columns=NAMES):
                for row in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
                    yield _place(row), row

    out: list[tuple] = []
    for _, row in loser_tree([rows(f) for f in files]):
        out.append(row)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], NAMES)


def merge_runs(index: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Captures in global order of URL key, time and page.

    Spark sorts each partition, which may spill; what it writes for each range of keys is a run. The runs of a range are merged
    by loser trees, lazily from their files, in as many passes as fan_in asks for. Partition i of the result is range i.
    """
    spark = index.sparkSession
    n = parts(spark)
    rows = kept(index.select(*NAMES), "index")
    found = bounded_sample(rows.select(*ORDER), SAMPLE, F.lit(True), "archive", "position").collect()
    keys = sorted(_place(tuple(r.asDict().get(c) for c in NAMES)) for r in found)
    # ranges by whole places, so that the captures of one frequent URL are split too
    bounds = [keys[len(keys) * i // n] for i in range(1, n)] if keys else []
    schema = pa.schema([(c, pa.int64() if t == "long" else pa.string()) for c, t in (x.split() for x in INDEX.split(", "))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(bounds, _place(r)) for r in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "part"])

    folder = scratch(spark, "runs")
    # `low` sorts null page ids first as _place does
    low = F.coalesce("page_id", F.lit(-(2**63)))
    dealt = rows.mapInArrow(deal, INDEX + ", part int").sortWithinPartitions("part", "url_key", "captured", low, "archive", "position")
    dealt.write.partitionBy("part").option("compression", "zstd").parquet(folder)
    base_uri = qualified(spark, folder)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(base_uri)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                where = posixpath.join(base, f"part={part}")
                listed = fs.get_file_info(pafs.FileSelector(where, allow_not_found=True))
                files = sorted(f.path for f in listed if f.base_name.endswith(".parquet"))
                while len(files) > fan_in:  # a pass over the first runs makes one longer run
                    name = posixpath.join(where, f"_merged-{uuid.uuid4().hex}")
                    with fs.open_output_stream(name) as out, pq.ParquetWriter(out, schema) as writer:
                        for b in _merged(fs, files[:fan_in], schema):
                            writer.write_batch(b)
                    files = [*files[fan_in:], name]
                yield from _merged(fs, files, schema)

    return spark.range(0, n, 1, n).mapInArrow(merge, INDEX)


def capture_histories(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the archives, reads them back and merges their index runs: one row for each record."""
    folder = qualified(pages.sparkSession, scratch(pages.sparkSession, "warc"))
    archives = kept(write_archives(pages, folder, least), "archives").repartition(parts(pages.sparkSession))
    return merge_runs(read_archives(archives, folder))
