"""Near-duplicate documents by DartMinHash (operator 5).

A document is a weighted set of shingles of five words. Darts are thrown at its weighted elements: each
unit of weight is a strip along the axis of ranks, on which hashed exponential gaps place darts; a dart
belongs to a coordinate by its hash, and each coordinate keeps the dart of the smallest rank. Two sets
agree on a coordinate with the probability of their weighted Jaccard similarity. Signatures are cut into
bands; documents with a common band are candidates, and the exact similarity of each candidate pair decides.

Hot bands: documents with equal sets are one node first. Then every band compares its members with one pivot,
its likely origin, where the elements that nobody else has leave room for a link; members that join the pivot's
class need no more comparison. The nodes of bands that are not one class then meet by their rarest elements:
ordered from rare to frequent, two sets with a link have a common element among their first ones, so pairs that
share none of these are ruled out without being formed. The buckets of rare elements are compared in the same
way, with four times as many pivots a round, until every pair has been compared or is in one class, so no link
between classes is lost. A class is a connected component of links; class_id is its smallest doc_id.

Cases: documents without words (null, empty) and with a null id are in no class but their own; fewer than five
words make one shingle; rows that share an id are one document, judged by one of their texts; words are runs
of other bytes than space and 9 to 13, unchanged; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from llm.common import kept, map_arrow
from llm.graph import components
from llm.words import U, Words, blocks, mix, runs, signed, whole

SHINGLE = 5
BANDS, ROWS = 22, 4
#: Pivots of a bucket of rare elements in its first round; four times as many in each later one.
PIVOTS = 16
SALTS = 8  # keys over which the rows of a hot bucket are spread
SHARE = 256  # members of a bucket that meet its pivots under one key


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times) of the block, ordered by text and shingle."""
    n = np.diff(w.first)
    gram = runs(w.hashes, SHINGLE)
    text, ok = whole(w.first, len(w.hashes), SHINGLE)
    text, gram = text[ok], gram[ok]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.array([runs(w.text(d), int(n[d]))[0] for d in short], dtype=U)
        text, gram = np.concatenate([text, short]), np.concatenate([gram, own])
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], gram[at], np.diff(np.append(at, len(gram)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers over 0 up to 1."""
    return ((x >> U(11)).astype(np.float64) + 1.0) / float(1 << 53)


def darts(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """The signatures: size dart numbers for each text; texts without elements have zeros."""
    out = np.zeros((n_texts, size), dtype=U)
    total = np.bincount(text, weights=weight, minlength=n_texts)
    todo = total > 0
    mean = size * (math.log(size) + 3.0)  # darts of a text; all coordinates get one in 19 of 20 texts
    while todo.any():
        use = todo[text]
        _throw(text[use], element[use], weight[use], mean / np.maximum(total, 1e-300), out)
        todo = (total > 0) & (out == 0).any(axis=1)
        mean *= 2.0  # the same darts and later ones
    return out


def _throw(text: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, out: np.ndarray) -> None:
    size = out.shape[1]
    # cells: a unit of weight by a unit of rank, within the text's limit
    strips = np.ceil(weight).astype(np.int64)
    levels = np.ceil(limit[text]).astype(np.int64)
    count = strips * levels
    at = np.repeat(np.arange(len(text)), count)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    strip, level = cell // levels[at], cell % levels[at]
    seed = mix(element[at] ^ mix(strip.astype(U) * U(0x9E3779B97F4A7C15) + level.astype(U) * U(0xC2B2AE3D27D4EB4F) + U(1)))
    rank = level.astype(np.float64)
    top = np.minimum(level + 1.0, limit[text[at]])
    keys, ranks, numbers = [], [], []
    turn = 0
    while len(at):
        turn += 1
        seed = mix(seed + U(0xD1342543DE82EF95))
        rank = rank - np.log(_unit(seed))
        live = rank < top
        at, seed, rank, top, strip = at[live], seed[live], rank[live], top[live], strip[live]
        under = strip + _unit(mix(seed ^ U(0xA24BAED4963EE407))) <= weight[at]  # the dart's place along the weight
        number = mix(seed ^ U(0x9FB21C651E98DF25)) | U(1)
        keys.append((text[at] * size + ((number >> U(20)) % U(size)).astype(np.int64))[under])
        ranks.append(rank[under])
        numbers.append(number[under])
    key, rank, number = np.concatenate(keys), np.concatenate(ranks), np.concatenate(numbers)
    order = np.lexsort((number, rank, key))
    key, number = key[order], number[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    out[key[first] // size, key[first] % size] = number[first]


def signatures(docs: DataFrame, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """pid, k1 and k2 (which tell the weighted set), bands; null bands where there are no words."""
    prime = np.arange(1, rows + 1).astype(U) * U(0x9E3779B97F4A7C15)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, found, null = [], [], [], []
        for row, end, w in blocks(batch.column("text")):
            n = end - row
            text, gram, times = shingles(w)
            weight = np.ones(len(gram)) if weights == "set" else times.astype(np.float64)
            sign = darts(text, gram, weight, n, bands * rows).reshape(n, bands, rows)
            band = mix(np.bitwise_xor.reduce(mix(sign + prime), axis=2) + np.arange(bands).astype(U) * U(0xD1342543DE82EF95))
            own = mix(gram + (weight.astype(U) << U(1)))
            bounds = np.searchsorted(text, np.arange(n + 1))
            for which, to in ((own, k1), (mix(own + U(7)), k2)):
                sums = np.concatenate([np.zeros(1, U), np.cumsum(which)])
                to.append(signed(sums[bounds[1:]] - sums[bounds[:-1]]))
            found.append(signed(band))
            null.append(bounds[1:] == bounds[:-1])
        k1, k2, found, null = np.concatenate(k1), np.concatenate(k2), np.concatenate(found), np.concatenate(null)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(k1) + 1) * bands, pa.int32()), pa.array(found.ravel()), mask=pa.array(null))
        return pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(k1), pa.array(k2), lists], ["pid", "k1", "k2", "bands"])

    return map_arrow(docs, each, "pid long, k1 long, k2 long, bands array<long>")


def sets(docs: DataFrame, weights: str = "set") -> DataFrame:
    """pid and its sorted shingles as bytes; with counts, the n-th time of a shingle is an element of its own."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for row, end, w in blocks(batch.column("text")):
            text, gram, times = shingles(w)
            if weights != "set" and len(times):
                at = np.repeat(np.arange(len(gram)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                text, gram = text[at], mix(gram[at] + nth.astype(U))
                order = np.lexsort((gram, text))
                text, gram = text[order], gram[order]
            bounds = np.searchsorted(text, np.arange(end - row + 1))
            out += [gram[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("pid"), pa.array(out, pa.binary())], ["pid", "elements"])

    return map_arrow(docs, each, "pid long, elements binary")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaccard similarity of two sorted sets of 64-bit elements."""
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, U), np.frombuffer(y, U)
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        both = int((y[at] == x).sum()) if len(y) else 0
        out.append(both / (len(x) + len(y) - both))
    return pd.Series(out)


def _exploded(held: DataFrame) -> DataFrame:
    """node, element for every element of the sets."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [np.frombuffer(x, U) for x in batch.column("elements").to_pylist()]
        n = np.array([len(x) for x in raw])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("pid").to_numpy(), n)), pa.array(signed(np.concatenate(raw)))], ["node", "element"])

    return map_arrow(held, each, "node long, element long")


def _with_own(band: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Bands with n, the elements of the node, and own, how many of them no other node has; without nodes that can't have a link."""

    single = _exploded(held).groupBy("element").agg(F.count("*").alias("times"), F.min("node").alias("node")).where("times = 1")
    own = single.groupBy("node").agg(F.count("*").alias("own"))
    size = held.select(F.col("pid").alias("node"), (F.length("elements") / 8).cast("long").alias("n")).join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    return band.join(size.where(F.col("n") - F.col("own") >= threshold * F.col("n")), "node")


def _at_buckets(rows: DataFrame, per_bucket: DataFrame) -> DataFrame:
    """rows (bucket, node, ...) with what per_bucket (a row a bucket) says of their bucket; a hot bucket's rows are spread over SALTS keys."""
    salted = per_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["bucket", "salt"]).drop("salt")


def _strays(open_: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets that may still hold pairs to compare, with root, stray, strays and members (of the bucket).

    The largest class of a bucket is its main one; all others are strays, which must be compared with
    everything outside their class, unless they have been used as pivots.
    """
    now = open_.join(labels, "node")
    size = now.groupBy("bucket", "root").agg(F.count("*").alias("size"), F.count_if(~F.col("used")).alias("free"))
    top = F.max(F.struct("size", F.negative("root").alias("neg"), "free"))
    whole_ = size.groupBy("bucket").agg(top.alias("m"), F.count("*").alias("classes"), F.sum("free").alias("free"), F.sum("size").alias("members")).where("classes > 1")
    main = whole_.select("bucket", "members", F.negative("m.neg").alias("main"), (F.col("free") - F.col("m.free")).alias("strays")).where("strays > 0")
    return _at_buckets(now, main).withColumn("stray", (F.col("root") != F.col("main")) & ~F.col("used")).drop("main")


def _links(now: DataFrame, held: DataFrame, threshold: float, extra: str, meet: F.Column) -> DataFrame:
    """a, b, ra, rb: the links between the pivots of a bucket and its other classes, for pairs that meet.

    The members of a large bucket are spread over several keys, each of which gets all its pivots.
    """
    shares = F.ceil(F.col("members") / F.lit(SHARE)).cast("int")
    now = now.withColumn("salt", F.pmod(F.xxhash64("node"), shares).cast("int"))
    centre = now.where("pivot").select("bucket", F.explode(F.sequence(F.lit(0), shares - 1)).alias("salt"), F.col("node").alias("p"), F.col("root").alias("p_root"), F.col("n").alias("p_n"), (F.col("n") - F.col("own")).alias("p_both"), F.col(extra).alias(f"p_{extra}"))
    most = F.least("p_both", F.col("n") - F.col("own"))  # common elements
    close = (F.col("p_root") != F.col("root")) & (most >= threshold * (F.col("n") + F.col("p_n") - most) - 1e-9)
    swap = F.col("p") > F.col("node")
    one, two = F.struct(F.col("p").alias("id"), F.col("p_root").alias("root")), F.struct(F.col("node").alias("id"), F.col("root"))
    found = centre.join(now.drop("pivot", "used", "members"), ["bucket", "salt"]).where(close & meet).select(F.when(swap, two).otherwise(one).alias("one"), F.when(swap, one).otherwise(two).alias("two"))
    pairs = found.select(F.col("one.id").alias("a"), F.col("one.root").alias("ra"), F.col("two.id").alias("b"), F.col("two.root").alias("rb")).distinct()
    with_a = pairs.join(held.select(F.col("pid").alias("a"), F.col("elements").alias("x")), "a")
    both = with_a.join(held.select(F.col("pid").alias("b"), F.col("elements").alias("y")), "b")
    # lengths alone rule out many pairs
    fits = F.least(F.length("x"), F.length("y")) >= threshold * F.greatest(F.length("x"), F.length("y"))
    return kept(both.where(fits).withColumn("s", similarity("x", "y")).where(F.col("s") >= threshold).select("a", "b", "ra", "rb"), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after the classes that a link joins become one."""
    if links.isEmpty():
        return labels
    moved = components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    return kept(labels.join(moved.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root")), "labels")


def _rarest(held: DataFrame, threshold: float) -> DataFrame:
    """bucket (an element), node, pos: the rarest elements of each node that another node has, with their place by rarity.

    Of two sets with a link, the rarest common element is at a place before n - ceil(threshold * n) + 1 in both.
    """
    rows = _exploded(held)
    # A hot element's rows are spread over SALTS keys; elements of one node alone need no row.
    times = rows.groupBy("element").agg(F.count("*").alias("times")).where("times > 1").select("element", "times", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(times, ["element", "salt"], "left")
    own = Window.partitionBy("node")
    rows = rows.withColumn("pos", F.row_number().over(own.orderBy(F.coalesce("times", F.lit(1)), "element")) - 1).withColumn("size", F.count("*").over(own))
    return rows.where(F.col("times").isNotNull() & (F.col("pos") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9))).select(F.col("element").alias("bucket"), "node", "pos")


def classes(docs: DataFrame, threshold: float = 0.8, weights: str = "set", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, class_id for every row of docs (doc_id, text).

    weights: "set" (each shingle weighs 1) or "count" (as often as it occurs).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("pid"), "text").where(F.col("pid").isNotNull())
    signs = kept(signatures(base, weights, bands, rows), "signatures")
    one = signs.where(F.col("bands").isNotNull())
    nodes = one.groupBy("k1", "k2").agg(F.min("pid").alias("node"))
    member = kept(one.join(nodes, ["k1", "k2"]).groupBy("pid").agg(F.min("node").alias("node")), "members")

    # Bands with at least two nodes.
    rep = member.where("pid = node").select("pid")
    own = one.join(rep, "pid", "left_semi").groupBy(F.col("pid").alias("node")).agg(F.min("bands").alias("bands"))
    band = own.select("node", F.explode("bands").alias("bucket"))
    many = band.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("bucket")
    # Every band that is open: it may still hold pairs that have not been compared.
    open_ = kept(_at_buckets(band, many).join(own, "node").withColumn("used", F.lit(False)), "bands")
    wanted = open_.select(F.col("node").alias("pid")).distinct()
    held = kept(sets(base.join(wanted, "pid", "left_semi").groupBy("pid").agg(F.min("text").alias("text")), weights), "sets")

    # Elements that no other candidate has can be in no intersection; they bound the similarity of every pair.
    open_ = kept(_with_own(open_, held, threshold), "bands")
    labels = kept(wanted.select(F.col("pid").alias("node"), F.col("pid").alias("root")), "labels")
    # Round 1 compares every band with its likely origin: the node with the fewest elements of its own.
    now = _strays(open_, labels)
    origin = now.groupBy("bucket").agg(F.min(F.struct("own", "node"))["node"].alias("origin"))
    now = kept(_at_buckets(now, origin).withColumn("pivot", F.col("node") == F.col("origin")).withColumn("used", F.col("pivot")).drop("origin", "stray", "strays"), "bands")
    # a pair belongs to the first of its common bands
    first = F.col("p_bands")[F.array_position(F.zip_with("p_bands", "bands", lambda x, y: x == y), True) - 1] == F.col("bucket")
    labels = _merged(labels, _links(now, held, threshold, "bands", first))

    # Later rounds: the nodes of bands that still hold strays meet by their rarest elements.
    rest = kept(_strays(now.drop("root", "pivot", "members"), labels).select("node", "n", "own").distinct(), "rest")
    held = kept(held.join(rest.select(F.col("node").alias("pid")), "pid", "left_semi"), "sets")
    open_ = kept(_rarest(held, threshold).join(rest, "node").withColumn("used", F.lit(False)), "rarest")
    need = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("p_n")) - 1e-9)
    early = (F.col("pos") <= F.col("n") - need) & (F.col("p_pos") <= F.col("p_n") - need)
    pivots = PIVOTS
    while True:
        now = _strays(open_, labels)
        share = F.pmod(F.xxhash64("node", F.lit(pivots)), F.lit(1 << 40)) / float(1 << 40)
        now = now.withColumn("pivot", F.col("stray") & (share < pivots / F.col("strays")))
        now = kept(now.withColumn("used", F.col("used") | F.col("pivot")).drop("stray", "strays"), "rarest")
        if now.isEmpty():
            break
        labels = _merged(labels, _links(now, held, threshold, "pos", early))
        open_ = now.drop("root", "pivot", "members")
        pivots *= 4

    of = member.join(labels, "node", "left").select("pid", F.coalesce("root", "node").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(of.withColumnRenamed("pid", "doc_id"), "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each class: that of the smallest id. Rows with a null id stay."""
    first = classes(docs, threshold).where("doc_id = class_id").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi")
    return named.dropDuplicates(["doc_id"]).unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)
