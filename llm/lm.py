"""Quality classifier by an interpolated modified Kneser-Ney model (operator 10).

Symbols are the bytes of UTF-8, ORDER of them a gram; every language has models of its own. The documents are
written once in blocks of about BLOCK bytes, bucketed by block, so that no later step shuffles texts. Each block gives its
distinct grams and how often its trusted documents have them, dealt to shards by gram. The counts are summed in shards by gram and joined,
order by order, with the totals, discounts and continuation counts of their contexts; the grams that blocks ask for
are joined with these tables, and the answers go from the shards back to the blocks, where the mean over all grams
of a document gives its perplexity.

Documents are in two folds by a hash of their id and each is scored by the model of the other fold, so no trusted
document is scored by a model that has seen it. A document is rejected where its perplexity is above a quantile of the
trusted documents of its language and length class (powers of two of bytes). Quantiles are the conformal ones: the k-th smallest of n with
k = ceil(quantile * (n + 1)); where k is larger than n, there is none, and the quantile over all lengths of the language is
taken; where there is none either, documents are kept.

Cases: a null or empty text has no symbols, no perplexity, and is kept; so are documents of a null language and of
one without trusted text; where only one fold of a language has trusted text, its model scores both; a document labelled
toxic is not trusted; rows with the same id are scored each for itself, and are trusted if a label says so; conflicting
labels: the lowest quality counts; equal perplexities are decided alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from llm.common import in_blocks, kept, map_arrow, parts

ORDER = 5
SYMBOLS = 256
BLOCK = 32 << 20  # bytes of text in a block
RUN = 1 << 20  # bytes of text whose grams are held at once
QUANTILE = 0.98
DIGITS = 3  # of a perplexity
LANG_BITS = 15  # a header of language and fold stands above the bytes of a gram


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of the texts, one that ends at each byte, and the text of each. Before a text stand zeros."""
    pad = b"\0" * (ORDER - 1)
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t)), np.uint8)
    n = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    last = np.arange(len(text)) + (text + 1) * (ORDER - 1)
    code = np.zeros(len(last), dtype=np.int64)
    for k in range(ORDER - 1, -1, -1):
        code = (code << 8) | raw[last - k]
    return code, text


def runs_of(texts: list[bytes], size: int = RUN) -> Iterator[tuple[int, list[bytes]]]:
    """(first text, texts) for runs of about size bytes."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield start, texts[start : i + 1]
            start, n = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _by_language(table: pa.Table, codes: dict[str, int]) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(code, rows, texts as bytes) for each language that has a code; empty texts are left out."""
    lang, text = table.column("lm_lang").to_pylist(), table.column("lm_text").to_pylist()
    rows: dict[str, list[int]] = {}
    for i, (a, t) in enumerate(zip(lang, text, strict=True)):
        if t and a in codes:
            rows.setdefault(a, []).append(i)
    for a in sorted(rows):
        yield codes[a], np.array(rows[a]), [text[i].encode("utf-8", "surrogatepass") for i in rows[a]]


# --- blocks ---


def dealt(docs: DataFrame) -> DataFrame:
    """docs in blocks: with lm_row (its own for each row) and lm_block, which is odd for fold 1."""
    return in_blocks(docs, "text", BLOCK, "lm_block", "lm_row", fold_of(F.col("doc_id")))


def fold_of(doc_id: F.Column) -> F.Column:
    """0 or 1 by a product of the id; a null id is in fold 0."""
    mixed = F.shiftright(F.pmod(doc_id.cast("long"), F.lit(1 << 31)) * F.lit(2654435761), 16)
    return F.coalesce(F.pmod(mixed, F.lit(2)), F.lit(0))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents that are labelled good, and never toxic."""
    return labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND coalesce(t, 0) <> 1").select("doc_id")


def _light(docs: DataFrame) -> DataFrame:
    """What the steps on texts need of dealt documents."""
    return docs.select("lm_block", "lm_row", F.col("lang").cast("string").alias("lm_lang"), F.col("text").cast("string").alias("lm_text"))


def packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences; any number of them, the first 8 bytes tell how many."""
    return len(numbers).to_bytes(8, "little") + pa.compress(np.diff(numbers, prepend=0).astype("<i8").tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    return np.cumsum(np.frombuffer(pa.decompress(raw[8:], size * 8, "zstd", asbytes=True), "<i8")) if size else np.zeros(0, np.int64)


def shard_of(key, shards: int):  # noqa: ANN001, ANN201
    """The shard of a key without fold, for numbers and for columns."""
    if isinstance(key, F.Column):
        return F.pmod(key.bitwiseXOR(F.shiftright(key, 13)).bitwiseXOR(F.shiftright(key, 29)), F.lit(shards)).cast("int")
    return (key ^ (key >> 13) ^ (key >> 29)) % shards


def asked(docs: DataFrame, trusted: DataFrame, codes: dict[str, int], shards: int) -> DataFrame:
    """shard, lm_block, keys (language and gram), times: the distinct grams of each block, and how often its trusted documents have them."""

    def gather(block: pa.Table, rows: pa.Table) -> pa.Table:
        good = np.isin(block.column("lm_row").to_numpy(), rows.column("row").to_numpy())
        out_k, out_n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for code, own, texts in _by_language(block, codes):
            found, times = [], []
            for start, run in runs_of(texts):
                code_of, text = grams(run)
                d = pa.array(code_of).dictionary_encode()
                at = d.indices.to_numpy()
                found.append(d.dictionary.to_numpy())
                times.append(np.bincount(at[good[own[start + text]]], minlength=len(found[-1])))
            gram, at = np.unique(np.concatenate(found), return_inverse=True)
            out_k.append((code << (8 * ORDER)) | gram)
            out_n.append(np.bincount(at, np.concatenate(times), minlength=len(gram)).astype(np.int64))
        key, n = np.concatenate(out_k), np.concatenate(out_n)
        at = shard_of(key, shards)
        order = np.argsort(at, kind="stable")  # keys stay sorted within a shard
        key, n, at = key[order], n[order], at[order]
        some = np.unique(at)
        ends = np.searchsorted(at, some, "right").tolist()
        places = list(zip(np.searchsorted(at, some).tolist(), ends, strict=True))
        number = (block if block.num_rows else rows).column("lm_block")[0].as_py()
        return pa.table({"shard": pa.array(some, pa.int32()), "lm_block": pa.array([number] * len(some), pa.int64()), "keys": pa.array([packed(key[a:b]) for a, b in places], pa.binary()), "times": pa.array([n[a:b].astype("<i8").tobytes() for a, b in places], pa.binary())})

    return _light(docs).groupBy("lm_block").cogroup(trusted.select("lm_block", F.col("lm_row").alias("row")).groupBy("lm_block")).applyInArrow(gather, "shard int, lm_block long, keys binary, times binary")


def _model_keys(key: np.ndarray, block: int, alone: frozenset[int]) -> np.ndarray:
    """Keys with the fold of the model that scores the block: the other one, or its own where only that has trusted text."""
    own = block % 2
    lang = key >> (8 * ORDER)
    lonely = np.isin(lang, [x // 2 for x in alone if x % 2 == own])
    return key | (np.where(lonely, own, 1 - own) << (8 * ORDER + LANG_BITS))


def counted(requests: DataFrame) -> DataFrame:
    """gram (with its fold above the language), n: the sum over all blocks."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        grams_, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for block, keys, times in zip(*(batch.column(c).to_pylist() for c in ("lm_block", "keys", "times")), strict=True):
            t = np.frombuffer(times, "<i8")
            grams_.append((unpacked(keys) | (block % 2 << (8 * ORDER + LANG_BITS)))[t > 0])
            n.append(t[t > 0])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams_)), pa.array(np.concatenate(n))], ["gram", "n"])

    return map_arrow(requests, each, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def wanted(requests: DataFrame, alone: frozenset[int]) -> DataFrame:
    """gram: the distinct grams that are asked for."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [_model_keys(unpacked(k), b, alone) for b, k in zip(batch.column("lm_block").to_pylist(), batch.column("keys").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)))], ["gram"])

    return map_arrow(requests.select("lm_block", "keys"), each, "gram long").distinct()


def answered(requests: DataFrame, p: DataFrame, alone: frozenset[int], shards: int) -> DataFrame:
    """lm_block, keys, p: the probabilities that a shard of the model gives for the grams of each block."""

    def look(asking: pa.Table, model: pa.Table) -> pa.Table:
        gram, value = model.column("gram").to_numpy(), model.column("p").to_numpy()
        order = np.argsort(gram)
        gram, value = gram[order], value[order]
        out = [value[np.searchsorted(gram, _model_keys(unpacked(k), b, alone))].tobytes() for b, k in zip(asking.column("lm_block").to_pylist(), asking.column("keys").to_pylist(), strict=True)]
        return pa.table({"lm_block": asking.column("lm_block"), "keys": asking.column("keys"), "p": pa.array(out, pa.binary())})

    own = p.withColumn("shard", shard_of(F.col("gram").bitwiseAND((1 << (8 * ORDER + LANG_BITS)) - 1), shards))
    return requests.select("shard", "lm_block", "keys").groupBy("shard").cogroup(own.groupBy("shard")).applyInArrow(look, "lm_block long, keys binary, p binary")


# --- the model ---


def suffix(key: F.Column, k: int) -> F.Column:
    """The gram of order k without its first symbol."""
    return F.shiftleft(F.shiftright(key, 8 * k), 8 * (k - 1)).bitwiseOR(key.bitwiseAND((1 << (8 * (k - 1))) - 1))


def levels(counted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """From order 1 up: (gram, share): what a seen gram has of its own; (context, rest): what a context leaves to the lower order.

    counted: gram, n of order ORDER. A lower order counts how many different symbols stand before a gram.
    """
    out = []
    table = counted
    for k in range(ORDER, 0, -1):
        head = F.shiftright("gram", 8 * k)
        times = lambda *at: [F.count_if(F.col("n") == i).cast("double").alias(f"m{i}") for i in at]
        m = table.groupBy(head.alias("head")).agg(*times(1, 2, 3, 4))
        y = F.col("m1") / (F.col("m1") + 2 * F.col("m2"))
        cut = lambda i: F.when(F.col(f"m{i}") > 0, F.least(F.lit(i - 0.01), F.greatest(F.lit(0.01), i - (i + 1) * y * F.col(f"m{i + 1}") / F.col(f"m{i}")))).otherwise(F.lit(0.9)).alias(f"d{i}")
        # one row for each language and fold
        discounts = F.broadcast(m.select("head", cut(1), cut(2), cut(3)))
        with_cut = table.withColumn("head", head).join(discounts, "head").select("gram", "n", F.shiftright("gram", 8).alias("context"), F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("cut"))
        totals = with_cut.groupBy("context").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
        share = with_cut.join(totals, "context").select("gram", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"))
        out.append((share, totals.select("context", (F.col("left") / F.col("total")).alias("rest"))))
        if k > 1:
            table = kept(table.groupBy(suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    return out[::-1]


def probabilities(grams_: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """gram, p for distinct grams of order ORDER, by joins with every order of the model."""
    orders = [grams_]
    for k in range(ORDER, 1, -1):
        orders.append(kept(orders[-1].select(suffix(F.col("gram"), k).alias("gram")).distinct(), "wanted"))
    p = None
    for k, (own, (share, rest)) in enumerate(zip(orders[::-1], model, strict=True), 1):
        found = own.withColumn("context", F.shiftright("gram", 8)).join(share, "gram", "left").join(rest, "context", "left")
        if p is None:
            found = found.withColumn("low", F.lit(1.0 / SYMBOLS))
        else:
            found = found.withColumn("lower", suffix(F.col("gram"), k)).join(p.select(F.col("gram").alias("lower"), F.col("p").alias("low")), "lower")
        p = kept(found.select("gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("low")).alias("p")), "shares")
    return p


def fit(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """The model of the texts of trusted (text), as one language; for use with probabilities()."""
    docs = dealt(trusted.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.lit("").alias("lang")))
    found = counted(asked(docs, docs.select("lm_block", "lm_row"), {"": 0}, 8))
    one = found.groupBy(F.col("gram").bitwiseAND((1 << (8 * ORDER + LANG_BITS)) - 1).alias("gram")).agg(F.sum("n").alias("n"))
    return levels(kept(one, "counts"))


# --- scores ---


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """lm_block, lm_row, doc_id, lang, trusted, symbols, perplexity for every row of dealt docs."""
    ids = docs.select("lm_block", "lm_row", F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("some"))
    trusted = kept(ids.join(trusted_ids(labels), "doc_id", "left_semi"), "trusted")
    # a row for each language and fold
    seen = {(r["lang"], r["fold"]) for r in trusted.where("some AND lang IS NOT NULL").select("lang", F.pmod("lm_block", F.lit(2)).alias("fold")).distinct().collect()}
    codes = {a: i for i, a in enumerate(sorted({a for a, _ in seen}))}
    if len(codes) >= 1 << LANG_BITS:
        raise ValueError("too many languages")
    result = "lm_block long, lm_row long, symbols long, perplexity double"
    if codes:
        shards = 4 * parts(docs.sparkSession)
        requests = kept(asked(docs, trusted, codes, shards), "requests")
        alone = frozenset(codes[a] * 2 + f for a, f in seen if (a, 1 - f) not in seen)
        p = probabilities(kept(wanted(requests, alone), "wanted"), levels(kept(counted(requests), "counts")))
        answers = answered(requests, p, alone, shards)
    else:
        answers = docs.sparkSession.createDataFrame([], "lm_block long, keys binary, p binary")

    def score(block: pa.Table, found: pa.Table) -> pa.Table:
        n = np.zeros(block.num_rows, dtype=np.int64)
        loss = np.full(block.num_rows, np.nan)
        key = np.concatenate([np.zeros(0, np.int64), *map(unpacked, found.column("keys").to_pylist())])
        p = np.frombuffer(b"".join(found.column("p").to_pylist()), "<f8")
        order = np.argsort(key)
        key, cost = key[order], -np.log(p[order])
        for i, t in enumerate(block.column("lm_text").to_pylist()):
            n[i] = len(t.encode("utf-8", "surrogatepass")) if t else 0
        for code, own, texts in _by_language(block, codes):
            for start, run in runs_of(texts):
                gram, text = grams(run)
                d = pa.array(gram).dictionary_encode()
                at = np.searchsorted(key, (code << (8 * ORDER)) | d.dictionary.to_numpy())
                sums = np.bincount(text, cost[at][d.indices.to_numpy()], minlength=len(run))
                loss[own[start : start + len(run)]] = sums / n[own[start : start + len(run)]]
        value = np.round(np.exp(loss), DIGITS)
        return pa.table({"lm_block": block.column("lm_block"), "lm_row": block.column("lm_row"), "symbols": n, "perplexity": pa.array(value, mask=np.isnan(value))})

    found = _light(docs).groupBy("lm_block").cogroup(answers.groupBy("lm_block")).applyInArrow(score, result)
    marked = trusted.select("lm_block", "lm_row", F.lit(True).alias("trusted"))
    both = found.join(ids.drop("some"), ["lm_block", "lm_row"]).join(marked, ["lm_block", "lm_row"], "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    return kept(both, "scores")


def length_class(symbols: F.Column) -> F.Column:
    return F.length(F.bin(symbols))


def quantiles(scored: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """by, threshold: the conformal quantile of the trusted perplexities. Equal values are counted before the sum, and there is a bounded number of different ones."""
    counts = scored.where("trusted AND perplexity IS NOT NULL").groupBy(*by, "perplexity").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(own.orderBy("perplexity"))).withColumn("k", F.ceil(F.lit(quantile) * (F.sum("n").over(own) + 1) - 1e-9))
    return ranked.where("upto >= k").groupBy(*by).agg(F.min("perplexity").alias("threshold"))


def decided(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """scores() with threshold and keep."""
    scored = scores(docs, labels).withColumn("size", length_class(F.col("symbols")))
    # a row for each language and length class: at most 2**LANG_BITS times 64
    close, wide = (F.broadcast(quantiles(scored, by, quantile)) for by in (["lang", "size"], ["lang"]))
    both = scored.join(close, ["lang", "size"], "left").join(wide.withColumnRenamed("threshold", "wide"), "lang", "left")
    limit = F.when(F.col("perplexity").isNotNull(), F.coalesce("threshold", "wide"))
    return both.withColumn("threshold", limit).withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, threshold, keep: one row per row of docs (doc_id, lang, text)."""
    own = dealt(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    return decided(own, labels, quantile).select("doc_id", "lang", F.col("symbols").alias("n_symbols"), "perplexity", "threshold", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs without the rejected ones."""
    own = dealt(docs)
    out = kept(decided(own, labels, quantile).where("NOT keep").select("lm_block", F.col("lm_row").alias("row")), "rejected")

    def drop(block: pa.Table, rows: pa.Table) -> pa.Table:
        stays = ~np.isin(block.column("lm_row").to_numpy(), rows.column("row").to_numpy())
        return block.filter(pa.array(stays)).select(names)

    names = docs.columns
    return own.groupBy("lm_block").cogroup(out.groupBy("lm_block")).applyInArrow(drop, StructType(list(docs.schema.fields)))
