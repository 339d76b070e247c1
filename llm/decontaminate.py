"""Benchmark decontamination by greedy string tiling (operator 8).

Benchmark items stand in a file that all tasks read in blocks of a bounded number of words. Documents and items join on
shared seeds (SEED words); where the seeds could cover enough of an item, greedy string tiling marks the
longest common runs that do not overlap, found by running Karp-Rabin hashes of falling length, until no run
of SEED words is left. An item is leaked where its tiles cover enough of it, in whatever order they stand.

Words are runs of Unicode letters, marks and digits in lower case, so punctuation and line breaks do not matter; in
scripts without spaces each character is a word. An item of fewer than SEED words is leaked where a document holds
all its words in a row.

Cases: null and empty texts, and items without words, are in no pair; ties between tiles: the one
that starts first in the item, then in the document; repeated rows of a document give repeated pairs, repeated
items of one id count once each text; an item with a null id is judged like others and named by null; other columns are ignored by ``leaks`` and kept by ``clean``; empty tables: nothing is leaked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from llm.common import map_arrow, read_shared, shared_file
from llm.words import _MARKS, U, blocks, in_sorted, runs, whole

SEED = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000  # of benchmark items sent at once
SIGNS = r"[^\p{L}\p{M}\p{N}]+"
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"


def plain(column: pa.Array) -> pa.Array:
    """Lower case; in texts beyond ASCII, blanks for signs and around the characters of scripts without spaces."""
    low = pc.utf8_lower(column)
    wide = pc.fill_null(pc.invert(pc.string_is_ascii(low)), False)
    if not pc.any(wide).as_py():
        return low
    split = pc.replace_substring_regex(pc.replace_substring_regex(low.filter(wide), SIGNS, " "), UNSPACED, r" \1 ")
    return pc.replace_with_mask(low, wide, split)


@dataclass
class Items:
    """A block of benchmark items: word hashes, and the seeds of each in order of their hashes."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray
    item: np.ndarray  # of each seed
    place: np.ndarray
    short: dict[int, dict[int, list[int]]]  # items of fewer than SEED words: by their number and the hash of their run


def index(rows: list[tuple[int | None, str | None]]) -> Items:
    ids, words, seeds, item, place = [], [], [], [], []
    short: dict[int, dict[int, list[int]]] = {}
    if rows:
        for row, end, w in blocks(plain(pa.array([t for _, t in rows], pa.string())), separators=_MARKS):
            for d in range(end - row):
                own = w.text(d)
                grams = runs(own, SEED)
                seeds.append(grams)
                item.append(np.full(len(grams), len(ids)))
                place.append(np.arange(len(grams)))
                if 0 < len(own) < SEED:
                    short.setdefault(len(own), {}).setdefault(int(runs(own, len(own))[0]), []).append(len(ids))
                ids.append(rows[row + d][0])
                words.append(own.copy())
    seeds = np.concatenate(seeds) if seeds else np.zeros(0, U)
    order = np.argsort(seeds, kind="stable")
    flat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int64))[order]
    return Items(ids, words, seeds[order], flat(item), flat(place), short)


def tiles(item: np.ndarray, text: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in item, place in text, length). The longest match that is left is always next."""
    free_i, free_t = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), 4 * least))
    while size >= least:
        found, longest = _matches(item, text, free_i, free_t, size)
        if longest > 2 * size:
            size = longest  # very long runs: start again from there
            continue
        queue = [(-n, i, t) for i, t, n in found]
        heapify(queue)
        while queue:
            n, i, t = heappop(queue)
            both = free_i[i : i - n] & free_t[t : t - n]
            if both.all():
                free_i[i : i - n] = free_t[t : t - n] = False
                out.append((i, t, -n))
                continue
            # what other tiles have left of it waits for its turn; parts shorter than size come with a smaller size
            edge = np.flatnonzero(np.diff(np.concatenate([[False], both, [False]]).astype(np.int8)))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= size:
                    heappush(queue, (a - b, i + a, t + a))
        size = size // 2 if size > 2 * least else least if size > least else 0
    return out


def _matches(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, size: int) -> tuple[list[tuple[int, int, int]], int]:
    """Unmarked common runs of at least size words, as long as they go, by Karp-Rabin hashes of size words."""
    if len(item) < size or len(text) < size:
        return [], 0
    held = lambda free: np.convolve(free, np.ones(size, dtype=np.int64), "valid") == size
    hi, ht = runs(item, size), runs(text, size)
    at_i, at_t = np.flatnonzero(held(free_i)), np.flatnonzero(held(free_t))
    at_t = at_t[np.isin(ht[at_t], hi[at_i])]
    by_hash: dict[int, list[int]] = {}
    for i in at_i.tolist():
        by_hash.setdefault(int(hi[i]), []).append(i)
    out, longest = [], 0
    for t in at_t.tolist():
        for i in by_hash.get(int(ht[t]), ()):
            if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of a run that starts before
            most = min(len(item) - i, len(text) - t)
            same = (item[i : i + most] == text[t : t + most]) & free_i[i : i + most] & free_t[t : t + most]
            n = most if same.all() else int(np.argmin(same))
            if n >= size:
                out.append((i, t, n))
                longest = max(longest, n)
    return out, longest


def found_in(column: pa.Array, items: Items, coverage: float) -> list[tuple[int, int, float, int]]:
    """(row, item id, coverage, number of tiles) of the leaked items of a batch."""
    out = []
    if not len(items.seeds) and not items.short:
        return out
    for row, _, w in blocks(plain(column), separators=_MARKS):
        for size, by_hash in items.short.items():
            gram = runs(w.hashes, size)
            text, ok = whole(w.first, len(w.hashes), size)
            hit = np.flatnonzero(ok & in_sorted(gram, np.array(sorted(by_hash), U)))
            pairs = {(int(text[i]), k) for i in hit.tolist() for k in by_hash[int(gram[i])] if (w.hashes[i : i + size] == items.words[k]).all()}
            out += [(row + d, items.ids[k], 1.0, 1) for d, k in sorted(pairs)]
        gram = runs(w.hashes, SEED)
        text, ok = whole(w.first, len(w.hashes), SEED)
        hit = np.flatnonzero(ok & in_sorted(gram, items.seeds))
        for d in np.unique(text[hit]).tolist():
            own = np.unique(gram[hit[text[hit] == d]])
            low, high = np.searchsorted(items.seeds, own), np.searchsorted(items.seeds, own, "right")
            at = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            which = items.item[at]
            for k in np.unique(which).tolist():
                n = len(items.words[k])
                cover = np.zeros(n, dtype=bool)
                cover[(items.place[at[which == k]][:, None] + np.arange(SEED)).ravel()] = True
                if cover.sum() < coverage * n:  # no tiling covers more than the seeds do
                    continue
                laid = tiles(items.words[k], w.text(d))
                share = sum(x[2] for x in laid) / n
                if share >= coverage:
                    out.append((row + d, items.ids[k], share, len(laid)))
    return out


_INDEXED: dict[str, list[Items]] = {}


def _item_file(benchmark: DataFrame) -> str:
    """The distinct items in the shared folder."""
    return shared_file(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct(), "items")


def _blocks_of(uri: str, words: int) -> Iterator[Items]:
    """Within a task: the items in blocks of about `words` words. A benchmark of one block is indexed once in a worker, a larger one is read block by block."""
    if uri in _INDEXED:
        yield from _INDEXED[uri]
        return
    order = lambda item: (item[0] is not None, item[0] or 0, item[1])  # noqa: E731  a null id is the smallest
    rows, size, blocks_ = [], 0, 0
    for batch in read_shared(uri, 1_024):
        for item in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows.append(item)
            size += len(item[1])
            if size > 6 * words:
                yield index(sorted(rows, key=order))
                rows, size, blocks_ = [], 0, blocks_ + 1
    last = index(sorted(rows, key=order))
    if not blocks_:
        _INDEXED.clear()
        _INDEXED[uri] = [last]
    yield last


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles for every document (doc_id, text) and benchmark item (item_id, text) that it leaks."""
    uri = _item_file(benchmark)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r for items in _blocks_of(uri, block_words) for r in found_in(batch.column("text"), items, coverage)]
        ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64())))], ["doc_id", "item_id", "coverage", "n_tiles"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), each, "doc_id long, item_id long, coverage double, n_tiles long")


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the documents that leak an item."""
    uri = _item_file(benchmark)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, dtype=bool)
        for items in _blocks_of(uri, block_words):
            keep[[r[0] for r in found_in(batch.column("text"), items, coverage)]] = False
        return batch.filter(pa.array(keep))

    return map_arrow(docs, each, StructType(list(docs.schema.fields)))
