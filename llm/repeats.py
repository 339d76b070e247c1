"""Removal of repeated passages with sharded Aho-Corasick automata (operator 4).

The documents are written once in blocks of about BLOCK bytes, bucketed by block; every step groups by block, so texts are
not shuffled. Exact copies of a smaller document are set aside first; all their words are under repeated windows.

1. Confirm: every window of `window` words has an anchor, the smallest hash of its phrases of PHRASE words; neighbouring
   windows with the same anchor form a span. Anchors of several documents are counted with their spans. A span that an earlier document
   has too recurs whole. The first holders of different spans of one anchor compare these window by window.
2. Passages: the document that has a confirmed window first gives its words, neighbours joined to passages of at most PIECE windows.
3. Automata: each block gets the passages that its documents have from earlier ones and compiles them with pyahocorasick:
   the words around every anchor, so that each window holds one of these patterns whole.
4. Stream: every document of the block runs through the automata. Each occurrence is followed along the passage in both
   directions, word by word; what is equal over at least a window is removed if the passage is from a smaller document.
   Windows that repeat within their own document are found there.

Words are runs of other bytes than space and 9 to 13, unchanged. Hashes only choose what is compared; removed words are equal.

Cases: null and empty texts have no words; a text shorter than a window loses nothing; rows that share an
id count as one document with regard to each other, and a null id is smaller than all; overlapping windows
remove their union; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import id_key, in_blocks, kept
from llm.words import U, Words, blocks, in_sorted, mix, powers, runs, signed, whole

PHRASE = 5  # words of a phrase
BLOCK = 8 << 20  # bytes of text in a block
PIECE = 256  # windows of a passage at most; longer ones are cut, no window is
SHARD_WORDS = 500_000  # words of the passages in one automaton at most; more of them go to a second one


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by doubling."""
    return x[least_at(x, width)]


def least_at(x: np.ndarray, width: int) -> np.ndarray:
    """Where the first smallest of each `width` neighbours is, by doubling."""
    at = np.arange(len(x))
    size = 1
    while size < width and len(at):
        step = min(size, width - size)
        a, b = at[: max(0, len(at) - step)], at[step:]
        at = np.where(x[a] <= x[b], a, b)
        size += step
    return at


def window_hashes(w: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window's words: 64 bits and 32 more."""
    return runs(w.hashes, window), (runs(mix(w.hashes + U(1)), window) >> U(33)).astype(np.int32)


def span_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words from each start to each end."""
    p, q = powers(0, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum((hashes ^ (hashes >> U(7))) * p[: len(hashes)], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U))


def spans(w: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, number of windows, anchor, hash of the words) of each span of the words."""
    text, ok = whole(w.first, len(w.hashes), window)
    low = least_of(runs(w.hashes, PHRASE), window - PHRASE + 1)[: len(text)]
    at = np.flatnonzero(ok)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, U), np.zeros(0, U)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[at[1:]] != low[at[:-1]]) | (text[at[1:]] != text[at[:-1]])
    begin = np.flatnonzero(new)
    first, n = at[begin], np.diff(np.append(begin, len(at)))
    return text[first], first, n, low[first], span_hashes(w.hashes, first, first + n + window - 1)


def _own_words(block: pa.Table, marks: pa.Table) -> Iterator[tuple[np.ndarray, Words]]:
    """(pid of each text, words) for runs of the block's documents without copies (marks of kind 1)."""
    copies = marks.column("value").to_numpy()[marks.column("kind").to_numpy() == 1]
    own = block.filter(pa.array(~np.isin(block.column("row").to_numpy(), copies))).combine_chunks()
    if own.num_rows:
        pid = own.column("pid").to_numpy()
        for row, end, w in blocks(own.column("text").combine_chunks()):
            yield pid[row:end], w


def _values(marks: pa.Table, kind: int = 0) -> np.ndarray:
    return np.unique(marks.column("value").to_numpy()[marks.column("kind").to_numpy() == kind].astype(np.int64).view(U))


def _joined(parts: list[tuple], types: list) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate(types)]


def _number(block: pa.Table, marks: pa.Table) -> int:
    return (block if block.num_rows else marks).column("block")[0].as_py()


def _anchor_rows(window: int):  # noqa: ANN202
    def each(block: pa.Table, marks: pa.Table) -> pa.Table:
        out = []
        for pid, w in _own_words(block, marks):
            text, _, _, anchor, _ = spans(w, window)
            out.append((signed(anchor), pid[text]))
        anchor, pid = _joined(out, [np.int64, np.int64])
        order = np.lexsort((pid, anchor))
        anchor, pid = anchor[order], pid[order]
        new = np.ones(len(pid), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (pid[1:] != pid[:-1])
        return pa.table({"anchor": anchor[new], "pid": pid[new], "block": np.full(int(new.sum()), _number(block, marks))})

    return each, "anchor long, pid long, block long"


def _span_rows(window: int):  # noqa: ANN202
    """Spans of the anchors in marks: one row for each block, with the smallest and the largest document that has it."""

    def each(block: pa.Table, marks: pa.Table) -> pa.Table:
        wanted, out = _values(marks), []
        for pid, w in _own_words(block, marks):
            text, _, _, anchor, span = spans(w, window)
            hit = in_sorted(anchor, wanted)
            out.append((signed(anchor[hit]), signed(span[hit]), pid[text[hit]]))
        anchor, span, pid = _joined(out, [np.int64] * 3)
        order = np.lexsort((pid, span, anchor))
        anchor, span, pid = anchor[order], span[order], pid[order]
        new = np.ones(len(pid), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (span[1:] != span[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pid)) - 1 if len(pid) else first
        return pa.table({"anchor": anchor[first], "span": span[first], "low": pid[first], "high": pid[last], "block": np.full(len(first), _number(block, marks))})

    return each, "anchor long, span long, low long, high long, block long"


def _window_rows(window: int):  # noqa: ANN202
    """The windows of the spans in marks: one row for each block, with the smallest and the largest document that has it."""

    def each(block: pa.Table, marks: pa.Table) -> pa.Table:
        wanted, out = _values(marks), []
        for pid, w in _own_words(block, marks):
            text, first, n, _, span = spans(w, window)
            hit = in_sorted(span, wanted)
            text, first, n = text[hit], first[hit], n[hit]
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            one, two = window_hashes(w, window)
            out.append((signed(one[at]), two[at], pid[np.repeat(text, n)]))
        one, two, pid = _joined(out, [np.int64, np.int32, np.int64])
        order = np.lexsort((pid, two, one))
        one, two, pid = one[order], two[order], pid[order]
        new = np.ones(len(pid), dtype=bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(pid)) - 1 if len(pid) else first
        return pa.table({"one": one[first], "two": two[first], "low": pid[first], "high": pid[last], "block": np.full(len(first), _number(block, marks))})

    return each, "one long, two int, low long, high long, block long"


def _passage_rows(window: int):  # noqa: ANN202
    """The passages of the spans (kind 0) and windows (kind 2) in marks, each from the smallest document of the block."""

    def each(block: pa.Table, marks: pa.Table) -> pa.Table:
        wanted = np.union1d(_values(marks), _values(marks, 2))
        # by key: which document of the block gives it
        found = []
        for pid, w in _own_words(block, marks):
            text, first, n, _, span = spans(w, window)
            hit = in_sorted(span, wanted)
            found.append((span[hit], pid[text[hit]]))
            one = runs(w.hashes, window)
            text, ok = whole(w.first, len(w.hashes), window)
            hit = ok & in_sorted(one, wanted)
            found.append((one[hit], pid[text[hit]]))
        key, owner = _joined(found, [U, np.int64])
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        key, owner = key[new], owner[new]
        rows: dict[str, list] = {"passage": [], "pid": [], "words": [], "keys": []}
        number = _number(block, marks)
        for pid, w in _own_words(block, marks):
            text, first, n, _, span = spans(w, window)
            one = runs(w.hashes, window)
            each_text, ok = whole(w.first, len(w.hashes), window)
            at = np.flatnonzero(ok & in_sorted(one, key))
            # (first window, after the last window, key) of what this run of documents has to give
            hit = np.flatnonzero(in_sorted(span, key))
            start, stop = np.concatenate([first[hit], at]), np.concatenate([first[hit] + n[hit], at + 1])
            own, doc = np.concatenate([span[hit], one[at]]), np.concatenate([text[hit], each_text[at]])
            mine = owner[np.searchsorted(key, own)] == pid[doc] if len(own) else np.zeros(0, dtype=bool)
            order = np.lexsort((stop[mine], start[mine]))
            start, stop, own, doc = start[mine][order], stop[mine][order], own[mine][order], doc[mine][order]
            raw = w.data.tobytes()
            i = 0
            while i < len(start):
                j, end = i + 1, stop[i]
                while j < len(start) and start[j] <= end and doc[j] == doc[i]:
                    end = max(end, stop[j])
                    j += 1
                for a in range(int(start[i]), int(end), PIECE):
                    b = min(a + PIECE, int(end))
                    inside = np.flatnonzero((start[i:j] < b) & (stop[i:j] > a)) + i
                    rows["passage"].append(number * (1 << 24) + len(rows["passage"]))
                    rows["pid"].append(int(pid[doc[i]]))
                    rows["words"].append(b" ".join(raw[s:e] for s, e in zip(w.starts[a : b + window - 1].tolist(), w.ends[a : b + window - 1].tolist(), strict=True)))
                    rows["keys"].append(signed(np.unique(own[inside])).tolist())
                i = j
        types = {"passage": pa.int64(), "pid": pa.int64(), "words": pa.binary(), "keys": pa.list_(pa.int64())}
        return pa.table({"block": pa.array([number] * len(rows["pid"]), pa.int64()), **{c: pa.array(v, types[c]) for c, v in rows.items()}})

    return each, "block long, passage long, pid long, words binary, keys array<long>"


class Automaton:
    """The patterns of some passages; words are numbered, so a pattern is a short string of such numbers."""

    def __init__(self, pids: np.ndarray, passages: list[bytes], window: int) -> None:
        self.window, self.pids, self.passages = window, pids, passages
        self.split: dict[int, list[bytes]] = {}
        w = next(iter(blocks(pa.array(passages, pa.large_binary()), 1 << 62)))[2]
        self.first, self.hashes = w.first, w.hashes
        self.words, numbers = np.unique(w.hashes, return_inverse=True)
        self.machine = ahocorasick.Automaton()
        text, ok = whole(w.first, len(w.hashes), window)
        at = np.flatnonzero(ok)
        one, two = window_hashes(w, window)
        # of equal windows that of the smallest document stands for all
        order = np.lexsort((at, pids[text[at]], two[at], one[at]))
        at = at[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (one[at[1:]] != one[at[:-1]]) | (two[at[1:]] != two[at[:-1]])
        anchor = least_at(runs(w.hashes, PHRASE), window - PHRASE + 1)
        half = -(-(window - PHRASE) // 2)
        self.least = PHRASE + half  # words of a pattern
        inside = whole(w.first, len(w.hashes), 2)[1]
        self.pairs = np.unique(runs(w.hashes, 2)[inside])
        places: dict[str, list[tuple[int, int]]] = {}
        symbols = self.symbols(numbers)
        for p in np.unique(anchor[at[new]]).tolist():
            k = int(np.searchsorted(self.first, p, "right")) - 1
            for a, b in ((p, p + PHRASE + half), (p - half, p + PHRASE)):
                if a >= self.first[k] and b <= self.first[k + 1]:
                    places.setdefault(symbols[a:b], []).append((k, a - int(self.first[k])))
        for pattern, where in places.items():
            self.machine.add_word(pattern, (len(pattern), sorted(set(where))))
        self.machine.make_automaton()

    @staticmethod
    def symbols(numbers: np.ndarray) -> str:
        # surrogates are no characters of their own in UTF-32
        n = numbers.astype(np.uint32) + 2
        return np.where(n >= 0xD800, n + 0x800, n).astype("<u4").tobytes().decode("utf-32-le")

    def same(self, k: int, at: int, words: list[bytes]) -> bool:
        """Whether passage k has these words from its word `at` on."""
        if k not in self.split:
            self.split[k] = self.passages[k].split(b" ")
        return self.split[k][at : at + len(words)] == words

    def occurrences(self, hashes: np.ndarray, pid: int, words: Callable[[int, int], list[bytes]], late: bytearray) -> None:
        """Marks in late every window that a smaller document's passage has too; words gives a text's words from one place to another."""
        if not len(self.words) or len(hashes) < self.window:
            return
        done: set[tuple[int, int]] = set()
        # no pattern lies across two neighbours that no passage has side by side
        edge = np.flatnonzero(np.diff(np.concatenate([[False], in_sorted(runs(hashes, 2), self.pairs), [False]]).astype(np.int8)))
        for start, stop in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
            if stop - start >= self.least:
                self._stretch(hashes, start, stop, pid, words, late, done)

    def _stretch(self, hashes: np.ndarray, start: int, stop: int, pid: int, words: Callable[[int, int], list[bytes]], late: bytearray, done: set[tuple[int, int]]) -> None:
        reach = self.window
        text = self.symbols(np.searchsorted(self.words, hashes[start:stop]))
        for end, (size, where) in self.machine.iter(text):
            end += start
            # all windows around the pattern are known
            if late.find(0, max(0, end + 1 - reach), min(len(late), end + 2 - size)) < 0:
                continue
            for k, offset in where:
                if self.pids[k] >= pid:
                    continue
                shift = end + 1 - size - offset  # of the passage against the text
                if (k, shift) in done:
                    continue
                done.add((k, shift))
                a = max(0, shift)
                own = self.hashes[self.first[k] + a - shift : self.first[k + 1]]
                own = own[: len(hashes) - a]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own == hashes[a : a + len(own)], [False]]).astype(np.int8)))
                for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if e - s >= reach and self.same(k, a + s - shift, words(a + s, a + e)):
                        n = e - s - reach + 1
                        late[a + s : a + s + n] = b"\1" * n


def words(raw: bytes, w: Words, a: int, b: int) -> list[bytes]:
    return [raw[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]


def _again(w: Words, window: int) -> np.ndarray:
    """Windows that start earlier in the same text."""
    text, ok = whole(w.first, len(w.hashes), window)
    at = np.flatnonzero(ok)
    one, two = (x[at] for x in window_hashes(w, window))
    order = np.lexsort((at, two, one, text[at]))
    one, two, doc = one[order], two[order], text[at][order]
    same = np.zeros(len(at), dtype=bool)
    same[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1]) & (doc[1:] == doc[:-1])
    return at[order[same]]


NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")
TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())


def _final_rows(window: int, keep_text: bool):  # noqa: ANN202
    names = NAMES[: 5 if keep_text else 4]

    def each(block: pa.Table, given: pa.Table) -> pa.Table:
        kind = given.column("kind").to_numpy()
        copies = given.column("value").to_numpy()[kind == 1]
        given = given.filter(pa.array(kind == 0))
        machines, start, n = [], 0, 0
        pids, passages = given.column("pid").to_numpy(), given.column("words").to_pylist()
        for i, p in enumerate(passages):
            n += p.count(b" ") + 1
            if n >= SHARD_WORDS or i == len(passages) - 1:
                machines.append(Automaton(pids[start : i + 1], passages[start : i + 1], window))
                start, n = i + 1, 0
        rows: list[tuple] = []
        pid = block.column("pid").to_numpy()
        copy = np.isin(block.column("row").to_numpy(), copies)
        if not block.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, TYPES, strict=False)})
        for row, end, w in blocks(block.column("text").combine_chunks()):
            gone = np.zeros(len(w.hashes) + 1, dtype=np.int64)
            again = _again(w, window)
            np.add.at(gone, again, 1)
            np.add.at(gone, again + window, -1)
            raw = w.data.tobytes()
            for d in range(end - row):
                a, b = int(w.first[d]), int(w.first[d + 1])
                if copy[row + d] and b - a >= window:
                    gone[a] += 1
                    gone[b] -= 1
                elif b - a >= window:
                    late = bytearray(b - a - window + 1)
                    for m in machines:
                        m.occurrences(w.hashes[a:b], int(pid[row + d]), lambda i, j: words(raw, w, a + i, a + j), late)  # noqa: B023
                    at = np.flatnonzero(np.frombuffer(late, np.uint8)) + a
                    gone[at] += 1
                    np.add.at(gone, at + window, -1)
            lost = np.cumsum(gone)[:-1] > 0
            for d in range(end - row):
                a, b = int(w.first[d]), int(w.first[d + 1])
                left = np.flatnonzero(~lost[a:b]) + a
                text = b" ".join([raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])
                own = int(pid[row + d])
                rows.append((None if own == -(2**63) else own, b - a, int(lost[a:b].sum()), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if keep_text else None))
        return pa.table({c: pa.array(v, t) for c, v, t in zip(names, zip(*rows, strict=True), TYPES, strict=False)})

    return each, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")


def remove_repeats(docs: DataFrame, window: int = 20, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept]: one row per row of docs (doc_id, text)."""
    if window < PHRASE:
        raise ValueError(f"a window has at least {PHRASE} words")
    base = docs.select(id_key().alias("pid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole_docs = in_blocks(base, "text", BLOCK, "block", "row")
    keyed = whole_docs.select("block", "row", "pid", F.unhex(F.sha2("text", 256)).alias("key"))
    first = keyed.groupBy("key").agg(F.min("pid").alias("least"), F.max("pid").alias("most")).where("least < most")
    copies = kept(keyed.join(first, "key").where("pid > least").select("block", F.lit(1).alias("kind"), F.col("row").alias("value")), "copies")

    def by_block(task: tuple, marks: DataFrame) -> DataFrame:
        """The task on every block with its marks (block, kind, value) and copies."""
        return whole_docs.groupBy("block").cogroup(marks.unionByName(copies, allowMissingColumns=True).groupBy("block")).applyInArrow(*task)

    mark = lambda column, kind=0: (F.lit(kind).alias("kind"), F.col(column).alias("value"))
    found = kept(by_block(_anchor_rows(window), copies.limit(0)), "anchors")
    shared = found.groupBy("anchor").agg(F.min("pid").alias("a"), F.max("pid").alias("b")).where("a < b").select("anchor")
    span = kept(by_block(_span_rows(window), found.join(shared, "anchor").select("block", *mark("anchor")).distinct()), "spans")

    # the first holder of each span, and what is to be compared window by window
    holder = span.groupBy("anchor", "span").agg(F.min(F.struct("low", "block")).alias("source"), F.max("high").alias("last"))
    mixed = holder.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    windows = kept(by_block(_window_rows(window), holder.join(mixed, "anchor").select(F.col("source.block").alias("block"), *mark("span")).distinct()), "windows")
    late = span.join(holder.where("source.low < last"), ["anchor", "span"]).where("high > source.low").select(F.col("source.block").alias("of"), *mark("span"), "block")
    again = windows.groupBy("one", "two").agg(F.min(F.struct("low", "block")).alias("source"), F.max("high").alias("last")).where("source.low < last")
    late_windows = windows.join(again, ["one", "two"]).where("high > source.low").select(F.col("source.block").alias("of"), *mark("one", 2), "block")
    asked = kept(late.unionByName(late_windows).distinct(), "asked")

    passages = kept(by_block(_passage_rows(window), asked.select(F.col("of").alias("block"), "kind", "value").distinct()), "passages")
    of = passages.select(F.col("block").alias("of"), "passage", F.explode("keys").alias("value"))
    to = asked.join(of, ["of", "value"]).select("block", "passage").distinct()
    given = to.join(passages.select("passage", "pid", "words"), "passage").select("block", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("value"), "pid", "words")
    return by_block(_final_rows(window, keep_text), given)
