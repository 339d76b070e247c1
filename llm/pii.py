"""Personal data by rules and a semi-Markov conditional random field (operator 2).

The base rules find e-mail addresses, IP addresses, card numbers and phone numbers. The field then
segments the places that hold digits or address signs: features of a whole span score every candidate
segment of at most MAX_PARTS parts for each kind, and dynamic programming over the bounded segments chooses
boundaries and kinds together. Spans of the field are added where no base span stands; base spans stay.

Cases: a null or empty text has no spans; repeated rows give repeated results; equal segmentations: the
one that leaves parts outside, then the shorter segment, then the kind listed first; other columns pass
through ``redact`` and are ignored by ``find``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, map_arrow

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
DIGIT, NOT_DIGIT = re.compile("[0-9]"), re.compile("[^0-9]")
MAX_PARTS = 6  # of a segment
PART = re.compile(r"\S+")
SIGN = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.IGNORECASE)
EDGE = ".,;:!?\"'<>[]{}|"
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """Whether what a base rule matched is kept."""
    if kind == "ip":
        return all(len(p := x.lstrip("0") or "0") <= 3 and int(p) <= 255 for x in text.split("."))
    if kind in ("card", "phone"):
        digits = NOT_DIGIT.sub("", text)
        return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    found = []
    digit = DIGIT.search(text)
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text or kind != "email" and not digit:
            continue
        if kind == "email":
            found += [(kind, a, b) for a, b in _addresses(text)]
        elif kind == "ip":
            found += [(kind, a, b) for a, b in _quads(text) if holds(kind, text[a:b])]
        else:
            found += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if holds(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


LOCAL, DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def _addresses(text: str) -> list[tuple[int, int]]:
    """The e-mail rule's matches, found from each @: linear also in long words without one."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, end := m.end()))
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)
    return out


NUMBERS, NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)*"), re.compile("[0-9]+")


def _quads(text: str) -> list[tuple[int, int]]:
    """The IP rule's matches: each run of numbers and dots gives its numbers in fours. Linear also in long runs of digits."""
    out = []
    for run in NUMBERS.finditer(text):
        if run[0].count(".") > 2:
            own = [m.span() for m in NUMBER.finditer(text, *run.span())]
            out += [(own[i][0], own[i + 3][1]) for i in range(0, len(own) - 3, 4)]
    return out


# --- the field ---


def regions(text: str) -> list[list[tuple[int, int]]]:
    """Runs of parts (their trimmed places) in which every segment lies: its first and last part hold a sign."""
    out: list[list[tuple[int, int]]] = []
    done = 0
    m = SIGN.search(text)
    while m:
        # the word of the sign, and on for as long as the next sign is within reach
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        own: list[tuple[int, int, bool]] = []
        for p in PART.finditer(text, start):
            signed = SIGN.search(p[0]) is not None
            own.append((p.start(), p.end(), signed))
            done = p.end()
            if not signed and not any(s for _, _, s in own[-(MAX_PARTS - 1) :]):
                break
        while own and not own[-1][2]:
            own.pop()
        if own:
            out.append([_trim(text, a, b) for a, b, _ in own])
        m = SIGN.search(text, done)
    return out


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while b - a > 1 and text[b - 1] in EDGE:
        b -= 1
    while b - a > 1 and text[a] in EDGE:
        a += 1
    return a, b


def span_features(text: str, a: int, b: int) -> list[str]:
    """Of the whole span, whatever its kind."""
    s = text[a:b]
    digits = NOT_DIGIT.sub("", s)
    letters = sum(c.isalpha() for c in s)
    numbers = [x for x in re.split("[^0-9]+", s) if x]
    before = text[max(0, a - 24) : a].lower().split()
    n = len(digits)
    return [
        "one",
        f"digits {n if n < 6 else 6 if n < 9 else 9 if n < 12 else 12 if n <= 15 else 16 if n <= 19 else 20}",
        f"letters {min(3, letters)} of {'all' if letters > n else 'some'}",
        f"signs {'@' in s or bool(re.search('[([]at[])]', s.lower()))} {min(4, s.count('.'))}",
        f"parts {len(s.split())}",
        f"groups {min(5, len(numbers))}",
        f"sum {n >= 12 and luhn(digits)} {n >= 12}",
        f"bytes {len(numbers) == 4 and all(len(x) < 4 and int(x) < 256 for x in numbers)} {letters > 0}",
        f"first {'+' if s[0] == '+' else '(' if s[0] == '(' else 'd' if s[0].isdigit() else 'a' if s[0].isalpha() else '.'}",
        f"last {'d' if s[-1].isdigit() else 'a' if s[-1].isalpha() else '.'}",
        f"marks {'-' in s} {'(' in s} {'=' in s or '/' in s or chr(34) in s}",
        f"before {before[-1][:12] if before else ''}",
    ]


class Field:
    """Weights by kind and feature. The score of a part outside all segments is 0."""

    def __init__(self, weights: dict[tuple[str, str], float] | None = None) -> None:
        self.weights = weights or {}

    def candidates(self, text: str, region: list[tuple[int, int]]) -> list[tuple[int, int, list[str]]]:
        """(first part, after the last part, features)."""
        signed = [SIGN.search(text, a, b) is not None or text[a] == "+" for a, b in region]
        return [(i, j, span_features(text, region[i][0], region[j - 1][1])) for i in range(len(region)) if signed[i] for j in range(i + 1, min(len(region), i + MAX_PARTS) + 1) if signed[j - 1]]

    def score(self, kind: str, features: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in features)

    def best(self, text: str, region: list[tuple[int, int]]) -> list[Span]:
        n = len(region)
        by_end: dict[int, list[tuple[int, str, float]]] = defaultdict(list)
        for i, j, f in self.candidates(text, region):
            for kind in KINDS:
                if (s := self.score(kind, f)) > 0:
                    by_end[j].append((i, kind, s))
        top, back = [0.0] * (n + 1), [None] * (n + 1)
        for j in range(1, n + 1):
            top[j] = top[j - 1]
            for i, kind, s in sorted(by_end[j], key=lambda x: -x[0]):
                if top[i] + s > top[j]:
                    top[j], back[j] = top[i] + s, (i, kind)
        out, j = [], n
        while j:
            if back[j]:
                i, kind = back[j]
                out.append((kind, region[i][0], region[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]


def train(texts: list[str], rounds: int = 12, rate: float = 0.3, most_regions: int = 1_500) -> Field:
    """Maximises the likelihood of the segmentations that the base rules give, by adaptive gradient steps.

    The rules' own regular expressions are no features, so that the field learns what such spans look like.
    """
    field = Field()
    cases = []
    for text in texts:
        labels = base_spans(text)
        for region in regions(text):
            cand = field.candidates(text, region)
            gold = {}
            for i, j, _ in cand:
                for kind, a, b in labels:
                    if (a, b) == (region[i][0], region[j - 1][1]):
                        gold[i, j] = kind
            inside = [s for s in labels if region[0][0] <= s[1] < region[-1][1]]
            if len(gold) == len({s[1] for s in inside}) and len(region) <= 60:
                cases.append((len(region), cand, gold))
        if len(cases) >= most_regions:
            break
    squares: dict[tuple[str, str], float] = defaultdict(lambda: 1e-6)
    w = field.weights
    for _ in range(rounds):
        for n, cand, gold in cases:
            scores = [(i, j, k, field.score(k, f), f) for i, j, f in cand for k in KINDS]
            alpha, beta = _sums(n, scores)
            steps: dict[tuple[str, str], float] = defaultdict(float)
            for i, j, k, s, f in scores:
                p = math.exp(min(0.0, alpha[i] + s + beta[j] - alpha[n]))
                g = (gold.get((i, j)) == k) - p
                if abs(g) > 1e-4:
                    for x in f:
                        steps[k, x] += g
            for key, g in steps.items():
                g -= 0.002 * w.get(key, 0.0)
                squares[key] += g * g
                w[key] = w.get(key, 0.0) + rate * g / math.sqrt(squares[key])
    field.weights = dict(w)
    return field


def _sums(n: int, scores: list[tuple]) -> tuple[list[float], list[float]]:
    """Log sums over all segmentations of the parts before and from each place."""
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    ends, starts = defaultdict(list), defaultdict(list)
    for i, j, _, s, _ in scores:
        ends[j].append((i, s))
        starts[i].append((j, s))
    for j in range(1, n + 1):
        alpha[j] = float(np.logaddexp.reduce([alpha[j - 1], *(alpha[i] + s for i, s in ends[j])]))
    for i in range(n - 1, -1, -1):
        beta[i] = float(np.logaddexp.reduce([beta[i + 1], *(beta[j] + s for j, s in starts[i])]))
    return alpha, beta


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with the field's: each by start, then kind as listed."""
    if not text or not SIGN.search(text):
        return [], []
    base = base_spans(text)
    covered: list[list[int]] = []  # the union of the base spans
    for _, a, b in base:
        if covered and a < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]

    def free(a: int, b: int) -> bool:
        at = bisect_left(starts, b) - 1
        return at < 0 or covered[at][1] <= a

    more = [s for region in regions(text) for s in field.best(text, region) if free(s[1], s[2])]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, sample_rows: int = 400, longest: int = 20_000) -> Field:
    """The field from a bounded sample: at most sample_rows texts with signs, of at most `longest` characters, by a hash of id and text."""
    some = bounded_sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), sample_rows, F.col("text").rlike("[0-9@]") & (F.length("text") <= longest), "doc_id", "text")
    return train([r["text"] for r in some.collect()])


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256, spans: one row per row of docs (doc_id, text)."""
    field = field or fit(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base, both = all_spans(text or "", field)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(both)))
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types[1:], strict=True))], names)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), each, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field | None = None, column: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in capitals within angle brackets; overlapping spans become one."""
    field = field or fit(docs)

    @F.pandas_udf("string")
    def clean(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda t: hide(t, all_spans(t, field)[1]) if t else t)

    return docs.withColumn(column, clean(F.col(column)))


def hide(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])
