"""Secret scan with a random forest against false positives (operator 3).

Candidates are runs of key characters with a digit or a capital within, runs that begin as an issuer's keys do, private key blocks, and
whatever is assigned to a key word, of any length and characters. Spark ML's random forest scores each from its length,
the transitions between its characters, the share that dictionary words cover, the document's path and
the words and signs beside it; it alone decides. It is trained on labelled findings: candidates whose place tells what they are
(see ``label``). The signs by which they are labelled are no features. Every finding is learnt twice, once
without what stands beside it, so that the forest does not lean on the usual surroundings.

Cases: null and empty texts have no candidates; repeated rows give repeated findings; a null path is an empty
one; without findings of both kinds to learn from, the labels themselves decide; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import bounded_sample, kept, map_arrow

CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{8,}={0,2}")
INNER = re.compile("[0-9]|[a-z][A-Z]|=$")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.DOTALL)
#: Words that stand before a secret, and the beginnings that issuers give their keys.
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential")
ISSUED = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-|sk_live_|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10}|-----BEGIN ")
BEFORE = re.compile(r"([A-Za-z_]+)[\"']?\s*[=:]\s*[\"']?$")
#: What is assigned to a name with a key word: in quotes, or up to a blank or bracket.
ASSIGNED = re.compile(r"""(?i)(?<![A-Za-z_])[A-Za-z_]*(?:%s)[A-Za-z_]*["']?\s*[=:]\s*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;<>(){}\[\]]+))""" % "|".join(KEY_WORDS))
HINT = re.compile("(?i)[0-9]|[=:]|xox|sk_live_|gh[pousr]_|AKIA|ASIA|AIza|eyJ|-----BEGIN |(?-i:[a-z][A-Z])")
WORD = re.compile(r"[^\W\d_]{3,}")
SAMPLE_DOCS, SAMPLE_LONGEST = 4_000, 20_000  # texts from which findings are labelled, and their characters at most
DICTIONARY = 5_000  # words
#: What a candidate is, and what stands beside it.
OWN = ("length", "entropy", "letter to digit", "digit to letter", "case changes", "hex share", "upper share", "digit share", "sign share", "padded", "dictionary")
BESIDE = ("assigned", "quoted", "path config", "path length", "known before", "known after", "length before", "length after")
FEATURES = OWN + BESIDE


def transitions(s: str) -> list[float]:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s" for c in s]
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    n = max(1, len(s) - 1)
    return [(pairs["l", "d"] + pairs["u", "d"]) / n, (pairs["d", "l"] + pairs["d", "u"]) / n, (pairs["l", "u"] + pairs["u", "l"]) / n]


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def covered(s: str, words: frozenset[str]) -> float:
    """Share of s under dictionary words, the longest first."""
    low, i, n = s.lower(), 0, 0
    while i < len(low):
        for k in range(min(12, len(low) - i), 2, -1):
            if low[i : i + k] in words:
                n += k
                i += k
                break
        else:
            i += 1
    return n / max(1, len(s))


def features(text: str, a: int, b: int, path: str, words: frozenset[str]) -> list[float]:
    s = text[a:b]
    before, after = text[max(0, a - 40) : a], text[b : b + 24]
    share = lambda f: sum(map(f, s)) / len(s)
    # a key word is a sign of the label: the word before it stands in its place
    left = [x for x in WORD.findall(before) if not any(k in x.lower() for k in KEY_WORDS)]
    right = WORD.findall(after)
    return [
        float(len(s)), entropy(s), *transitions(s), share(lambda c: c in "0123456789abcdef"), share(str.isupper), share(str.isdigit), share(lambda c: not c.isalnum()), float(s.endswith("=")), covered(s[:512], words),
        float(bool(BEFORE.search(before))), float(before[-1:] in ("'", '"')), float(bool(re.search(r"env|conf|secret|cred|yaml|ini", path.lower()))), float(len(path)),
        float(bool(left) and left[-1].lower() in words), float(bool(right) and right[0].lower() in words), float(len(left[-1]) if left else 0), float(len(right[0]) if right else 0),
    ]


def label(text: str, a: int, b: int) -> int:
    """1 secret: as an issuer writes it, or assigned to a key word by = or in quotes. 0 none: part of an address, of a dotted name, or a card number. -1 unknown."""
    s = text[a:b]
    before, after = text[max(0, a - 40) : a], text[b : b + 1]
    m = BEFORE.search(before)
    named = bool(m) and any(k in m[1].lower() for k in KEY_WORDS)
    if ISSUED.match(s) or named and (before[-1:] in ("'", '"') or "=" in m[0]):
        return 1
    if not named and ("@" in (before[-1:], after) or "." in (before[-1:], after) and not before.endswith(". ") or s.isdigit() and 12 <= len(s) <= 19 and luhn(s)):
        return 0
    return -1


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def places(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidates of a text; of two that overlap, a key block, then an assigned value, else the first one."""
    out = [m.span() for m in BLOCK.finditer(text)] if "-----BEGIN " in text else []
    for more in (
        [m.span(next(i for i in (1, 2, 3) if m[i] is not None)) for m in ASSIGNED.finditer(text)],
        [m.span() for m in CANDIDATE.finditer(text) if INNER.search(m[0]) or ISSUED.match(m[0])],
    ):
        at, free = 0, []
        for a, b in sorted(set(more)):
            while at < len(out) and out[at][1] <= a:
                at += 1
            if (at == len(out) or out[at][0] >= b) and (not free or free[-1][1] <= a):
                free.append((a, b))
        out = sorted(out + free)
    return out


def candidates(docs: DataFrame, words: frozenset[str]) -> DataFrame:
    """doc_id, start, end, sha256 of the candidate, features, label (doc_id, text, path)."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, text, path in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path")), strict=True):
            if not text or not HINT.search(text):
                continue
            for a, b in places(text):
                f = features(text, a, b, path or "", words)
                rows.append((doc, a, b, hashlib.sha256(text[a:b].encode("utf-8", "surrogatepass")).hexdigest(), f, label(text, a, b)))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "start", "end", "sha256", "features", "label"])

    return map_arrow(docs, each, "doc_id long, start long, end long, sha256 string, features array<double>, label int")


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> frozenset[str]:
    """The most frequent words of all texts; only their number is bounded."""
    word = docs.select(F.explode(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}{3,12})', 1)")).alias("w"))
    return frozenset(r["w"] for r in word.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect())


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> tuple[frozenset[str], RandomForestClassificationModel | None]:
    """Dictionary, and a forest from at most sample_docs texts (of at most SAMPLE_LONGEST characters) with digits or assignments, by a hash; the dictionary from all."""
    wanted = F.col("text").rlike(HINT.pattern) & (F.length("text") <= SAMPLE_LONGEST)
    some = bounded_sample(docs.select("doc_id", "text", "path"), sample_docs, wanted, "doc_id", "text")
    words = dictionary(docs)
    found = candidates(some, words).where("label >= 0")
    twice = F.explode(F.array(F.col("features"), F.transform("features", lambda x, i: F.when(i < len(OWN), x).otherwise(F.lit(0.0)))))
    rows = kept(found.select(twice.alias("f"), F.col("label").cast("double").alias("label")).select(array_to_vector("f").alias("x"), "label"), "findings")
    if rows.select("label").distinct().count() < 2:
        return words, None
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=24, maxDepth=8, maxBins=32, featureSubsetStrategy="sqrt", seed=7)
    return words, forest.fit(rows)


def scan(docs: DataFrame, path: str | None = None, threshold: float = 0.5, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, start, end, sha256, score for every finding that the forest keeps, in docs (doc_id, text, and the column of the path)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(path).cast("string") if path else F.lit("")).alias("path"))
    words, forest = fit(base, sample_docs)
    found = candidates(base, words)
    if forest is None:
        return found.where("label = 1").select("doc_id", "start", "end", "sha256", F.lit(1.0).alias("score"))
    scored = forest.transform(found.withColumn("x", array_to_vector("features")).drop("label"))
    return scored.select("doc_id", "start", "end", "sha256", vector_to_array("probability")[1].alias("score")).where(F.col("score") >= threshold)
