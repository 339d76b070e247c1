"""Nulls in every column, empty tables, repeated rows and columns whose names clash with those that operators make."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from llm import decontaminate, html, lm, near, pii, repeats, secrets, tokenize, warc

TOKENIZER = "byte_bpe_multi_50k.tiktoken"
CLASH = ("pid", "node", "bands", "class_id", "root", "key", "hash", "n_words", "kept_sha256", "n_tokens", "spans", "score", "perplexity", "quality", "label", "item_id", "first", "n", "url_key", "captured_at", "elements")


def clashing(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASH if c not in df.columns))


@pytest.fixture(scope="module")
def docs(spark):
    long_ = "alpha beta gamma delta epsilon " * 3_000
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (2, "", "en", None, 0), (3, None, None, "a", None), (4, long_, "de", "b", len(long_)), (5, long_, "de", "b", len(long_)), (6, "mail a.b@c.de now", None, None, 17)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (4, 1, 0), (2, 0, 1), (None, None, None), (6, None, 1), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t")).withColumn("lang", F.lit("xx"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, None), (None, "alpha beta gamma delta epsilon " * 6), (2, ""), (2, "")], "item_id long, text string").withColumn("doc_id", F.lit(9)).withColumn("n", F.lit(1))


CALLS = {
    "near": lambda d, la, it: near.classes(d),
    "keep_one": lambda d, la, it: near.keep_one(d),
    "repeats": lambda d, la, it: repeats.remove_repeats(d),
    "pii": lambda d, la, it: pii.find(d),
    "redact": lambda d, la, it: pii.redact(d),
    "bpe": lambda d, la, it: tokenize.encode_decode(d, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN),
    "quality": lambda d, la, it: lm.classify(d, la),
    "keep_good": lambda d, la, it: lm.keep_good(d, la),
    "leaks": lambda d, la, it: decontaminate.leaks(d, it),
    "clean": lambda d, la, it: decontaminate.clean(d, it),
    "secrets": lambda d, la, it: secrets.scan(d, "source"),
}
#: One row for each row of the input.
WHOLE = ("near", "repeats", "pii", "redact", "bpe", "quality")


@pytest.mark.parametrize("name", CALLS)
def test_odd_rows(docs, labels, items, name):
    found = CALLS[name](docs, labels, items)
    rows = found.collect()
    if name in WHOLE:
        assert len(rows) == 8
    if name in ("keep_one", "redact", "keep_good", "clean"):
        assert found.columns == docs.columns


@pytest.mark.parametrize("name", CALLS)
def test_empty(docs, labels, items, name):
    assert CALLS[name](docs.limit(0), labels.limit(0), items.limit(0)).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "<p>x</p>"), (None, None, None), (2, "", ""), (2, "", "")], "page_id long, url string, html string")
    pages = pages.select("*", *(F.lit("x").alias(c) for c in ("text", "pid", "key", "first", "n_chars", "payload_digest", "position")))
    assert html.extract(pages).count() == warc.capture_histories(pages).count() == 4
    assert html.extract(pages.limit(0)).count() == warc.capture_histories(pages.limit(0)).count() == 0
