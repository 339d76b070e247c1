"""The pipeline and the queries without SQL against plain versions over the whole smallest tables."""

import base64
import hashlib
import itertools
import math
import os
import random

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from llm import decontaminate, pii, queries
from llm.words import _MARKS, blocks, runs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def words_of(text):
    return next(iter(blocks(decontaminate.plain(pa.array([text])), separators=_MARKS)))[2].hashes


def leaked(texts):
    """(document, item, coverage, tiles) of every pair, tiled without any join."""
    items = [(r["item_id"], words_of(r["text"])) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"]]
    out = set()
    for d, text in texts.items():
        own = words_of(text or "")
        seeds = set(runs(own, decontaminate.SEED).tolist())
        for i, item in items:
            if seeds.intersection(runs(item, decontaminate.SEED).tolist()):
                laid = decontaminate.tiles(item, own)
                share = sum(t[2] for t in laid) / len(item)
                if share >= decontaminate.COVERAGE:
                    out.add((d, i, share, len(laid)))
    return out


def encoder():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.TOKENIZER), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenised(enc, text):
    ids = np.array(enc.encode_ordinary(text), dtype="<u4")
    return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_leaks_of_all_pairs(spark, rows):
    got = {(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in queries.op8_leaks(spark, SF).collect()}
    assert got == leaked({r["doc_id"]: r["text"] for r in rows})


def test_tokens_of_all_documents(spark, rows):
    enc = encoder()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_bpe(spark, SF).collect()}
    assert got == {r["doc_id"]: tokenised(enc, r["text"] or "") for r in rows}


def test_base_spans_of_all_documents(spark, rows):
    want = {}
    for r in rows:
        own = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in pii.BASE[kind].finditer(r["text"] or "") if pii.holds(kind, m[0]))
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in own)
        want[r["doc_id"]] = (*(sum(k == i for _, k, _ in own) for i in range(4)), hashlib.sha256(text.encode()).hexdigest())
    found = queries.op2_pii(spark, SF).collect()
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found} == want


def test_field_chooses_the_best_segmentation():
    rng = random.Random(4)
    text = "call 555 0101 9 at a1@b.cd or +49 30 1234567 now 10.0.0.1 end"
    for _ in range(40):
        names = {f for region in pii.regions(text) for _, _, fs in pii.Field().candidates(text, region) for f in fs}
        field = pii.Field({(k, f): rng.uniform(-1, 1) for k in pii.KINDS for f in sorted(names)})
        for region in pii.regions(text):
            cand = [(i, j, k, field.score(k, f)) for i, j, f in field.candidates(text, region) for k in pii.KINDS]
            best = max((sum(s for *_, s in some) for n in range(4) for some in itertools.combinations([c for c in cand if c[3] > 0], n) if all(a[1] <= b[0] or b[1] <= a[0] for a, b in itertools.combinations(some, 2))), default=0.0)
            at = {a: i for i, (a, _) in enumerate(region)}
            ends = {b: j + 1 for j, (_, b) in enumerate(region)}
            score = {(i, j, k): s for i, j, k, s in cand}
            chosen = sum(score[at[a], ends[b], k] for k, a, b in field.best(text, region))
            assert chosen >= best - 1e-9


def test_pipeline_against_plain_stages(spark, rows):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    sql = con.sql(queries.duckdb_sql()["op10_quality"])
    good = {r[list(sql.columns).index("doc_id")] for r in sql.fetchall() if r[list(sql.columns).index("keep")]}
    texts = {r["doc_id"]: r["text"] for r in rows if r["doc_id"] in good}
    # one document of each class of similar ones
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x])}
    root = {d: d for d in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    texts = {d: t for d, t in texts.items() if root[d] == d}
    bad = {d for d, *_ in leaked(texts)}
    texts = {d: t for d, t in texts.items() if d not in bad}
    # the stage fits its field on what it gets
    docs = spark.createDataFrame([(d, t) for d, t in sorted(texts.items())], "doc_id long, text string")
    field = pii.fit(docs)
    enc = encoder()
    want = {d: tokenised(enc, pii.hide(t, pii.all_spans(t, field)[1]) if t else "") for d, t in texts.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_pipeline_with_odd_rows(spark, tmp_path):
    docs = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, None, None, None, None), (2, "", "en", None, 0), (3, "mail a.b@c.de now", "de", "b", 17), (4, "x " * 40_000, "de", "b", 80_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).withColumn("pid", F.lit("x")).withColumn("lm_keep", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "alpha beta gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in found) == [(False, 0), (True, 1), (True, 2), (True, 3), (True, 4)]
    for stage in corpus_pipeline.STAGES[:-1]:
        kept = stage[1](spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
        assert kept.columns == [*(c.split()[0] for c in schema.split(", ")), "pid", "lm_keep"]
    assert math.isfinite(len(found))
