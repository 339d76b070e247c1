"""The operators against brute force on small fixtures, with nulls, empty and long texts, ties and empty tables."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from llm import decontaminate, graph, html, lm, near, pii, repeats, secrets, tokenize, vectors, warc
from llm.words import U

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(40)] + ["é", "ß,", "a.b"]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = some(60), some(120)
    out = [None, "", " \t\n", "one", some(19), base, base, base.replace("w1 ", "zz "), some(30) + "\n" + passage, passage + " " + some(25), some(10) + " " + passage + " " + passage, "x y z w v " * 40]
    for k in range(5):
        w = base.split()
        w[10 + 20 * k] = "edit%d" % k
        out.append(" ".join(w))
    return out + [some(9_000)]


def test_repeats(spark, texts):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if (x := tuple(w[k : k + 20])) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(x)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(a for a, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == want
    assert repeats.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_near(spark, texts):
    sets, root = {}, {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        root[i] = i
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id: r.class_id for r in near.classes(docs_of(spark, texts)).collect()} == root
    kept = near.keep_one(docs_of(spark, texts), 0.8)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    element = rng.integers(1, 1 << 62, 300).astype(U)
    x, y = rng.integers(1, 5, 300).astype(float), rng.integers(1, 5, 300) * 0.75
    sign = near.darts(np.repeat([0, 1], 300), np.concatenate([element, element]), np.concatenate([x, y]), 2, 2048)
    assert abs((sign[0] == sign[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.05


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (40, 60)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 21)} | {50: 40, 60: 40}


def test_bpe_chunks(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*texts, "  \n\n x  " * 900 + "日本語 " * 2_000 + "🙂" * 3_000, "a" * 5_000]
    got = tokenize.encode_decode(docs_of(spark, texts), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, chunk=1_000, overlap=200)
    rows = {r.doc_id: r for r in got.collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == enc.encode_ordinary(t or "") and bytes(rows[i].decoded).decode() == (t or "")


def test_pii_base_and_field(spark):
    text = "Mail a.b+c@x.example.com, call +1 (988) 555-2485 or 10.0.0.256; 4111 1111 1111 1111. ip 1.2.3.4 x@y"
    want = sorted((m.start(), pii.KINDS.index(k), m.end()) for k in pii.KINDS for m in pii.BASE[k].finditer(text) if pii.holds(k, m[0]))
    assert [(a, pii.KINDS.index(k), b) for k, a, b in pii.base_spans(text)] == want and [k for k, _, _ in pii.base_spans(text)] == ["email", "phone", "card", "ip"]
    field = pii.train([text, f"and {text}", "token 0cab398dc11d1a2a of 2024-01-02"] * 6)
    assert ("phone", 5, 21) in pii.all_spans("call 1 (988) 555-2485 now", field)[1] or pii.all_spans(text, field)[0] == pii.base_spans(text)
    got = pii.find(docs_of(spark, [text, None, ""]), field).orderBy("doc_id").collect()
    assert [r.n_email for r in got] == [1, 0, 0] and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "example.com" not in pii.redact(docs_of(spark, [text]), field).first().text


def test_html(spark):
    page = '<html><head><title>T</title><script>if(a<b){"</p>"}</script></head><body><nav><a href="/">Menu</a></nav><div class="ad">Buy this now</div><article><h1>Head &amp; more</h1><p><b>One</b>\n two&nbsp;three<p>Four<aside>side</aside></p><div class="comments"><p>reader says</p></div></article><footer>&copy; me</footer></body></html>'
    w = html.fit([page] * 3)
    assert html.main_text(page, w) == "Head & more\nOne two three\nFour"
    assert html.best_run([-1, 2, -1, 2, -5, 3]) == (1, 4) and html.best_run([-1.0]) == (0, 0)
    got = html.extract(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", "")], "page_id long, url string, html string"), w).orderBy("page_id").collect()
    assert [r.n_chars for r in got] == [30, 0, 0]


def test_warc(spark):
    assert list(warc.loser_tree([[1, 4, 9], [], [2, 2, 8], [3]])) == [1, 2, 2, 3, 4, 8, 9]
    rows = [(i, f"http://h{i % 3}.example.org/{i % 2}", "same" if i % 2 else f"p{i}") for i in range(9)] + [(20, None, None), (21, "x", "")]
    got = warc.capture_histories(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {(i, "response" if i in (1, 20) or i % 2 == 0 else "revisit", None if i in (1, 20) or i % 2 == 0 else 20 if i == 21 else 1) for i, _, _ in rows}
    assert [(r.url_key, r.page_id) for r in got] == sorted((r.url_key, r.page_id) for r in got)


def test_vectors(spark):
    rng = np.random.default_rng(2)
    vecs = [rng.integers(-50, 50, 6).astype(float).tolist() for _ in range(120)] + [[1.0] * 6] * 20
    df = spark.createDataFrame([*enumerate(vecs), (900, None), (901, [float("nan")] * 6), (902, [])], "id long, vec array<double>")
    want = {}
    for q in range(0, 140, 10):
        best = sorted((-float(np.dot(vecs[q], v)), i) for i, v in enumerate(vecs) if i != q)[:5]
        want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    got = vectors.top_k(df, df.where("id % 10 = 0"), 5)
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got.collect()} == want


def test_tiling(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    moved = "so Eta, theta iota kappa lambda mu. then alpha beta gamma delta epsilon zeta end"
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None)], "item_id long, text string")
    docs = docs_of(spark, [moved, "alpha beta gamma delta epsilon only", None, ""])
    assert [(r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in decontaminate.leaks(docs, bench).collect()] == [(0, 7, 1.0, 2)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [1, 2, 3]
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_language_model(spark):
    good = ["the cat sat on the mat and the dog ran to the cat " * 3] * 60
    docs = docs_of(spark, [*good, "&&& %%% ### $$$ ||| *** " * 20, None, ""])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    # all symbols after a context: their probabilities have the sum 1
    contexts = [b"the ", b"zzzz", b"\0\0\0\0"]
    every = spark.createDataFrame([(int.from_bytes(x + bytes([i])),) for x in contexts for i in range(256)], "gram long")
    p = {r.gram: r.p for r in lm.probabilities(every, lm.fit(docs.where("doc_id < 60"))).collect()}
    for x in contexts:
        assert abs(sum(p[int.from_bytes(x + bytes([i]))] for i in range(256)) - 1) < 1e-9
    assert p[int.from_bytes(b"the c")] > 0.3
    keep = {r.doc_id: r.keep for r in lm.classify(docs, labels).collect()}
    assert all(keep[i] for i in range(60)) and not keep[60] and keep[61] and keep[62]
    assert lm.classify(docs, labels.limit(0)).where("not keep").count() == 0


def test_secrets(spark):
    rng = random.Random(5)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    docs = docs_of(spark, [f'set token = "{key()}" there' for _ in range(30)] + [f"mail person{i}number@mail.example.com 4111111111111{i:03d}" for i in range(30)] + [None, ""])
    found = {r.doc_id for r in secrets.scan(docs, "source").collect()}
    assert found == set(range(30))
