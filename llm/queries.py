"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import decontaminate, html, lm, near, pii, repeats, secrets, tokenize, vectors, warc
from llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), "source")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 20)


def op5_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"), 0.8)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(vectors.finite("embedding"))
    vecs = rows.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("vec"))
    return vectors.top_k(vecs, vecs.where("id % 50 = 0"), 5, whole_numbers=True)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.capture_histories(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _language_model_sql() -> str:
    """Counts, discounts, probabilities and thresholds of operator 10 in SQL; grams are hexadecimal strings of lm.ORDER bytes."""
    n = lm.ORDER
    steps = [f"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, (((doc_id % 2147483648) * 2654435761) >> 16) & 1 AS fold FROM documents),
        good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND coalesce(max(toxic), 0) <> 1),
        has AS (SELECT DISTINCT lang, fold FROM d WHERE doc_id IN (SELECT doc_id FROM good) AND text <> '' AND lang IS NOT NULL),
        x AS (SELECT doc_id, d.lang, d.fold, CASE WHEN o.lang IS NULL THEN d.fold ELSE 1 - d.fold END AS model, regexp_extract_all(hex(encode(text)), '..') AS b
              FROM d LEFT JOIN has o ON o.lang = d.lang AND o.fold = 1 - d.fold WHERE text <> '' AND d.lang IN (SELECT lang FROM has)),
        y AS (SELECT doc_id, lang, fold, model, unnest(b) AS b, unnest(range(len(b))) AS i FROM x),
        g AS (SELECT doc_id, lang, fold, model, {' || '.join([f"lag(b, {i}, '00') OVER w" for i in range(n - 1, 0, -1)] + ['b'])} AS gram FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        c{n} AS (SELECT lang, fold, gram, count(*)::DOUBLE AS n FROM g WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY ALL)"""]
    for k in range(n, 0, -1):
        if k < n:
            steps.append(f"c{k} AS (SELECT lang, fold, substr(gram, 3) AS gram, count(*)::DOUBLE AS n FROM c{k + 1} GROUP BY ALL)")
        cut = lambda i: f"CASE WHEN m{i} > 0 THEN least({i - 0.01}, greatest(0.01, {i} - {i + 1} * (m1 / (m1 + 2 * m2)) * m{i + 1} / m{i})) ELSE 0.9 END AS d{i}"
        steps.append(f"m{k} AS (SELECT lang, fold, {', '.join(f'count(*) FILTER (WHERE n = {i})::DOUBLE AS m{i}' for i in (1, 2, 3, 4))} FROM c{k} GROUP BY ALL)")
        steps.append(f"d{k} AS (SELECT lang, fold, {cut(1)}, {cut(2)}, {cut(3)} FROM m{k})")
        steps.append(f"w{k} AS (SELECT lang, fold, gram, n, left(gram, {2 * k - 2}) AS context, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS cut FROM c{k} JOIN d{k} USING (lang, fold))")
        steps.append(f"t{k} AS (SELECT lang, fold, context, sum(n) AS total, sum(cut) AS cuts FROM w{k} GROUP BY ALL)")
    steps.append(f"u{n} AS (SELECT DISTINCT lang, model AS fold, gram FROM g)")
    steps += [f"u{k} AS (SELECT DISTINCT lang, fold, substr(gram, 3) AS gram FROM u{k + 1})" for k in range(n - 1, 0, -1)]
    for k in range(1, n + 1):
        low = "1.0 / 256" if k == 1 else "l.p"
        join = "" if k == 1 else f" JOIN p{k - 1} l ON l.lang = u.lang AND l.fold = u.fold AND l.gram = substr(u.gram, 3)"
        steps.append(f"""p{k} AS (SELECT u.lang, u.fold, u.gram, coalesce((w.n - w.cut) / t.total, 0) + coalesce(t.cuts / t.total, 1) * {low} AS p FROM u{k} u LEFT JOIN w{k} w ON w.lang = u.lang AND w.fold = u.fold AND w.gram = u.gram
                     LEFT JOIN t{k} t ON t.lang = u.lang AND t.fold = u.fold AND t.context = left(u.gram, {2 * k - 2}){join})""")
    steps.append(f"""s AS (SELECT doc_id, round(exp(avg(-ln(p))), {lm.DIGITS}) AS perplexity FROM g JOIN p{n} p ON p.lang = g.lang AND p.fold = g.model AND p.gram = g.gram GROUP BY doc_id),
        a AS (SELECT doc_id, d.lang, octet_length(encode(text)) AS n_symbols, perplexity, length(bin(octet_length(encode(text)))) AS size, doc_id IN (SELECT doc_id FROM good) AND perplexity IS NOT NULL AS trusted FROM d LEFT JOIN s USING (doc_id)),
        r AS (SELECT lang, size, perplexity, row_number() OVER (PARTITION BY lang, size ORDER BY perplexity) AS i, count(*) OVER (PARTITION BY lang, size) AS n, row_number() OVER (PARTITION BY lang ORDER BY perplexity) AS j, count(*) OVER (PARTITION BY lang) AS m FROM a WHERE trusted),
        near AS (SELECT lang, size, min(perplexity) AS threshold FROM r WHERE i >= ceil({lm.QUANTILE} * (n + 1) - 1e-9) GROUP BY ALL),
        wide AS (SELECT lang, min(perplexity) AS threshold FROM r WHERE j >= ceil({lm.QUANTILE} * (m + 1) - 1e-9) GROUP BY ALL)
        SELECT doc_id, a.lang, n_symbols, perplexity, CASE WHEN perplexity IS NOT NULL THEN coalesce(near.threshold, wide.threshold) END AS threshold, coalesce(perplexity <= coalesce(near.threshold, wide.threshold), true) AS keep
        FROM a LEFT JOIN near ON near.lang = a.lang AND near.size = a.size LEFT JOIN wide ON wide.lang = a.lang""")
    # each step is computed once
    return re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", ",\n".join(steps))


def duckdb_sql() -> dict[str, str]:
    return {
        "op10_quality": _language_model_sql(),
        "op1_html_text": r"""
            WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
            b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(body, '<br>', ' ', 'g'), '</?b>', '', 'g'), '<[^>]*>', chr(1), 'g') AS body FROM a),
            d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g') AS body FROM b),
            p AS (SELECT page_id, url, list_filter(list_transform(string_split(body, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS parts FROM d)
            SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM p""",
        "op4_repeats": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            one AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
            p AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS words FROM one),
            r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY md5(array_to_string(words, ' ')) ORDER BY doc_id, pos) AS nth FROM p WHERE len(words) = 20),
            gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS pos FROM r WHERE nth > 1),
            kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM one ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
            SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
        "op5_near": r"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS pos FROM d WHERE len(w) > 0),
            s AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 4], ' ') AS shingle FROM p),
            n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
            c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
            links AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * common >= 4 * (na.size + nb.size - common)),
            reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
            SELECT doc_id, least(doc_id, min(b)) AS class_id FROM d LEFT JOIN reach ON a = doc_id GROUP BY doc_id""",
        "op6_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
                  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op7_warc": r"""
            WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
            h AS (SELECT *, sha1(html) AS sha, min(page_id) OVER (PARTITION BY html) AS of, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), '^www[.]', '') AS host,
                  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*([?][^#]+)', 1) AS query FROM p),
            b AS (SELECT *, list_transform(range(0, 8), lambda k: ('0x' || substr(sha, (5 * k + 1)::INTEGER, 5))::BIGINT) AS fives FROM h)
            SELECT page_id, octet_length(encode(html)) AS payload_bytes,
                   array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((fives[j // 4 + 1] >> (15 - 5 * (j % 4))::INTEGER) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
                   CASE WHEN page_id = of THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> of THEN of END AS refers_to,
                   CASE WHEN url = '' THEN '' ELSE array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query END AS url_key,
                   '1970-01-01T00:00:00Z' AS captured FROM b""",
    }
