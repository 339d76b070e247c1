"""Registered queries of the library's own operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions import json as J
from marlpit.functions import maths as M
from marlpit.functions import rows as R
from marlpit.functions import sequences as Q
from marlpit.functions import strings as S
from marlpit.functions import times as T
from marlpit.operators import dml, grouping, joins, scans
from marlpit.session import read
from marlpit.sources.rows import key_value
from marlpit.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- scans ---


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-03-01' AND l_shipdate < TIMESTAMP '1995-04-01'")
def scan_range(spark, d):
    return read(spark, d, "lineitem").where("l_shipdate >= timestamp'1995-03-01' and l_shipdate < timestamp'1995-04-01'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT * FROM customer WHERE c_custkey = 42")
def get_row(spark, d):
    return scans.get(read(spark, d, "customer"), ["c_custkey"], [42])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7")
def multi_get_keys(spark, d):
    return scans.multi_get(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [7], keys_only=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def multi_get_batch(spark, d):
    parents = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("l_orderkey"))
    return scans.multi_get_batch(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], parents).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_mktsegment, c_acctbal, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_acctbal <= 5000 ORDER BY c_mktsegment DESC, c_acctbal DESC")
def index_scan(spark, d):
    return scans.index_scan(read(spark, d, "customer"), ["c_mktsegment", "c_acctbal"], ["BUILDING"], 0, 5000, "reverse", ["c_mktsegment", "c_acctbal", "c_custkey"])


@query("SELECT 'parent' AS level, o_orderkey AS k FROM orders UNION ALL SELECT 'lineitem', l_orderkey FROM lineitem")
def scan_depth(spark, d):
    return scans.with_depth(read(spark, d, "orders").select(c("o_orderkey").alias("k")), {"lineitem": read(spark, d, "lineitem").select(c("l_orderkey").alias("k"))}, ["k"])


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view') AND (event_type, user_id % 10) IN (('click', 1), ('view', 2), ('view', 3))")
def in_tuples(spark, d):
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).cast("long").alias("b"))
    return read(spark, d, "events").where(c("event_type").isin("click", "view") & F.struct(c("event_type").alias("a"), (c("user_id") % 10).alias("b")).isin(pair("click", 1), pair("view", 2), pair("view", 3))).select("event_id", "event_type")


@query("SELECT '/' || l_orderkey || '/' || l_linenumber AS key, '{\"l_orderkey\":' || l_orderkey || ',\"l_linenumber\":' || l_linenumber || '}' AS value FROM lineitem")
def key_value_rows(spark, d):
    return key_value(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


# --- joins ---


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def inner_join3(spark, d):
    o, cu, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    return joins.inner(joins.inner(o.where("o_totalprice > 100000"), cu, o.o_custkey == cu.c_custkey), n, cu.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey AND a.s_acctbal >= b.s_acctbal")
def self_join_theta(spark, d):
    s = read(spark, d, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_suppkey") != c("b.s_suppkey")) & (c("a.s_acctbal") >= c("b.s_acctbal"))).select(c("a.s_suppkey").alias("a"), c("b.s_suppkey").alias("b"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey")
def left_outer_join(spark, d):
    cu, o = read(spark, d, "customer"), read(spark, d, "orders").where("o_totalprice > 200000")
    return joins.left_outer(cu, o, cu.c_custkey == o.o_custkey).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""SELECT n_nationkey AS a_k, c_custkey AS b_c, NULL::BIGINT AS g_s FROM nation JOIN customer ON c_nationkey = n_nationkey
          UNION ALL SELECT n_nationkey, NULL, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
          UNION ALL SELECT n_nationkey, NULL, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def nested_tables_tree(spark, d):
    n = read(spark, d, "nation").select(c("n_nationkey").alias("k"))
    b = read(spark, d, "customer").select(c("c_nationkey").alias("k"), c("c_custkey").alias("c"))
    g = read(spark, d, "supplier").select(c("s_nationkey").alias("k"), c("s_suppkey").alias("s"))
    tree = joins.Nested("a", n, ("k",), [joins.Nested("b", b, ("k", "c")), joins.Nested("g", g, ("k", "s"))])
    return joins.nested_tables(tree).select("a_k", "b_c", "g_s")


@query("SELECT o_orderkey AS t_k, l_linenumber AS l_n, o_orderstatus AS t_st FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45")
def nested_tables_linear(spark, d):
    o = read(spark, d, "orders").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("st"))
    li = read(spark, d, "lineitem").where("l_quantity > 45").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"))
    return joins.nested_tables(joins.Nested("t", o, ("k",), [joins.Nested("l", li, ("k", "n"))])).select("t_k", "l_n", "t_st")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def unnest_words(spark, d):
    return joins.unnest(read(spark, d, "part"), F.split("p_name", " "), "word").groupBy("word").agg(F.count("*").alias("n"))


# --- grouping ---


@query("""SELECT c_mktsegment, count(*) AS n, list_sort(list(DISTINCT n_name)) AS nations, round(avg(o_totalprice), 4) AS mean
          FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment""")
def flagship(spark, d):
    o, cu, n = (read(spark, d, t) for t in ("orders", "customer", "nation"))
    found = o.join(cu, o.o_custkey == cu.c_custkey).join(n, cu.c_nationkey == n.n_nationkey)
    out = found.groupBy("c_mktsegment").agg(F.count("*").alias("n"), grouping.array_collect(c("n_name"), distinct=True).alias("nations"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return scans.order_by(out, "n", "c_mktsegment", desc=[True])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY ALL")
def group_aggregates(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_totalprice < 0")
def global_aggregate_empty(spark, d):
    return read(spark, d, "orders").where("o_totalprice < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1")
def group_by_case(spark, d):
    size = F.when(c("p_size") < 10, "small").when(c("p_size") < 30, "medium").otherwise("large")
    return read(spark, d, "part").groupBy(size.alias("class")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands"))


@query("SELECT DISTINCT o_orderstatus, year(o_orderdate)::INTEGER AS y FROM orders")
def select_distinct(spark, d):
    return read(spark, d, "orders").select("o_orderstatus", T.part("year", c("o_orderdate")).alias("y")).distinct()


@query("SELECT label, sum(len(list_filter(embedding, lambda x: x > 0)))::BIGINT AS items FROM embeddings GROUP BY label")
def count_sequence_items(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(grouping.count_items(F.filter("embedding", lambda x: x > 0)).alias("items"))


@query("SELECT l_orderkey, list_sort(list(l_partkey) FILTER (WHERE l_partkey IS NOT NULL)) AS parts FROM lineitem GROUP BY l_orderkey")
def array_collect(spark, d):
    # an order has a bounded number of items
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(grouping.array_collect(c("l_partkey")).alias("parts"))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 5")
def order_limit_offset(spark, d):
    return scans.page(scans.order_by(read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", desc=[True]), 20, 5)


# --- sequences and paths ---


@query("SELECT vec_id, embedding[2:4] AS part, list_filter(embedding, lambda x: x > 0.1) AS big FROM embeddings")
def slice_and_filter(spark, d):
    return read(spark, d, "embeddings").select("vec_id", Q.slice_step(c("embedding"), 1, 3).alias("part"), Q.filter_step(c("embedding"), lambda x, i: x > F.lit(0.1)).alias("big"))


@query("SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS any_gt, list_contains(string_split(vec_id::VARCHAR, ''), '7') AS has7 FROM embeddings")
def any_comparison(spark, d):
    return read(spark, d, "embeddings").select("vec_id", Q.any_value(">", c("embedding"), F.lit(0.2)).alias("any_gt"), Q.any_op("=", F.split(c("vec_id").cast("string"), ""), F.array(F.lit("7"))).alias("has7"))


@query("""SELECT p_partkey, len(w) AS n, list_min(w) AS low, list_max(w) AS high, list_sort(w) AS sorted, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE, 6) AS chars,
          round(list_avg(list_transform(w, lambda x: length(x)))::DOUBLE, 6) AS mean FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def sequence_aggregates(spark, d):
    w = F.split("p_name", " ")
    n = Q.seq_transform(w, F.char_length)
    return read(spark, d, "part").select("p_partkey", Q.seq_count(w).alias("n"), Q.seq_min(w).alias("low"), Q.seq_max(w).alias("high"), Q.seq_sort(w).alias("sorted"), F.round(Q.seq_sum(n), 6).alias("chars"), F.round(Q.seq_avg(n), 6).alias("mean"))


@query("SELECT doc_id, list_sort(list_distinct(string_split(lower(lang || ' ' || source || ' ' || lang), ' '))) AS words FROM documents")
def sequence_distinct(spark, d):
    return read(spark, d, "documents").select("doc_id", Q.seq_sort(Q.seq_distinct(F.split(S.lower(F.concat_ws(" ", "lang", "source", "lang")), " "))).alias("words"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE (props::JSON->>'k')::BIGINT > 50")
def json_path(spark, d):
    k = J.path(J.parse_json(c("props")), "$.k", "bigint")
    return read(spark, d, "events").select("event_id", k.alias("k")).where("k > 50")


@query("SELECT (props::JSON->>'k')::DOUBLE AS number, count(*) AS n FROM events GROUP BY 1")
def json_group(spark, d):
    key = J.canonical(J.parse_json(c("props")), "$.k")
    return read(spark, d, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(c("key.number").alias("number"), "n")


# --- functions ---


@query("""SELECT p_partkey, substr(p_name, 3, 4) AS sub, upper(p_name) AS up, lower(p_type) AS low, length(p_name)::INTEGER AS len, reverse(p_brand) AS rev, replace(p_name, 'a', 'X') AS rep,
          contains(p_name, 'or') AS has, starts_with(p_brand, 'Brand') AS st, ends_with(p_brand, '1') AS en, (strpos(p_name, 'e') - 1)::INTEGER AS at, p_brand || p_type AS con FROM part""")
def string_functions(spark, d):
    p = c("p_name")
    return read(spark, d, "part").select(
        "p_partkey", S.substring(p, 2, 4).alias("sub"), S.upper(p).alias("up"), S.lower(c("p_type")).alias("low"), S.length(p).alias("len"), S.reverse(c("p_brand")).alias("rev"), S.replace(p, F.lit("a"), F.lit("X")).alias("rep"),
        S.contains(p, F.lit("or")).alias("has"), S.starts_with(c("p_brand"), F.lit("Brand")).alias("st"), S.ends_with(c("p_brand"), F.lit("1")).alias("en"), S.index_of(p, "e").alias("at"), S.concat(c("p_brand"), c("p_type")).alias("con"),
    )


@query("SELECT c_custkey, trim(leading 'C' from c_name) AS t, regexp_full_match(c_name, 'Customer.*[05]') AS m FROM customer")
def trim_and_regex(spark, d):
    return read(spark, d, "customer").select("c_custkey", S.trim(c("c_name"), "leading", "C").alias("t"), S.regex_like(c("c_name"), "Customer.*[05]").alias("m"))


@query("""SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS sq, round(ln(l_extendedprice), 6) AS ln, round(log10(l_extendedprice), 6) AS lg, round(pow(l_discount + 1, 3), 6) AS pw, floor(l_extendedprice) AS fl, ceil(l_extendedprice) AS ce,
          trunc(l_extendedprice) AS tr, round(sin(l_quantity) + cos(l_quantity) + tan(l_discount), 6) AS tg, round(atan2(l_discount, l_tax + 1), 6) AS at, round(degrees(l_discount) + radians(l_quantity), 6) AS dr, sign(l_discount - 0.05)::DOUBLE AS sg, round(exp(l_discount), 6) AS ex, abs(l_quantity - 25) AS ab FROM lineitem""")
def math_functions(spark, d):
    q, e, di = c("l_quantity"), c("l_extendedprice"), c("l_discount")
    r = lambda x: F.rint(x * 1e6) / 1e6  # noqa: E731  much cheaper than round, which goes through decimals
    return read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(F.sqrt(q)).alias("sq"), r(M.ln(e)).alias("ln"), r(M.log10(e)).alias("lg"), r(F.pow(di + 1, F.lit(3))).alias("pw"), M.floor(e).alias("fl"), M.ceil(e).alias("ce"),
        M.trunc(e).alias("tr"), r(F.sin(q) + F.cos(q) + F.tan(di)).alias("tg"), r(M.atan2(di, c("l_tax") + 1)).alias("at"), r(F.degrees(di) + F.radians(q)).alias("dr"), M.sign(di - 0.05).alias("sg"), r(F.exp(di)).alias("ex"), F.abs(q - 25).alias("ab"),
    )


@query("SELECT o_orderkey, o_orderkey // 7 AS q, CASE WHEN o_custkey % 3 = 0 THEN CASE WHEN o_totalprice = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END ELSE o_totalprice / (o_custkey % 3) END AS f FROM orders")
def arithmetic(spark, d):
    p, by = c("o_totalprice"), c("o_custkey") % 3
    p = F.when(by != 0, p).when(p == 0, p).otherwise(F.lit(1.0))  # over 0, the SQL takes every price but 0 (nulls and negative ones too) as positive
    return read(spark, d, "orders").select("o_orderkey", M.divide(c("o_orderkey"), F.lit(7).cast("long"), integral=True).alias("q"), M.divide(p, by).alias("f"))


@query("""SELECT event_id, year(ts)::INTEGER AS y, month(ts)::INTEGER AS mo, day(ts)::INTEGER AS d, hour(ts)::INTEGER AS h, minute(ts)::INTEGER AS mi, second(ts)::INTEGER AS s, weekofyear(ts)::INTEGER AS iw, quarter(ts)::INTEGER AS q, isodow(ts)::INTEGER AS dow,
          dayofyear(ts)::INTEGER AS doy, (microsecond(ts) % 1000000 // 1000)::INTEGER AS ms FROM events""")
def time_parts(spark, d):
    names = {"y": "year", "mo": "month", "d": "day", "h": "hour", "mi": "minute", "s": "second", "iw": "isoweek", "q": "quarter", "dow": "day_of_week", "doy": "day_of_year", "ms": "millisecond"}
    return read(spark, d, "events").select("event_id", *(T.part(u, c("ts")).alias(a) for a, u in names.items()))


@query("""SELECT event_id, date_trunc('hour', ts) AS fl, CASE WHEN date_trunc('day', ts) = ts THEN ts ELSE date_trunc('day', ts) + INTERVAL 1 DAY END AS ce, date_trunc('hour', ts + INTERVAL 30 MINUTE) AS ro, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bu,
          ts + INTERVAL 1 MONTH + INTERVAL 3 HOUR AS ad, epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-01') // 1000 AS di, last_day(ts)::TIMESTAMP AS la, strftime(ts, '%Y/%m/%d %H') AS fo FROM events""")
def time_arithmetic(spark, d):
    t = c("ts")
    return read(spark, d, "events").select("event_id", T.timestamp_floor(t, "hour").alias("fl"), T.timestamp_ceil(t, "day").alias("ce"), T.timestamp_round(t, "hour").alias("ro"), T.timestamp_bucket(t, "15 minutes").alias("bu"), T.timestamp_add(t, "1 month 3 hours").alias("ad"), T.timestamp_diff(t, F.lit("2024-01-01")).alias("di"), T.to_last_day_of_month(t).alias("la"), T.format_timestamp(t, "yyyy/MM/dd HH").alias("fo"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_buckets(spark, d):
    return changes.bucket_counts(read(spark, d, "events"), "1 day").withColumn("total", F.round("total", 4))


# --- changes of tables ---


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "ts", c("event_id").alias("region"))
    return changes.last_write_wins(e, ["user_id"]).select("user_id", "event_type", "ts")


@query("""SELECT c_custkey, CASE WHEN o.t IS NULL THEN c_acctbal ELSE o.t END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def upsert_rows(spark, d):
    cu = read(spark, d, "customer").select("c_custkey", "c_acctbal")
    new = read(spark, d, "orders").groupBy(c("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).join(cu.select("c_custkey"), "c_custkey", "left_semi")
    return dml.upsert(cu, new, ["c_custkey"])


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 0.5 ELSE p_retailprice END AS p_retailprice, p_size FROM part WHERE NOT p_size = 1")
def update_delete(spark, d):
    left, _ = dml.delete(read(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), c("p_size") == 1)
    return dml.update(left, c("p_size") > 25, p_retailprice=c("p_retailprice") * 0.5)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def bulk_load_first(spark, d):
    return dml.bulk_load(read(spark, d, "events").select("user_id", "event_id"), ["user_id"], c("event_id"))


@query("SELECT event_id, '{\"k\":' || (props::JSON->>'k') || ',\"seen\":true}' AS props FROM events")
def json_merge_patch(spark, d):
    return read(spark, d, "events").select("event_id", dml.json_merge(c("props"), F.lit('{"seen":true,"gone":null}')).alias("props"))


@query("SELECT o_orderkey, o_orderdate AS created, date_trunc('day', o_orderdate) + INTERVAL 31 DAY AS expires FROM orders WHERE date_trunc('day', o_orderdate) + INTERVAL 31 DAY > TIMESTAMP '1996-01-01'")
def row_properties(spark, d):
    rows = R.with_meta(read(spark, d, "orders"), ["o_orderkey"], c("o_orderdate"), 30)
    return R.live(rows, F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", R.creation_time().alias("created"), R.expiration_time().alias("expires"))


@query("""SELECT s_suppkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(s_nationkey + 10 - s_suppkey % 60) / 2), 2) + cos(radians(s_suppkey % 60)) * cos(radians(s_nationkey + 10)) * pow(sin(radians(20 - s_suppkey % 90) / 2), 2))), 2) AS metres FROM supplier""")
def geo_distance(spark, d):
    point = lambda x, y: F.concat(F.lit('{"type":"Point","coordinates":['), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]}"))
    return read(spark, d, "supplier").select("s_suppkey", F.round(R.geo_distance(point(c("s_suppkey") % 90, c("s_suppkey") % 60), point(F.lit(20), c("s_nationkey") + 10)), 2).alias("metres"))


# --- further functions and operators ---


@query("""SELECT c_custkey, ltrim('  ' || c_name || ' ') AS l, rtrim(' ' || c_name || '  ') AS r, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END || c_name AS con,
          CASE WHEN strpos(substr(c_name, 6), '0') = 0 THEN -1 ELSE strpos(substr(c_name, 6), '0') + 4 END::INTEGER AS at, CASE WHEN length(c_name) > 12 THEN substr(c_name, 13) END AS tail FROM customer""")
def trims_and_places(spark, d):
    n = c("c_name")
    return read(spark, d, "customer").select("c_custkey", S.ltrim(F.concat(F.lit("  "), n, F.lit(" "))).alias("l"), S.rtrim(F.concat(F.lit(" "), n, F.lit("  "))).alias("r"), S.concat(F.when(c("c_acctbal") > 0, c("c_mktsegment")), n).alias("con"), S.index_of(n, "0", 5).alias("at"), S.substring(n, 12).alias("tail"))


@query("""WITH e AS (SELECT event_id, ts, epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-15') // 1000 AS ms FROM events),
          p AS (SELECT *, abs(ms) // 86400000 AS d, abs(ms) // 3600000 % 24 AS h, abs(ms) // 60000 % 60 AS m, abs(ms) // 1000 % 60 AS s, abs(ms) % 1000 AS u FROM e)
          SELECT event_id, CASE WHEN ms = 0 THEN '0 second' ELSE CASE WHEN ms < 0 THEN '-' ELSE '' END || concat_ws(' ', CASE WHEN d > 0 THEN d || ' day' || CASE WHEN d > 1 THEN 's' ELSE '' END END, CASE WHEN h > 0 THEN h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END END,
          CASE WHEN m > 0 THEN m || ' minute' || CASE WHEN m > 1 THEN 's' ELSE '' END END, CASE WHEN s > 0 THEN s || ' second' || CASE WHEN s > 1 THEN 's' ELSE '' END END, CASE WHEN u > 0 THEN u || ' millisecond' || CASE WHEN u > 1 THEN 's' ELSE '' END END) END AS took,
          date_trunc('day', ts) - to_days(dayofweek(ts)::INTEGER) AS sunday, date_trunc('week', ts)::TIMESTAMP AS monday, date_trunc('minute', ts) AS again FROM p""")
def durations(spark, d):
    t = c("ts")
    again = T.parse_to_timestamp(T.format_timestamp(t, "yyyy/MM/dd HH:mm"), "yyyy/MM/dd HH:mm")
    return read(spark, d, "events").select("event_id", T.get_duration(T.timestamp_diff(t, F.lit("2024-01-15"))).alias("took"), T.timestamp_floor(t, "week").alias("sunday"), T.timestamp_floor(t, "iweek").alias("monday"), again.alias("again"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice) / ln(l_quantity + 1), 6) AS lg, round(1 / tan(l_quantity), 6) AS ct, round(asin(l_discount) + acos(l_tax) + atan(l_quantity), 6) AS arc,
          trunc(l_extendedprice / 100) * 100 AS tr, CASE WHEN l_discount = 0 THEN 'Infinity'::DOUBLE ELSE l_quantity / l_discount END AS ra, round(l_quantity / 4) AS ro FROM lineitem""")
def math_more(spark, d):
    q, e, di = c("l_quantity"), c("l_extendedprice"), c("l_discount")
    over = F.when(di == 0, F.lit(1.0)).otherwise(q)  # over 0, the SQL takes every quantity (0, nulls and negative ones too) as positive
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.log(e, q + 1), 6).alias("lg"), F.round(M.cot(q), 6).alias("ct"), F.round(F.asin(di) + F.acos("l_tax") + F.atan(q), 6).alias("arc"), M.trunc(e, -2).alias("tr"), M.rdiv(over, di).alias("ra"), M.round_(q / 4).alias("ro"))


@query("""SELECT p_partkey, len(w)::INTEGER AS n, len(list_filter(w, lambda x: length(x) > 6)) > 0 AS any_long, list_concat(w, [p_brand, p_type]) AS more, list_min(list_filter(w, lambda x: length(x) > 4)) AS low, list_max(w) AS high
          FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def sequence_steps(spark, d):
    w = F.split("p_name", " ")
    long_ = Q.filter_step(w, lambda x, _: F.char_length(x) > 6)
    return read(spark, d, "part").select("p_partkey", Q.size(w).alias("n"), Q.exists(long_).alias("any_long"), Q.seq_concat(w, F.array("p_brand", "p_type")).alias("more"), Q.seq_min_i(F.transform(w, lambda x: F.when(F.char_length(x) > 4, x))).alias("low"), Q.seq_max_i(w).alias("high"))


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN ['size', 'brand_length'] ELSE ['brand_length'] END AS ks, CASE WHEN p_size > 10 THEN [p_size, length(p_brand)] ELSE [length(p_brand)] END AS vs,
          ['brand_length', 'more'] AS put_keys, [length(p_brand), 1] AS put_values FROM part WHERE length(p_brand) > 0""")
def map_steps(spark, d):
    m = F.create_map(F.lit("size"), c("p_size"), F.lit("brand_length"), F.char_length("p_brand"))
    keep = lambda k, v: (k != "size") | (v > 10)
    edited = dml.map_remove(dml.map_put(m, F.create_map(F.lit("more"), F.lit(1))), "size")
    return read(spark, d, "part").where("length(p_brand) > 0").select("p_partkey", Q.keys(m, keep).alias("ks"), Q.values(m, keep).alias("vs"), Q.keys(edited).alias("put_keys"), Q.values(edited).alias("put_values"))


@query("SELECT s_suppkey, 'nation' AS name, s_nationkey::DOUBLE AS amount FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier")
def unnest_map_entries(spark, d):
    entries = F.create_map(F.lit("nation"), c("s_nationkey").cast("double"), F.lit("balance"), c("s_acctbal"))
    return joins.unnest_map(read(spark, d, "supplier"), entries, "name", "amount").select("s_suppkey", "name", "amount")


@query("""SELECT p_partkey, list_concat(['first'], w) AS front, list_concat(w, [p_brand]) AS back, list_concat(w[1:1], w[3:]) AS fewer FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def array_edits(spark, d):
    w = F.split("p_name", " ")
    return read(spark, d, "part").select("p_partkey", dml.array_add(w, F.lit("first"), 0).alias("front"), dml.array_add(w, c("p_brand")).alias("back"), dml.array_remove_at(w, 1).alias("fewer"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT l_orderkey, sum(l_extendedprice) FROM lineitem WHERE l_linenumber = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def insert_absent(spark, d):
    old = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    new = read(spark, d, "lineitem").where("l_linenumber = 1").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("o_totalprice"))
    return dml.insert(old, new, ["o_orderkey"])


@query("""SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal, s_nationkey FROM supplier""")
def put_if_version(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    now = F.md5(F.concat_ws("|", "s_suppkey", "s_nationkey"))
    new = s.withColumn("expected", F.when(c("s_nationkey") % 2 == 0, now).otherwise("stale")).withColumn("s_acctbal", F.lit(0.0))
    return dml.put_if_version(s, new, ["s_suppkey"], now)


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1")
def bulk_load_duplicates(spark, d):
    return dml.duplicates(read(spark, d, "events").select("user_id", "event_id"), ["user_id"], c("event_id"))


@query("""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id)
          SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l) UNION ALL SELECT user_id, value FROM l WHERE event_type <> 'click'""")
def apply_changes(spark, d):
    op = F.when(c("event_type") == "click", "delete").otherwise("put")
    e = read(spark, d, "events").select(c("user_id").alias("c_custkey"), c("value").alias("c_acctbal"), op.alias("op"), "ts", c("event_id").alias("region"))
    return changes.apply_changes(read(spark, d, "customer").select("c_custkey", "c_acctbal"), e, ["c_custkey"])


@query("""SELECT event_id, json_type(props::JSON, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS num, CASE WHEN props IS NULL THEN 0 WHEN json_extract(props, '$.none') IS NULL THEN 1 ELSE 2 END AS kind FROM events WHERE json_exists(props::JSON, '$.k')""")
def json_kinds(spark, d):
    v = J.parse_json(c("props"))
    nothing = J.null_kind(v, "$.none")
    rows = read(spark, d, "events").where(J.null_kind(v, "$.k") != J.EMPTY)
    return rows.select("event_id", J.is_of_type(F.try_variant_get(v, "$.k", "variant"), "number").alias("num"), F.when(nothing == J.SQL_NULL, 0).when(nothing == J.EMPTY, 1).otherwise(2).alias("kind"))


@query("SELECT o_orderkey, floor((epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 31 DAY) - epoch_ms(TIMESTAMP '1996-01-01')) / 86400000)::INTEGER AS days, floor((epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP + INTERVAL 31 DAY) - epoch_ms(TIMESTAMP '1996-01-01')) / 3600000)::INTEGER AS hours FROM orders")
def remaining_time(spark, d):
    now = F.lit("1996-01-01").cast("timestamp")
    return R.with_meta(read(spark, d, "orders"), ["o_orderkey"], c("o_orderdate"), 30).select("o_orderkey", R.remaining_days(now).alias("days"), R.remaining_hours(now).alias("hours"))


@query("SELECT l_orderkey, list_sort(list(l_suppkey)) AS keys, count(*) AS numbers FROM lineitem GROUP BY l_orderkey")
def collect_regroup(spark, d):
    part = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(grouping.array_collect(c("l_suppkey")).alias("part"), grouping.count_numbers(F.parse_json(c("l_suppkey").cast("string"))).alias("n"))
    return part.groupBy("l_orderkey").agg(grouping.collect_regroup(c("part")).alias("keys"), F.sum("n").alias("numbers"))


@query("""SELECT n_name, c_custkey, o_orderkey FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE r_regionkey = 1""")
def mixed_joins(spark, d):
    n, r, cu, o = (read(spark, d, t) for t in ("nation", "region", "customer", "orders"))
    inside = joins.inner(joins.inner(n, r.where("r_regionkey = 1"), n.n_regionkey == r.r_regionkey), cu, n.n_nationkey == cu.c_nationkey)
    return joins.left_outer(inside, o.where("o_orderstatus = 'P'"), cu.c_custkey == o.o_custkey).select("n_name", "c_custkey", "o_orderkey")
