"""Registered queries, second part: casts, comparisons, JSON aggregates and order, nested changes, row formats and properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlpit.functions import json as J
from marlpit.functions import maths as M
from marlpit.functions import rows as R
from marlpit.functions import sequences as Q
from marlpit.functions import strings as S
from marlpit.functions import times as T
from marlpit.functions import values as V
from marlpit.operators import dml, grouping, joins, scans
from marlpit.plans.queries import c, query
from marlpit.session import read
from marlpit.sources import rows as formats
from marlpit.variables import prepared

#: The same mixed JSON values for every event, by its id.
MIXED = "CASE event_id % 6 WHEN 0 THEN '9007199254740993' WHEN 1 THEN '\"s' || (event_id % 50) || '\"' WHEN 2 THEN 'null' WHEN 3 THEN 'true' WHEN 4 THEN '[1,2]' ELSE (event_id % 100) || '.5' END"


def mixed(spark, d):
    """event_id, g and v, a VARIANT of one of six kinds."""
    e = read(spark, d, "events")
    text = F.expr("case event_id % 6 when 0 then '9007199254740993' when 1 then concat('\"s', event_id % 50, '\"') when 2 then 'null' when 3 then 'true' when 4 then '[1,2]' else concat(event_id % 100, '.5') end")
    return e.select("event_id", (c("event_id") % 10).alias("g"), F.parse_json(text).alias("v"))


# --- numbers ---


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 0.29 WHEN 1 THEN 1.15 WHEN 2 THEN -2.79 ELSE 1234.56789 END::DOUBLE AS x,
          CASE o_orderkey % 4 WHEN 0 THEN 0.29 WHEN 1 THEN 1.15 WHEN 2 THEN -2.79 ELSE 1234.56 END::DOUBLE AS two, CASE o_orderkey % 4 WHEN 3 THEN 1200 ELSE 0 END::DOUBLE AS hundreds, round(pi() + exp(1), 9) AS pe, -o_custkey AS neg FROM orders""")
def trunc_digits(spark, d):
    x = F.expr("cast(case o_orderkey % 4 when 0 then 0.29 when 1 then 1.15 when 2 then -2.79 else 1234.56789 end as double)")
    return read(spark, d, "orders").select("o_orderkey", x.alias("x"), M.trunc(x, 2).alias("two"), (M.trunc(x, -2) + 0.0).alias("hundreds"), F.round(M.pi() + M.e(), 9).alias("pe"), V.negative(c("o_custkey")).alias("neg"))


@query("SELECT vec_id, 9007199254740993 + vec_id AS total, (list_sum(list_transform(embedding, lambda x: floor(x * 100)))::BIGINT)::DOUBLE AS hundredths, 2::INTEGER AS n FROM embeddings")
def exact_sequence_sums(spark, d):
    whole = F.array(F.lit(9007199254740993), c("vec_id"), F.lit(None).cast("bigint"))
    hundredths = F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("double"))
    return read(spark, d, "embeddings").select("vec_id", Q.seq_sum(whole).alias("total"), Q.seq_sum_i(hundredths).alias("hundredths"), Q.seq_count_i(whole).alias("n"))


# --- casts, comparisons, types ---


@query("""SELECT event_id, epoch_us(ts) // 1000 AS millis, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back, CAST(user_id AS VARCHAR) AS text, CAST(CAST(user_id AS VARCHAR) AS INTEGER) AS number, user_id::DOUBLE AS real,
          (props::JSON->>'k')::BIGINT AS k, event_id % 2 = 0 AS flag FROM events""")
def casts(spark, d):
    text = V.cast(c("user_id"), "long", "string")
    millis = V.cast(c("ts"), "timestamp", "long")
    k = F.try_variant_get(F.parse_json("props"), "$.k", "variant")
    flag = V.cast(F.when(c("event_id") % 2 == 0, "true").otherwise("false"), "string", "boolean")
    return read(spark, d, "events").select("event_id", millis.alias("millis"), V.cast(millis, "long", "timestamp").alias("back"), text.alias("text"), V.cast(text, "string", "integer").alias("number"), V.cast(c("user_id"), "long", "double").alias("real"), V.cast(k, "json", "long").alias("k"), flag.alias("flag"))


@query("SELECT event_id, user_id > value AS number, ts < TIMESTAMP '2024-01-02' AS moment, false AS apart, true AS unequal, CASE WHEN event_id % 2 = 0 THEN user_id = 3 END AS nothing FROM events")
def promoted_comparisons(spark, d):
    maybe = F.when(c("event_id") % 2 == 0, c("user_id"))
    return read(spark, d, "events").select(
        "event_id", V.compare(">", c("user_id"), "long", c("value"), "double").alias("number"), V.compare("<", c("ts"), "timestamp", F.lit("2024-01-02"), "string").alias("moment"),
        V.compare("=", c("event_type"), "string", c("user_id"), "long").alias("apart"), V.compare("!=", c("event_type"), "string", c("user_id"), "long").alias("unequal"), V.compare("=", maybe, "long", F.lit(3), "integer").alias("nothing"),
    )


@query(f"""SELECT event_id, event_id % 6 = 0 OR event_id % 6 = 5 AND event_id % 100 + 0.5 > 10 AS over10, event_id % 6 = 1 AND event_id % 50 = 1 AS is_s1, event_id % 6 = 2 AS is_null, NOT (event_id % 6 = 3) AS not_true, {MIXED} <> '' AS same, false AS none FROM events""")
def item_comparisons(spark, d):
    one, of = F.array(c("v")), lambda text: F.array(F.parse_json(F.lit(text)))
    return mixed(spark, d).select(
        "event_id", V.compare_items(">", one, of("10")).alias("over10"), V.compare_items("=", one, of('"s1"')).alias("is_s1"), V.compare_items("=", one, of("null")).alias("is_null"), V.compare_items("!=", one, of("true")).alias("not_true"),
        F.lit(True).alias("same"), V.compare_items("=", one, F.filter(one, lambda x: F.lit(False))).alias("none"),
    )


@query("SELECT event_id, event_id % 6 IN (0, 5) AS num, event_id % 6 = 0 AS long_, event_id % 6 = 5 AS double_, event_id % 6 IN (0, 1, 2, 3, 5) AS atomic, event_id % 6 IN (1, 4) AS text_or_array, false AS many, true AS maybe FROM events")
def types_of_items(spark, d):
    one = F.array(c("v"))
    return mixed(spark, d).select(
        "event_id", V.is_of_type(one, ("number", "")).alias("num"), V.is_of_type(one, ("long", ""), only=True).alias("long_"), V.is_of_type(one, ("double", "?"), only=True).alias("double_"), V.is_of_type(one, ("jsonatomic", "+")).alias("atomic"),
        V.is_of_type(one, ("string", ""), ("array", "")).alias("text_or_array"), V.is_of_type(F.array("v", "v"), ("any", "?")).alias("many"), V.is_of_type(F.array_remove(F.array(F.lit(1)), 1).cast("array<variant>"), ("number", "*")).alias("maybe"),
    )


@query("""SELECT p_partkey, p_size IN (1, 5, 9) AS listed, false AS empty, list_contains(string_split(p_name, ' '), 'ring') AS found, len(list_filter(string_split(p_name, ' '), lambda x: x >= 'r')) > 0 AS some_ge,
          len(list_filter(string_split(p_name, ' '), lambda x: x <> 'ring')) > 0 AS some_ne, NULL::BOOLEAN AS nothing FROM part""")
def sequences_and_lists(spark, d):
    w = F.split("p_name", " ")
    return read(spark, d, "part").select(
        "p_partkey", V.in_sequence(c("p_size"), [1, 5, 9]).alias("listed"), V.in_sequence(c("p_size"), []).alias("empty"), V.in_sequence(F.lit("ring"), w).alias("found"), Q.any_op(">=", w, F.array(F.lit("r"))).alias("some_ge"),
        Q.any_op("!=", w, F.array(F.lit("ring"))).alias("some_ne"), Q.any_op("<", w, F.lit(None).cast("array<string>")).alias("nothing"),
    )


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value ELSE user_id::DOUBLE END AS chosen, props::JSON->>'k' AS k, [event_id, event_id + 1] AS steps FROM events")
def computed_steps(spark, d):
    m = F.create_map(F.lit("even"), c("value"), F.lit("odd"), c("user_id").cast("double"))
    name = F.when(c("user_id") % 2 == 0, "even").otherwise("odd")
    records = F.array(F.struct(c("event_id").alias("x")), F.struct((c("event_id") + 1).alias("x")))
    return read(spark, d, "events").select("event_id", V.field_by_name(m, name).alias("chosen"), V.json_field_by_name(c("props"), F.lit("k")).alias("k"), Q.field_step(records, "x").alias("steps"))


@query("SELECT c_custkey, upper(c_name) = upper('cUSTOMER#000000007') AS seven, regexp_full_match(c_name, 'customer.*', 'i') AS any_case, 'ÉTÉ' = 'ÉTÉ' AS accents FROM customer")
def regex_flags(spark, d):
    n = c("c_name")
    return read(spark, d, "customer").select("c_custkey", S.regex_like(n, "cUSTOMER#000000007", "i").alias("seven"), S.regex_like(n, "customer.*", "iu").alias("any_case"), S.regex_like(F.lit("ÉTÉ"), "été", "iu").alias("accents"))


@query("SELECT c_custkey, '$x?' AS mark, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 100 AND c_nationkey = 3")
def bound_variables(spark, d):
    read(spark, d, "customer").createOrReplaceTempView("bound_customer")
    sql = "declare $seg string; $least double; select /*+ FORCE_PRIMARY_INDEX(customer) */ c_custkey, '$x?' as mark, c_acctbal from bound_customer where c_mktsegment = $seg and c_acctbal > $least and c_nationkey = ?"
    return prepared(spark, sql, 3, seg="BUILDING", least=100.0)


# --- JSON aggregates and order ---


@query("""SELECT event_id % 10 AS g, sum(CASE event_id % 6 WHEN 0 THEN 9007199254740993 WHEN 5 THEN event_id % 100 + 0.5 END)::DECIMAL(38,1)::VARCHAR AS total,
          round((sum(CASE event_id % 6 WHEN 0 THEN 9007199254740993 WHEN 5 THEN event_id % 100 + 0.5 END) / count(CASE WHEN event_id % 6 IN (0, 5) THEN 1 END))::DOUBLE / 1000000) AS mean, count(CASE WHEN event_id % 6 IN (0, 5) THEN 1 END) AS numbers,
          CASE WHEN count(CASE WHEN event_id % 6 IN (0, 5) THEN 1 END) > 0 THEN CASE WHEN min(CASE WHEN event_id % 6 = 5 THEN event_id % 100 END) IS NULL THEN '9007199254740993' ELSE min(CASE WHEN event_id % 6 = 5 THEN event_id % 100 END) || '.5' END
          WHEN count(CASE WHEN event_id % 6 = 1 THEN 1 END) > 0 THEN min(CASE WHEN event_id % 6 = 1 THEN 's' || (event_id % 50) END) ELSE 'true' END AS low,
          CASE WHEN count(CASE WHEN event_id % 6 = 3 THEN 1 END) > 0 THEN 'true' ELSE max(CASE event_id % 6 WHEN 1 THEN 's' || (event_id % 50) WHEN 0 THEN '9007199254740993' END) END AS high FROM events GROUP BY ALL""")
def json_aggregates(spark, d):
    out = mixed(spark, d).groupBy("g").agg(J.number_sum(c("v"), "$").alias("s"), J.number_avg(c("v"), "$").alias("m"), grouping.count_numbers(c("v")).alias("numbers"), J.item_min(c("v"), "$").alias("low"), J.item_max(c("v"), "$").alias("high"))
    return out.select("g", F.col("s").cast("decimal(38,1)").cast("string").alias("total"), F.round(F.col("m").cast("double") / 1000000).alias("mean"), "numbers", "low", "high")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -1 END AS kind FROM events
          ORDER BY CASE event_id % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 3 END, CASE WHEN event_id % 4 = 3 THEN event_id % 7 END, event_id LIMIT 9000""")
def json_order(spark, d):
    text = F.expr("case event_id % 4 when 0 then null when 1 then '{\"a\":null}' when 2 then '{}' else concat('{\"a\":', event_id % 7, '}') end")
    rows = read(spark, d, "events").select("event_id", F.parse_json(text).alias("v"))
    key = J.canonical(c("v"), "$.a")
    ordered = scans.order_by(rows.select("event_id", key.alias("key"), J.null_kind(c("v"), "$.a").alias("kind")), c("key.nothing"), c("key.number"), "event_id")
    return scans.page(ordered.select("event_id", "kind"), 9000)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k FROM orders ORDER BY k DESC NULLS LAST, o_orderkey LIMIT 100000")
def order_nulls(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.when(c("o_orderkey") % 3 != 0, c("o_custkey")).alias("k"))
    return scans.page(scans.order_by(rows, "k", "o_orderkey", desc=[True], nulls=["last"]), 100000)


# --- tables and hierarchies ---


@query("SELECT 'target' AS level, count(*) AS n FROM orders WHERE o_orderkey = 7 UNION ALL SELECT 'items', count(*) FROM lineitem WHERE l_orderkey = 7")
def multi_get_table(spark, d):
    o = read(spark, d, "orders").withColumnRenamed("o_orderkey", "k")
    li = read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    return scans.multi_get_table(o, ["k"], [7], children={"items": li}).groupBy(c("table").alias("level")).agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS level, c_custkey AS k FROM customer UNION ALL SELECT 'orders', o_custkey FROM orders")
def scan_children_only(spark, d):
    n = read(spark, d, "nation").select(c("n_nationkey").cast("long").alias("k"))
    tables = {"customer": read(spark, d, "customer").select(c("c_custkey").alias("k")), "orders": read(spark, d, "orders").select(c("o_custkey").alias("k")), "orders.lineitem": read(spark, d, "lineitem").select(c("l_orderkey").alias("k"))}
    return scans.with_depth(n, tables, ["k"], "CHILDREN_ONLY")


@query("SELECT l_orderkey AS t_k, l_linenumber AS t_n, o_orderstatus AS a_st, CASE WHEN o_totalprice > 100000 THEN c_name END AS b_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def nested_tables_ancestors(spark, d):
    li = read(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"))
    o = read(spark, d, "orders").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("st"))
    # the second ancestor has an ON of its own
    both = read(spark, d, "orders").where("o_totalprice > 100000").join(read(spark, d, "customer"), c("o_custkey") == c("c_custkey")).select(c("o_orderkey").alias("k"), c("c_name").alias("name"))
    return joins.nested_tables(joins.Nested("t", li, ("k", "n")), [joins.Nested("a", o, ("k",)), joins.Nested("b", both, ("k",))]).select("t_k", "t_n", "a_st", "b_name")


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x >= 'm')) > 0 AND p_size > 10")
def element_scan(spark, d):
    found = scans.element_scan(read(spark, d, "part"), F.split("p_name", " "), lambda x: x >= "m")
    m = F.create_map(F.lit("size"), c("p_size"))
    return scans.entry_scan(found, m, lambda k, v: (k == "size") & (v > 10)).select("p_partkey")


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, len(string_split(p_name, ' '))::INTEGER AS n FROM part")
def lateral_values(spark, d):
    rows = joins.let(read(spark, d, "part"), words=F.split("p_name", " "))
    return joins.unnest(joins.let(rows, n=F.size("words")), c("words"), "word").select("p_partkey", "word", "n")


# --- changes ---


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN [[2 * s_suppkey + 1, 0], [2 * 500 + 1, 500]] ELSE [[s_suppkey, 0], [500, 500]] END AS phones, CASE WHEN s_nationkey = 3 THEN s_nationkey * 10 ELSE s_nationkey END AS age FROM supplier")
def update_nested(spark, d):
    phone = lambda n, code: F.struct(n.cast("long").alias("number"), code.cast("long").alias("area"))
    info = F.struct(F.array(phone(c("s_suppkey"), F.lit(0)), phone(F.lit(500), F.lit(500))).alias("phones"), F.create_map(F.lit("x"), F.struct(c("s_nationkey").alias("age"))).alias("children"))
    rows = read(spark, d, "supplier").select("s_suppkey", "s_nationkey", info.alias("info"))
    out = dml.update_paths(
        rows, c("s_nationkey") == 3, ("info", ["phones", "[]", "number"], lambda x: x * 2), ("info", ["phones", lambda p: p.area >= 0, "number"], lambda x: x + 1), ("info", ["children", "{}", "age"], lambda x: x * 10)
    )
    return out.select("s_suppkey", F.transform("info.phones", lambda p: F.array(p.number, p.area)).alias("phones"), c("info.children")["x"]["age"].alias("age"))


@query("SELECT count(*) FILTER (WHERE p_size > 25) AS \"NumRowsUpdated\" FROM part")
def rows_updated(spark, d):
    return dml.num_rows_updated(read(spark, d, "part"), c("p_size") > 25)


@query("""SELECT l_orderkey AS o_orderkey, min(l_partkey) AS o_custkey, 'N' AS o_orderstatus FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey""")
def insert_returning(spark, d):
    old = read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")
    new = read(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_partkey").alias("o_custkey"))  # several rows of one key
    return dml.inserted(old, new, ["o_orderkey"], c("o_custkey"), {"o_orderstatus": F.lit("N")})


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey, arg_max(l_extendedprice, (l_linenumber, l_partkey, l_extendedprice)) FROM lineitem GROUP BY l_orderkey""")
def upsert_repeated_keys(spark, d):
    new = read(spark, d, "lineitem").select(c("l_orderkey").alias("o_orderkey"), c("l_extendedprice").alias("o_totalprice"), "l_linenumber", "l_partkey")
    return dml.upsert(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), new, ["o_orderkey"], F.struct("l_linenumber", "l_partkey", "o_totalprice"))


@query("SELECT s_suppkey, s_nationkey FROM supplier WHERE NOT (s_nationkey % 2 = 0) AND NOT (s_nationkey = 5 AND s_suppkey BETWEEN 1 AND 1000)")
def versioned_deletes(spark, d):
    s = read(spark, d, "supplier").select("s_nationkey", "s_suppkey")
    now = F.md5(F.concat_ws("|", "s_suppkey", "s_nationkey"))
    keys = s.withColumn("expected", F.when(c("s_nationkey") % 2 == 0, now).otherwise("stale"))
    left = dml.delete_if_version(s, keys, ["s_nationkey", "s_suppkey"], now)
    return dml.multi_delete(left, ["s_nationkey", "s_suppkey"], [5], 1, 1000)


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, true AS above, true AS given FROM part")
def identity_values(spark, d):
    p = read(spark, d, "part").select("p_partkey")
    own = dml.identity(p, "id", 10, 5)
    kept = dml.identity(p.withColumn("id", c("p_partkey")), "id", always=False)
    a = own.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), (F.min("id") >= 10).alias("above"))
    return a.join(kept.agg(F.bool_and(c("id") == c("p_partkey")).alias("given")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN date_trunc('hour', TIMESTAMP '2000-01-01 10:30:00') + INTERVAL 4 HOUR ELSE date_trunc('day', o_orderdate) + INTERVAL 31 DAY END AS expires, CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2000-01-01 10:30:00' ELSE o_orderdate END AS modified,
          'x' || o_orderkey AS who, true AS versioned, true AS placed, true AS sized FROM orders""")
def row_times_and_places(spark, d):
    o = read(spark, d, "orders")
    meta = F.concat(F.lit('{"who":"x'), c("o_orderkey").cast("string"), F.lit('"}'))
    rows = R.with_meta(o, ["o_orderkey"], c("o_orderdate"), 30, meta)
    rows = R.set_ttl(rows, c("o_orderkey") % 2 == 0, F.lit("2000-01-01 10:30:00").cast("timestamp"), ttl_hours=3)
    part, shard = R.partition(["o_orderkey"], 60), R.shard(["o_orderkey"], 60, 4)
    return rows.select(
        "o_orderkey", R.expiration_time().alias("expires"), R.modification_time().alias("modified"), R.row_metadata("$.who").alias("who"), (F.length(R.version()) == 32).alias("versioned"),
        (part.between(1, 60) & shard.between(1, 4) & (F.pmod(part - 1, F.lit(4)) + 1 == shard)).alias("placed"), (R.row_storage_size(["o_orderkey", "o_orderstatus"]) > R.index_storage_size(["o_orderkey"], ["o_orderkey"])).alias("sized"),
    )


# --- times, formats, geometry ---


@query("""SELECT event_id, (epoch_us(ts) % 1000000)::INTEGER AS us, (epoch_us(ts) % 1000000 * 1000)::INTEGER AS ns, day(ts)::INTEGER AS dom, ((dayofyear(ts) - 1 + dayofweek(date_trunc('year', ts))) // 7 + 1)::INTEGER AS wk,
          date_trunc('week', make_date(isoyear(ts)::INTEGER, 1, 4))::TIMESTAMP AS iy, date_trunc('week', make_date(isoyear(ts)::INTEGER + (isoyear(ts) < isoyear(ts + INTERVAL 183 DAY))::INTEGER, 1, 4))::TIMESTAMP IS NOT NULL AS ok,
          date_trunc('year', ts)::TIMESTAMP AS y, date_trunc('quarter', ts)::TIMESTAMP AS q, date_trunc('month', ts)::TIMESTAMP AS m, date_trunc('second', ts)::TIMESTAMP AS s,
          time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '2024-01-01 00:30:00') AS bu, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS berlin FROM events""")
def time_units(spark, d):
    t = c("ts")
    return read(spark, d, "events").select(
        "event_id", T.part("microsecond", t).alias("us"), T.part("nanosecond", t).alias("ns"), T.part("day_of_month", t).alias("dom"), T.part("week", t).alias("wk"), T.timestamp_floor(t, "iyear").alias("iy"), T.timestamp_ceil(t, "iyear").isNotNull().alias("ok"),
        T.timestamp_floor(t, "year").alias("y"), T.timestamp_floor(t, "quarter").alias("q"), T.timestamp_floor(t, "month").alias("m"), T.timestamp_floor(t, "second").alias("s"),
        T.timestamp_bucket(t, "2 hours", F.lit("2024-01-01 00:30:00").cast("timestamp")).alias("bu"), T.format_timestamp(t, "yyyy-MM-dd HH:mm", "Etc/GMT-1").alias("berlin"),
    )


@query("SELECT count(*) AS n, count(DISTINCT user_id) >= 1 AS users, true AS ids, true AS now FROM events")
def volatile_functions(spark, d):
    near = F.abs(T.current_time_millis() - T.to_millis(T.current_time())) < 1000
    return read(spark, d, "events").withColumn("id", S.random_uuid()).agg(F.count("*").alias("n"), (F.count_distinct("user_id") >= 1).alias("users"), (F.count_distinct("id") == F.count("*")).alias("ids"), F.bool_and(near).alias("now"))


@query("""SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || '}' AS json, 's_suppkey: ' || s_suppkey || chr(10) || 's_nationkey: ' || s_nationkey AS lines, s_suppkey || ',' || s_nationkey AS csv FROM supplier""")
def row_formats(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    both = s.select("s_suppkey", formats.json_text(s).alias("json"), formats.line_text(s).alias("lines"), formats.csv_text(s).alias("csv"))
    return both


@query("SELECT s_suppkey, s_suppkey % 3 = 0 AS point, false AS bare, s_suppkey % 3 <> 1 AS line FROM supplier")
def geometries(spark, d):
    xy = F.concat(F.lit("["), c("s_suppkey").cast("string"), F.lit(",1]"))
    point = F.when(c("s_suppkey") % 3 == 0, F.concat(F.lit('{"type":"Point","coordinates":'), xy, F.lit("}"))).otherwise('{"type":"Spot","coordinates":[1,2]}')
    line = F.when(c("s_suppkey") % 3 != 1, F.concat(F.lit('{"type":"LineString","coordinates":['), xy, F.lit(",[0,0]]}"))).otherwise('{"type":"LineString","coordinates":[]}')
    return read(spark, d, "supplier").select("s_suppkey", R.geo_is_geometry(point).alias("point"), R.geo_is_geometry(F.lit('{"type":"Point"}')).alias("bare"), R.geo_is_geometry(line).alias("line"))
