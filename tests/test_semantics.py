"""The traps: nulls, zero-based strings, floating results, JSON nothings, changes of tables."""

import math

import pytest
from pyspark.sql import functions as F

from marlpit.functions import json as J
from marlpit.functions import maths as M
from marlpit.functions import sequences as Q
from marlpit.functions import strings as S
from marlpit.functions import times as T
from marlpit.functions import values as V
from marlpit.operators import dml, joins, scans
from marlpit.sources import rows
from marlpit.streaming import changes
from marlpit.variables import prepared


def one(spark, *cols):
    r = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()
    return list(r)


def test_strings(spark):
    s = F.lit("abcd")
    assert one(spark, S.substring(s, -1), S.substring(s, 4), S.substring(s, 1, 0), S.substring(s, 1), S.index_of(s, "z"), S.index_of(s, ""), S.index_of(s, "a", -3)) == [None, None, "", "bcd", -1, 0, 0]
    assert one(spark, S.concat(F.lit(None).cast("string"), s), S.concat(F.lit(None).cast("string"), F.lit(None).cast("string")), S.trim(F.lit("xxaxx"), "trailing", "xy"), S.trim(s, "up"), S.replace(s, F.lit("b"))) == ["abcd", None, "xxa", None, "acd"]
    assert one(spark, S.regex_like(F.lit("Roy"), ".oy"), S.regex_like(F.lit("Royal"), ".oy"), S.regex_like(F.lit("a.b"), "a.b", "l"), S.regex_like(F.lit("ROY"), "roy", "i")) == [True, False, True, True]
    with pytest.raises(ValueError):
        S.regex_like(s, "(?=a)b")


def test_maths(spark):
    d = lambda x: F.lit(float(x))
    got = one(spark, M.ln(d(0)), M.ln(d(-1)), M.divide(d(1), d(0)), M.divide(d(-1), d(0)), M.trunc(d(-2.79), 1), M.ceil(d("nan")), F.round(d(-0.5)), M.divide(F.lit(7), F.lit(2), integral=True))
    assert got[0] == -math.inf and math.isnan(got[1]) and got[2:5] == [math.inf, -math.inf, -2.7] and math.isnan(got[5]) and got[6:] == [-1.0, 3]


def test_times(spark):
    t = F.lit("2021-02-28T10:30:15.123456").cast("timestamp")
    assert one(spark, T.part("day_of_week", t), T.part("millisecond", t), T.part("week", F.lit("2017-03-20")), T.part("isoweek", F.lit("2017-03-20")), T.get_duration(F.lit(108_000_000)), T.get_duration(F.lit(-1000))) == [7, 123, 12, 12, "1 day 6 hours", "-1 second"]
    assert [str(x) for x in one(spark, T.timestamp_add(t, "-1 day 2 hours"), T.timestamp_round(t, "hour"), T.timestamp_bucket(t, "7 days"), T.timestamp_floor(t, "week"))] == ["2021-02-27 08:30:15.123456", "2021-02-28 11:00:00", "2021-02-25 00:00:00", "2021-02-28 00:00:00"]
    with pytest.raises(ValueError):
        T.duration("3 parsecs")


def test_sequences(spark):
    a, none, empty = F.array(F.lit(1), F.lit(None), F.lit(3)), F.lit(None).cast("array<int>"), F.array().cast("array<int>")
    assert one(spark, Q.seq_count(a), Q.seq_count(empty), Q.seq_sum(a), Q.seq_max(a), Q.seq_max_i(a), Q.any_value(">", a, F.lit(2)), Q.any_op("!=", empty, a), Q.any_op("<", none, a), Q.exists(none), Q.exists(empty)) == [None, 0, 4.0, None, 3, True, False, None, None, False]
    assert one(spark, Q.slice_step(F.array(*map(F.lit, range(5))), 1, 2), Q.slice_step(F.array(*map(F.lit, range(5))), None, 1)) == [[1, 2], [0, 1]]


def test_json_nothings(spark):
    df = spark.createDataFrame([('{"a":null}',), ("{}",), (None,), ('{"a":1}',), ('{"a":1.0}',)], "s string")
    v = J.parse_json(F.col("s"))
    assert [r[0] for r in df.select(J.null_kind(v, "$.a")).collect()] == [J.JSON_NULL, J.EMPTY, J.SQL_NULL, J.VALUE, J.VALUE]
    assert df.groupBy(J.canonical(v, "$.a").alias("k")).count().count() == 4


def test_nested_tables_tree(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1, 1), (1, 2)], "k int, b int")
    g = spark.createDataFrame([(1, 9), (2, 8)], "k int, g int")
    got = joins.nested_tables(joins.Nested("a", a, ("k",), [joins.Nested("b", b, ("k", "b")), joins.Nested("g", g, ("k", "g"))]))
    assert sorted(((r.a_k, r.b_b, r.g_g) for r in got.collect()), key=repr) == sorted([(1, 1, None), (1, 2, None), (1, None, 9), (2, None, 8), (3, None, None)], key=repr)


def test_order(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert [r.x for r in scans.order_by(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in scans.order_by(df, "x", desc=[True]).collect()] == [None, 2, 1]


def test_dml(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    n = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    assert rows_of(dml.insert(t, n, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows_of(dml.upsert(t, n, ["k"])) == [(1, "a"), (2, "B"), (3, "C")]
    assert rows_of(dml.put_if_present(t, n, ["k"])) == [(1, "a"), (2, "B")]
    assert dml.merge_patch({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": None}, "d": [2], "e": 3}) == {"a": {"c": 2}, "d": [2], "e": 3}


def test_variables(spark):
    spark.range(3).toDF("k").createOrReplaceTempView("A")
    assert prepared(spark, "declare $x int; select k from A where k = $x", x=1).count() == 1
    assert prepared(spark, "select /*+ FORCE_INDEX(t i) */ '$x' as a, \"it's ?\" as b from A where k > ? and k < $y", 0, y=2).collect() == [("$x", "it's ?")]
    with pytest.raises(ValueError):
        prepared(spark, "select ?")


def test_sources_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "k int, v string")
    assert rows.to_lines(df).first()[0] == "k: 1\nv: x"
    with pytest.raises(ValueError):
        rows.write_csv(df.withColumn("a", F.array("k")), str(tmp_path / "c"))
    schema = "table string, op string, k int, v string, ts timestamp, region int"
    log = spark.createDataFrame([("t", "put", 1, "old", None, 1), ("t", "put", 1, "new", None, 2), ("u", "put", 9, "z", None, 1), ("t", "delete", 2, None, None, 1)], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    log.write.parquet(str(tmp_path / "log"))
    stream = changes.subscribe(spark, str(tmp_path / "log"), schema, ["t"])
    changes.to_table(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    kept = spark.read.schema(schema).parquet(str(tmp_path / "out"))
    now = changes.apply_changes(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), kept, ["k"])
    assert sorted(map(tuple, now.collect())) == [(1, "new")]


def test_stream_resumes_from_its_checkpoint(spark, tmp_path):
    schema = "table string, op string, k int, ts timestamp"
    put = lambda k: spark.createDataFrame([("t", "put", k, None)], schema).write.mode("append").parquet(str(tmp_path / "log"))
    run = lambda: changes.to_table(changes.subscribe(spark, str(tmp_path / "log"), schema, ["t"]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    put(1)
    run()
    put(2)
    run()
    run()
    assert sorted(r.k for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_values_that_were_once_wrong(spark):
    d = lambda x: F.lit(float(x))
    assert one(spark, M.trunc(d(0.29), 2), M.trunc(d(1.15), 2), M.trunc(d(-2.79), 1), M.trunc(d(1234.5), -2), M.trunc(d(1e20), 3), M.trunc(F.lit(None).cast("double"), 2)) == [0.29, 1.15, -2.7, 1200.0, 1e20, None]
    nothing = F.lit(None).cast("array<int>")
    assert one(spark, *(Q.any_op(op, F.array(F.lit(1)), nothing) for op in Q.OPS)) == [None] * 6
    assert one(spark, Q.seq_sum(F.array(F.lit(9007199254740993))), S.regex_like(F.lit("É"), "é", "iu")) == [9007199254740993, True]
    big = spark.createDataFrame([('{"a":9007199254740993}',), ('{"a":9007199254740992}',), ('{"a":1}',), ('{"a":1.0}',)], "s string")
    assert big.groupBy(J.canonical(J.parse_json(F.col("s")), "$.a").alias("k")).count().count() == 3
    t = F.lit("2021-01-02T10:00:00")  # in the ISO year 2020
    assert [str(x)[:10] for x in one(spark, T.timestamp_floor(t, "iyear"), T.timestamp_ceil(t, "iyear"), T.timestamp_round(t, "iyear"))] == ["2019-12-30", "2021-01-04", "2021-01-04"]
    with pytest.raises(ValueError):
        T.timestamp_add(t, "1 hour 1 day")


def test_new_rows_of_one_key(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    n = spark.createDataFrame([(2, "c"), (2, "b"), (1, "z"), (3, None)], "k int, v string")
    assert sorted(map(tuple, dml.insert(t, n, ["k"], F.col("v"), {"v": F.lit("?")}).collect())) == [(1, "a"), (2, "b"), (3, "?")]
    assert sorted(map(tuple, dml.upsert(t, n.where("v is not null"), ["k"], F.col("v")).collect())) == [(1, "z"), (2, "c")]
    bad = spark.createDataFrame([("{", "{}"), ('{"a":1}', '{"a":null}')], "d string, p string")
    assert [r[0] for r in bad.select(dml.json_merge("d", "p")).collect()] == [None, "{}"]
    with pytest.raises(Exception, match="must be an object"):
        bad.select(dml.json_merge("d", F.lit("[1]"))).collect()


def test_several_items_and_types(spark):
    v = lambda *texts: F.array(*(F.parse_json(F.lit(x)) for x in texts))
    none = F.filter(v("1"), lambda x: F.lit(False))
    assert one(spark, V.compare_items("=", v("1"), v("1.0")), V.compare_items("<", v('"a"'), v("2")), V.compare_items("!=", v('"a"'), v("2")), V.compare_items("=", none, none), V.compare_items("=", none, v("1")), V.compare_items("=", v("null"), v("null"))) == [True, False, True, True, False, True]
    with pytest.raises(Exception, match="more than one item"):
        one(spark, V.compare_items("=", v("1", "2"), v("1")))
    assert one(spark, V.is_of_type(v("1", "2"), ("number", "+")), V.is_of_type(v("1", "2"), ("number", "?")), V.is_of_type(v("1"), ("double", ""), only=True), V.is_of_type(none, ("string", "?")), V.is_of_type(v("1.5"), ("long", ""))) == [True, False, False, True, False]
    with pytest.raises(ValueError):
        V.cast(F.lit(True), "boolean", "long")
    with pytest.raises(ValueError):
        scans.order_by(spark.createDataFrame([([1],)], "a array<int>"), "a")


def test_large_numbers_lose_digits_before_the_point(spark):
    d = lambda x: F.lit(float(x))
    got = one(spark, M.trunc(d(4503599627370497), -2), M.trunc(d(-9007199254740991), -3), M.trunc(d(123456789012345680), -2), M.trunc(d(1e300), -2), M.trunc(d(1.5e38), -37), M.trunc(d(1.5e39), -39), M.trunc(d(9.9e20), -21), M.trunc(d("-inf"), -2), M.trunc(d(4503599627370497), 2), M.trunc(F.lit(None).cast("double"), -2), M.trunc(d("nan"), -2))
    assert got[:10] == [4503599627370400.0, -9007199254740000.0, 123456789012345600.0, 1e300, 1.5e38, 1e39, 0.0, -math.inf, 4503599627370497.0, None] and math.isnan(got[10])
