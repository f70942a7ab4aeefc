"""Steps and reports on odd rows: nulls, blank texts, empty tables, ties."""

from pyspark.sql import functions as F

from recall_spark.operators import context as C


def test_fallback_summary(spark):
    rows = [(0, None), (1, " \n\t"), (2, "  kept \n"), (3, "x" * 257)]
    got = {r.k: r.out for r in spark.createDataFrame(rows, "k int, t string").select("k", C.fallback_summary("t", 10).alias("out")).collect()}
    assert got[0] == got[1] == ""
    assert got[2] == C.FALLBACK_WHOLE + "\nkept"
    assert got[3] == C.FALLBACK_CUT + "\n" + "x" * 256


def test_file_ids_in_order_once(spark):
    a, b = "file_" + "a" * 16, "file_" + "b" * 16
    rows = [(0, None), (1, ""), (2, f"{b.upper()} {a}, {b} x{a} {a}0"), (3, "file_12")]
    got = {r.k: r.out for r in spark.createDataFrame(rows, "k int, t string").select("k", C.file_ids("t").alias("out")).collect()}
    assert got == {0: None, 1: [], 2: [b, a], 3: []}


def test_ranges_are_replaced_and_numbered(spark):
    items = spark.createDataFrame([(1, i, f"m{i}") for i in range(6)] + [(2, 0, "n")], "conversation_id int, ordinal long, ref string")
    ranges = spark.createDataFrame([(1, 1, 2, "s0"), (1, 3, 4, "s1")], "conversation_id int, first long, last long, summary string")
    got = sorted(map(tuple, C.replace_ranges(items, ranges).collect()))
    assert got == [(1, 0, "m0"), (1, 1, "s0"), (1, 2, "s1"), (1, 3, "m5"), (2, 0, "n")]
    assert C.replace_ranges(items, ranges.where("false")).count() == 7
    assert C.replace_ranges(items.where("false"), ranges.where("false")).count() == 0


def test_covered_only_by_hidden_leaves(spark):
    links = spark.createDataFrame([(1, 0, 7), (1, 0, 8), (1, 1, 7), (2, 0, 7)], "conversation_id int, ordinal long, leaf int")
    hidden = spark.createDataFrame([(1, 7)], "conversation_id int, leaf int")
    assert [tuple(r) for r in C.covered_only_by(links, hidden).collect()] == [(1, 1)]


def test_cache_misses_treat_nulls_as_equal(spark):
    ask = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("b", None)], "k string, t int")
    held = spark.createDataFrame([("b", None), ("a", 2)], "k string, t int")
    assert sorted(map(tuple, C.cache_misses(ask, held, ["k", "t"]).collect()), key=repr) == [("a", 1), (None, 1)]


def test_bounds_without_nulls(spark):
    low, high, some = C.tighten([F.lit(None).cast("int"), F.col("x")], [F.lit(5), F.lit(None).cast("int")])
    got = spark.createDataFrame([(1,), (5,), (None,)], "x int").select(low, high, some).collect()
    assert [tuple(r) for r in got] == [(1, 5, True), (5, 5, False), (None, 5, True)]


def test_recall_lift_without_common_queries(spark):
    a = spark.createDataFrame([(1, None, 0.5)], "query_id int, stratum string, recall double")
    assert C.recall_lift(a, a.withColumn("query_id", F.lit(2))).count() == 0
    assert [tuple(r) for r in C.recall_lift(a, a.withColumn("recall", F.lit(0.75))).collect()] == [("unknown", 0.5, 0.75, 0.25)]


def test_latest_binding_is_active(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("a", 2, 3), (None, 1, 4)]
    got = {r.i: r.active for r in C.latest_bindings(spark.createDataFrame(rows, "k string, at int, i int"), "k", ["at", "i"]).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}
