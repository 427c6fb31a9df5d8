import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import delivery, difference, references

LOG = "seq bigint, judge string, item_id string, mode string, attempt int, __rank int, n string"
ROWS = [
    (1, "A/b", "x", None, None, 7, "p"), (2, " a/B ", "X ", "reference_free", 1, 8, "q"), (3, "a/b", "x", "grounded", 1, 9, None),
    (4, "a/b", None, None, None, 1, "r"), (5, "a/b", None, None, None, 1, "r"), (6, None, "x", None, 2, 0, "s"), (7, None, "x", None, 2, 0, "s"), (7, None, "x", None, 2, 0, "s"), (None, "a/b", "x", "grounded", None, 3, "t"),
]


def _key():
    from sparkpanel.plans.quality import verdict_key

    return verdict_key()


@pytest.mark.parametrize("limits", [{}, {"hot_share": 0.0, "hot_least": 1}])
def test_one_copy_of_each_message(spark, limits):
    log = spark.createDataFrame(ROWS, LOG)
    kept = delivery.keep_first(log, _key(), F.col("item_id"), "seq", **limits)
    assert kept.columns == log.columns
    assert sorted((r.seq or 0) for r in kept.collect()) == [1, 3, 4, 5, 6]
    extra = delivery.surplus(log, _key(), F.col("item_id"), "seq", **limits)
    assert sorted((r.seq or 0) for r in extra.collect()) == [0, 2, 7, 7]
    assert kept.count() + extra.count() == log.count()


def test_delivery_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "A ", "b", None]), rng.choice(["x", "x", "x", "y", " Y", None]), rng.choice([None, "grounded"]), rng.choice([None, 1, 2]), 0, "") for i in range(400)]
    log = spark.createDataFrame(rows, LOG)
    seen, want = set(), []
    for r in rows:
        norm = lambda v: v if v is None else v.strip().lower()
        k = (norm(r[1]), norm(r[2]), norm(r[3]) or "reference_free", r[4] or 1)
        if r[2] is not None and k in seen:
            want.append(r[0])
        seen.add(k)
    for limits in ({}, {"hot_share": 0.02, "hot_least": 5}):
        assert sorted(r.seq for r in delivery.surplus(log, _key(), F.col("item_id"), "seq", **limits).collect()) == want


def test_stored_rows_come_before_new_ones(spark):
    stored = spark.createDataFrame([(9, "a", "x")], "seq bigint, judge string, item_id string")
    new = spark.createDataFrame([(1, "a", "x", 5), (2, "a", "y", 6)], "seq bigint, judge string, item_id string, more int")
    got = delivery.absorb(stored, new, {"judge": F.col("judge"), "item": F.col("item_id")}, F.col("item_id"), "seq")
    assert {(r.seq, r.more) for r in got.collect()} == {(9, None), (2, 6)}
    empty = stored.limit(0)
    assert delivery.keep_first(empty, {"judge": F.col("judge")}, F.col("item_id"), "seq").count() == 0


def _t(day, hour=0):
    return dt.datetime(2025, 1, day, hour)


def test_orphans_by_reason(spark):
    parents = spark.createDataFrame([("a", _t(2), _t(5)), ("a", _t(8), None), ("a", _t(8), None), ("b", _t(3), _t(3)), ("c", None, _t(4)), (None, _t(1), None)], "id string, a timestamp_ntz, b timestamp_ntz")
    rows = [(1, "a", _t(1)), (2, "a", _t(2)), (3, "a", _t(5)), (4, "a", _t(8)), (5, "b", _t(1)), (6, "b", _t(3)), (7, "c", _t(1)), (8, "c", _t(4)), (9, "d", _t(1)), (10, None, _t(1)), (11, "d", None), (12, "a", None), (13, "a", _t(4, 23)), (14, "d", _t(1))]
    kids = spark.createDataFrame(rows, "seq bigint, k string, t timestamp_ntz")
    find = lambda k, p: {(r.ref_table, r.seq): r.reason for r in references.orphans([references.Child("log", k, F.col("k"), F.col("t"), F.col("seq"))], p, F.col("id"), F.col("a"), F.col("b")).collect()}
    want = {1: "late", 3: "deleted", 5: "late", 6: "deleted", 8: "deleted", 9: "missing", 11: "missing", 14: "missing"}
    assert find(kids, parents) == {("log", k): v for k, v in want.items()}
    assert find(kids.limit(0), parents) == {}
    assert set(find(kids, parents.limit(0)).values()) == {"missing"}


def test_orphans_against_brute_force(spark):
    rng = random.Random(3)
    when = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randrange(4000))
    parents = [(rng.choice("abcdef"), a := when(), rng.choice([None, a + dt.timedelta(minutes=rng.randrange(900))])) for _ in range(12)]
    kids = [(i, rng.choice("abcdefgh"), when()) for i in range(300)]
    want = {}
    for i, k, t in kids:
        own = [p for p in parents if p[0] == k]
        if not any(a <= t and (b is None or t < b) for _, a, b in own):
            want[i] = "missing" if not own else "late" if all(a > t for _, a, _ in own) else "deleted"
    got = references.orphans([references.Child("x", spark.createDataFrame(kids, "seq bigint, k string, t timestamp_ntz"), F.col("k"), F.col("t"), F.col("seq"))], spark.createDataFrame(parents, "id string, a timestamp_ntz, b timestamp_ntz"), F.col("id"), F.col("a"), F.col("b"))
    assert {r.seq: r.reason for r in got.collect()} == want
    assert sum(r.n for r in references.orphan_counts(got).collect()) == len(want)


def test_differences(spark):
    schema = "k string, s bigint, x double, flag boolean, ignored array<string>, note string"
    inf = float("inf")
    left = spark.createDataFrame([("a", 1, 1.0, True, None, "u"), ("a", 1, 1.0, True, None, "v"), ("b", 1, inf, None, [], ""), (None, 2, 0.1, True, None, ""), ("c", 1, 5.0, False, ["x"], ""), ("d", 1, None, True, None, ""), ("e", 1, 2.0, True, None, "")], schema)
    right = spark.createDataFrame([("a", 1, 1.0 + 1e-12, True), ("b", 1, inf, None), (None, 2, 0.2, True), ("c", 1, 6.0, True), ("d", 1, 0.0, True), ("f", 1, 2.0, True)], "k string, s bigint, x double, flag boolean")
    got = {tuple(r) for r in difference.differences(left, right, ["k", "s"], ["x", "flag"]).collect()}
    assert got == {(None, 2, "x", "value"), ("c", 1, "flag", "value"), ("d", 1, "x", "value"), ("e", 1, "", "only_expected"), ("f", 1, "", "only_output")}
    assert difference.differences(left.limit(0), right.limit(0), ["k", "s"], ["x", "flag"]).count() == 0
    assert {r.kind for r in difference.differences(left, right.limit(0), ["k", "s"], ["x", "flag"]).collect()} == {"only_expected"}
    assert difference.differences(left, left, ["k", "s"], ["x", "flag"]).count() == 0


def test_unlike_rows_of_a_key_hide_no_difference(spark):
    schema = "k string, x double, __low0 string, ignored array<string>"
    rows = [("a", 1.0, "", None), ("a", 9.0, "", None), ("b", 1.0, "", None), ("b", None, "", None), ("c", 1.0, "", None), ("c", 2.0, "", None), ("d", 1.0, "", ["x"]), ("d", 2.0, "", ["x"])]
    left = spark.createDataFrame(rows, schema)
    right = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("c", 1.0), ("d", 3.0)], "k string, x double")
    got = {tuple(r) for r in difference.differences(left, right, ["k"], ["x"]).collect()}
    assert got == {("a", "x", "value"), ("b", "x", "value"), ("c", "x", "conflict")}


def test_a_hot_message_with_equal_or_null_order(spark):
    for order in ("cast(null as bigint)", "7L", "id"):
        log = spark.range(500).selectExpr(f"{order} as seq", "'j' as judge", "if(id % 3 = 0, concat('i', id), 'hot') as item_id", "id as clash")
        args = (log, {"judge": F.col("judge"), "item": F.col("item_id")}, F.col("item_id"), "seq", 0.01, 10)
        kept = delivery.keep_first(*args)
        assert kept.count() == 168 and kept.where("item_id = 'hot'").count() == 1
        assert kept.unionByName(delivery.surplus(*args)).select("clash").distinct().count() == 500
        windows = [w for w in delivery.surplus(*args)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in w]
        assert len(windows) == 1  # only the usual groups are ranked in a window


def test_references_without_a_time_or_in_one_hour(spark):
    parents = spark.createDataFrame([("hot", _t(2), _t(2, 6)), ("hot", _t(2, 8), None)], "id string, a timestamp_ntz, b timestamp_ntz")
    kids = spark.range(3000).selectExpr("id as seq", "if(id % 7 = 0, 'gone', 'hot') as k", "case when id % 3 = 0 then null else timestamp_ntz'2025-01-02 05:30:00' + make_dt_interval(0, 0, cast(id % 60 as int), 0) end as t")
    got = references.orphans([references.Child("x", kids, F.col("k"), F.col("t"), F.col("seq"))], parents, F.col("id"), F.col("a"), F.col("b"))
    want = {i: "missing" if i % 7 == 0 else "deleted" for i in range(3000) if i % 7 == 0 or (i % 3 and i % 60 >= 30)}
    assert {r.seq: r.reason for r in got.collect()} == want
