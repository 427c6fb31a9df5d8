import math

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import panel as P
from sparkpanel.operators import sampling as S
from sparkpanel.operators import stats as T
from sparkpanel.plans import panels


def _risk(spark, misses):
    rows = spark.createDataFrame([("f", *m) for m in misses], "family string, m1 int, m2 int, m3 int")
    counts = T.miss_counts(rows, ["family"])
    return T.risk(counts).join(T.overlap_p(counts, ["family"]), "family").first()


@pytest.mark.parametrize(
    ("misses", "corr", "all3", "null3", "lift", "p"),
    [([(1, 1, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0)], 1.0, 0.5, 0.125, 4.0, 1 / 36), ([(0, 0, 0)] * 4, 0.0, 0.0, 0.0, 0.0, 1.0), ([(1, 1, 1)] * 4, 0.0, 1.0, 1.0, 1.0, 1.0)],
)
def test_risk_of_hand_computed_panels(spark, misses, corr, all3, null3, lift, p):
    r = _risk(spark, misses)
    assert (r.fn_corr, r.all3, r.null3, r.lift) == pytest.approx((corr, all3, null3, lift))
    assert r.p == pytest.approx(p, abs=1e-9)


def test_exact_law_has_mass_one_and_the_product_mean(spark):
    n, a, b = 60, 20, 25
    xs = spark.range(n + 1).select(F.col("id").alias("x")).where(f"x <= {a} and x >= {a + b - n}")
    h = xs.select("x", T.hypergeometric(F.lit(n), F.lit(a), F.lit(b), F.col("x")).alias("h")).collect()
    assert sum(r.h for r in h) == pytest.approx(1, abs=1e-10)
    assert sum(r.x * r.h for r in h) == pytest.approx(a * b / n, abs=1e-9)


def test_conventions(spark):
    one = spark.createDataFrame([(0, 0), (0, 10)], "hits int, n int")
    low, high = T.wilson(F.col("hits"), F.col("n"))
    got = one.orderBy("n").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(got[0]) == (0.0, 1.0)
    assert got[1].l == pytest.approx(0, abs=1e-12) and got[1].h == pytest.approx(0.2775, abs=1e-4)
    assert spark.createDataFrame([(0.3,)], "x double").agg(T.std("x").alias("s")).first().s == 0.0
    assert spark.createDataFrame([], "x double").agg(T.std("x").alias("s")).first().s is None
    assert spark.createDataFrame([(1.0,), (math.inf,), (None,)], "x double").agg(T.finite_mean("x").alias("m")).first().m == 1.0
    assert (S.half_up(25, 0.1), S.half_up(25, 0.5)) == (3, 13)


def _wide(spark, rows):
    return spark.createDataFrame(rows, "id string, family string, is_corrupted boolean, v1 string, v2 string, v3 string, g1 string, g2 string, g3 string, flag boolean")


def test_policies(spark):
    t, f, bad = "true", "false", "parse_fail"
    rows = _wide(spark, [("a", "x", True, t, t, bad, f, f, t, True), ("b", "x", True, t, f, bad, None, t, t, True), ("c", "x", False, t, t, t, t, None, t, True), ("d", "x", False, t, t, t, t, t, f, True)])
    got = {(r.id, r.policy): (r.accept, r.escalated) for r in P.decisions(rows).collect()}
    assert got[("a", "rf_majority")] == (True, False) and got[("a", "rf_unanimous")] == (False, False) and got[("a", "risk_routed")] == (False, True)
    assert got[("b", "rf_majority")] == (False, False) and got[("b", "ground_all_accepts")] == (False, False) and got[("b", "always_grounded")] == (None, True)
    assert got[("c", "risk_routed")] == (None, True) and got[("d", "risk_routed")] == (True, True) and got[("a", "disagreement_routed")] == (False, True)
    rates = {r.policy: r for r in P.rates(P.decisions(rows), ["policy"]).collect()}
    assert rates["rf_majority"].false_accept == 0.5 and rates["rf_majority"].true_accept == 1.0
    assert rates["risk_routed"].false_accept is None and rates["risk_routed"].missing_grounded == 1
    bounds = {r.policy: r for r in P.bounds(P.decisions(rows), ["policy"]).collect()}
    assert (bounds["risk_routed"].ta_low, bounds["risk_routed"].ta_high) == (0.5, 1.0)


def test_latest_and_first_verdicts(spark):
    log = spark.createDataFrame([(1, "J", "i", None, "parse_fail"), (2, " j", "I", "reference_free", "true"), (3, "j", "i", "grounded", "false"), (4, "j", "i", "grounded_foil", "true"), (5, None, "i", None, "true")], "seq bigint, judge string, item_id string, mode string, verdict string")
    assert [tuple(r) for r in P.verdicts(log).collect()] == [("j", "i", "true")]
    assert [tuple(r) for r in P.verdicts(log, last=False).collect()] == [("j", "i", "parse_fail")]
    assert [tuple(r) for r in P.verdicts(log, grounded=True, last=False).collect()] == [("j", "i", "false")]
    assert P.coalesced([P.verdicts(log, grounded=True, last=False), P.verdicts(log)]).first().store == 0
    assert [tuple(r) for r in P.todo(spark.createDataFrame([("i",), ("k",)], "id string"), P.verdicts(log), ["j"]).collect()] == [("j", "k")]


def test_ranks_and_splits(spark):
    items = spark.createDataFrame([(f"i{k}", "x" if k % 3 else "y", k % 2 == 0) for k in range(200)], "id string, family string, is_corrupted boolean")
    ranked = S.ranked(items.withColumn("h", S.hashed("s", F.col("id"))), ["family"], "h", "r").collect()
    for family in ("x", "y"):
        mine = sorted((r for r in ranked if r.family == family), key=lambda r: r.h)
        assert [r.r for r in mine] == list(range(1, len(mine) + 1))
    roles = S.split(items, (1, 2), most=20).groupBy("seed", "family", "is_corrupted", "role").count().collect()
    assert {r["count"] for r in roles if r.role == "calibration"} <= {16, 17, 20} and sum(r["count"] for r in roles) == 400


def test_exact_and_replayed_nulls_agree(spark):
    rows = spark.createDataFrame([("f", k, int(k % 2 == 0), int(k % 3 == 0), int(k % 4 == 0)) for k in range(60)], "family string, id int, m1 int, m2 int, m3 int")
    exact = T.risk(T.miss_counts(rows, ["family"])).join(T.overlap_p(T.miss_counts(rows, ["family"]), ["family"]), "family").first()
    replay = T.replay_null(rows, "family", "id", permutations=800).first()
    assert replay.null3 == pytest.approx(exact.null3, abs=0.01) and replay.p == pytest.approx(exact.p, abs=0.05)


def test_hash_null_agrees_with_the_exact_law_below_one_in_41(spark):
    rows = spark.createDataFrame([("f", s, f"i{k}", int(k % 4 == 0), int(k % 4 == 0 or k == 1), int(k % 8 == 0)) for s in (1, 2) for k in range(60)], "family string, seed int, id string, m1 int, m2 int, m3 int")
    exact = T.risk(T.miss_counts(rows, ["seed"])).join(T.overlap_p(T.miss_counts(rows, ["seed"]), ["seed"]), "seed").first()
    got = T.hash_null(rows, ["family", "seed"], 3000, ["seed"]).orderBy("seed").collect()
    assert [r.seed for r in got] == [1, 2] and got[0].null3 != got[1].null3
    for r in got:
        assert r.n == 60 and r.all3 == exact.all3 and r.null3 == pytest.approx(exact.null3, abs=0.005)
        assert r.p < 1 / 41 and r.p == pytest.approx(exact.p, abs=0.005)


def test_bootstrap_of_both_metrics(spark):
    same = [(k % 2, k % 2, k % 2, 0, 0, 0) for k in range(40)]
    none = [(k % 2, k % 3 == 0, 0, k % 2, k % 3 == 0, 0) for k in range(40)]
    rows = spark.createDataFrame([(f, f"i{k}", *map(int, x)) for f, xs in (("same", same), ("none", none)) for k, x in enumerate(xs)], "family string, id string, m1 int, m2 int, m3 int, e1 int, e2 int, e3 int")
    got = {(r.family, r.metric): r for r in T.bootstrap_reductions(rows, ["family"], "id", 5000).collect()}
    assert len(got) == 4 and got[("same", "mean_pair")].reduction == 1 and got[("same", "all3")].reduction == 0.5
    r = got[("same", "all3")]
    half = 1.96 * math.sqrt(0.25 / 40)
    assert (r.low, r.high) == pytest.approx((0.5 - half, 0.5 + half), abs=0.03) and r.p_lower == pytest.approx(1 / 5001)
    assert all((got[("none", m)].reduction, got[("none", m)].low, got[("none", m)].p_lower) == (0, 0, 1) for m in ("mean_pair", "all3"))


def test_random_routing_has_the_mean_of_samples_without_replacement(spark):
    schema = "family string, is_corrupted boolean, rf boolean, una boolean, gm int, n bigint, budget bigint"
    rows = spark.createDataFrame([("f", True, True, True, 0, 30, 40), ("f", True, False, False, 1, 10, 40), ("f", False, True, False, 1, 60, 40), ("g", True, True, True, -1, 5, 3), ("g", False, True, True, 1, 5, 3), ("h", True, True, True, -1, 5, 0)], schema)
    got = {r.family: r for r in T.random_routing(rows, ["family"], 100).collect()}
    # 0.4 of the items are grounded: 18 of 40 corrupted ones keep their acceptance and 4 gain one.
    assert got["f"].false_accept == pytest.approx((0.6 * 30 + 0.4 * 10) / 40, abs=0.02) and got["f"].true_accept == 1 and got["f"].missing_grounded == 0
    assert got["f"].false_accept_std > 0
    assert got["g"].false_accept is None and got["g"].missing_grounded > 0 and got["g"].false_accept_low == pytest.approx(0.7, abs=0.1)
    assert (got["h"].budget, got["h"].false_accept, got["h"].true_accept) == (0, 1.0, None)


@pytest.mark.parametrize("name", ["hash_permutation_null", "replay_permutation_null", "bootstrap_reduction", "policy_random_budget"])
def test_resampling_has_the_sizes_of_the_reference(spark, name):
    assert (panels.PERMUTATIONS, panels.REPLICATES, panels.TRIALS) == (3000, 5000, 100)
    rows = panels.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert {r.seed for r in rows} == set(range(1, 11)) and len({(r.family, r.seed, getattr(r, "metric", None)) for r in rows}) == len(rows)


def test_drift_and_transfer_run_the_grid(spark):
    folder = "/root/testdata/sf0.1"
    drift = panels.drift_mixture(spark, folder).collect()
    cells = {(r.target, r.seed, r.share, r["size"]) for r in drift}
    assert len(drift) == len(cells) == 3 * 10 * 5 * 3 and {r.share for r in drift} == {0.0, 0.1, 0.25, 0.5, 1.0}
    assert all(r.complete and r.n == r["size"] and r.p is not None and r.flag is not None for r in drift)
    assert all(len({(r.fn_corr, r.all3) for r in drift if (r.seed, r["size"]) == (s, 95) and r.share == 0}) == 1 for s in range(1, 11))
    pools = panels.leave_one_family_out(spark, folder).collect()
    assert {(r.target, r.seed) for r in pools} == {(f, s) for f in panels.FAMILIES for s in range(1, 11)} and len(pools) == 50
    assert all((r.pool_n, r.pool_n_clean, r.n_clean, r.n_corrupt) == (150, 150, 150, 150) for r in pools)
    assert all((r.routed > 0) == r.pool_flag and r.routed_calls == 3 * r.routed for r in pools if r.false_accept)
