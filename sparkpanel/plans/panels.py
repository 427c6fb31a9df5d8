"""Queries over panels of judges: risk, routing, resampling experiments and log maintenance."""

from __future__ import annotations

from functools import cache
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spelled, table, written
from ..operators import panel as P
from ..operators import sampling as S
from ..operators import stats as T

#: The panel and the seeds of the splits.
PANEL = ("lumen/arbiter-8b", "quartz/referee-large", "tarn/verity-12b")
SECOND = ("halcyon/juror-v2", "osprey/assayer-mini", "pumice/ledger-7b")
SEEDS = tuple(range(1, 11))
FAMILIES = ("attribute", "entity", "natural", "number", "refutes")
#: Permutations of a sample, resamples of the bootstrap, trials of random routing.
PERMUTATIONS, REPLICATES, TRIALS = 3000, 5000, 100
#: The drift grid. The family of FEVER refutations stands for the reference's negative control, which isn't in the tables.
CONTROL, TARGETS = "refutes", ("number", "entity", "natural")
SHARES, AUDITS, ROLE = (0.0, 0.1, 0.25, 0.5, 1.0), (25, 50, 95), 95


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rf_cache").select("seq", "judge", "item_id", "mode", "verdict", "attempt")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return P.items_once(table(spark, folder, "items"))


def _rf(spark: SparkSession, folder: str) -> DataFrame:
    return P.verdicts(_log(spark, folder))


def _wide(spark: SparkSession, folder: str, panel: tuple[str, ...] = PANEL) -> DataFrame:
    return P.wide_once(_items(spark, folder).select("id", "family", "is_corrupted"), _log(spark, folder), panel)


def _risk(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    counts = written(T.miss_counts(rows.where("is_corrupted"), by), "counts")  # a row for each group, read by both parts
    out = T.risk(counts).join(T.overlap_p(counts, by), list(by), "left").withColumn("p", F.round("p", 8))
    return out.withColumn("flag", T.flagged(F.col("fn_corr"), F.col("lift"), F.col("lift_infinite"), F.coalesce("p", F.lit(1.0))))


def _calibrated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = written(S.split(_wide(spark, folder), SEEDS), "split")
    risk = _risk(rows.where("role = 'calibration'"), ("family", "seed"))
    return rows, risk


def risk_flag_pairwise(spark: SparkSession, folder: str) -> DataFrame:
    return _calibrated(spark, folder)[1].select("family", "seed", "n", "fn_corr", "all3", "null3", "lift", "lift_infinite", "p", "flag")


def risk_by_family(spark: SparkSession, folder: str) -> DataFrame:
    return T.risk(T.miss_counts(_wide(spark, folder).where("is_corrupted"), ["family"])).select("family", "n", "fn_corr", "all3", "null3", "lift", "lift_infinite")


def hash_permutation_null(spark: SparkSession, folder: str) -> DataFrame:
    """Mean overlap and smoothed p over 3000 hash-ranked permutations of the calibration sample of each of the ten seeds."""
    sample = S.split(_wide(spark, folder), SEEDS).where("role = 'calibration' and is_corrupted")
    return T.hash_null(sample.select("family", "seed", "id", "m1", "m2", "m3"), ["family", "seed"], PERMUTATIONS, ["seed"])


def replay_permutation_null(spark: SparkSession, folder: str) -> DataFrame:
    """Overlap, its mean and smoothed p over 3000 seeded shuffles of the calibration sample of each of the ten seeds."""
    sample = S.split(_wide(spark, folder), SEEDS).where("role = 'calibration' and is_corrupted")
    return T.replay_null(sample, ["family", "seed"], "id", PERMUTATIONS, "seed")


def judge_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rf(spark, folder).join(_items(spark, folder).select("id", "gold"), "id")
    return rows.groupBy("judge").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(T.d(F.col("verdict") == F.col("gold"))), 9).alias("accuracy"))


def false_consensus_rate(spark: SparkSession, folder: str) -> DataFrame:
    rows = _wide(spark, folder).where("v1 = v2 and v2 = v3")
    wrong = F.col("v1") != F.when(F.col("is_corrupted"), "false").otherwise("true")
    return rows.groupBy("family").agg(F.count(F.lit(1)).alias("n_agree"), F.round(F.avg(T.d(wrong)), 9).alias("false_consensus"))


def judge_pair_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return P.mean_pair(_rf(spark, folder).join(_items(spark, folder).select("id"), "id"), [])


def panel_judge_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rf(spark, folder).join(_items(spark, folder).select("id", "is_corrupted"), "id")
    bad, yes = F.col("is_corrupted"), F.col("verdict") == "true"
    return rows.groupBy("judge").agg(F.round(T.rate(F.count_if(bad & yes), F.count_if(bad)), 9).alias("false_negative"), F.round(T.rate(F.count_if(~bad & yes), F.count_if(~bad)), 9).alias("true_accept"), F.count_if(F.col("verdict") == "parse_fail").alias("parse_fail"))


def balanced_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    bad, yes = F.col("is_corrupted"), P.majority()
    tp, tn = T.rate(F.count_if(~bad & yes), F.count_if(~bad)), T.rate(F.count_if(bad & ~yes), F.count_if(bad))
    return _wide(spark, folder).groupBy("family").agg(F.round((F.coalesce(tp, F.lit(0.0)) + F.coalesce(tn, F.lit(0.0))) / 2, 9).alias("balanced_accuracy"))


def parse_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rf(spark, folder).rollup("judge").agg(F.count_if(F.col("verdict") == "parse_fail").alias("n_fail"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.coalesce("judge", F.lit("(all)")).alias("judge"), "n_fail", "n")


def verdict_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _rf(spark, folder).groupBy("judge", "verdict").agg(F.count(F.lit(1)).alias("n"))


def verdict_first(spark: SparkSession, folder: str) -> DataFrame:
    return P.verdicts(_log(spark, folder), grounded=True, last=False)


def verdict_store_priority(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    return P.coalesced([P.verdicts(log, grounded=True, last=False), P.verdicts(log)]).groupBy("store", "verdict").agg(F.count(F.lit(1)).alias("n"))


def todo_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return P.todo(_items(spark, folder), _rf(spark, folder), PANEL)


def complete_case_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _wide(spark, folder).where(" and ".join(f"v{i} in ('true', 'false')" for i in (1, 2, 3))).select("id", "family", "is_corrupted")


def cache_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Grounded verdicts of majority accepts that are missing or failed, by family."""
    rows = _wide(spark, folder).where(P.majority())
    each = rows.select("family", F.explode(F.array("g1", "g2", "g3")).alias("g"))
    return each.groupBy("family").agg(F.count_if(F.col("g").isNull()).alias("n_missing"), F.count_if(F.coalesce(F.col("g") == "parse_fail", F.lit(False))).alias("n_failed"), F.count(F.lit(1)).alias("n_needed"))


def _decided(spark: SparkSession, folder: str) -> DataFrame:
    rows, risk = _calibrated(spark, folder)
    deployed = rows.where("role = 'deployment'").join(F.broadcast(risk.select("family", "seed", "flag")), ["family", "seed"], "left")  # a row for each family and seed
    return P.decisions(deployed)


def policy_rates(spark: SparkSession, folder: str) -> DataFrame:
    return P.rates(_decided(spark, folder), ["family", "seed", "policy"])


def policy_bounds_missing(spark: SparkSession, folder: str) -> DataFrame:
    return P.bounds(_decided(spark, folder), ["family", "seed", "policy"])


#: What a summary over seeds has the mean and deviation of.
METRICS = ("false_accept", "true_accept", "false_consensus", "extra_verifier_items", "extra_verifier_calls", "extra_model_calls")


def policy_summary_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of six metrics over the seeds, by family and policy."""
    named = [F.round(f(c), 7).alias(f"{c}_{k}") for c in METRICS for k, f in (("mean", F.avg), ("std", T.std))]
    return policy_rates(spark, folder).groupBy("family", "policy").agg(*named, (F.sum("missing_grounded") == 0).alias("all_complete"), F.sum("missing_grounded").cast("bigint").alias("missing_total"))


def identity_check(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged splits in which risk routing and grounding all accepts decide unlike, counted by item."""
    rows = _decided(spark, folder).where("flag and policy in ('risk_routed', 'ground_all_accepts')")
    pairs = rows.groupBy("family", "seed", "id").agg(F.max(F.when(F.col("policy") == "risk_routed", F.coalesce(F.col("accept").cast("string"), F.lit("none")))).alias("a"), F.max(F.when(F.col("policy") == "ground_all_accepts", F.coalesce(F.col("accept").cast("string"), F.lit("none")))).alias("b"))
    return pairs.groupBy("family", "seed").agg(F.count_if(F.col("a") != F.col("b")).alias("violations"), F.count(F.lit(1)).alias("n"))


def policy_random_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Random routing over 100 trials in each family and seed, with the number of items that risk routing escalates there."""
    gm = F.coalesce(P.grounded_majority().cast("int"), F.lit(-1))  # -1: no grounded answer
    kinds = ["family", "seed", "is_corrupted", "m1", "m2", "m3", P.majority().alias("rf"), P.unanimous().alias("una"), gm.alias("gm")]
    every = written(S.split(_wide(spark, folder), SEEDS).groupBy(*kinds, "role").agg(F.count(F.lit(1)).alias("n")), "kinds")  # a row for each kind of item, not for each item
    risk = _risk(every.where("role = 'calibration'").withColumn("copy", F.explode(F.expr("sequence(1, n)"))), ("family", "seed"))
    counts = every.where("role = 'deployment'").groupBy("family", "seed", "is_corrupted", "rf", "una", "gm").agg(F.sum("n").alias("n"))
    budget = counts.groupBy("family", "seed").agg(F.sum(F.when(F.col("rf"), F.col("n")).otherwise(0)).alias("accepts"))
    flag = risk.select("family", "seed", "flag")
    known = counts.join(budget, ["family", "seed"]).join(flag, ["family", "seed"], "left").withColumn("budget", F.when(F.col("flag"), F.col("accepts")).otherwise(0))
    return T.random_routing(known, ["family", "seed"], TRIALS)


def cross_family(spark: SparkSession, folder: str) -> DataFrame:
    risk = risk_flag_pairwise(spark, folder)
    return risk.groupBy("family").agg(F.round(F.avg("fn_corr"), 8).alias("corr_mean"), F.round(T.finite_mean("lift"), 8).alias("lift_mean"), F.count_if("lift_infinite").alias("n_infinite"), F.count_if("flag").alias("n_flagged"), F.min("fn_corr").alias("corr_min"), F.max("fn_corr").alias("corr_max"))


def threshold_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """For each single-statistic rule, the splits it decides unlike the conjunction."""
    risk = risk_flag_pairwise(spark, folder)
    rules = {"corr": F.col("fn_corr") > T.MAX_CORRELATION, "lift": F.col("lift_infinite") | F.coalesce(F.col("lift") > T.MAX_LIFT, F.lit(False)), "p": F.coalesce(F.col("p") < T.MAX_P, F.lit(False))}
    each = F.array(*(F.struct(F.lit(k).alias("rule"), (c != F.col("flag")).alias("differs")) for k, c in rules.items()))
    return risk.select(F.explode(each).alias("x")).select("x.*").groupBy("rule").agg(F.count_if("differs").alias("errors"), F.count(F.lit(1)).alias("n"))


def invariance_region(spark: SparkSession, folder: str) -> DataFrame:
    """How far each threshold may move, the others fixed, without any decision changing: from low up to, but not including, high; null if no split is flagged (or, for p, none isn't)."""
    risk = risk_flag_pairwise(spark, folder)
    flagged, unflagged = F.col("flag"), ~F.col("flag")
    least = lambda c: F.min(F.when(flagged, c))
    lift = F.when(F.col("lift_infinite"), F.lit(float("inf"))).otherwise(F.col("lift"))
    ends = risk.agg(least(F.col("fn_corr")).alias("corr"), least(lift).alias("lift"), F.max(F.when(flagged, F.col("p"))).alias("p_low"), F.min(F.when(unflagged, F.col("p"))).alias("p_high"))
    each = F.array(*(F.struct(F.lit(k).alias("statistic"), low.alias("low"), F.col(high).alias("high")) for k, low, high in (("fn_corr", F.lit(0.0), "corr"), ("lift", F.lit(0.0), "lift"), ("p", F.col("p_low"), "p_high"))))
    return ends.select(F.explode(each).alias("x")).select("x.*")


def wilson_policy_rates(spark: SparkSession, folder: str) -> DataFrame:
    rows = _wide(spark, folder).where("is_corrupted").groupBy("family").agg(F.count_if(P.majority()).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = T.wilson(F.col("hits"), F.col("n"))
    return rows.select("family", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def _accepts(by: list[str], rows: DataFrame, name: str = "") -> DataFrame:
    """Rates of plain majority and unanimity, and how many items the majority accepts."""
    bad, yes = F.col("is_corrupted"), P.majority()
    rates = {"false_accept": T.rate(F.count_if(bad & yes), F.count_if(bad)), "true_accept": T.rate(F.count_if(~bad & yes), F.count_if(~bad)), "false_consensus": T.rate(F.count_if(bad & P.unanimous()), F.count_if(bad))}
    return rows.groupBy(*by).agg(F.count_if(~bad).alias(f"{name}n_clean"), F.count_if(bad).alias(f"{name}n_corrupt"), *(F.round(c, 9).alias(name + k) for k, c in rates.items()), F.count_if(yes).alias("accepts"))


def drift_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The whole drift experiment: the risk of an audit that mixes a target family into the control, for each target, seed, share and audit size.

    The control's items have disjoint roles: the first 95 of a class calibrate, the next 95 are evaluated, the next 95
    audited; of a target's corrupted items the first 95 are evaluated and the next 95 audited. The evaluation stream
    keeps plain majority; ``routed`` counts its accepts if the audit is flagged. Where a family has too few items for
    its roles, ``complete`` is false and the n are short.
    """
    rows = _wide(spark, folder).where(F.col("family").isin(CONTROL, *TARGETS)).where((F.col("family") == CONTROL) | F.col("is_corrupted"))
    each = rows.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS)))).withColumn("h", S.hashed("drift", F.col("seed"), F.col("family"), F.col("is_corrupted"), F.col("id")))
    own = F.col("family") == CONTROL
    top = S.ranked(each, ["family", "seed", "is_corrupted"], "h", "place").where(F.col("place") <= F.when(own, 3 * ROLE).otherwise(2 * ROLE))
    past = F.when(own, F.floor((F.col("place") - 1) / ROLE)).otherwise(F.floor((F.col("place") - 1) / ROLE) + 1)
    pools = written(top.withColumn("role", F.element_at(F.array(*map(F.lit, ("initial", "evaluation", "audit"))), (past + 1).cast("int"))).withColumn("at", (F.col("place") - 1) % ROLE + 1).drop("h", "place"), "pools")
    keys = ["target", "seed", "share", "size"]

    def mixed(role: str, sizes: tuple[int, ...]) -> DataFrame:
        """Clean and corrupted items of the role, the latter by share, in each cell of the grid."""
        cells = spark.createDataFrame([(t, x, n, S.half_up(n, x)) for t in TARGETS for x in SHARES for n in sizes], "target string, share double, size int, part int")
        cut = F.when(~F.col("is_corrupted"), F.col("size")).when(own, F.col("size") - F.col("part")).otherwise(F.col("part"))
        return pools.where(F.col("role") == role).join(F.broadcast(cells), own | (F.col("family") == F.col("target"))).where(F.col("at") <= cut)  # a row for each cell

    start = pools.where("role = 'initial'")
    initial = _risk(start, ("seed",)).select("seed", F.col("n").alias("initial_n"), F.col("flag").alias("initial_flag"))
    stream = _accepts(keys[:3], mixed("evaluation", (ROLE,)), "eval_")
    audits = _risk(mixed("audit", AUDITS), tuple(keys))
    out = audits.join(initial, "seed").join(stream, keys[:3])
    full = (F.col("initial_n") == ROLE) & (F.col("n") == F.col("size")) & (F.col("eval_n_corrupt") == ROLE) & (F.col("eval_n_clean") == ROLE)
    return out.select(*keys, "initial_n", "initial_flag", "n", "fn_corr", "all3", "null3", "lift", "lift_infinite", "p", "flag", "eval_n_clean", "eval_n_corrupt", "eval_false_accept", "eval_true_accept", "eval_false_consensus", F.when(F.col("flag"), F.col("accepts")).otherwise(0).alias("routed"), full.alias("complete"))


def leave_one_family_out(spark: SparkSession, folder: str) -> DataFrame:
    """For each target and seed: the risk of 150 corrupted items pooled from all other families, the target's own, and routing of the target by the pooled flag.

    Donors share each class by balanced quotas in an order seeded for it. The target is judged on at most 150 items of
    each class, at most half of the smaller one; its own flag is for comparison and routes nothing. Clean pooled items
    enter no risk figure and are only counted.
    """
    rows = written(_wide(spark, folder).drop("g1", "g2", "g3"), "wide")
    each = rows.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    placed = S.ranked(each.withColumn("h", S.hashed("source", F.col("seed"), F.col("family"), F.col("is_corrupted"), F.col("id"))), ["family", "seed", "is_corrupted"], "h", "place").where("place <= 150")
    from pyspark.sql import Window

    donors = [(t, f, seed, bad) for t in FAMILIES for f in FAMILIES if f != t for seed in SEEDS for bad in (False, True)]
    order = Window.partitionBy("target", "seed", "is_corrupted").orderBy(S.hashed("quota", F.col("seed"), F.col("target"), F.col("is_corrupted"), F.col("family")))
    quota = spark.createDataFrame(donors, "target string, family string, seed int, is_corrupted boolean").withColumn("quota", S.quotas(150, F.row_number().over(order), F.lit(len(FAMILIES) - 1)))
    pooled = written(placed.join(F.broadcast(quota), ["family", "seed", "is_corrupted"]).where("place <= quota"), "pooled")  # a row for each donor and seed
    source = _risk(pooled, ("target", "seed")).select("target", "seed", *(F.col(c).alias(f"pool_{c}") for c in ("n", "fn_corr", "all3", "lift", "lift_infinite", "p", "flag")))
    clean = pooled.groupBy("target", "seed").agg(F.count_if(~F.col("is_corrupted")).alias("pool_n_clean"))
    sizes = rows.groupBy("family").agg(F.least(F.lit(150), F.floor(F.count_if(F.col("is_corrupted")) / 2), F.floor(F.count_if(~F.col("is_corrupted")) / 2)).alias("most"))
    ranked = S.ranked(each.withColumn("h", S.hashed("target", F.col("seed"), F.col("family"), F.col("is_corrupted"), F.col("id"))), ["family", "seed", "is_corrupted"], "h", "place")
    target = written(ranked.join(F.broadcast(sizes), "family").where("place <= most").withColumn("target", F.col("family")), "target")  # a row for each family
    own = _risk(target, ("target", "seed")).select("target", "seed", *(F.col(c).alias(f"own_{c}") for c in ("fn_corr", "all3", "lift", "lift_infinite", "p", "flag")))
    out = source.join(clean, ["target", "seed"]).join(own, ["target", "seed"]).join(_accepts(["target", "seed"], target), ["target", "seed"])
    routed = F.when(F.col("pool_flag"), F.col("accepts")).otherwise(0)
    return out.select("*", routed.alias("routed"), (3 * routed).alias("routed_calls")).drop("accepts")


def utility_breakeven(spark: SparkSession, folder: str) -> DataFrame:
    """For each family, seed and policy against plain majority: false accepts avoided, references spent and the price at which they cancel."""
    r = policy_rates(spark, folder).select("family", "seed", "policy", "false_accept", "n_corrupt", "extra_verifier_items")
    base = r.where("policy = 'rf_majority'").select("family", "seed", F.col("false_accept").alias("base"))
    saved = (F.col("base") - F.col("false_accept")) * F.col("n_corrupt")
    return r.where("policy <> 'rf_majority'").join(base, ["family", "seed"]).where("false_accept is not null").select("family", "seed", "policy", F.round(saved, 6).alias("avoided"), "extra_verifier_items", F.when(F.col("extra_verifier_items") > 0, F.round(saved / F.col("extra_verifier_items"), 8)).alias("breakeven"))


def bootstrap_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """Reductions by grounding in the pairwise correlation and the triple misses over 5000 resamples, for each family and seed.

    Calibration items without a grounded verdict of every judge are left out, as no model is called; n counts the rest.
    """
    sample = S.split(_wide(spark, folder), SEEDS).where("role = 'calibration' and is_corrupted and g1 is not null and g2 is not null and g3 is not null")
    return T.bootstrap_reductions(sample.withColumns({f"e{i}": (F.col(f"g{i}") == "true").cast("int") for i in (1, 2, 3)}), ["family", "seed"], "id", REPLICATES)


def family_inference(spark: SparkSession, folder: str) -> DataFrame:
    """The family by the stem of the id against the stored one."""
    stems = {"num": "number", "ent": "entity", "att": "attribute", "nat": "natural", "ref": "refutes", "ctl": "control"}
    stem = F.substring_index(F.col("id"), "_", 1)
    named = F.coalesce(F.element_at(F.create_map(*(x for k, v in stems.items() for x in (F.lit(k), F.lit(v)))), stem), F.lit("unknown"))
    return _items(spark, folder).groupBy(named.alias("inferred"), "family").agg(F.count(F.lit(1)).alias("n"))


def collapse_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Families whose dependence collapses: correlation below 0.10 and lift below 1.3."""
    r = risk_by_family(spark, folder)
    return r.select("family", ((F.col("fn_corr") < 0.10) & ~F.col("lift_infinite") & F.coalesce(F.col("lift") < 1.3, F.lit(False))).alias("collapsed"))


QUERIES = {
    f.__name__: f
    for f in (
        bootstrap_reduction, hash_permutation_null, policy_random_budget, drift_mixture, leave_one_family_out, family_inference, collapse_rule, risk_flag_pairwise, risk_by_family, replay_permutation_null, judge_accuracy, false_consensus_rate, judge_pair_agreement, panel_judge_metrics,
        balanced_accuracy, parse_failures, verdict_latest, verdict_first, verdict_store_priority, todo_anti_join, complete_case_filter, cache_repair, policy_rates, policy_bounds_missing, policy_summary_mean_std, identity_check,
        cross_family, threshold_ablation, invariance_region, wilson_policy_rates, utility_breakeven,
    )
}


@cache
def _sql() -> tuple[dict[str, str], SimpleNamespace]:
    s = "lower(trim({}, ' \t\n\r '))".format
    mode = f"coalesce({s('mode')}, 'reference_free')"

    def across(alias: str, name: str, panel: tuple[str, ...]) -> str:
        return ", ".join(f"max(case when judge = '{j}' then verdict end) {name}{i}" for i, j in enumerate(panel, 1)) + f" from {alias} where judge in ({', '.join(map(repr, panel))}) group by id"

    def picked(grounded: bool, order: str) -> str:
        where = f"starts_with({mode}, 'grounded')" if grounded else f"{mode} = 'reference_free'"
        return f"select judge, id, verdict from (select {s('judge')} judge, {s('item_id')} id, verdict, row_number() over (partition by {s('judge')}, {s('item_id')} order by seq {order}) rn from rf_cache where judge is not null and item_id is not null and {where}) where rn = 1"

    def base(panel: tuple[str, ...] = PANEL, w: str = "w") -> str:
        return f"""it as (select id, kind family, is_corrupted, gold, statement, source_dataset, length_bin from (select *, row_number() over (partition by {s('id')} order by seq desc) rn from (select * replace ({s('id')} as id) from items where id is not null)) where rn = 1 and kind is not null and kind <> 'control' and is_corrupted is not null),
rf as ({picked(False, 'desc')}), gr as ({picked(True, 'asc')}),
{w}v as (select id, {across('rf', 'v', panel)}), {w}g as (select id, {across('gr', 'g', panel)}),
{w}0 as (select it.id, family, is_corrupted, coalesce(v1, 'parse_fail') v1, coalesce(v2, 'parse_fail') v2, coalesce(v3, 'parse_fail') v3, g1, g2, g3 from it left join {w}v on it.id = {w}v.id left join {w}g on it.id = {w}g.id),
{w} as (select *, (is_corrupted and v1 = 'true')::bigint m1, (is_corrupted and v2 = 'true')::bigint m2, (is_corrupted and v3 = 'true')::bigint m3,
 (v1 = 'true')::int + (v2 = 'true')::int + (v3 = 'true')::int >= 2 rfm, v1 = 'true' and v2 = 'true' and v3 = 'true' una,
 case when g1 is not null and g2 is not null and g3 is not null then (g1 = 'true')::int + (g2 = 'true')::int + (g3 = 'true')::int >= 2 end gm,
 v1 not in ('true', 'false') or v2 not in ('true', 'false') or v3 not in ('true', 'false') or v1 <> v2 or v1 <> v3 dis from {w}0)"""

    def corr(a: str, b: str, ab: str) -> str:
        z = f"(n::double * {a}::double - {a}::double * {a}::double) * (n::double * {b}::double - {b}::double * {b}::double)"
        return f"(case when {z} > 0 then (n::double * {ab}::double - {a}::double * {b}::double) / sqrt({z}) else 0.0::double end)"

    def risk(source: str, by: str, name: str = "risk") -> str:
        null3 = "(s1::double * s2::double * s3::double / (n::double * n::double * n::double))"
        return f"""{name}c as (select {by}, count(*) n, sum(m1)::bigint s1, sum(m2)::bigint s2, sum(m3)::bigint s3, sum(m1 * m2)::bigint s12, sum(m1 * m3)::bigint s13, sum(m2 * m3)::bigint s23, sum(m1 * m2 * m3)::bigint s123 from {source} group by {by}),
{name}0 as (select *, round(({corr('s1', 's2', 's12')} + {corr('s1', 's3', 's13')} + {corr('s2', 's3', 's23')}) / 3, 9) fn_corr, round(s123::double / n::double, 9) all3, round({null3}, 9) null3,
 case when {null3} > 0 then round(s123::double / n::double / {null3}, 9) when s123 = 0 then 0.0::double end lift, ({null3} = 0 and s123 > 0) lift_infinite from {name}c)"""

    def hg(n: str, k: str, m: str, x: str) -> str:
        f = lambda e: f"lgamma(({e})::double + 1)"
        return f"exp({f(k)} - {f(x)} - {f(f'{k} - {x}')} + {f(f'{n} - {k}')} - {f(f'{m} - {x}')} - {f(f'{n} - {k} - {m} + {x}')} - {f(n)} + {f(m)} + {f(f'{n} - {m}')})"

    split = f"""sp as (select w.*, seed, row_number() over (partition by family, seed, is_corrupted order by sha256(concat_ws('|', 'split', seed, id))) rk, count(*) over (partition by family, seed, is_corrupted) nn from w, (select unnest([{', '.join(map(str, SEEDS))}]) seed)),
roles as (select *, case when rk <= least(150, floor(nn / 2.0)) then 'calibration' else 'deployment' end as role from sp),
cal as (select * from roles where role = 'calibration' and is_corrupted)"""
    def law(by: str, name: str = "risk") -> str:
        """Exact p and flag of each group of {name}0 as {name}f."""
        on = lambda x, y: " and ".join(f"{x}.{c.strip()} = {y}.{c.strip()}" for c in by.split(","))
        return f"""{name}x as (select {by}, n, s1, s2, s3, s123, x from {name}c, (select unnest(range(0, 151)) x) where x <= n and x <= least(s1, s2) and x >= s1 + s2 - n),
{name}t as (select *, t from {name}x, (select unnest(range(0, 151)) t) where t <= n and t >= s123 and t <= least(x, s3) and t >= x + s3 - n),
{name}p as (select {by}, round(least(1.0::double, sum({hg('n', 's1', 's2', 'x')} * {hg('n', 'x', 's3', 't')})), 8) p from {name}t group by {by}),
{name}f as (select r.*, p, (fn_corr > {T.MAX_CORRELATION} and (lift_infinite or coalesce(lift > {T.MAX_LIFT}, false)) and coalesce(p, 1.0) < {T.MAX_P}) flag from {name}0 r left join {name}p q on {on('r', 'q')})"""

    p = law("family, seed") + ", fl as (select family, seed, n, fn_corr, all3, null3, lift, lift_infinite, p, flag from riskf)"
    flags = f"{base()}, {split}, {risk('cal', 'family, seed')}, {p}"
    route = {"rf_majority": ("rfm", "false"), "rf_unanimous": ("una", "false"), "always_grounded": ("gm", "true"), "risk_routed": ("case when coalesce(flag, false) and rfm then gm else rfm end", "coalesce(flag, false) and rfm"), "ground_all_accepts": ("case when rfm then gm else false end", "rfm"), "disagreement_routed": ("case when dis then gm else rfm end", "dis")}
    dec = "dep as (select r.*, flag from roles r left join fl on r.family = fl.family and r.seed = fl.seed where role = 'deployment'), dc as (" + " union all ".join(f"select id, family, seed, is_corrupted, una, flag, '{k}' as policy, {a} as accept, {e} as escalated from dep" for k, (a, e) in route.items()) + ")"
    ratio = lambda part, whole: f"round(case when {whole} > 0 then ({part})::double / ({whole})::double end, 9)"
    cnt = lambda c: f"count(*) filter (where {c})"
    rates = f"""pr as (select family, seed, policy, {cnt('is_corrupted')} n_corrupt, {cnt('not is_corrupted')} n_clean, {cnt('accept is null')} missing_grounded,
 case when {cnt('accept is null')} = 0 then {ratio(cnt('is_corrupted and accept'), cnt('is_corrupted'))} end false_accept, case when {cnt('accept is null')} = 0 then {ratio(cnt('not is_corrupted and accept'), cnt('not is_corrupted'))} end true_accept,
 case when {cnt('accept is null')} = 0 then {ratio(cnt('is_corrupted and accept and una'), cnt('is_corrupted'))} end false_consensus, {cnt('escalated')} extra_verifier_items, {cnt('escalated')} extra_verifier_calls, 3 * {cnt('escalated')} extra_model_calls from dc group by all)"""
    full = f"{flags}, {dec}, {rates}"
    wil = "hits::double / n::double"
    z = T.Z95
    mid, half = f"(({wil} + {z * z!r} / (2 * n)) / (1 + {z * z!r} / n))", f"({z!r} * sqrt({wil} * (1 - {wil}) / n + {z * z!r} / (4 * n::double * n)) / (1 + {z * z!r} / n))"
    out = {
        "risk_flag_pairwise": f"with {flags} select family, seed, n, fn_corr, all3, null3, lift, lift_infinite, p, flag from fl",
        "risk_by_family": f"with {base()}, bad as (select * from w where is_corrupted), {risk('bad', 'family')} select family, n, fn_corr, all3, null3, lift, lift_infinite from risk0",
        "hash_permutation_null": f"""with {base()}, {split}, smp as (select family, seed, id, m1, m2, m3 from cal),
lg as (select family, seed, id, 1 judge, m1 miss from smp union all select family, seed, id, 2, m2 from smp union all select family, seed, id, 3, m3 from smp),
pl as (select family, seed, b, miss, row_number() over (partition by family, seed, b, judge order by sha256(concat_ws('|', 'perm', seed, b, judge, id))) place from lg, (select unnest(range(1, {PERMUTATIONS + 1})) b)),
ht as (select family, seed, b, sum(a)::bigint t, count(*) n from (select family, seed, b, place, min(miss) a from pl group by all) group by all), ob as (select family, seed, sum(m1 * m2 * m3)::bigint obs from smp group by all)
select ht.family, ht.seed, max(n) n, round(max(obs::double / n), 9) all3, round(avg(t::double / n::double), 9) null3, round(({cnt('t >= obs')}::double + 1) / {PERMUTATIONS + 1}.0::double, 9) p from ht join ob on ht.family = ob.family and ht.seed = ob.seed group by all""",
        "judge_accuracy": f"with {base()} select judge, count(*) n, round(avg((verdict = gold)::int::double), 9) accuracy from rf join it using (id) group by judge",
        "false_consensus_rate": f"with {base()} select family, count(*) n_agree, round(avg((v1 <> case when is_corrupted then 'false' else 'true' end)::int::double), 9) false_consensus from w where v1 = v2 and v2 = v3 group by family",
        "judge_pair_agreement": f"with {base()}, x as (select rf.* from rf join it using (id)) select a.judge judge_a, b.judge judge_b, count(*) n, round(avg((a.verdict = b.verdict)::int::double), 9) agreement from x a join x b on a.id = b.id and a.judge < b.judge group by all",
        "panel_judge_metrics": f"with {base()} select judge, {ratio(cnt(chr(39).join(['is_corrupted and verdict = ', 'true', ''])), cnt('is_corrupted'))} false_negative, {ratio(cnt(chr(39).join(['not is_corrupted and verdict = ', 'true', ''])), cnt('not is_corrupted'))} true_accept, count(*) filter (where verdict = 'parse_fail') parse_fail from rf join it using (id) group by judge",
        "balanced_accuracy": f"with {base()} select family, round((coalesce({cnt('not is_corrupted and rfm')}::double / nullif({cnt('not is_corrupted')}, 0), 0.0) + coalesce({cnt('is_corrupted and not rfm')}::double / nullif({cnt('is_corrupted')}, 0), 0.0)) / 2, 9) balanced_accuracy from w group by family",
        "parse_failures": f"with {base()} select coalesce(judge, '(all)') judge, count(*) filter (where verdict = 'parse_fail') n_fail, count(*) n from rf group by rollup (judge)",
        "verdict_latest": f"with {base()} select judge, verdict, count(*) n from rf group by all",
        "verdict_first": f"with {base()} select judge, id, verdict from gr",
        "verdict_store_priority": f"with {base()} select store, verdict, count(*) n from (select coalesce(gr.judge, rf.judge) judge, case when gr.judge is not null then 0 else 1 end::int store, case when gr.judge is not null then gr.verdict else rf.verdict end verdict from gr full join rf on gr.judge = rf.judge and gr.id = rf.id) group by all",
        "todo_anti_join": f"with {base()}, want as (select id, unnest([{', '.join(map(repr, PANEL))}]) judge from it) select judge, id from want anti join (select * from rf where verdict in ('true', 'false')) ok using (judge, id)",
        "complete_case_filter": f"with {base()} select id, family, is_corrupted from w where v1 <> 'parse_fail' and v2 <> 'parse_fail' and v3 <> 'parse_fail'",
        "cache_repair": f"with {base()}, e as (select family, unnest([g1, g2, g3]) g from w where rfm) select family, {cnt('g is null')} n_missing, count(*) filter (where g = 'parse_fail') n_failed, count(*) n_needed from e group by family",
        "policy_rates": f"with {full} select * from pr",
        "policy_bounds_missing": f"with {flags}, {dec} select family, seed, policy, " + ", ".join(f"coalesce(round(({cnt(f'{c} and accept')} + {extra})::double / nullif({cnt(c)}, 0), 9), 0.0) {name}" for c, a in (("is_corrupted", "fa"), ("not is_corrupted", "ta")) for name, extra in ((f"{a}_low", "0"), (f"{a}_high", cnt(f"{c} and accept is null")))) + " from dc group by all",
        "policy_summary_mean_std": f"with {full} select family, policy, " + ", ".join(f"round(avg({c}), 7) {c}_mean, round(case when count({c}) = 1 then 0.0 else stddev_samp({c}) end, 7) {c}_std" for c in METRICS) + ", sum(missing_grounded) = 0 all_complete, sum(missing_grounded)::bigint missing_total from pr group by family, policy",
        "identity_check": f"with {flags}, {dec} select family, seed, count(*) filter (where a.accept is distinct from b.accept) violations, count(*) n from (select * from dc where policy = 'risk_routed' and flag) a join (select family, seed, id, accept from dc where policy = 'ground_all_accepts' and flag) b using (family, seed, id) group by family, seed",
        "cross_family": f"with {flags} select family, round(avg(fn_corr), 8) corr_mean, round(avg(lift), 8) lift_mean, {cnt('lift_infinite')} n_infinite, {cnt('flag')} n_flagged, min(fn_corr) corr_min, max(fn_corr) corr_max from fl group by family",
        "threshold_ablation": f"with {flags}, e as (" + " union all ".join(f"select '{k}' as rule, ({c}) <> flag differs from fl" for k, c in (("corr", f"fn_corr > {T.MAX_CORRELATION}"), ("lift", f"lift_infinite or coalesce(lift > {T.MAX_LIFT}, false)"), ("p", f"coalesce(p < {T.MAX_P}, false)"))) + f") select rule, {cnt('differs')} errors, count(*) n from e group by rule",
        "invariance_region": f"""with {flags}, e as (select min(fn_corr) filter (where flag) c, min(case when lift_infinite then 'inf'::double else lift end) filter (where flag) l, max(p) filter (where flag) pl, min(p) filter (where not flag) ph from fl)
select 'fn_corr' as statistic, 0.0::double low, c as high from e union all select 'lift', 0.0::double, l from e union all select 'p', pl, ph from e""",
        "wilson_policy_rates": f"with {base()}, h as (select family, {cnt('rfm')} hits, count(*) n from w where is_corrupted group by family) select family, hits, n, round(greatest(0.0, {mid} - {half}), 9) low, round(least(1.0, {mid} + {half}), 9) high from h",
        "utility_breakeven": f"with {full}, r as (select * from pr) select r.family, r.seed, r.policy, round((b.false_accept - r.false_accept) * r.n_corrupt, 6) avoided, r.extra_verifier_items, case when r.extra_verifier_items > 0 then round((b.false_accept - r.false_accept) * r.n_corrupt / r.extra_verifier_items, 8) end breakeven from r join (select family, seed, false_accept from r where policy = 'rf_majority') b on r.family = b.family and r.seed = b.seed where r.policy <> 'rf_majority' and r.false_accept is not null",
    }
    seeds = f"(select unnest([{', '.join(map(str, SEEDS))}]) seed)"
    rate3 = lambda pre="": f"{cnt('not is_corrupted')} {pre}n_clean, {cnt('is_corrupted')} {pre}n_corrupt, {ratio(cnt('is_corrupted and rfm'), cnt('is_corrupted'))} {pre}false_accept, {ratio(cnt('not is_corrupted and rfm'), cnt('not is_corrupted'))} {pre}true_accept, {ratio(cnt('is_corrupted and una'), cnt('is_corrupted'))} {pre}false_consensus, {cnt('rfm')} accepts"
    at = lambda word: f"row_number() over (partition by family, seed, is_corrupted order by sha256(concat_ws('|', '{word}', seed, family, is_corrupted, id))) place"
    both = lambda pre, names: ", ".join(f"{pre}.{c} {pre}_{c}" for c in names)
    told = ("fn_corr", "all3", "lift", "lift_infinite", "p", "flag")
    out["leave_one_family_out"] = f"""with {base()}, ea as (select * from w, {seeds}), src as (select *, {at('source')} from ea), qt as (select *, {150 // (len(FAMILIES) - 1)} + (row_number() over (partition by target, seed, bad order by sha256(concat_ws('|', 'quota', seed, target, bad, donor))) <= {150 % (len(FAMILIES) - 1)})::int quota
 from (select unnest([{', '.join(map(repr, FAMILIES))}]) target), (select unnest([{', '.join(map(repr, FAMILIES))}]) donor), (select unnest([true, false]) bad), {seeds} where target <> donor),
po as (select src.*, target from src join qt on src.family = donor and src.seed = qt.seed and src.is_corrupted = bad where place <= 150 and place <= quota), pob as (select * from po where is_corrupted), {risk('pob', 'target, seed', 'pool')}, {law('target, seed', 'pool')},
cl as (select target, seed, {cnt('not is_corrupted')} pool_n_clean from po group by all), sz as (select family f, least(150, {cnt('is_corrupted')} // 2, {cnt('not is_corrupted')} // 2) most from w group by family),
tg as (select *, family target from (select *, {at('target')} from ea) join sz on family = f where place <= most), tgb as (select * from tg where is_corrupted), {risk('tgb', 'target, seed', 'own')}, {law('target, seed', 'own')}, ac as (select target, seed, {rate3()} from tg group by all)
select pool.target, pool.seed, {both('pool', ('n', *told))}, pool_n_clean, {both('own', told)}, ac.* exclude (target, seed, accepts), case when pool.flag then accepts else 0 end routed, case when pool.flag then 3 * accepts else 0 end routed_calls
from poolf pool join cl on cl.target = pool.target and cl.seed = pool.seed join ownf own on own.target = pool.target and own.seed = pool.seed join ac on ac.target = pool.target and ac.seed = pool.seed"""
    listed = lambda xs: "[" + ", ".join(map(str, xs)) + "]"
    part = "cast(floor(size * share + 0.5) as int)"
    out["drift_mixture"] = f"""with {base()}, ea as (select *, {at('drift')} from w, {seeds} where family = '{CONTROL}' or (family in ({', '.join(map(repr, TARGETS))}) and is_corrupted)),
pools as (select *, (place - 1) // {ROLE} + (family <> '{CONTROL}')::int as role, (place - 1) % {ROLE} + 1 as rk from ea where place <= case when family = '{CONTROL}' then {3 * ROLE} else {2 * ROLE} end),
cells as (select * from (select unnest([{', '.join(map(repr, TARGETS))}]) target), (select unnest({listed(SHARES)})::double as share), (select unnest({listed(sorted({*AUDITS, ROLE}))}) size)),
mx as (select pools.*, target, share, size from pools join cells on (family = '{CONTROL}' or family = target) where rk <= case when not is_corrupted then size when family = '{CONTROL}' then size - {part} else {part} end),
ini as (select * from pools where role = 0 and is_corrupted), {risk('ini', 'seed', 'st')}, {law('seed', 'st')},
aud as (select * from mx where role = 2 and is_corrupted and size in ({', '.join(map(str, AUDITS))})), {risk('aud', 'target, seed, share, size', 'ar')}, {law('target, seed, share, size', 'ar')},
ev as (select target, seed, share, {rate3('eval_')} from mx where role = 1 and size = {ROLE} group by all)
select a.target, a.seed, a.share, a.size, i.n initial_n, i.flag initial_flag, a.n, a.fn_corr, a.all3, a.null3, a.lift, a.lift_infinite, a.p, a.flag, eval_n_clean, eval_n_corrupt, eval_false_accept, eval_true_accept, eval_false_consensus,
case when a.flag then accepts else 0 end routed, (i.n = {ROLE} and a.n = a.size and eval_n_corrupt = {ROLE} and eval_n_clean = {ROLE}) complete
from arf a join stf i on i.seed = a.seed join ev on ev.target = a.target and ev.seed = a.seed and ev.share = a.share"""
    out |= {
        "family_inference": f"with {base()} select case split_part(id, '_', 1) when 'num' then 'number' when 'ent' then 'entity' when 'att' then 'attribute' when 'nat' then 'natural' when 'ref' then 'refutes' when 'ctl' then 'control' else 'unknown' end inferred, family, count(*) n from it group by all",
        "collapse_rule": f"with {base()}, bad as (select * from w where is_corrupted), {risk('bad', 'family')} select family, (fn_corr < 0.10 and not lift_infinite and coalesce(lift < 1.3, false)) collapsed from risk0",
    }
    return out, SimpleNamespace(base=base, flags=flags, dec=dec, full=full, cnt=cnt, ratio=ratio, risk=risk, law=law, spelled=s, split=split, hg=hg, null3="(s1::double * s2::double * s3::double / (n::double * n::double * n::double))", mean_corr=f"(({corr('s1', 's2', 's12')} + {corr('s1', 's3', 's13')} + {corr('s2', 's3', 's23')}) / 3)", lofo=out["leave_one_family_out"])


#: The SQL of these queries, and the parts of it that other modules build on.
SQL, PARTS = _sql()
