"""Experiments over splits: regimes, reference-free routing, full sets, transfer of flags, recalibration over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import spelled, table, written
from ..operators import panel as P
from ..operators import sampling as S
from ..operators import stats as T
from . import panels

#: What each family is in the comparison of detection rates.
SIGNAL, CONTROL = ("attribute", "entity", "natural", "number"), "refutes"
#: Price of a judge's call in dollars, share of corrupted claims. Fixed values.
CALL_PRICE, CORRUPT_SHARE = 0.0034 / 900, 0.5


def regime_summary(spark: SparkSession, folder: str) -> DataFrame:
    """By family, regime (splits flagged or not) and policy: means over its splits of the bounds of the rates, whether they are exact, surviving unanimous errors and references."""
    bad, ok, gone = F.col("is_corrupted"), ~F.col("is_corrupted"), F.col("accept").isNull()
    may = gone | F.coalesce(F.col("accept"), F.lit(False))
    each = panels._decided(spark, folder).groupBy("family", "seed", "policy", F.coalesce("flag", F.lit(False)).alias("flag")).agg(
        *(T.rate(F.count_if(c & F.coalesce(F.col("accept"), F.lit(False))), F.count_if(c)).alias(f"{n}_low") for n, c in (("fa", bad), ("ta", ok))), *(T.rate(F.count_if(c & may), F.count_if(c)).alias(f"{n}_high") for n, c in (("fa", bad), ("ta", ok))),
        *((F.count_if(c & gone) == 0).alias(f"{n}_exact") for n, c in (("fa", bad), ("ta", ok))), T.rate(F.count_if(bad & F.col("all_true") & may), F.count_if(bad)).alias("surviving"), F.count_if("escalated").alias("refs"),
    )
    out = each.groupBy("family", F.when(F.col("flag"), "high").otherwise("low").alias("regime"), "policy")
    means = [F.round(F.avg(c), 8).alias(f"{c}_mean") for c in ("fa_low", "fa_high", "ta_low", "ta_high")]
    return out.agg(F.count(F.lit(1)).alias("n_splits"), *means, F.bool_and("fa_exact").alias("fa_exact"), F.bool_and("ta_exact").alias("ta_exact"), F.round(F.avg("surviving"), 8).alias("surviving_mean_high"), F.round(F.avg("refs"), 8).alias("references_mean"))


def rf_only_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Routing without any grounded call: where a split is flagged, accepts stay undecided, the rates are unknown and the calls they would need are counted."""
    rows, risk = panels._calibrated(spark, folder)
    flags = risk.select("family", "seed", F.col("flag").alias("high"))
    deployed = rows.where("role = 'deployment'").join(flags, ["family", "seed"], "left").withColumn("high", F.coalesce("high", F.lit(False)))
    bad, yes, una = F.col("is_corrupted"), P.majority(), P.unanimous()
    each = deployed.groupBy("family", "seed", "high").agg(
        F.count_if(bad).alias("n_corrupt"), F.count_if(~bad).alias("n_clean"), F.count_if(bad & yes).alias("fa"), F.count_if(~bad & yes).alias("ta"), F.count_if(bad & una).alias("fc"), F.count_if(yes).alias("accepts")
    )
    open_ = F.col("high") & (F.col("accepts") > 0)
    rates = {"false_accept": T.rate(F.col("fa"), F.col("n_corrupt")), "true_accept": T.rate(F.col("ta"), F.col("n_clean")), "residual": T.rate(F.col("fc"), F.col("n_corrupt"))}
    extra = F.when(F.col("high"), F.col("accepts")).otherwise(0)
    return each.select("family", "seed", F.when(open_, "requires_grounded").otherwise("complete").alias("status"), *(F.round(c, 9).alias(f"rf_{k}") for k, c in rates.items()), *(F.round(F.when(~open_, c), 9).alias(f"routed_{k}") for k, c in rates.items()), extra.alias("extra_items"), (3 * extra).alias("extra_calls"))


def rf_only_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Means over the splits of a family: detected splits, risk figures with finite lifts alone, rates and calls."""
    risk = panels.risk_flag_pairwise(spark, folder)
    risks = risk.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_splits"), F.count_if("flag").alias("high_splits"), F.count_if("lift_infinite").alias("infinite_splits"),
        *(F.round(f(c), 7).alias(f"{c}_{k}") for c in ("fn_corr", "all3", "p", "lift") for k, f in (("mean", F.avg), ("std", T.std))),
    )
    rates = rf_only_routing(spark, folder).groupBy("family").agg(*(F.round(F.avg(c), 7).alias(f"{c}_mean") for c in ("rf_false_accept", "rf_true_accept", "routed_false_accept", "routed_true_accept", "extra_calls")))
    return risks.join(rates, "family", "left")


def detection_tiers(spark: SparkSession, folder: str) -> DataFrame:
    """Flagged splits: the least of any signal family, the most of the negative control, and by family in the order of the most flagged."""
    each = panels.risk_flag_pairwise(spark, folder).groupBy("family").agg(F.count_if("flag").alias("high_splits"), F.count(F.lit(1)).alias("n_splits"))
    kind = F.when(F.col("family").isin(*SIGNAL), "signal").when(F.col("family") == CONTROL, "control").otherwise("boundary")
    whole = Window.partitionBy(F.lit(1))  # a row for each family: few enough for one window
    ends = {"min_signal": F.min(F.when(F.col("family").isin(*SIGNAL), F.col("high_splits"))).over(whole), "max_control": F.max(F.when(F.col("family") == CONTROL, F.col("high_splits"))).over(whole)}
    return each.withColumn("kind", kind).withColumns(ends).withColumn("place", F.row_number().over(whole.orderBy(F.desc("high_splits"), "family")).cast("bigint"))


def flag_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """How the flag pooled from other families and a family's own flag agree over its splits, by target and for all targets."""
    rows = panels.leave_one_family_out(spark, folder).select("target", F.col("pool_flag").alias("a"), F.col("own_flag").alias("b"))
    counts = rows.rollup("target").agg(F.count(F.lit(1)).alias("n_splits"), *(F.count_if(x & y).alias(n) for n, x, y in (("hh", F.col("a"), F.col("b")), ("hn", F.col("a"), ~F.col("b")), ("nh", ~F.col("a"), F.col("b")), ("nn", ~F.col("a"), ~F.col("b")))))
    return counts.select(F.coalesce("target", F.lit("(all)")).alias("target"), "n_splits", "hh", "hn", "nh", "nn")


def _full(rows: DataFrame) -> DataFrame:
    """The flag of each family from all its corrupted items, of whatever number."""
    counts = written(T.miss_counts(rows.where("is_corrupted"), ["family"]), "full")
    risk = T.risk(counts).join(T.count_null(counts, ["family"], panels.PERMUTATIONS), "family")
    return risk.withColumn("flag", T.flagged(F.col("fn_corr"), F.col("lift"), F.col("lift_infinite"), F.col("p")))


def full_set_policy(spark: SparkSession, folder: str) -> DataFrame:
    """Policies over all items of a family, with the flag from all of them, where the held-out mode has splits."""
    rows = written(panels._wide(spark, folder), "wide")
    flags = _full(rows).select("family", "p", "flag")
    return P.rates(P.decisions(rows.join(flags.drop("p"), "family", "left")), ["family", "policy"]).join(flags, "family")


def heldout_vs_full(spark: SparkSession, folder: str) -> DataFrame:
    """Known accepts of the policies that need no flag: mean and deviation over the held-out splits, the figure of the full set, and whether it lies within one deviation."""
    names = "policy in ('rf_majority', 'rf_unanimous', 'ground_all_accepts')"
    known = F.coalesce(F.col("accept"), F.lit(False))
    rates = [T.rate(F.count_if(c & known), F.count_if(c)).alias(n) for n, c in (("fa", F.col("is_corrupted")), ("ta", ~F.col("is_corrupted")))]
    splits = panels._decided(spark, folder).where(names).groupBy("family", "seed", "policy").agg(*rates)
    held = splits.groupBy("family", "policy").agg(*(F.round(f(c), 8).alias(f"{c}_{k}") for c in ("fa", "ta") for k, f in (("mean", F.avg), ("std", T.std))))
    full = P.decisions(panels._wide(spark, folder).withColumn("flag", F.lit(False))).where(names).groupBy("family", "policy").agg(*(F.round(r, 8) for r in rates))
    full = full.toDF("family", "policy", "fa_full", "ta_full")
    return held.join(full, ["family", "policy"]).select("*", *((F.abs(F.col(f"{c}_mean") - F.col(f"{c}_full")) <= F.col(f"{c}_std")).alias(f"{c}_within") for c in ("fa", "ta")))


def _calls(policy: Column, refs: Column) -> Column:
    """Judges' calls a claim: three, and three for each reference; grounding alone needs only the latter."""
    return F.when(policy == "always_grounded", 3.0).otherwise(3.0 + 3.0 * refs)


def utility_closed_form(spark: SparkSession, folder: str) -> DataFrame:
    """For each family, regime and alternative to risk routing, the price of a reference at which both are worth the same: value of a true accept, cost of a false one and price of calls, each per reference saved. Only policies with exact rates; null if both need as many references."""
    rows = regime_summary(spark, folder).where("fa_exact and ta_exact")
    deployed = panels._decided(spark, folder).where("policy = 'rf_majority'").groupBy("family", "seed").agg(F.count(F.lit(1)).alias("n")).groupBy("family").agg(F.avg("n").alias("n"))
    refs = F.col("references_mean") / F.col("n")
    rows = rows.join(deployed, "family").select("family", "regime", "policy", ((1 - CORRUPT_SHARE) * F.col("ta_low_mean")).alias("tp"), (CORRUPT_SHARE * F.col("fa_low_mean")).alias("fp"), refs.alias("refs"), (CALL_PRICE * _calls(F.col("policy"), refs)).alias("cost"))
    one = rows.where("policy = 'risk_routed'").select("family", "regime", *(F.col(c).alias(f"{c}_0") for c in ("tp", "fp", "refs", "cost")))
    both = rows.where("policy <> 'risk_routed'").join(one, ["family", "regime"])
    saved = F.col("refs") - F.col("refs_0")
    per = lambda c: F.when(F.abs(saved) >= 1e-12, F.round(c / saved, 7))
    return both.select("family", "regime", F.col("policy").alias("alternative"), F.round(saved, 8).alias("references_saved"), per(F.col("tp") - F.col("tp_0")).alias("true_accept_term"), per(F.col("fp_0") - F.col("fp")).alias("false_accept_term"), per((F.col("cost_0") - F.col("cost")) * 1e6).alias("call_term_micro"))


def replication_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the dependence of a family replicates over all its items with every grounded verdict: correlation above 0.15, lift above 1.5, p below 0.05, and a correlation below 0.10 once grounded."""
    rows = written(panels._wide(spark, folder).where("is_corrupted and g1 is not null and g2 is not null and g3 is not null"), "grounded")
    free = _full(rows).select("family", "n", "fn_corr", "lift", "lift_infinite", "p")
    grounded = T.risk(T.miss_counts(rows.select("family", *((F.col(f"g{i}") == "true").cast("int").alias(f"m{i}") for i in (1, 2, 3))), ["family"])).select("family", F.col("fn_corr").alias("grounded_corr"))
    out = free.join(grounded, "family")
    high = (F.col("fn_corr") > T.MAX_CORRELATION) & (F.col("lift_infinite") | F.coalesce(F.col("lift") > T.MAX_LIFT, F.lit(False))) & (F.col("p") < T.MAX_P)
    return out.select("*", (F.col("grounded_corr") < 0.10).alias("collapses"), (high & (F.col("grounded_corr") < 0.10)).alias("replicates"))


def window_recalibration(spark: SparkSession, folder: str) -> DataFrame:
    """Risk of the panel in each month of the log, and what routing by the flag of the last closed month would ground.

    A verdict belongs to the month it was logged in; an item counts in a month in which all three judges gave it a
    verdict, the last of the month. The first month is routed without a flag.
    """
    log = table(spark, folder, "rf_cache").select(spelled("judge").alias("judge"), spelled("item_id").alias("id"), F.coalesce(spelled("mode"), F.lit("reference_free")).alias("mode"), "verdict", "seq", F.date_format("logged_at", "yyyy-MM").alias("month"))
    rows = log.where(F.col("judge").isin(*panels.PANEL) & (F.col("mode") == "reference_free") & F.col("id").isNotNull() & F.col("month").isNotNull())
    last = [F.max_by(F.when(F.col("judge") == j, F.col("verdict")), F.when(F.col("judge") == j, F.col("seq"))).alias(f"v{i}") for i, j in enumerate(panels.PANEL, 1)]
    seen = rows.groupBy("month", "id").agg(*last).where("v1 is not null and v2 is not null and v3 is not null")
    items = P.items_once(table(spark, folder, "items")).select("id", "is_corrupted")
    told = written(seen.join(items, "id").withColumns({f"m{i}": (F.col("is_corrupted") & (F.col(f"v{i}") == "true")).cast("int") for i in (1, 2, 3)}), "months")
    counts = written(T.miss_counts(told.where("is_corrupted"), ["month"]), "counts")
    risk = T.risk(counts).join(T.count_null(counts, ["month"], panels.PERMUTATIONS), "month")
    risk = risk.withColumn("flag", T.flagged(F.col("fn_corr"), F.col("lift"), F.col("lift_infinite"), F.col("p")))
    stream = panels._accepts(["month"], told)
    # A row for each month: few enough for one window.
    before = F.lag("flag").over(Window.orderBy("month"))
    out = stream.join(risk.select("month", "fn_corr", "all3", "lift", "p", "flag"), "month", "left").withColumn("last_flag", before)
    return out.select("*", F.when(F.coalesce("last_flag", F.lit(False)), F.col("accepts")).otherwise(0).alias("routed"))


#: Counters of a fold: what is counted (b: corrupted, y: majority accepts, g: grounded majority, u: unanimous, f: flagged).
COUNTERS = {
    "n_false": "b", "n_clean": "not b", "rf_false_accept": "b and y", "rf_clean_accept": "not b and y", "rf_all3": "b and u", "ground_all_false_accept": "b and y and g", "ground_all_clean_accept": "not b and y and g",
    "corrected": "b and y and not g", "lost": "not b and y and not g", "references_acquired": "y", "routed_false_accept": "b and y and (not f or g)", "routed_clean_accept": "not b and y and (not f or g)", "routed_references": "f and y", "references_avoided": "not f and y", "unknown": "y and g is null",
}
#: Rates of a fold: their counter and what it is divided by.
RATES = {k: (k, "n_false") for k in ("rf_false_accept", "rf_all3", "ground_all_false_accept", "corrected", "routed_false_accept")} | {k: (k, "n_clean") for k in ("rf_clean_accept", "ground_all_clean_accept", "lost", "routed_clean_accept")}


def crossfit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of each fold (a hash of the item) with the flag from all other folds, and pooled, for both panels.

    The other folds' counts are all counts less the fold's own, so no item is repeated. Accepts without every grounded
    verdict are unknown and count as neither corrected nor lost.
    """
    out = None
    for name, panel in (("first", panels.PANEL), ("second", panels.SECOND)):
        fold = F.conv(F.substring(S.hashed("fold", F.col("id")), 1, 4), 16, 10).cast("bigint") % 5
        rows = written(panels._wide(spark, folder, panel).withColumn("fold", fold), "folds")
        own = written(T.miss_counts(rows.where("is_corrupted"), ["fold"]), "own")
        sums = ("n", "s1", "s2", "s3", "s12", "s13", "s23", "s123")
        every = own.agg(*(F.sum(c).alias(f"all_{c}") for c in sums)).first()
        others = own.select("fold", *((F.lit(every[f"all_{c}"] or 0) - F.col(c)).alias(c) for c in sums))
        risk = T.risk(others).join(T.count_null(others, ["fold"], panels.PERMUTATIONS), "fold")
        flags = risk.select("fold", T.flagged(F.col("fn_corr"), F.col("lift"), F.col("lift_infinite"), F.col("p")).alias("f"))
        told = rows.join(flags, "fold", "left").select(F.col("fold").cast("string").alias("fold"), F.coalesce("f", F.lit(False)).alias("f"), F.col("is_corrupted").alias("b"), P.majority().alias("y"), P.grounded_majority().alias("g"), P.unanimous().alias("u"))
        each = told.groupBy("fold", "f").agg(*(F.count_if(F.expr(c)).alias(k) for k, c in COUNTERS.items()))
        pooled = each.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in COUNTERS)).select(F.lit("pooled").alias("fold"), F.lit(None).cast("boolean").alias("f"), *COUNTERS)
        counts = each.unionByName(pooled).select(F.lit(name).alias("panel"), "fold", F.col("f").alias("flag"), *COUNTERS)
        out = counts if out is None else out.unionByName(counts)
    return out


def crossfit_rates(spark: SparkSession, folder: str) -> DataFrame:
    """The rates of these counters with their 95 % intervals; 0 of nothing is 0."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(k).alias("k"), F.col(n).alias("n")) for m, (k, n) in RATES.items()))
    rows = crossfit_counts(spark, folder).select("panel", "fold", F.explode(each).alias("x")).select("panel", "fold", "x.*")
    low, high = T.wilson(F.col("k"), F.col("n"))
    return rows.select("*", F.round(F.coalesce(T.rate(F.col("k"), F.col("n")), F.lit(0.0)), 9).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


QUERIES = {f.__name__: f for f in (crossfit_counts, crossfit_rates, regime_summary, rf_only_routing, rf_only_summary, detection_tiers, flag_confusion, full_set_policy, heldout_vs_full, utility_closed_form, replication_rule, window_recalibration)}


def _sql() -> dict[str, str]:
    q = panels.PARTS
    cnt, ratio = q.cnt, lambda a, b: f"case when {b} > 0 then ({a})::double / ({b})::double end"
    may = "(accept is null or accept)"
    bad, ok = "is_corrupted", "not is_corrupted"
    regime = f"""re as (select family, seed, policy, coalesce(flag, false) flag, {", ".join(f"{ratio(cnt(f'{c} and accept'), cnt(c))} {n}_low, {ratio(cnt(f'{c} and {may}'), cnt(c))} {n}_high, {cnt(f'{c} and accept is null')} = 0 {n}_exact" for n, c in (("fa", bad), ("ta", ok)))},
 {ratio(cnt(f'{bad} and una and {may}'), cnt(bad))} surviving, {cnt('escalated')} refs from dc group by all),
rg as (select family, case when flag then 'high' else 'low' end regime, policy, count(*) n_splits, {", ".join(f"round(avg({c}), 8) {c}_mean" for c in ("fa_low", "fa_high", "ta_low", "ta_high"))}, bool_and(fa_exact) fa_exact, bool_and(ta_exact) ta_exact, round(avg(surviving), 8) surviving_mean_high, round(avg(refs), 8) references_mean from re group by all)"""
    rf = f"""rr as (select r.*, coalesce(flag, false) high from roles r left join fl on r.family = fl.family and r.seed = fl.seed where role = 'deployment'),
rc as (select family, seed, high, {cnt(bad)} nb, {cnt(ok)} nk, {cnt(bad + ' and rfm')} fa, {cnt(ok + ' and rfm')} ta, {cnt(bad + ' and una')} fc, {cnt('rfm')} accepts from rr group by all),
rx as (select *, high and accepts > 0 undecided, {ratio('fa', 'nb')} a, {ratio('ta', 'nk')} b, {ratio('fc', 'nb')} c from rc),
ro as (select family, seed, case when undecided then 'requires_grounded' else 'complete' end status, {", ".join(f"round({x}, 9) rf_{n}, round(case when not undecided then {x} end, 9) routed_{n}" for x, n in (("a", "false_accept"), ("b", "true_accept"), ("c", "residual")))}, case when high then accepts else 0 end extra_items, case when high then 3 * accepts else 0 end extra_calls from rx)"""
    std = lambda c: f"case when count({c}) = 1 then 0.0 else stddev_samp({c}) end"
    kind = f"case when family in ({', '.join(map(repr, SIGNAL))}) then 'signal' when family = '{CONTROL}' then 'control' else 'boundary' end"
    names = "policy in ('rf_majority', 'rf_unanimous', 'ground_all_accepts')"
    known = lambda src, by: f"select {by}, {ratio(cnt(bad + ' and accept'), cnt(bad))} fa, {ratio(cnt(ok + ' and accept'), cnt(ok))} ta from {src} where {names} group by all"
    price = f"{CALL_PRICE!r}::double"
    per = lambda x: f"case when abs(s) >= 1e-12 then round(({x}) / s, 7) end"
    confusion = q.lofo
    sums = ("n", "s1", "s2", "s3", "s12", "s13", "s23", "s123")

    def crossfit(name: str, panel: tuple[str, ...]) -> str:
        return f"""select * from (with {q.base(panel)}, fo as (select *, (('0x' || substr(sha256(concat_ws('|', 'fold', id)), 1, 4))::bigint % 5) fold from w), bd as (select * from fo where is_corrupted), {q.risk('bd', 'fold', 'ow')},
al as (select {", ".join(f"sum({c})::bigint a_{c}" for c in sums)} from owc), mk as (select fold, {", ".join(f"a_{c} - {c} {c}" for c in sums)} from owc, al),
m0 as (select fold, {q.null3} null3, {q.mean_corr} corr, n, s1, s2, s3, s123 from mk),
xs as (select *, unnest(range(0, n + 1)) x from m0), xk as (select * from xs where x <= least(s1, s2) and x >= s1 + s2 - n), ts as (select *, unnest(range(0, n + 1)) t from xk), tk as (select * from ts where t >= s123 and t <= least(x, s3) and t >= x + s3 - n),
pv as (select fold, least(1.0, sum({q.hg('n', 's1', 's2', 'x')} * {q.hg('n', 'x', 's3', 't')})) p from tk group by fold),
fg as (select m0.fold, (round(corr, 9) > {T.MAX_CORRELATION} and ((null3 = 0 and s123 > 0) or coalesce(case when null3 > 0 then s123::double / n / null3 when s123 = 0 then 0.0 end > {T.MAX_LIFT}, false)) and coalesce(p, 1.0) < {T.MAX_P}) f from m0 left join pv on m0.fold = pv.fold),
tl as (select fo.fold::varchar fold, coalesce(f, false) f, is_corrupted b, rfm y, gm g, una u from fo left join fg on fo.fold = fg.fold), c as (select fold, f flag, {", ".join(f"{cnt(c)} as {k}" for k, c in COUNTERS.items())} from tl group by all)
select '{name}' as panel, * from c union all select '{name}', 'pooled', null, {", ".join(f"coalesce(sum({k}), 0)::bigint" for k in COUNTERS)} from c)"""

    folds = " union all ".join(crossfit(n, p) for n, p in (("first", panels.PANEL), ("second", panels.SECOND)))
    z, rate = T.Z95, "k::double / n::double"
    mid, half = f"(({rate} + {z * z!r} / (2 * n)) / (1 + {z * z!r} / n))", f"({z!r} * sqrt({rate} * (1 - {rate}) / n + {z * z!r} / (4 * n::double * n)) / (1 + {z * z!r} / n))"
    return {
        "crossfit_counts": folds,
        "crossfit_rates": f"with cf as ({folds}), r as (" + " union all ".join(f"select panel, fold, '{m}' as metric, {k} k, {n} n from cf" for m, (k, n) in RATES.items()) + f") select *, round(case when n > 0 then {rate} else 0.0 end, 9) rate, round(case when n > 0 then greatest(0.0, {mid} - {half}) else 0.0 end, 9) low, round(case when n > 0 then least(1.0, {mid} + {half}) else 1.0 end, 9) high from r",
        "regime_summary": f"with {q.flags}, {q.dec}, {regime} select * from rg",
        "rf_only_routing": f"with {q.flags}, {rf} select * from ro",
        "rf_only_summary": f"""with {q.flags}, {rf}, a as (select family, count(*) n_splits, {cnt('flag')} high_splits, {cnt('lift_infinite')} infinite_splits, {", ".join(f"round(avg({c}), 7) {c}_mean, round({std(c)}, 7) {c}_std" for c in ("fn_corr", "all3", "p", "lift"))} from fl group by family),
b as (select family, {", ".join(f"round(avg({c}), 7) {c}_mean" for c in ("rf_false_accept", "rf_true_accept", "routed_false_accept", "routed_true_accept", "extra_calls"))} from ro group by family) select * from a left join b using (family)""",
        "detection_tiers": f"with {q.flags}, e as (select family, {cnt('flag')} high_splits, count(*) n_splits from fl group by family) select *, {kind} kind, row_number() over (order by high_splits desc, family) place, (select min(high_splits) from e where family in ({', '.join(map(repr, SIGNAL))})) min_signal, (select max(high_splits) from e where family = '{CONTROL}') max_control from e",
        "flag_confusion": f"with lofo as ({confusion}) select coalesce(target, '(all)') target, count(*) n_splits, {cnt('pool_flag and own_flag')} hh, {cnt('pool_flag and not own_flag')} hn, {cnt('not pool_flag and own_flag')} nh, {cnt('not pool_flag and not own_flag')} nn from lofo group by rollup (target)",
        "heldout_vs_full": f"""with {q.flags}, {q.dec}, h as ({known('dc', 'family, seed, policy')}), hm as (select family, policy, {", ".join(f"round(avg({c}), 8) {c}_mean, round({std(c)}, 8) {c}_std" for c in ("fa", "ta"))} from h group by all),
fd as (select family, is_corrupted, 'rf_majority' as policy, rfm accept from w union all select family, is_corrupted, 'rf_unanimous', una from w union all select family, is_corrupted, 'ground_all_accepts', case when rfm then gm else false end from w),
f as (select family, policy, round(fa, 8) fa_full, round(ta, 8) ta_full from ({known('fd', 'family, policy')})) select hm.*, fa_full, ta_full, abs(fa_mean - fa_full) <= fa_std fa_within, abs(ta_mean - ta_full) <= ta_std ta_within from hm join f on hm.family = f.family and hm.policy = f.policy""",
        "utility_closed_form": f"""with {q.flags}, {q.dec}, {regime}, dn as (select family, avg(n) n from (select family, seed, count(*) n from dc where policy = 'rf_majority' group by all) group by family),
u as (select rg.family, regime, policy, {1 - CORRUPT_SHARE}::double * ta_low_mean tp, {CORRUPT_SHARE}::double * fa_low_mean fp, references_mean / n refs, {price} * case when policy = 'always_grounded' then 3.0::double else 3.0::double + 3.0::double * (references_mean / n) end as cost from rg join dn on rg.family = dn.family where fa_exact and ta_exact),
v as (select a.*, o.tp tp0, o.fp fp0, o.cost cost0, a.refs - o.refs s from u a join u o on a.family = o.family and a.regime = o.regime and o.policy = 'risk_routed' where a.policy <> 'risk_routed')
select family, regime, policy alternative, round(s, 8) references_saved, {per('tp - tp0')} true_accept_term, {per('fp0 - fp')} false_accept_term, {per('(cost0 - cost) * 1e6::double')} call_term_micro from v""",
    }


SQL = _sql()
