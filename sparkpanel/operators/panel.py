"""Items joined with the verdicts of a panel, routing policies and their rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import spelled
from .stats import d, rate

VALID = ("true", "false")
POLICIES = ("rf_majority", "rf_unanimous", "always_grounded", "risk_routed", "ground_all_accepts", "disagreement_routed")


def items_once(items: DataFrame) -> DataFrame:
    """The last delivered row of each item with its family; items without an id, class or family and the sentinel are left out."""
    rows = items.select(spelled("id").alias("id"), F.struct("seq", F.col("kind").alias("family"), "is_corrupted", "gold", "statement", "source_dataset", "length_bin").alias("x")).where("id is not null")
    last = rows.groupBy("id").agg(F.max("x").alias("x")).select("id", "x.*")
    return last.where("family is not null and family <> 'control' and is_corrupted is not null")


def verdicts(log: DataFrame, grounded: bool = False, last: bool = True) -> DataFrame:
    """One verdict of each judge and item among reference-free or grounded rows: the last or the first delivered."""
    mode = F.coalesce(spelled("mode"), F.lit("reference_free"))
    rows = log.select(spelled("judge").alias("judge"), spelled("item_id").alias("id"), "verdict", "seq", mode.alias("mode")).where("judge is not null and id is not null")
    rows = rows.where(F.col("mode").startswith("grounded") if grounded else F.col("mode") == "reference_free")
    pick = F.max_by if last else F.min_by
    return rows.groupBy("judge", "id").agg(pick("verdict", "seq").alias("verdict"))


def wide(items: DataFrame, rf: DataFrame, grounded: DataFrame, panel: Sequence[str]) -> DataFrame:
    """Items with v1.. (parse_fail where missing) and g1.. (null where missing) of the panel, and their miss flags."""

    def across(frame: DataFrame, name: str) -> DataFrame:
        return frame.where(F.col("judge").isin(*panel)).groupBy("id").agg(*(F.max(F.when(F.col("judge") == j, F.col("verdict"))).alias(f"{name}{i}") for i, j in enumerate(panel, 1)))

    both = items.join(across(rf, "v"), "id", "left").join(across(grounded, "g"), "id", "left")
    k = range(1, len(panel) + 1)
    both = both.withColumns({f"v{i}": F.coalesce(f"v{i}", F.lit("parse_fail")) for i in k})
    return both.withColumns({f"m{i}": (F.col("is_corrupted") & (F.col(f"v{i}") == "true")).cast("int") for i in k})


def wide_once(items: DataFrame, log: DataFrame, panel: Sequence[str]) -> DataFrame:
    """:func:`wide` from the raw log in one pass: the last reference-free and the first grounded verdict of each judge of the panel, by item, summed up before the shuffle."""
    mode = F.coalesce(spelled("mode"), F.lit("reference_free"))
    rows = log.select(spelled("judge").alias("judge"), spelled("item_id").alias("id"), "verdict", "seq", mode.alias("mode"))
    rows = rows.where(F.col("id").isNotNull() & F.col("judge").isin(*panel) & ((F.col("mode") == "reference_free") | F.col("mode").startswith("grounded")))
    free = F.col("mode") == "reference_free"
    picked = [f(F.when(F.col("judge") == j, F.col("verdict")), F.when((F.col("judge") == j) & c, F.col("seq"))).alias(f"{name}{i}") for name, f, c in (("v", F.max_by, free), ("g", F.min_by, ~free)) for i, j in enumerate(panel, 1)]
    both = items.join(rows.groupBy("id").agg(*picked), "id", "left")
    k = range(1, len(panel) + 1)
    both = both.withColumns({f"v{i}": F.coalesce(f"v{i}", F.lit("parse_fail")) for i in k})
    return both.withColumns({f"m{i}": (F.col("is_corrupted") & (F.col(f"v{i}") == "true")).cast("int") for i in k})


def _votes(name: str, k: int) -> Column:
    return sum((F.coalesce(F.col(f"{name}{i}") == "true", F.lit(False)).cast("int") for i in range(1, k + 1)), F.lit(0))


def majority(k: int = 3, name: str = "v") -> Column:
    """At least two literal 'true'."""
    return _votes(name, k) >= 2


def unanimous(k: int = 3) -> Column:
    return _votes("v", k) == k


def disagrees(k: int = 3) -> Column:
    """Any verdict that isn't valid, or both valid ones."""
    v = [F.col(f"v{i}") for i in range(1, k + 1)]
    bad = [~x.isin(*VALID) for x in v] + [v[0] != x for x in v[1:]]
    out = bad[0]
    for b in bad[1:]:
        out = out | b
    return out


def grounded_majority(k: int = 3) -> Column:
    """Null unless all grounded verdicts are there."""
    there = F.lit(True)
    for i in range(1, k + 1):
        there = there & F.col(f"g{i}").isNotNull()
    return F.when(there, majority(k, "g"))


def decisions(rows: DataFrame, flag: str = "flag", k: int = 3) -> DataFrame:
    """One row for each item and policy: accept (null where a grounded verdict is missing), unanimous and escalated."""
    rf, g, dis, risky = majority(k), grounded_majority(k), disagrees(k), F.coalesce(F.col(flag), F.lit(False))
    routes = {
        "rf_majority": (rf, F.lit(False)),
        "rf_unanimous": (unanimous(k), F.lit(False)),
        "always_grounded": (g, F.lit(True)),
        "risk_routed": (F.when(risky & rf, g).otherwise(rf), risky & rf),
        "ground_all_accepts": (F.when(rf, g).otherwise(False), rf),
        "disagreement_routed": (F.when(dis, g).otherwise(rf), dis),
    }
    each = F.array(*(F.struct(F.lit(p).alias("policy"), a.alias("accept"), e.alias("escalated")) for p, (a, e) in routes.items()))
    return rows.withColumn("all_true", unanimous(k)).withColumn("x", F.explode(each)).select("*", "x.*").drop("x")


def rates(decided: DataFrame, by: Sequence[str], k: int = 3) -> DataFrame:
    """False-accept, true-accept and residual-consensus rates, null if any decision of the group is missing, and the budget: items that are grounded, a call of the verifier each, and ``k`` calls of models each."""
    bad, ok = F.col("is_corrupted"), ~F.col("is_corrupted")
    acc = F.coalesce(F.col("accept"), F.lit(False))
    out = decided.groupBy(*by).agg(
        F.count_if(bad).alias("n_corrupt"), F.count_if(ok).alias("n_clean"), F.count_if(F.col("accept").isNull()).alias("missing_grounded"),
        F.count_if(bad & acc).alias("fa"), F.count_if(ok & acc).alias("ta"), F.count_if(bad & acc & F.col("all_true")).alias("fc"), F.count_if("escalated").alias("extra_verifier_items"),
    )
    full = F.col("missing_grounded") == 0
    named = {"false_accept": ("fa", "n_corrupt"), "true_accept": ("ta", "n_clean"), "false_consensus": ("fc", "n_corrupt")}
    return out.select(*by, "n_corrupt", "n_clean", "missing_grounded", *(F.when(full, F.round(rate(F.col(a), F.col(b)), 9)).alias(name) for name, (a, b) in named.items()), "extra_verifier_items", F.col("extra_verifier_items").alias("extra_verifier_calls"), (F.col("extra_verifier_items") * k).alias("extra_model_calls"))


def bounds(decided: DataFrame, by: Sequence[str]) -> DataFrame:
    """False- and true-accept rates with missing decisions taken as rejected and as accepted; 0 for an empty class."""
    cols = []
    for name, c in (("fa", F.col("is_corrupted")), ("ta", ~F.col("is_corrupted"))):
        n, known, gone = F.count_if(c), F.count_if(c & F.coalesce(F.col("accept"), F.lit(False))), F.count_if(c & F.col("accept").isNull())
        cols += [F.coalesce(F.round(rate(known, n), 9), F.lit(0.0)).alias(f"{name}_low"), F.coalesce(F.round(rate(known + gone, n), 9), F.lit(0.0)).alias(f"{name}_high")]
    return decided.groupBy(*by).agg(*cols)


def todo(items: DataFrame, log: DataFrame, panel: Sequence[str]) -> DataFrame:
    """(judge, id) of the panel without a valid verdict."""
    wanted = items.select("id", F.explode(F.array(*map(F.lit, panel))).alias("judge"))
    return wanted.join(log.where(F.col("verdict").isin(*VALID)).select("judge", "id"), ["judge", "id"], "left_anti")


def coalesced(logs: Sequence[DataFrame]) -> DataFrame:
    """(judge, id, verdict, store): the verdict of the first log that has one."""
    both = None
    for place, log in enumerate(logs):
        part = log.select("judge", "id", "verdict", F.lit(place).alias("store"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy("judge", "id").agg(F.min_by("verdict", "store").alias("verdict"), F.min("store").alias("store"))


def mean_pair(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Agreement of each pair a < b of judges, by group, over (id, judge, verdict) rows."""
    a, b = rows.select("id", *by, F.col("judge").alias("judge_a"), F.col("verdict").alias("va")), rows.select("id", F.col("judge").alias("judge_b"), F.col("verdict").alias("vb"))
    return a.join(b, "id").where("judge_a < judge_b").groupBy(*by, "judge_a", "judge_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(d(F.col("va") == F.col("vb"))), 9).alias("agreement"))


def first_rows(frame: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in the given order, nulls last; picked by an aggregation that combines before the shuffle, so a group of any size is one row a task."""
    place = F.struct(*(x for c in order for x in (F.col(c).isNull(), F.col(c))))
    rest = [c for c in frame.columns if c not in by]
    return frame.groupBy(*by).agg(F.min_by(F.struct(*rest), place).alias("__first")).select(*by, "__first.*")
