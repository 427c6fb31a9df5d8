"""Queries over the verdict log, its references and the two copies of the metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spelled, table
from ..operators import delivery, difference, references

#: Metric fields that are compared. Fixed values.
FIELDS = [
    "false_accept", "true_accept", "false_consensus", "lift", "p_value", "elapsed_s", "extra_verifier_items",
    "extra_verifier_calls", "missing_grounded", "new_api_calls_this_run", "prompt_tokens_this_run", "flagged",
]
#: Batches before this one are stored, the others new, where a query needs both.
NEW_FROM = 200


def verdict_key() -> dict:
    return {"judge": spelled("judge"), "item_id": spelled("item_id"), "mode": F.coalesce(spelled("mode"), F.lit("reference_free")), "attempt": F.coalesce(F.col("attempt"), F.lit(1))}


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "rf_cache").select("seq", "judge", "item_id", "mode", "attempt", "verdict", "batch_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.surplus(_log(spark, folder).drop("verdict", "batch_id"), verdict_key(), F.col("item_id"), "seq").select("seq")


def p1_kept(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.keep_first(_log(spark, folder), verdict_key(), F.col("item_id"), "seq")


def p1_absorbed(spark: SparkSession, folder: str) -> DataFrame:
    log = _log(spark, folder)
    late = F.coalesce(F.col("batch_id") >= NEW_FROM, F.lit(False))
    return delivery.absorb(log.where(~late), log.where(late), verdict_key(), F.col("item_id"), "seq").select("seq", "batch_id")


def p1_by_batch(spark: SparkSession, folder: str) -> DataFrame:
    return delivery.surplus(_log(spark, folder).drop("verdict"), verdict_key(), F.col("item_id"), "seq").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_surplus"))


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "rf_cache").select("seq", "item_id", "logged_at")
    refs = table(spark, folder, "retrieval_refs").select("seq", "item_id", "written_at")
    items = table(spark, folder, "items").select("id", "loaded_at", "removed_at")
    children = [references.Child("rf_cache", log, spelled("item_id"), F.col("logged_at"), F.col("seq")), references.Child("retrieval_refs", refs, spelled("item_id"), F.col("written_at"), F.col("seq"))]
    return references.orphans(children, items, spelled("id"), F.col("loaded_at"), F.col("removed_at"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("ref_table", "seq", "reason")


def p2_by_month(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_counts(_orphans(spark, folder))


def _copies(spark: SparkSession, folder: str) -> DataFrame:
    jobs = table(spark, folder, "release_jobs").select(F.col("name").alias("job_name"), "expected", "output", F.col("ignore").alias("ignored"))

    def side(name: str, path: str) -> DataFrame:
        rows = table(spark, folder, name).select("path", spelled("family").alias("family"), "seed", "policy", *FIELDS)
        return rows.join(F.broadcast(jobs), F.trim(rows.path) == F.trim(jobs[path])).select("job_name", "family", "seed", "policy", *FIELDS, "ignored")  # the manifest is a table of fixed size

    return difference.differences(side("snapshot_metrics", "expected"), side("replay_metrics", "output").drop("ignored"), ["job_name", "family", "seed", "policy"], FIELDS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder)


def p3_by_field(spark: SparkSession, folder: str) -> DataFrame:
    return _copies(spark, folder).groupBy("job_name", "kind", "field").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_absorbed, p1_by_batch, p2_found, p2_by_month, p3_found, p3_by_field)}

_T = "lower(trim({0}, ' \t\n\r '))".format
_KEYED = f"""
keyed as (select *, {_T("judge")} kj, {_T("item_id")} ki, coalesce({_T("mode")}, 'reference_free') km, coalesce(attempt, 1) ka from rf_cache),
ranked as (select *, case when ki is null then 1 else row_number() over (partition by kj, ki, km, ka order by seq) end rn,
  case when ki is null then 1 else row_number() over (partition by kj, ki, km, ka order by coalesce(batch_id >= {NEW_FROM}, false), seq) end rm from keyed)"""
_ORPHANS = f"""
refs as (select 'rf_cache' ref_table, seq, {_T("item_id")} k, logged_at t from rf_cache where item_id is not null
  union all select 'retrieval_refs', seq, {_T("item_id")}, written_at from retrieval_refs where item_id is not null),
held as (select distinct {_T("id")} k, loaded_at a, removed_at b from items where id is not null),
judged as (select ref_table, seq, t, count(held.k) n, count(*) filter (where a <= t and (b is null or t < b)) present, count(*) filter (where a <= t) begun
  from refs left join held on refs.k = held.k group by ref_table, seq, t),
found as (select ref_table, seq, t, case when n = 0 then 'missing' when begun = 0 then 'late' else 'deleted' end reason from judged where present = 0)"""
_SAME = {f: f"(l.{f} is not distinct from r.{f} or abs(l.{f} - r.{f}) <= greatest({difference.RELATIVE!r} * greatest(abs(l.{f}), abs(r.{f})), {difference.ABSOLUTE!r}) and not isinf(abs(l.{f} - r.{f})))" for f in FIELDS if f not in ("flagged",)}
_SAME = {f: (s if f in ("false_accept", "true_accept", "false_consensus", "lift", "p_value", "elapsed_s") else f"(l.{f} is not distinct from r.{f})") for f, s in (_SAME | {"flagged": ""}).items()}
_KEY = "job_name, family, seed, policy"
_DIFFS = (
    f"""
l as (select distinct j.name job_name, {_T("m.family")} family, seed, policy, {", ".join(FIELDS)}, coalesce(j.ignore, []) skip from snapshot_metrics m join release_jobs j on trim(m.path) = trim(j.expected)),
r as (select distinct j.name job_name, {_T("m.family")} family, seed, policy, {", ".join(FIELDS)} from replay_metrics m join release_jobs j on trim(m.path) = trim(j.output)),
diffs as (
  select {_KEY}, '' field, 'only_expected' kind from l anti join r using ({_KEY}) union all
  select {_KEY}, '', 'only_output' from r anti join l using ({_KEY})"""
    + "".join(f" union all select {', '.join('l.' + k.strip() for k in _KEY.split(','))}, '{f}', 'value' from l join r using ({_KEY}) where not list_contains(skip, '{f}') and not coalesce({s}, false)" for f, s in _SAME.items())
    + ")"
)
SQL = {
    "p1_found": f"with {_KEYED} select seq from ranked where rn > 1",
    "p1_kept": f"with {_KEYED} select seq, judge, item_id, mode, attempt, verdict, batch_id from ranked where rn = 1",
    "p1_absorbed": f"with {_KEYED} select seq, batch_id from ranked where rm = 1",
    "p1_by_batch": f"with {_KEYED} select batch_id, count(*) n_surplus from ranked where rn > 1 group by batch_id",
    "p2_found": f"with {_ORPHANS} select ref_table, seq, reason from found",
    "p2_by_month": f"with {_ORPHANS} select ref_table, reason, strftime(t, '%Y-%m') as month, count(*) n from found group by all",
    "p3_found": f"with {_DIFFS} select * from diffs",
    "p3_by_field": f"with {_DIFFS} select job_name, kind, field, count(*) n from diffs group by all",
}
