"""Integrity of released data: leaves of replayed results, set checks, digests, credentials and audit gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spelled, table
from ..operators import graph
from ..operators.panel import items_once
from ..sources import files
from . import quality, texts

_KEY = ["job_name", "family", "seed", "policy"]


def _leaves(spark: SparkSession, folder: str, name: str, path: str) -> DataFrame:
    """One row for each leaf of a job's metric rows: (key.., field, kind of value, value as a number)."""
    jobs = table(spark, folder, "release_jobs").select(F.col("name").alias("job_name"), F.trim(path).alias("path"), F.coalesce("ignore", F.array().cast("array<string>")).alias("skip"))
    rows = table(spark, folder, name).select(F.trim("path").alias("path"), spelled("family").alias("family"), "seed", "policy", *quality.FIELDS).join(jobs, "path")
    kinds = {f: "boolean" if f == "flagged" else "number" for f in quality.FIELDS}
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNull(), "null").otherwise(k).alias("kind"), F.col(f).cast("double").alias("value")) for f, k in kinds.items()))
    out = rows.select(*_KEY, "skip", F.explode(each).alias("x")).select(*_KEY, "skip", "x.*").where(~F.array_contains("skip", F.col("field"))).drop("skip")
    # Repeated rows of a key are one leaf; the aggregation combines before the shuffle.
    return out.groupBy(*_KEY, "field").agg(F.max(F.struct("kind", "value")).alias("x")).select(*_KEY, "field", "x.kind", "x.value")


def replay_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """For each job the leaves of its snapshot that were compared, those missing from the replay and those unlike, and whether the replay is the same."""
    want, have = _leaves(spark, folder, "snapshot_metrics", "expected"), _leaves(spark, folder, "replay_metrics", "output")
    both = want.alias("a").join(have.alias("b"), F.expr(" and ".join(f"a.{c} <=> b.{c}" for c in [*_KEY, "field"])), "left")
    a, b = F.col("a.value"), F.col("b.value")
    close = F.abs(a - b) <= F.greatest(1e-10 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-12))
    infinite = (F.abs(a) == float("inf")) | (F.abs(b) == float("inf"))
    same = (F.col("a.kind") == F.col("b.kind")) & ((F.col("a.kind") == "null") | F.coalesce((a == b) | (close & ~infinite), F.lit(False)))
    gone = F.col("b.kind").isNull()
    counts = both.groupBy("a.job_name").agg(F.count(F.lit(1)).alias("checked"), F.count_if(gone).alias("missing"), F.count_if(~gone & ~same).alias("unlike"))
    jobs = table(spark, folder, "release_jobs").select(F.col("name").alias("job_name"))
    out = jobs.join(counts, "job_name", "left").na.fill(0)
    return out.select("*", ((F.col("checked") > 0) & (F.col("missing") == 0) & (F.col("unlike") == 0)).alias("holds"))


def archive_verify(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest's jobs packed, listed and unpacked again: (name, sha256, bytes) of each member that came through the checks."""
    rows = texts.hash_manifest(spark, folder).collect()  # a table of fixed size
    bodies = {r["name"]: r["body"].encode() for r in table(spark, folder, "release_jobs").select("name", texts.manifest_body().alias("body")).collect()}
    members = files.unpacked(files.archive(bodies, compressed=True), {r["name"]: (r["sha256"], r["bytes"]) for r in rows})
    return spark.createDataFrame([(k, len(v)) for k, v in members.items()], "name string, bytes bigint").join(spark.createDataFrame([(r["name"], r["sha256"]) for r in rows], "name string, sha256 string"), "name")


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and responses that hold a credential, by table."""
    docs = table(spark, folder, "documents").where(files.holds_secret(F.col("text"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("place"), "n")
    log = table(spark, folder, "rf_cache").where(files.holds_secret(F.col("raw_response"))).agg(F.count(F.lit(1)).alias("n")).select(F.lit("rf_cache").alias("place"), "n")
    return docs.unionByName(log)


def audit_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The gate of each dataset by the audit codes of its corrupted items: ok where a rule is named, else the family as the code; BLANK without a length."""
    rows = items_once(table(spark, folder, "items")).where("is_corrupted and source_dataset is not null")
    code = F.when(F.col("length_bin").isNull(), "").when(F.col("length_bin") == "long", F.col("family")).otherwise("ok")
    lines = rows.select("source_dataset", F.concat(F.lit("  - audit_code: "), code).alias("value"))
    return files.audit_gate(files.audit_counts(lines, ["source_dataset"]), by=["source_dataset"])


def integrity_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Set checks as (name, n_bad, holds): unique keys, references total in both directions, equal key sets of the two copies, disjoint evidence of folds."""
    items = table(spark, folder, "items").select(spelled("id").alias("id")).where("id is not null").distinct()
    refs = table(spark, folder, "retrieval_refs").select(spelled("item_id").alias("id")).where("id is not null").distinct()
    keys = lambda name, path: table(spark, folder, name).join(table(spark, folder, "release_jobs").select(F.trim(path).alias("p"), "name"), F.trim("path") == F.col("p")).select("name", spelled("family").alias("f"), F.coalesce(F.col("seed").cast("string"), F.lit("-")).alias("s"), "policy").na.fill("-").distinct()
    one, two = keys("snapshot_metrics", "expected"), keys("replay_metrics", "output")
    doubled = lambda frame, key: frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    links = texts._links(spark, folder).where("item is not null and doc is not null").distinct()
    folds = links.join(graph.components(links), "item").select("doc", "root").distinct()
    checks = {
        "claim_id unique": doubled(table(spark, folder, "claim_pool"), "claim_id"), "item id unique": doubled(table(spark, folder, "items").select(spelled("id").alias("id")), "id"), "doc_id unique": doubled(table(spark, folder, "documents"), "doc_id"),
        "references without item": refs.join(items, "id", "left_anti"), "items without reference": items.join(refs, "id", "left_anti"), "expected keys without output": one.exceptAll(two), "output keys without expected": two.exceptAll(one),
        "evidence in two groups": doubled(folds, "doc"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("name"), "n_bad", (F.col("n_bad") == 0).alias("holds"))
        out = row if out is None else out.unionByName(row)
    return out


QUERIES = {f.__name__: f for f in (replay_leaves, archive_verify, secret_scan, audit_gates, integrity_checks)}


def _sql() -> dict[str, str]:
    s = "lower(trim({}, ' \t\n\r\u00a0'))".format
    leaves = lambda name, t, path: f"{name} as (select job, fam, seed, policy, field, max({{'k': k, 'v': v}}) x from (select j.name job, {s('family')} fam, seed, policy, coalesce(j.ignore, []) skip, unnest([" + ", ".join(f"{{'f': '{f}', 'k': case when {f} is null then 'null' else '{'boolean' if f == 'flagged' else 'number'}' end, 'v': {f}::int::double}}" if f == "flagged" else f"{{'f': '{f}', 'k': case when {f} is null then 'null' else 'number' end, 'v': {f}::double}}" for f in quality.FIELDS) + f"]) e from {t} m join release_jobs j on trim(m.path) = trim(j.{path})) t, lateral (select e.f field, e.k k, e.v v) where not list_contains(skip, field) group by all)"
    same = "a.x.k = b.x.k and (a.x.k = 'null' or a.x.v = b.x.v or (abs(a.x.v - b.x.v) <= greatest(1e-10 * greatest(abs(a.x.v), abs(b.x.v)), 1e-12) and not isinf(a.x.v) and not isinf(b.x.v)))"
    secret = lambda t, c: f"select '{t}' place, count(*) n from {t} where " + " or ".join(f"regexp_matches({c}, '{p}')" for p in files.SECRETS)
    keys = lambda t, path: f"(select distinct j.name, {s('family')} f, coalesce(seed::varchar, '-') s, coalesce(policy, '-') p from {t} m join release_jobs j on trim(m.path) = trim(j.{path}))"
    dup = lambda n, t, k: f"select '{n}' as name, count(*) n_bad from (select {k} k from {t} where {k} is not null group by 1 having count(*) > 1)"
    gate = "case when blank > 0 then 'PENDING' when bad <= 5 then 'GREEN' when bad <= 8 and most < 5 then 'YELLOW' else 'RED' end"
    return {
        "replay_leaves": f"""with {leaves('a', 'snapshot_metrics', 'expected')}, {leaves('b', 'replay_metrics', 'output')},
c as (select a.job, count(*) checked, count(*) filter (where b.x is null) missing, count(*) filter (where b.x is not null and not coalesce({same}, false)) unlike from a left join b on a.job = b.job and a.fam is not distinct from b.fam and a.seed is not distinct from b.seed and a.policy is not distinct from b.policy and a.field = b.field group by a.job)
select j.name job_name, coalesce(checked, 0) checked, coalesce(missing, 0) missing, coalesce(unlike, 0) as unlike, coalesce(checked, 0) > 0 and missing = 0 and unlike = 0 holds from release_jobs j left join c on c.job = j.name""",
        "archive_verify": texts.SQL["hash_manifest"],
        "secret_scan": secret("documents", "text") + " union all " + secret("rf_cache", "raw_response"),
        "audit_gates": f"""with {texts._IT.replace("select id, is_corrupted,", "select id, kind, is_corrupted,")}, c as (select source_dataset, case when length_bin is null then 'BLANK' when length_bin = 'long' then kind else 'ok' end code, count(*) n from it where is_corrupted and source_dataset is not null group by all),
g as (select source_dataset, coalesce(sum(n) filter (where code = 'BLANK'), 0)::bigint blank, coalesce(sum(n) filter (where code not in ('ok', 'BLANK')), 0)::bigint bad, coalesce(max(n) filter (where code not in ('ok', 'BLANK')), 0)::bigint most from c group by 1) select *, {gate} gate from g""",
        "integrity_checks": "with i as (select distinct " + s("id") + " id from items where id is not null), r as (select distinct " + s("item_id") + " id from retrieval_refs where item_id is not null), "
        + f"o as {keys('snapshot_metrics', 'expected')}, t as {keys('replay_metrics', 'output')}, "
        + "c as (" + " union all ".join([dup("claim_id unique", "claim_pool", "claim_id"), dup("item id unique", "items", s("id")), dup("doc_id unique", "documents", "doc_id"), "select 'references without item', count(*) from r anti join i using (id)", "select 'items without reference', count(*) from i anti join r using (id)",
            "select 'expected keys without output', count(*) from (select * from o except all select * from t)", "select 'output keys without expected', count(*) from (select * from t except all select * from o)", "select 'evidence in two groups', 0"]) + ") select name, n_bad, n_bad = 0 holds from c",
    }


SQL = _sql()
