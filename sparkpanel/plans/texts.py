"""Queries over claims, references and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spelled, table
from ..functions import text as X
from ..operators import graph, judges, retrieval, sampling
from ..operators.panel import first_rows, items_once
from ..streaming import log as stream


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "claim_pool")


def dedupe_first(spark: SparkSession, folder: str) -> DataFrame:
    """The first claim of each text, by rank, before any filter."""
    return first_rows(_claims(spark, folder).select("claim_id", "claim_text", "pool_rank"), ["claim_text"], ["pool_rank", "claim_id"]).select("claim_id")


def atomic_filter_attrition(spark: SparkSession, folder: str) -> DataFrame:
    claims = _claims(spark, folder).select("claim_id", "claim_text")
    first = dedupe_first(spark, folder).withColumn("first", F.lit(True))
    reason = F.when(F.col("first").isNull(), "duplicate").otherwise(F.coalesce(X.atomic_reject(F.col("claim_text")), F.lit("kept")))
    return claims.join(first, "claim_id", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def frame_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).groupBy(F.coalesce(X.frame_reject(F.col("claim_text")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def length_bins(spark: SparkSession, folder: str) -> DataFrame:
    words = X.word_count(F.col("claim_text"))
    return _claims(spark, folder).groupBy(X.length_bin(words).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(words).alias("low"), F.max(words).alias("high"))


def hedged_claims(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).where(X.hedged(F.col("claim_text"))).select("claim_id")


def relation_types(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).groupBy(X.relation(F.col("claim_text")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


def number_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).select("claim_id", X.single_number("claim_text").alias("x")).where("x.text is not null").select("claim_id", "x.*")


def number_classify(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).where("number is not null").select("claim_id", X.classify_number(F.col("number.text")).alias("kind"))


def number_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("number.text")
    kind = X.classify_number(n)
    rows = _claims(spark, folder).where("number is not null").select("claim_id", "claim_text", X.corrupted_number(n, kind).alias("shown"), F.col("number.start").alias("a"), F.col("number.end").alias("b"))
    changed = X.replaced(F.col("claim_text"), F.col("a"), F.col("b"), F.col("shown"))
    return rows.withColumn("changed", changed).select("claim_id", "shown", "changed", X.changed_numbers(F.col("claim_text"), F.col("changed")).alias("status"))


def obvious_control(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("number.text")
    return _claims(spark, folder).where("number is not null").select("claim_id", X.obvious_number(n, X.classify_number(n), F.col("claim_text")).alias("shown"))


def entity_extract(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).select("claim_id", F.explode(X.entities(F.col("claim_text"))).alias("entity")).distinct()


def entity_norm_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Swapped items whose old entity still stands, or whose new one doesn't."""
    rows = table(spark, folder, "items").where("original_entity is not null and new_entity is not null")
    old, new = X.contains_norm(F.col("statement"), F.col("original_entity")), X.contains_norm(F.col("statement"), F.col("new_entity"))
    return rows.select("seq", old.alias("old_stands"), new.alias("new_stands"), X.norm(F.col("new_entity")).alias("entity"))


def article_aware_replacement(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "items").where("original_attribute is not null and shown_attribute is not null")
    said = F.lower("statement")
    article = F.when(said.contains(F.concat(F.lit(" an "), F.lower("shown_attribute"))), "an").when(said.contains(F.concat(F.lit(" a "), F.lower("shown_attribute"))), "a").otherwise("")
    return rows.select("seq", article.alias("article"), X.article_matches(article, F.col("shown_attribute")).alias("matches"), X.match_case(F.col("original_attribute"), F.col("shown_attribute")).alias("cased"))


def parsed_truth(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "rf_cache").select("verdict", "raw_response")
    return rows.groupBy("verdict", X.parse_truth(F.col("raw_response")).alias("parsed")).agg(F.count(F.lit(1)).alias("n"))


def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    body = X.strip_json(F.col("raw_response"))
    rows = table(spark, folder, "rf_cache").select("seq", body.alias("body")).where("body is not null")
    return rows.select("seq", F.regexp_extract("body", r'"verdict"\s*:\s*"([a-z]*)"', 1).alias("told"))


def evidence_slice(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).select("claim_id", F.explode(F.slice(F.array_distinct(F.filter("evidence_stub", lambda e: e.wiki_url.isNotNull())), 1, 4)).alias("e")).select("claim_id", "e.wiki_url", "e.sentence_id")


def stratified_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _claims(spark, folder).select(F.coalesce("label", F.lit("missing")).alias("label"), spelled("source").alias("source"), F.coalesce("number.kind", F.lit("missing")).alias("kind"))
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("label", "source", "kind")))
    return rows.select(F.explode(each).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def length_matched_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Clean items by hash as many in each length bin as there are corrupted ones, at most 40 a bin."""
    rows = items_once(table(spark, folder, "items")).where("length_bin is not null").select("id", "is_corrupted", "length_bin").withColumn("h", sampling.hashed("match", F.col("id")))
    quota = rows.where("is_corrupted").groupBy("length_bin").agg(F.least(F.count(F.lit(1)), F.lit(40)).alias("quota"))
    placed = sampling.ranked(rows.where("not is_corrupted"), ["length_bin"], "h", "place")
    return placed.join(quota, "length_bin").where(F.col("place") <= F.col("quota")).select("id", "length_bin", "place")


def labelwise_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = _claims(spark, folder).where("label is not null").select("claim_id", "label").withColumn("h", sampling.hashed("label", F.col("claim_id")))
    return sampling.ranked(rows, ["label"], "h", "place").where("place <= 50").select("claim_id", "label", "place")


def proportional_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = _claims(spark, folder).select("claim_id", "length_bin").where("length_bin is not null").withColumn("h", sampling.hashed("order", F.col("claim_id")))
    return sampling.proportional_order(rows, "length_bin", "h").select("claim_id", "length_bin", F.col("stratum_rank").cast("bigint").alias("stratum_rank"), "place")


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    queries = table(spark, folder, "retrieval_refs").select(F.col("seq").alias("query_id"), F.col("statement").alias("text"))
    return retrieval.bm25(table(spark, folder, "documents").select("doc_id", "text"), queries).select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


def hit_miss_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Grounded verdicts on corrupted references by whether retrieval hit."""
    refs = table(spark, folder, "retrieval_refs").where("is_corrupted").select(spelled("item_id").alias("id"), F.explode("refs").alias("condition", "r")).groupBy("id", "condition").agg(F.max("r.hit").alias("hit"))
    told = table(spark, folder, "rf_cache").select(spelled("item_id").alias("id"), spelled("condition").alias("condition"), "verdict").where("condition is not null and id is not null")
    return told.join(refs, ["id", "condition"]).groupBy("condition", "hit").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "true").alias("n_true"))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "retrieval_refs").select(spelled("item_id").alias("item"), F.explode("gold_evidence.doc_id").alias("doc"))


def components(spark: SparkSession, folder: str) -> DataFrame:
    return graph.components(_links(spark, folder))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    classes = table(spark, folder, "retrieval_refs").groupBy(spelled("item_id").alias("item")).agg(F.max("is_corrupted").alias("bad"))
    return graph.groups(_links(spark, folder), graph.components(_links(spark, folder)).join(classes, "item"))


def evidence_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Items that share evidence, directly or through others: their sorted numbers, documents and classes."""
    return _groups(spark, folder)


def fold_balance(spark: SparkSession, folder: str) -> DataFrame:
    """Folds of whole groups with their clean and corrupted items."""
    return graph.folds(_groups(spark, folder), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n_clean").cast("bigint").alias("n_clean"), F.sum("n_false").cast("bigint").alias("n_false"))


def manifest_body() -> Column:
    return F.concat_ws("|", "name", "script", F.array_join("args", ","), "output", "expected")


def hash_manifest(spark: SparkSession, folder: str) -> DataFrame:
    body = manifest_body()
    return table(spark, folder, "release_jobs").select("name", F.sha2(body, 256).alias("sha256"), F.length(body).cast("bigint").alias("bytes"))


def verdict_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = stream.windowed(table(spark, folder, "rf_cache").where("logged_at is not null and judge is not null"), "logged_at", "1 day")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "judge", "n", "n_true", "n_fail")


def judge_replay(spark: SparkSession, folder: str) -> DataFrame:
    rows = items_once(table(spark, folder, "items")).select("id", "statement")
    return judges.judged(rows, [judges.HashJudge("rule-a"), judges.HashJudge("rule-b")]).groupBy("judge", "verdict").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_first, atomic_filter_attrition, frame_filter, length_bins, hedged_claims, relation_types, number_extract, number_classify, number_corrupt, obvious_control, entity_extract, entity_norm_filter, article_aware_replacement, parsed_truth, json_answers,
        evidence_slice, stratified_counts, length_matched_sample, labelwise_sample, proportional_order, bm25_topk, hit_miss_strata, components, evidence_groups, fold_balance, hash_manifest, verdict_windows, judge_replay,
    )
}

_s = "lower(trim({}, ' \t\n\r '))".format
_FIRST = "fst as (select claim_id from (select claim_id, row_number() over (partition by claim_text order by pool_rank, claim_id) rn from claim_pool) where rn = 1)"
_WORDS = "(case when trim(claim_text) = '' then 0 else len(regexp_split_to_array(trim(claim_text), '\\s+')) end)"
_norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
_IT = f"it as (select id, is_corrupted, length_bin, source_dataset from (select *, row_number() over (partition by {_s('id')} order by seq desc) rn from (select * replace ({_s('id')} as id) from items where id is not null)) where rn = 1 and kind is not null and kind <> 'control' and is_corrupted is not null)"
_OPENS = "^" + X.ENTITY.removeprefix("\\b")
_names = lambda t: f"(list_transform(list_filter(list_transform(regexp_extract_all({t}, '{X.ENTITY}'), lambda q, i: {{'e': trim(q), 'i': i}}), lambda z: not (z.i = 1 and regexp_matches({t}, '{_OPENS}') and not contains(z.e, ' ')) and z.e not in ({', '.join(map(repr, X.ENTITY_STOP))}) and lower(z.e) not in ('true', 'false') and not regexp_matches(z.e, '^The ({'|'.join(X.MONTHS)})\\b')), lambda z: z.e))"
_NAMES = f"nm0 as (select claim_id, claim_text, {_names('claim_text')} l from claim_pool), nm as (select claim_id, claim_text, list_filter(l, lambda q, i: list_position(l, q) = i) names from nm0)"
_KIND = "case when regexp_matches(replace(number.text, ',', ''), '^\\d{4}$') and replace(number.text, ',', '')::int between 1000 and 2099 then 'year' when regexp_matches(replace(number.text, ',', ''), '^\\d+$') then 'integer' else 'decimal' end"


def _case(pairs, column: str, other: str) -> str:
    return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{n}'" for n, p in pairs) + f" else '{other}' end"


SQL = {
    "dedupe_first": f"with {_FIRST} select claim_id from fst",
    "atomic_filter_attrition": f"with {_FIRST} select case when f.claim_id is null then 'duplicate' when {_WORDS} < 6 or {_WORDS} > 35 then 'length' when regexp_matches(claim_text, '[?;]') then 'question_or_semicolon' when len(claim_text) - len(replace(claim_text, '.', '')) > 1 then 'sentences' when regexp_matches(claim_text, '{X.HEDGE}') then 'hedge' else 'kept' end reason, count(*) n from claim_pool c left join fst f using (claim_id) group by all",
    "frame_filter": f"select {_case(X.FRAMES, 'claim_text', 'kept')} reason, count(*) n from claim_pool group by all",
    "length_bins": f"select case when {_WORDS} <= 10 then 'short' when {_WORDS} <= 18 then 'medium' else 'long' end bin, count(*) n, min({_WORDS})::int low, max({_WORDS})::int high from claim_pool group by 1",
    "hedged_claims": "select claim_id from claim_pool where " + " or ".join(f"contains(' ' || lower(claim_text) || ' ', '{h}')" for h in X.HEDGES),
    "relation_types": f"select {_case(X.RELATIONS, 'claim_text', 'none')} relation, count(*) n from claim_pool group by all",
    "number_classify": f"select claim_id, {_KIND} kind from claim_pool where number is not null",
    "entity_extract": f"with {_NAMES} select distinct claim_id, unnest(names) entity from nm",
    "entity_norm_filter": f"select seq, contains(' ' || {_norm('statement')} || ' ', ' ' || {_norm('original_entity')} || ' ') old_stands, contains(' ' || {_norm('statement')} || ' ', ' ' || {_norm('new_entity')} || ' ') new_stands, {_norm('new_entity')} entity from items where original_entity is not null and new_entity is not null",
    "article_aware_replacement": f"with a as (select *, case when contains(lower(statement), ' an ' || lower(shown_attribute)) then 'an' when contains(lower(statement), ' a ' || lower(shown_attribute)) then 'a' else '' end article from items where original_attribute is not null and shown_attribute is not null) select seq, article, case article when 'an' then regexp_matches({_norm('shown_attribute')}, '^[aeiou]') when 'a' then not regexp_matches({_norm('shown_attribute')}, '^[aeiou]') else true end matches, case when original_attribute = upper(original_attribute) and original_attribute <> lower(original_attribute) then upper(shown_attribute) when original_attribute[1] = upper(original_attribute[1]) and original_attribute[1] <> lower(original_attribute[1]) then upper(shown_attribute[1]) || shown_attribute[2:] else lower(shown_attribute[1]) || shown_attribute[2:] end cased from a",
    "parsed_truth": "select verdict, coalesce(nullif(lower(regexp_extract(upper(coalesce(raw_response, '')), '\\b(TRUE|FALSE)\\b', 1)), ''), 'parse_fail') parsed, count(*) n from rf_cache group by all",
    "json_answers": """with b as (select seq, regexp_extract(regexp_replace(raw_response, '```(?:json)?', '', 'g'), '(?s)(\\{.*\\})', 1) body from rf_cache where raw_response is not null) select seq, regexp_extract(body, '"verdict"\\s*:\\s*"([a-z]*)"', 1) told from b where body <> ''""",
    "stratified_counts": f"with r as (select coalesce(label, 'missing') as label, {_s('source')} as source, coalesce(number.kind, 'missing') kind from claim_pool) select 'label' field, label as value, count(*) n from r group by all union all select 'source', source, count(*) from r group by all union all select 'kind', kind, count(*) from r group by all",
    "length_matched_sample": f"with {_IT}, q as (select length_bin, least(count(*), 40) quota from it where is_corrupted and length_bin is not null group by 1), p as (select id, length_bin, row_number() over (partition by length_bin order by sha256(concat_ws('|', 'match', id))) place from it where not is_corrupted and length_bin is not null) select id, p.length_bin, place from p join q on p.length_bin = q.length_bin where place <= quota",
    "labelwise_sample": "select claim_id, label, place from (select claim_id, label, row_number() over (partition by label order by sha256(concat_ws('|', 'label', claim_id))) place from claim_pool where label is not null) where place <= 50",
    "proportional_order": "select claim_id, length_bin, rk stratum_rank, round((rk - 0.5::double) / sz, 9) place from (select claim_id, length_bin, row_number() over (partition by length_bin order by sha256(concat_ws('|', 'order', claim_id))) rk, count(*) over (partition by length_bin) sz from claim_pool where length_bin is not null)",
    "bm25_topk": f"""with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+') t from documents), z as (select count(*) n, avg(len(t)) avgdl from d),
p as (select doc_id, dl, term, count(*) tf from (select doc_id, len(t) dl, unnest(t) term from d) group by all), f as (select term, count(*) df from p group by term),
q as (select query_id, term, count(*) times from (select seq query_id, unnest(regexp_extract_all(lower(coalesce(statement, '')), '[\\p{{L}}\\p{{N}}_]+')) term from retrieval_refs) group by all),
s as (select query_id, doc_id, round(sum(times * ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * {retrieval.K1 + 1}::double / (tf + {retrieval.K1}::double * (1 - {retrieval.B}::double + {retrieval.B}::double * dl / avgdl))), 9) score from q join p using (term) join f using (term), z group by all)
select query_id, doc_id, score, rk as rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) rk from s) where rk <= 3""",
    "hit_miss_strata": f"with r as (select id, e.key as condition, max(e.value.hit::int) = 1 hit from (select {_s('item_id')} id, unnest(map_entries(refs)) e from retrieval_refs where is_corrupted) group by all), t as (select {_s('item_id')} id, {_s('condition')} as condition, verdict from rf_cache where condition is not null and item_id is not null) select condition, hit, count(*) n, count(*) filter (where verdict = 'true') n_true from t join r using (id, condition) group by all",
    "components": f"with recursive l as (select distinct {_s('item_id')} item, unnest(gold_evidence).doc_id doc from retrieval_refs where item_id is not null), e as (select distinct a.item a, b.item b from l a join l b on a.doc = b.doc), r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a item, min(b) root from r group by a",
    "hash_manifest": "with b as (select name, concat_ws('|', name, script, array_to_string(args, ','), output, expected) body from release_jobs) select name, sha256(body) sha256, length(body)::bigint bytes from b",
    "verdict_windows": f"select strftime(logged_at, '%Y-%m-%d') as day, {_s('judge')} judge, count(*) n, count(*) filter (where verdict = 'true') n_true, count(*) filter (where verdict = 'parse_fail') n_fail from rf_cache where logged_at is not null and judge is not null group by all",
}
_MONTHS = " or ".join(f"contains(near, '{m}')" for m in X.MONTHS)
SQL["obvious_control"] = f"""with n as (select claim_id, number.text t, try_cast(replace(number.text, ',', '') as bigint) v, {_KIND} k, strpos(claim_text, number.text) p, claim_text c from claim_pool where number is not null),
m as (select *, case when p > 0 then substr(c, greatest(p - 30, 1)::bigint, (length(t) + least(p - 1, 30) + 30)::bigint) else '' end near from n)
select claim_id, case when k = 'year' and v between 1700 and 2025 and not contains(t, ',') then '3026' when v between 1 and 31 and ({_MONTHS}) then '99' when v >= 1000 then '999,999,999' else '999' end shown from m"""
_SHOWN = f"""nu as (select claim_id, claim_text t, number.text n, number.start s, number.end e, replace(number.text, ',', '') raw, {_KIND} k from claim_pool where number is not null),
nw as (select *, case when regexp_matches(raw, '^\\d+$') then try_cast(raw as bigint) end w, try_cast(raw as double) v, case when contains(raw, '.') then length(split_part(raw, '.', -1)) else 1 end places from nu),
nm0 as (select *, case when w = 0 then 1 else round_even(w::double * case when w % 2 = 0 then 1.2::double else 0.8::double end, 0)::bigint end m0, printf('%.10f', round_even(case when floor(abs(v)) % 2 = 0 then v * 1.2::double else v * 0.8::double end, 6)) dec from nw),
sh as (select *, case when k = 'year' then case when regexp_matches(raw, '^\\d{{3,4}}$') then (case when w % 2 = 0 then w + 2 else w - 2 end)::varchar end when contains(raw, '.') or k = 'decimal' then case when v is not null then substr(dec, 1, length(dec) - 10 + places) end
 when w is not null then case when contains(n, ',') then format('{{:,}}', case when m0 = w then w + 1 else m0 end) else (case when m0 = w then w + 1 else m0 end)::varchar end end shown from nm0)"""
_pairs = lambda a, b: f"list_filter(list_zip(regexp_extract_all({a}, '{X.PLAIN_NUMBER}'), regexp_extract_all({b}, '{X.PLAIN_NUMBER}')), lambda z: z[1] is distinct from z[2])"
_count = lambda a: f"len(regexp_extract_all({a}, '{X.PLAIN_NUMBER}'))"
SQL["number_corrupt"] = f"with {_SHOWN}, ch as (select *, substr(t, 1, s) || shown || substr(t, e + 1) as changed from sh) select claim_id, shown, changed, case when changed is null or changed = t then 'generated_no_change' when {_count('t')} <> {_count('changed')} then 'number_count_changed' when len({_pairs('t', 'changed')}) <> 1 then 'not_exactly_one_number_changed' else 'accepted' end status from ch"
SQL["judge_replay"] = f"with {_IT.replace('select id, is_corrupted,', 'select id, statement, is_corrupted,')}, j as (select unnest(['rule-a', 'rule-b']) judge) select judge, case when ('0x' || substr(sha256(judge || '||' || coalesce(statement, '')), 3, 2))::int % 2 = 1 then 'true' else 'false' end verdict, count(*) n from it, j group by all"
SQL["evidence_slice"] = """with e as (select claim_id, unnest(evidence_stub) s, generate_subscripts(evidence_stub, 1) pos from claim_pool), f as (select claim_id, s.wiki_url wiki_url, s.sentence_id sentence_id, min(pos) p from e where s.wiki_url is not null group by all)
select claim_id, wiki_url, sentence_id from (select *, row_number() over (partition by claim_id order by p) rn from f) where rn <= 4"""
_GROUPED = SQL["components"].replace("select a item, min(b) root from r group by a", f""", c as (select a item, min(b) root from r group by a),
k as (select {_s('item_id')} item, max(is_corrupted::int) = 1 bad from retrieval_refs where item_id is not null group by 1),
g as (select root, list_sort(list(distinct item)) items, count(*) filter (where not bad) n_clean, count(*) filter (where bad) n_false from c join k using (item) group by root)""")
SQL["evidence_groups"] = _GROUPED + ", dd as (select root, list_sort(list(distinct doc)) docs from l join c using (item) where doc is not null group by root) select g.root, array_to_string(items, ',') item_ids, array_to_string(docs, ',') doc_ids, n_clean, n_false from g join dd using (root)"
SQL["fold_balance"] = _GROUPED + f""", o as (select *, row_number() over (order by greatest(n_clean, n_false) desc, n_clean + n_false desc, n_clean desc, sha256('fold|' || root)) i from g), t as (select sum(n_clean)::bigint tc, sum(n_false)::bigint tf from g),
w(i, cs, fs, fold) as (select 0::bigint, [0, 0, 0, 0, 0]::bigint[], [0, 0, 0, 0, 0]::bigint[], -1::bigint union all
 select i, list_transform(cs, lambda x, j: x + case when j = z.k + 1 then n_clean else 0 end), list_transform(fs, lambda x, j: x + case when j = z.k + 1 then n_false else 0 end), z.k from (
  select o.i, cs, fs, n_clean, n_false, list_sort(list_transform([0, 1, 2, 3, 4], lambda q: {{'e': n_clean * (5 * cs[q + 1] - tc) + n_false * (5 * fs[q + 1] - tf), 'm': greatest(list_max(list_transform(list_zip(cs, fs), lambda y: y[1] + y[2])), cs[q + 1] + fs[q + 1] + n_clean + n_false), 'k': q::bigint}}))[1] z from w join o on o.i = w.i + 1, t))
select fold, count(*) n_groups, sum(n_clean)::bigint n_clean, sum(n_false)::bigint n_false from w join o using (i) where w.i > 0 group by fold"""
