"""Building corrupted claims: filters of source and result, replacements, controls and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spelled, table, written
from ..functions import builders as B
from ..functions import text as X
from ..operators import judges, sampling
from ..operators.panel import items_once
from . import texts

#: Attributes of the claims in the tables, as a further type after the usual ones.
ADJECTIVES = tuple("alpine annual bilingual coastal experimental granite imperial lunar maritime medieval nomadic northern private rural secular silver subtropical unfinished volcanic wooden".split())
VOCABULARY = B.VOCABULARY | {"adjective": ADJECTIVES}
#: How often a pair of attributes may be used.
CAP = 2


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "claim_pool")


def number_source_filter(spark: SparkSession, folder: str) -> DataFrame:
    reason = B.number_source_reason(F.col("claim_text"), F.col("number.text"), X.classify_number(F.col("number.text")), F.col("number.start"), F.col("number.end"))
    return _claims(spark, folder).select("claim_id", reason.alias("reason"))


def number_post_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The number of each claim made wrong, and whether the result is one with that change alone."""
    n = F.col("number.text")
    rows = _claims(spark, folder).where("number is not null").withColumn("shown", X.corrupted_number(n, X.classify_number(n)))
    made = rows.withColumn("x", B.replaced_number(F.col("claim_text"), n, F.col("number.start"), F.col("number.end"), F.col("shown")))
    return made.select("claim_id", "x.changed", "x.note", B.number_post_reason(F.col("claim_text"), n, F.col("number.start"), F.col("x.changed")).alias("reason"))


def entity_classes(spark: SparkSession, folder: str) -> DataFrame:
    return _claims(spark, folder).select("claim_id", X.entity_class(F.col("claim_text"), X.entities(F.col("claim_text"))).alias("class"))


def entity_post_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "items").where("kind = 'entity' and is_corrupted")
    reason = B.entity_post_reason(F.col("original_statement"), F.col("statement"), F.col("original_entity"), F.col("new_entity"), X.entities(F.col("original_statement")))
    return rows.select("seq", reason.alias("reason"))


def attribute_pool(spark: SparkSession, folder: str) -> DataFrame:
    found = B.attribute_candidates(F.col("claim_text"), VOCABULARY)
    return _claims(spark, folder).select("claim_id", F.posexplode(found).alias("place", "x")).select("claim_id", "place", F.col("x.type").alias("type"), F.col("x.text").alias("text"))


def attribute_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Each claim's first attribute with 40 characters to both sides of its first place, and why it can't be changed."""
    first = F.get(B.attribute_candidates(F.col("claim_text"), VOCABULARY, 1), F.lit(0))
    rows = _claims(spark, folder).select("claim_id", "claim_text", first.alias("x")).where("x is not null").withColumn("start", F.instr("claim_text", F.col("x.text")) - 1)
    return rows.select("claim_id", X.surrounding(F.col("claim_text"), F.col("start"), F.col("start") + F.length("x.text")).alias("frame"), B.attribute_source_reason(F.col("claim_text"), F.col("x.type"), F.col("x.text"), F.col("start")).alias("reason"))


def attribute_post_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "items").where("kind = 'attribute' and is_corrupted")
    start = F.instr("original_statement", F.col("original_attribute")) - 1
    reason = B.attribute_post_reason(F.col("original_statement"), F.col("statement"), F.col("original_attribute"), F.col("shown_attribute"), start, X.entities(F.col("original_statement")))
    return rows.select("seq", reason.alias("reason"))


def _offered(spark: SparkSession, folder: str) -> DataFrame:
    said = F.get(B.attribute_candidates(F.col("claim_text"), {"adjective": ADJECTIVES}, 1), F.lit(0))["text"]
    rows = _claims(spark, folder).select("claim_id", "claim_text", said.alias("said")).where("said is not null").withColumn("start", F.instr("claim_text", F.col("said")) - 1)
    return rows.select("claim_id", F.lower("said").alias("value"), B.replacements(F.col("claim_text"), F.col("said"), F.col("start"), F.col("claim_id"), ADJECTIVES).alias("options"))


def attribute_replacements(spark: SparkSession, folder: str) -> DataFrame:
    """What each claim's adjective may become, in the claim's own order; the first is taken without a cap."""
    return _offered(spark, folder).select("claim_id", "value", F.get("options", F.lit(0)).alias("first"), F.size("options").cast("bigint").alias("n_options"))


def capped_replacements(spark: SparkSession, folder: str) -> DataFrame:
    """The same with each pair used at most CAP times, in the order of the claims."""
    offered = written(_offered(spark, folder).select("claim_id", "value", "options"), "offered")  # else each filter would work out the options again
    return B.capped(offered, "value", "options", "claim_id", CAP).select("claim_id", "value", "chosen")


def contradiction_control(spark: SparkSession, folder: str) -> DataFrame:
    """Clean number items with a plainly false statement appended; the statements are dealt evenly in a hashed order."""
    rows = items_once(table(spark, folder, "items")).where("family = 'number' and not is_corrupted and statement is not null").select("id", "statement").withColumn("h", sampling.hashed("template", F.col("id"))).withColumn("g", F.lit(1))
    placed = sampling.ranked(rows, ["g"], "h", "place")
    number = ((F.col("place") - 1) % len(B.CONTRADICTIONS)).cast("int")
    return placed.select("id", number.cast("bigint").alias("template"), F.concat(F.rtrim("statement"), F.lit(" "), F.get(F.lit(list(B.CONTRADICTIONS)), number)).alias("statement"))


def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompts for each item, without a reference and with its original statement as one, by digest."""
    rows = items_once(table(spark, folder, "items")).select("id", "statement").where("statement is not null")
    free, grounded = X.prompt(X.STATEMENT_PROMPT, F.col("statement")), X.prompt(X.GROUNDED_PROMPT, F.col("statement"), F.col("statement"))
    return rows.select("id", F.sha2(free, 256).alias("free"), F.sha2(grounded, 256).alias("grounded"))


def validator_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gates over the answers in JSON of the log: an answer passes if it is true and gives a reason."""
    body = F.from_json(X.strip_json(F.col("raw_response")), "map<string, string>")
    flags = F.map_from_arrays(F.array(F.lit("verdict"), F.lit("reason")), F.array(F.coalesce(F.element_at("b", F.lit("verdict")) == "true", F.lit(False)), F.coalesce(F.element_at("b", F.lit("reason")) != "", F.lit(False))))
    rows = table(spark, folder, "rf_cache").select("seq", "raw_response", body.alias("b")).where(F.col("raw_response").startswith("{"))
    usable = F.when(F.col("b").isNotNull() & (F.size("b") > 0), flags)
    return rows.groupBy(B.gate(usable, ("verdict", "reason")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def grounded_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Missing or invalid grounded verdicts of two deterministic judges asked again with the original statement as the reference: stored and repaired verdicts by judge."""
    items = items_once(table(spark, folder, "items")).select("id", "statement").where("statement is not null")
    backends = [judges.HashJudge("rule-a"), judges.HashJudge("rule-b")]
    stored = table(spark, folder, "rf_cache").where(F.lower(F.trim("mode")) == "grounded").select(spelled("item_id").alias("id"), "verdict", "seq").where("id is not null")
    last = stored.groupBy("id").agg(F.max_by("verdict", "seq").alias("verdict"))
    kept = last.select("id", F.lit("rule-a").alias("judge"), "verdict")
    out = judges.repaired(items.withColumn("reference", F.col("statement")), kept, backends)
    return out.groupBy("judge", "source", "verdict").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        number_source_filter, number_post_filter, entity_classes, entity_post_filter, attribute_pool, attribute_frames, attribute_post_filter, attribute_replacements, capped_replacements, contradiction_control, judge_prompts, validator_gates, grounded_repair,
    )
}


def _sql() -> dict[str, str]:
    s, norm, names = texts._s, texts._norm, texts._names
    some = lambda t, parts: "(" + " or ".join(f"contains({t}, '{p}')" for p in parts) + ")"
    among = lambda c, parts: f"{c} in ({', '.join(map(repr, parts))})"
    hedge = some("(' ' || lower(t) || ' ')", (*X.HEDGES, " somewhat ", " estimate "))
    left, right = "regexp_extract(b, '([A-Za-z][A-Za-z''.-]*)[^A-Za-z0-9_]*$', 1)", "regexp_extract(a, '^[^A-Za-z0-9_]*([A-Za-z][A-Za-z''.-]*)', 1)"
    month = "lower(regexp_extract(substr(t, 1, s), '([A-Za-z]+)[^A-Za-z0-9_]*$', 1))"
    pairs = texts._pairs("t", "changed")
    days = "case m " + " ".join(f"when '{m}' then {n}" for m, n in X.MONTH_DAYS.items()) + " end"
    spaced = lambda c: f"(' ' || {norm(c)} || ' ')"
    times = lambda t, p: f"case when {norm(p)} = '' then 0 else (length({spaced(t)}) - length(replace({spaced(t)}, {spaced(p)}, ''))) // length({spaced(p)}) end"
    holds = lambda t, p: f"({norm(p)} <> '' and contains({spaced(t)}, {spaced(p)}))"

    def generic(c: str) -> str:
        n = norm(c)
        words = lambda terms: f"list_has_any(string_split({n}, ' '), [{', '.join(map(repr, terms))}])"
        cases = [(f"{n} = ''", "missing_entity_text"), (among(n, B.LANGUAGE_TERMS), "language_term"), (among(n, B.MEDIA_TERMS), "media_or_platform_term"), (among(n, B.LOW_MONTHS), "month_term"), (among(n, B.GENERIC_ATTRIBUTES), "generic_attribute"), (among(n, B.PLACEHOLDERS), "placeholder_entity"), (among(n, B.ROLE_TERMS), "role_or_office_term"),
            ("(" + " or ".join(f"starts_with({n}, '{r} of ')" for r in B.ROLE_TERMS) + ")", "role_or_office_phrase"), (f"{words(B.NATIONALITY_TERMS)} and {words(B.GENERIC_HEADS)}", "nationality_or_attribute_phrase"), (words(("tv", "radio", "television")), "media_type_phrase"), (f"{words(('senator',))} and {words(('democratic', 'republican'))}", "party_title_phrase"),
            (among(n, B.RELIGION_TERMS), "religion_or_attribute_term"), (among(n, B.AWARD_TERMS), "award_category_term"), (among(n, B.PARTIAL_TITLES), "partial_title_or_common_word")]
        return "case " + " ".join(f"when {a} then '{b}'" for a, b in cases) + " else '' end"

    entity = [("c is null or c = '' or c = o", "generated_no_change"), ("x is null or y is null or trim(x) = '' or trim(y) = ''", "missing_entity_metadata"), (f"{norm('x')} = {norm('y')}", "same_entity"), (f"not coalesce(list_bool_or(list_transform({names('o')}, lambda e: {norm('e')} = {norm('x')})), false)", "original_entity_not_in_allowed_list"),
        (f"not {holds('o', 'x')}", "original_entity_not_in_original"), (f"not {holds('c', 'y')}", "new_entity_not_in_modified"), (holds("o", "y"), "new_entity_already_in_original"), (holds("c", "x"), "original_entity_still_in_modified"), (f"({times('c', 'y')}) <> 1", "new_entity_not_unique_in_modified"),
        (f"regexp_matches({norm('y')}, '^\\d+(?:[/-]\\d+)*$')", "replacement_is_number_or_date"), (among(norm("y"), B.LOW_MONTHS), "replacement_is_month"), (among(norm("y"), B.GENERIC_ATTRIBUTES), "replacement_is_generic_attribute")]
    both = norm("o || ' ' || c")
    late = [("not contains(trim(x), ' ') and regexp_matches(o, '\\b' || regexp_escape(trim(x)) || '\\s+[A-Z][A-Za-z]+\\b')", "original_entity_is_partial_person_name"), (some(both, B.BROAD_FRAMES), "broad_or_ambiguous_frame"), ("ends_with(trim(o), '.') and not ends_with(trim(c), '.')", "punctuation_or_fluency_artifact"), (some(both, B.BROAD_FRAMES_V4), "broad_or_ambiguous_frame_v4")]
    cases = lambda xs: " ".join(f"when {a} then '{b}'" for a, b in xs)
    listed = "list_concat(" + ", ".join(f"list_transform(regexp_extract_all(claim_text, '{B.attribute_pattern(k, v)}', 1), lambda x: {{'k': '{k}', 'v': x}})" for k, v in VOCABULARY.items()) + ")"
    pool = f"ap as (select claim_id, claim_text, {listed} l from claim_pool where claim_text is not null and not ({' or '.join(f"regexp_matches(claim_text, '{p}')" for _, p in X.FRAMES)}))"
    frames = lambda t, last: "case " + " ".join(f"when regexp_matches({t}, '{p}') then '{n}'" for n, p in B.ARTIFACT_FRAMES) + f" else {last} end"
    nations = B._OF_NATION.lower()
    source = f"""case when {frames('claim_text', "''")} <> '' then {frames('claim_text', "''")} when k = 'genre' and n in ('action', 'adventure', 'fantasy') then 'genre_term_often_used_as_modifier_or_broad_category' when k = 'occupation' and n in ('writer', 'author', 'producer') then 'occupation_term_often_broad_or_multi_role'
 when k = 'nationality' and n in ('english', 'scottish', 'welsh') then 'nationality_term_can_be_language_or_regional_modifier' when k = 'occupation' and regexp_matches(a, '^\\s+of\\b') then 'occupation_followed_by_of_phrase' when k = 'genre' and regexp_matches(a, '^\\s+(?:duo|novelist|writer|author|band)\\b') then 'genre_modifies_non_work_head_noun'
 when k = 'genre' and regexp_matches(b, '\\banything to do with\\s+$') then 'genre_in_non_attribute_activity_frame' when k = 'genre' and regexp_matches(a, '^\\s+{nations}\\b') then 'genre_before_nationality_modifier' else 'accepted' end"""
    adjectives = f"[{', '.join(map(repr, ADJECTIVES))}]"
    n = len(ADJECTIVES)
    article = "lower(regexp_extract(substr(claim_text, 1, s), '([A-Za-z]+)[^A-Za-z0-9_]*$', 1))"
    vowel = "regexp_matches(x, '^[aeiou]')"
    cased = "case when v = upper(v) then upper(x) when v[1] = upper(v[1]) then upper(x[1]) || x[2:] else x end"
    attribute = f"""case when c is null or c = '' or c = o then 'generated_no_change' when x is null or y is null or trim(x) = '' or trim(y) = '' then 'missing_attribute_metadata' when lower(trim(x)) = lower(trim(y)) then 'same_attribute' when regexp_extract_all(o, '{X.PLAIN_NUMBER}') <> regexp_extract_all(c, '{X.PLAIN_NUMBER}') then 'number_changed'
 when contains({spaced('(substr(o, 1, s) || substr(o, s + length(x) + 1))')}, {spaced('y')}) then 'new_attribute_already_elsewhere_in_original' when {frames('o', "''")} <> '' then 'source_filter:' || {frames('o', "''")} when substr(o, s + 1, length(x)) is distinct from x then 'attribute_span_mismatch'
 when coalesce(list_bool_or(list_transform({names('o')}, lambda e: {norm('e')} <> {norm('x')} and {norm('e')} <> '' and not contains({spaced('c')}, {spaced('e')}))), false) then 'named_entity_removed_or_changed' else 'accepted' end"""
    templates = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in B.CONTRADICTIONS) + "]"
    text = lambda t, *parts: "'" + t.replace("'", "''").replace("%s", "' || {} || '").format(*parts) + "'"
    it = texts._IT.replace("select id, is_corrupted,", "select id, kind family, statement, is_corrupted,")
    return {
        "number_source_filter": f"""with c as (select claim_id, claim_text t, number.text n, {texts._KIND} k, number.start s, number.end e, substr(claim_text, 1, number.start) b, substr(claim_text, number.end + 1) a from claim_pool), d as (select *, coalesce(substr(t, s + 1, e - s) = n, false) st, {left} l, {right} r from c)
select claim_id, case when {hedge} then 'source_hedged_or_approximate' when n is null or n = '' then 'source_missing_or_unsupported_number' when st and regexp_matches(b, '\\([^)]*$') and contains(a, ')') then 'target_number_inside_parenthetical_disambiguator' when st and (ends_with(b, ':') or starts_with(a, ':')) then 'target_number_in_colon_time_or_title_expression'
 when st and regexp_matches(a, '(?i)^(?:''s|s)\\b') then 'target_number_has_decade_or_age_range_suffix' when st and regexp_matches(l, '^[A-Z]') and not {among('lower(l)', (*B.LOW_MONTHS, *B.PROPER_STOP))} then 'target_number_adjacent_to_proper_name_or_model' when st and s = 0 and regexp_matches(r, '^[A-Z]') and not {among('lower(r)', B.LOW_MONTHS)} then 'target_number_at_start_of_proper_name_or_model'
 when st and {among('lower(l)', B.PROPER_STOP)} and regexp_matches(r, '^[A-Z]') and not {among('lower(r)', (*B.LOW_MONTHS, *B.ADJECTIVES))} then 'target_number_begins_proper_title_after_stopword' else 'accepted' end reason from d""",
        "number_post_filter": f"""with {texts._SHOWN}, p as (select *, substr(t, s + 1, e - s) = n st, n <> '' and (length(t) - length(replace(t, n, ''))) = length(n) one from sh), ch as (select *, case when st then substr(t, 1, s) || shown || substr(t, e + 1) when one then replace(t, n, shown) end as changed, case when st then '' when one then 'span_mismatch_used_unique_replace' else 'number_span_mismatch_or_not_unique' end note, {month} m from p),
r as (select *, try_cast(replace({pairs}[1][2], ',', '') as int) dy from ch) select claim_id, changed, note, case when changed is null or changed = '' or changed = t then 'generated_no_change' when n <> '' and contains(changed, n) then 'original_number_still_in_modified' when {texts._count('t')} <> {texts._count('changed')} then 'number_count_changed' when len({pairs}) <> 1 then 'not_exactly_one_number_changed'
 when dy is not null and {days} is not null and (dy < 1 or dy > {days}) then 'invalid_month_day_after_corruption' else 'accepted' end reason from r""",
        "entity_classes": f"""with {texts._NAMES}, f as (select claim_id, claim_text t, names[1] e, strpos(claim_text, names[1]) p from nm), g as (select *, lower(e) el, lower(substr(t, greatest(p - 50, 1)::bigint, (length(e) + least(p - 1, 50) + 50)::bigint)) w from f)
select claim_id, case when e is null then 'none' when {some('el', X.ORGANIZATION)} then 'organization_like' when {some('el', X.PLACE)} then 'place_like' when regexp_matches(w, '\\b({'|'.join(X.PERSON)})\\b') then 'person_like' when regexp_matches(w, '\\b({'|'.join(X.WORK)})\\b') then 'work_like' when len(regexp_split_to_array(e, '\\s+')) >= 2 then 'multi_token_proper_noun' else 'single_token_proper_noun' end class from g""",
        "entity_post_filter": f"""with i as (select seq, original_statement o, statement c, original_entity x, new_entity y from items where kind = 'entity' and is_corrupted), g as (select *, {generic('x')} gx, {generic('y')} gy from i)
select seq, case {cases(entity)} when gx <> '' then 'original_entity_is_' || gx when gy <> '' then 'replacement_entity_is_' || gy {cases(late)} else 'accepted' end reason from g""",
        "attribute_pool": f"with {pool}, e as (select claim_id, unnest(l[1:3]) x, generate_subscripts(l[1:3], 1) - 1 place from ap) select claim_id, place, x.k as type, x.v as text from e",
        "attribute_frames": f"""with {pool}, f as (select claim_id, claim_text, l[1].k k, l[1].v v, strpos(claim_text, l[1].v) - 1 s from ap where len(l) > 0), g as (select *, lower(v) n, lower(substr(claim_text, (s + length(v) + 1)::bigint, 30)) a, lower(substr(claim_text, (greatest(s - 30, 0) + 1)::bigint, least(s, 30)::bigint)) b from f)
select claim_id, substr(claim_text, (greatest(s - 40, 0) + 1)::bigint, (s + length(v) + 40 - greatest(s - 40, 0))::bigint) frame, {source} reason from g""",
        "attribute_post_filter": f"with i as (select seq, original_statement o, statement c, original_attribute x, shown_attribute y, strpos(original_statement, original_attribute) - 1 s from items where kind = 'attribute' and is_corrupted) select seq, {attribute} reason from i",
        "attribute_replacements": f"""with f as (select claim_id, claim_text, regexp_extract_all(claim_text, '{B.attribute_pattern('adjective', ADJECTIVES)}', 1)[1] v from claim_pool where not ({' or '.join(f"regexp_matches(claim_text, '{p}')" for _, p in X.FRAMES)})), g as (select *, strpos(claim_text, v) - 1 s, (('0x' || substr(sha256(claim_id), 1, 8))::bigint % {n})::int k, {adjectives} vs from f where v is not null),
h as (select *, {article} art, list_concat(vs[k + 1:], vs[:k]) turned from g), o as (select claim_id, v, list_distinct_ordered from (select *, list_transform(list_filter(turned, lambda x: x <> {norm('v')} and case art when 'an' then {vowel} when 'a' then not {vowel} else true end), lambda x: {cased}) list_distinct_ordered from h))
select claim_id, lower(v) as value, list_distinct_ordered[1] as first, len(list_distinct_ordered) n_options from o""",
        "contradiction_control": f"with {it}, p as (select id, statement, (row_number() over (order by sha256(concat_ws('|', 'template', id))) - 1) % {len(B.CONTRADICTIONS)} as template from it where family = 'number' and not is_corrupted and statement is not null) select id, template, rtrim(statement) || ' ' || ({templates})[template + 1] as statement from p",
        "judge_prompts": f"with {it} select id, sha256({text(X.STATEMENT_PROMPT, 'statement')}) free, sha256({text(X.GROUNDED_PROMPT, 'statement', 'statement')}) grounded from it where statement is not null",
    }


SQL = _sql()
