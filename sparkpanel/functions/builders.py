"""Filters and perturbations that build corrupted claims, as column expressions: the first reason that applies, or accepted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as X

# Word lists, patterns and names of reasons that decide results.
PROPER_STOP = ("a", "an", "as", "by", "for", "from", "in", "of", "on", "the", "to", "was", "were")
ADJECTIVES = ("african", "american", "australian", "british", "canadian", "chinese", "dutch", "english", "european", "french", "german", "indian", "irish", "italian", "japanese", "korean", "mexican", "russian", "spanish", "swedish")
LOW_MONTHS = tuple(m.lower() for m in X.MONTHS)
GENERIC_ATTRIBUTES = (
    "actor", "actress", "singer", "director", "writer", "author", "book", "film", "movie", "album", "song", "series", "game", "novel", "play", "american", "british", "french", "german", "indian", "japanese",
    "canadian", "australian", "chinese", "italian", "spanish", "russian", "swedish", "korean", "mexican", "brazilian", "grammy", "emmy",
)
LANGUAGE_TERMS = ("arabic", "aramaic", "bengali", "cantonese", "english", "french", "german", "greek", "hebrew", "hindi", "italian", "japanese", "korean", "latin", "mandarin", "persian", "portuguese", "russian", "spanish", "tamil", "telugu", "urdu")
MEDIA_TERMS = ("radio", "television", "tv", "uk tv", "us tv", "netflix", "hulu", "streaming", "broadcast")
NATIONALITY_TERMS = ("american", "australian", "bengali", "british", "canadian", "chinese", "democratic", "french", "german", "indian", "italian", "japanese", "mexican", "republican", "russian", "south korean", "spanish", "swedish")
GENERIC_HEADS = ("actor", "actress", "author", "category", "director", "film", "genre", "language", "medium", "movie", "office", "personality", "president", "role", "senator", "show", "territory", "writer")
ROLE_TERMS = ("general secretary", "president", "prime minister", "senator", "secretary of state")
PLACEHOLDERS = ("abcd",)
RELIGION_TERMS = ("buddhist", "catholic", "christian", "christianity", "hindu", "hinduism", "islam", "islamic", "jewish", "judaism", "muslim", "protestant")
AWARD_TERMS = ("best actor", "best actress", "best supporting actor", "best supporting actress")
PARTIAL_TITLES = ("anything", "boy", "everything", "girl")
BROAD_FRAMES = (
    "general secretary is a rank", "has been in a movie", "is an american actor and film director", "was hospitalized during his childhood", "was hospitalized during her childhood", "worked on a comedy show",
)
BROAD_FRAMES_V4 = ("championship featured", "games are part of the", "games are part of", "is a series of spy films", "is a spy film series")
_LANGUAGES = ("English", "French", "Spanish", "Japanese", "German", "Italian", "Chinese", "Korean", "Hindi", "Tamil", "Russian", "Portuguese", "Arabic", "Mandarin", "Bengali", "Telugu", "Persian", "Latin")
_GENRES = ("black comedy", "romantic comedy", "science fiction", "comedy", "drama", "thriller", "horror", "documentary", "animated", "romance", "action", "adventure", "fantasy", "crime", "mystery", "western", "musical")
_OCCUPATIONS = ("actor", "actress", "singer", "writer", "author", "director", "filmmaker", "producer", "composer", "musician", "novelist", "poet", "politician", "footballer", "basketball player", "baseball player", "tennis player", "journalist", "comedian")
_NATIONS = ("American", "British", "Canadian", "French", "German", "Indian", "Italian", "Japanese", "Chinese", "Australian", "Spanish", "Russian", "Mexican", "Swedish", "Korean", "English", "Irish", "Dutch", "Brazilian", "Norwegian", "Danish", "Polish", "Turkish", "Greek", "Scottish", "Welsh", "Israeli")
_TYPES = ("public university", "private university", "liberal arts college", "research university", "professional wrestler", "professional footballer", "professional basketball player", "professional baseball player")
#: Attribute types in the order in which they are looked for, with what a value may be.
VOCABULARY = {"language": tuple(f"{x}[- ]language" for x in _LANGUAGES), "type": _TYPES, "genre": _GENRES, "occupation": _OCCUPATIONS, "nationality": _NATIONS}
_BE = r"\b(?:is|was|are|were)\s+(?:an?\s+)?"
_OF_NATION = "(?:American|British|Canadian|French|German|Indian|Italian|Japanese|Chinese|Australian|Spanish|Russian|Mexican|Swedish|Korean|English|Irish|Dutch|Brazilian|Israeli)"
#: What must stand before a value in the strict mode.
STRICT = {"language": _BE, "type": _BE, "genre": rf"{_BE}{_OF_NATION}?\s*", "occupation": rf"\b(?:is|was|are|were|works as|worked as)\s+(?:an?\s+)?{_OF_NATION}?\s*", "nationality": r"\b(?:is|was|are|were|becomes|became|born)\s+(?:an?\s+)?"}
#: Values that may stand for another one of their type, in order.
REPLACEMENTS = {
    "nationality": tuple(x for x in _NATIONS if x != "English"),
    "occupation": ("actor", "singer", "director", "musician", "writer", "author", "artist", "athlete", "journalist", "composer", "novelist", "poet", "politician", "footballer", "basketball player", "baseball player", "tennis player", "comedian", "filmmaker", "producer"),
    "genre": ("comedy", "drama", "thriller", "horror", "documentary", "animated", "romance", "action", "adventure", "fantasy", "science fiction", "crime", "mystery", "western", "musical"),
    "language": tuple(f"{x}-language" for x in _LANGUAGES), "type": (*_TYPES, "professional tennis player"),
}
ARTIFACT_FRAMES = (("there_is_named_frame", r"(?i)^\s*There (?:is|are)\b"), ("called_frame", r"(?i)\bcalled\b"), ("named_frame", r"(?i)\bnamed\b"), ("has_attribute_in_title_frame", r"(?i)\b(?:song|album|film|book|novel)\s+titled\b"))
CLEAN_FLAGS = ("original_supported", "original_is_atomic_fact", "fluent_no_artifact")
CORRUPT_FLAGS = {
    "number": ("original_supported", "original_is_atomic_fact", "corrupted_is_false", "single_number_change_only", "fluent_no_artifact"),
    "entity": ("original_supported", "original_is_atomic_fact", "corrupted_is_false", "single_change_only", "fluent_no_artifact"),
    "attribute": ("original_supported", "original_is_atomic_fact", "corrupted_is_false", "target_is_non_entity_attribute", "single_attribute_change_only", "fluent_no_artifact"),
}
#: Statements that are plainly false, appended to true ones.
CONTRADICTIONS = (
    "The year 3026 occurred before the year 2026.", "The year 2999 occurred before the year 1999.", "The year 2500 came earlier than the year 1500.", "The year 3000 happened before the year 2000.", "The year 2850 took place before the year 1850.",
    "The year 2700 preceded the year 1700.", "The year 2222 came before the year 1222.", "The year 2650 occurred earlier than the year 1650.", "The number 10 is greater than the number 1,000.", "The number 7 is larger than the number 700.",
    "The number 25 is greater than the number 2,500.", "The number 3 is larger than the number 300,000.", "The number 50 exceeds the number 5,000.", "The number 12 is bigger than the number 12,000.", "Two plus two equals 22.",
    "Ten plus ten equals 1,010.", "Five plus five equals 55.", "One plus one equals 11.", "Three plus three equals 33.", "Ten times ten equals 10.", "Twenty times ten equals 20.", "One hundred divided by two equals 2.",
    "One thousand divided by ten equals 10,000.", "Half of 100 is 500.", "Half of 40 is 400.", "Double of 6 is 3.", "Double of 15 is 5.", "When counting upward from zero, 90 comes before 9.",
    "When counting upward from zero, 500 comes before 50.", "When counting upward from zero, 71 comes before 17.", "A total of 30 items is more than a total of 3,000 items.", "A total of 8 items exceeds a total of 800 items.",
    "A group of 4 people is larger than a group of 400 people.", "A distance of 5 meters is longer than a distance of 5,000 meters.", "A distance of 2 kilometers is longer than a distance of 200 kilometers.",
    "A weight of 3 kilograms is heavier than a weight of 3,000 kilograms.", "An amount of 9 dollars is more money than an amount of 900 dollars.", "A score of 11 points is higher than a score of 1,100 points.",
    "A temperature increase from 10 degrees to 20 degrees is a decrease.", "A count that goes from 100 down to 10 has increased.",
)


def first_reason(*cases: tuple[Column, str | Column], last: str = "accepted") -> Column:
    """The reason of the first condition that holds; a null condition doesn't."""
    out = None
    for condition, reason in cases:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out.otherwise(last)


def number_source_reason(claim: Column, number: Column, kind: Column, start: Column, end: Column) -> Column:
    """Why a claim's number can't be changed: hedges, kinds, brackets, times and titles, ages, or a name that it belongs to. Places count from 0; a number that isn't at its place is only judged by the first two."""
    before, after = F.substr(claim, F.lit(1), start), F.substr(claim, end + 1)
    stands = F.coalesce(F.substr(claim, start + 1, end - start) == number, F.lit(False))
    left = F.regexp_extract(before, r"([A-Za-z][A-Za-z'.-]*)[^A-Za-z0-9_]*$", 1)
    right = F.regexp_extract(after, r"^[^A-Za-z0-9_]*([A-Za-z][A-Za-z'.-]*)", 1)
    low_left, low_right = F.lower(left), F.lower(right)
    upper = lambda c: c.rlike("^[A-Z]")
    return first_reason(
        (X.hedged(claim, strict=True), "source_hedged_or_approximate"),
        (number.isNull() | (number == "") | ~F.coalesce(kind.isin("year", "integer", "decimal"), F.lit(False)), "source_missing_or_unsupported_number"),
        (stands & before.rlike(r"\([^)]*$") & after.contains(")"), "target_number_inside_parenthetical_disambiguator"),
        (stands & (before.endswith(":") | after.startswith(":")), "target_number_in_colon_time_or_title_expression"),
        (stands & after.rlike(r"(?i)^(?:'s|s)\b"), "target_number_has_decade_or_age_range_suffix"),
        (stands & upper(left) & ~low_left.isin(*LOW_MONTHS, *PROPER_STOP), "target_number_adjacent_to_proper_name_or_model"),
        (stands & (start == 0) & upper(right) & ~low_right.isin(*LOW_MONTHS), "target_number_at_start_of_proper_name_or_model"),
        (stands & low_left.isin(*PROPER_STOP) & upper(right) & ~low_right.isin(*LOW_MONTHS, *ADJECTIVES), "target_number_begins_proper_title_after_stopword"),
    )


def number_post_reason(claim: Column, number: Column, start: Column, changed: Column) -> Column:
    """Why a changed claim isn't one with exactly one other, possible number."""
    a, b = (F.regexp_extract_all(x, F.lit(X.PLAIN_NUMBER), F.lit(0)) for x in (claim, changed))
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"] != z["b"])
    month = X.previous_word(claim, start)
    day = F.regexp_replace(F.get(pairs, F.lit(0))["b"], ",", "").try_cast("int")
    return first_reason(
        (changed.isNull() | (changed == "") | (changed == claim), "generated_no_change"), ((number != "") & changed.contains(number), "original_number_still_in_modified"), (F.size(a) != F.size(b), "number_count_changed"),
        (F.size(pairs) != 1, "not_exactly_one_number_changed"), (month.isin(*LOW_MONTHS) & day.isNotNull() & ~X.valid_day(month, day), "invalid_month_day_after_corruption"),
    )


def replaced_number(claim: Column, number: Column, start: Column, end: Column, shown: Column) -> Column:
    """(changed, note): the number replaced at its place or, if it isn't there, where it stands only once; else null."""
    stands = F.substr(claim, start + 1, end - start) == number
    times = (F.length(claim) - F.length(F.replace(claim, number))) / F.length(number)
    changed = F.when(stands, X.replaced(claim, start, end, shown)).when((number != "") & (times == 1), F.replace(claim, number, shown))
    note = F.when(stands, "").when((number != "") & (times == 1), "span_mismatch_used_unique_replace").otherwise("number_span_mismatch_or_not_unique")
    return F.struct(changed.alias("changed"), note.alias("note"))


def generic_entity(name: Column) -> Column:
    """Why a name is too general to be an entity, or an empty text."""
    n = X.norm(name)
    words = F.split(n, " ")
    some = lambda terms: F.arrays_overlap(words, F.lit(list(terms)))
    roles = F.lit(False)
    for r in ROLE_TERMS:
        roles = roles | n.startswith(f"{r} of ")
    return first_reason(
        (n == "", "missing_entity_text"), (n.isin(*LANGUAGE_TERMS), "language_term"), (n.isin(*MEDIA_TERMS), "media_or_platform_term"), (n.isin(*LOW_MONTHS), "month_term"), (n.isin(*GENERIC_ATTRIBUTES), "generic_attribute"),
        (n.isin(*PLACEHOLDERS), "placeholder_entity"), (n.isin(*ROLE_TERMS), "role_or_office_term"), (roles, "role_or_office_phrase"), (some(NATIONALITY_TERMS) & some(GENERIC_HEADS), "nationality_or_attribute_phrase"),
        (some(("tv", "radio", "television")), "media_type_phrase"), (F.array_contains(words, "senator") & some(("democratic", "republican")), "party_title_phrase"),
        (n.isin(*RELIGION_TERMS), "religion_or_attribute_term"), (n.isin(*AWARD_TERMS), "award_category_term"), (n.isin(*PARTIAL_TITLES), "partial_title_or_common_word"), last="",
    )


def entity_post_reason(claim: Column, changed: Column, old: Column, new: Column, allowed: Column) -> Column:
    """Why a claim with a swapped entity isn't one with exactly one other, specific name; in the strictest version."""
    low_old, low_new = X.norm(old), X.norm(new)
    listed = F.exists(allowed, lambda e: X.norm(e) == low_old)
    both = X.norm(F.concat_ws(" ", claim, changed))
    frame = lambda frames: X._contains_any(both, frames)
    generic = [(generic_entity(e) != "", F.concat(F.lit(f"{role}_entity_is_"), generic_entity(e))) for role, e in (("original", old), ("replacement", new))]
    partial = ~F.trim(old).contains(" ") & F.rlike(claim, F.concat(F.lit(r"\b\Q"), F.trim(old), F.lit(r"\E\s+[A-Z][A-Za-z]+\b")))
    return first_reason(
        (changed.isNull() | (changed == "") | (changed == claim), "generated_no_change"), (old.isNull() | new.isNull() | (F.trim(old) == "") | (F.trim(new) == ""), "missing_entity_metadata"), (low_old == low_new, "same_entity"),
        (~F.coalesce(listed, F.lit(False)), "original_entity_not_in_allowed_list"), (~X.contains_norm(claim, old), "original_entity_not_in_original"), (~X.contains_norm(changed, new), "new_entity_not_in_modified"),
        (X.contains_norm(claim, new), "new_entity_already_in_original"), (X.contains_norm(changed, old), "original_entity_still_in_modified"), (X.count_norm(changed, new) != 1, "new_entity_not_unique_in_modified"),
        (low_new.rlike(r"^\d+(?:[/-]\d+)*$"), "replacement_is_number_or_date"), (low_new.isin(*LOW_MONTHS), "replacement_is_month"), (low_new.isin(*GENERIC_ATTRIBUTES), "replacement_is_generic_attribute"),
        *generic, (partial, "original_entity_is_partial_person_name"), (frame(BROAD_FRAMES), "broad_or_ambiguous_frame"), (F.trim(claim).endswith(".") & ~F.trim(changed).endswith("."), "punctuation_or_fluency_artifact"), (frame(BROAD_FRAMES_V4), "broad_or_ambiguous_frame_v4"),
    )


def attribute_pattern(kind: str, values: Sequence[str], strict: bool = False) -> str:
    return rf"(?i){STRICT.get(kind, _BE) if strict else chr(92) + 'b'}({'|'.join(values)})\b"


def attribute_candidates(text: Column, vocabulary: Mapping[str, Sequence[str]] = VOCABULARY, most: int = 3, strict: bool = False) -> Column:
    """The first ``most`` attributes (type, text) of a claim, in the order of the types and then of the text; none where a frame rules the claim out. A place gives one attribute."""
    found = lambda kind, values: F.transform(F.regexp_extract_all(text, F.lit(attribute_pattern(kind, values, strict)), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))
    each = [found(k, v) for k, v in vocabulary.items()]
    return F.when(X.frame_reject(text).isNull(), F.slice(F.concat(*each), 1, most))


def artifact_reason(claim: Column) -> Column:
    return first_reason(*((claim.rlike(p), n) for n, p in ARTIFACT_FRAMES), last="")


def attribute_source_reason(claim: Column, kind: Column, value: Column, start: Column) -> Column:
    """Why an attribute can't be changed, in the strictest version: frames, broad terms and what stands around it."""
    n = F.lower(F.trim(value))
    after = F.lower(F.substr(claim, start + F.length(value) + 1, F.lit(30)))
    before = F.lower(F.substr(claim, F.greatest(start - 30, F.lit(0)) + 1, F.least(start, F.lit(30))))
    nations = _OF_NATION.lower()
    frame = artifact_reason(claim)
    return first_reason(
        (frame != "", frame), ((kind == "genre") & n.isin("action", "adventure", "fantasy"), "genre_term_often_used_as_modifier_or_broad_category"), ((kind == "occupation") & n.isin("writer", "author", "producer"), "occupation_term_often_broad_or_multi_role"),
        ((kind == "nationality") & n.isin("english", "scottish", "welsh"), "nationality_term_can_be_language_or_regional_modifier"), ((kind == "occupation") & after.rlike(r"^\s+of\b"), "occupation_followed_by_of_phrase"),
        ((kind == "genre") & after.rlike(r"^\s+(?:duo|novelist|writer|author|band)\b"), "genre_modifies_non_work_head_noun"), ((kind == "genre") & before.rlike(r"\banything to do with\s+$"), "genre_in_non_attribute_activity_frame"),
        ((kind == "genre") & after.rlike(rf"^\s+{nations}\b"), "genre_before_nationality_modifier"),
    )


def attribute_post_reason(claim: Column, changed: Column, old: Column, new: Column, start: Column, allowed: Column) -> Column:
    """Why a claim with a swapped attribute isn't one with exactly that change."""
    low = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    spaced = lambda c: F.concat(F.lit(" "), X.norm(c), F.lit(" "))
    numbers = lambda c: F.regexp_extract_all(c, F.lit(X.PLAIN_NUMBER), F.lit(0))
    rest = F.concat(F.substr(claim, F.lit(1), start), F.substr(claim, start + F.length(old) + 1))
    frame = artifact_reason(claim)
    body = spaced(changed)
    lost = F.exists(allowed, lambda e: (X.norm(e) != X.norm(old)) & (X.norm(e) != "") & ~body.contains(spaced(e)))
    return first_reason(
        (changed.isNull() | (changed == "") | (changed == claim), "generated_no_change"), (old.isNull() | new.isNull() | (F.trim(old) == "") | (F.trim(new) == ""), "missing_attribute_metadata"), (low(old) == low(new), "same_attribute"),
        (numbers(claim) != numbers(changed), "number_changed"), (spaced(rest).contains(spaced(new)), "new_attribute_already_elsewhere_in_original"), (frame != "", F.concat(F.lit("source_filter:"), frame)),
        (F.coalesce(F.substr(claim, start + 1, F.length(old)) != old, F.lit(True)), "attribute_span_mismatch"), (F.coalesce(lost, F.lit(False)), "named_entity_removed_or_changed"),
    )


def replacements(claim: Column, value: Column, start: Column, key: Column, values: Sequence[str]) -> Column:
    """Values that may stand for another of their type: rotated by the claim's key, without the value itself, fitting the article before it, in its case."""
    article = X.previous_word(claim, start)
    turned = X.rotated(F.lit(list(values)), key)
    fitting = F.filter(turned, lambda v: (X.norm(v) != X.norm(value)) & X.article_matches(article, v))
    return F.array_distinct(F.transform(fitting, lambda v: X.match_case(value, v)))


def capped(rows: DataFrame, value: str, options: str, order: str, cap: int, most: int = 32) -> DataFrame:
    """The rows with the first of their options (column chosen) whose pair with the value has been used fewer than ``cap`` times by rows before them in ``order``; null where all are used up.

    ``order`` is a unique column and no row has more than ``most`` options. Pairs of different values don't bear on each
    other, so each value is a sequence of its own. Of rows with the same value and the same set of options only the
    first (options x cap) can get one, as each takes a place and options never come back; all later ones get none
    without being looked at. So a value that any number of rows share is a short sequence, which the ranking's limit
    cuts before the shuffle. A null value, null options or none give null.
    """
    kinds = F.concat_ws("\u0001", F.array_sort(options))
    place = F.row_number().over(Window.partitionBy(value, "__kinds").orderBy(order))
    ranked = rows.where(F.col(value).isNotNull() & (F.size(options) > 0)).withColumn("__kinds", kinds).withColumn("__place", place).where(F.col("__place") <= cap * most)
    early = ranked.where(F.col("__place") <= cap * F.size(options))

    def choose(pdf):
        pdf = pdf.sort_values([order, "__place"], kind="stable")
        used: dict[str, int] = {}
        chosen = []
        for wanted in pdf[options]:
            found = next((w for w in wanted if used.get(w.lower(), 0) < cap), None)
            if found is not None:
                used[found.lower()] = used.get(found.lower(), 0) + 1
            chosen.append(found)
        return pdf.drop(columns=["__kinds", "__place"]).assign(chosen=chosen)

    schema = T.StructType([*rows.schema.fields, T.StructField("chosen", T.StringType())])
    sequence = early.groupBy(value).applyInPandas(choose, schema)
    rest = rows.join(early.select(order), order, "left_anti").select(*rows.columns)
    return sequence.unionByName(rest.withColumn("chosen", F.lit(None).cast("string")))


def gate(answer: Column, flags: Sequence[str], within: bool = False) -> Column:
    """accepted if all flags of a validator's answer (map of name to boolean) are true, and within_acceptable_range is false where that is asked; else the failed ones in order, or that there was no answer."""
    failed = [F.when(~F.coalesce(F.element_at(answer, F.lit(f)), F.lit(False)), f) for f in flags]
    if within:
        failed.append(F.when(F.coalesce(F.element_at(answer, F.lit("within_acceptable_range")), F.lit(True)), "within_acceptable_range"))
    reasons = F.concat_ws(",", *failed)
    return F.when(answer.isNull() | (F.size(answer) == 0), "validator_parse_or_api_fail").when(reasons == "", "accepted").otherwise(reasons)
