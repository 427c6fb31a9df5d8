import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel.functions import builders as B
from sparkpanel.functions import text as X
from sparkpanel.operators import judges
from sparkpanel.operators import stats
from sparkpanel.sources import files


def _one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_entities_at_the_start_of_a_text(spark):
    texts = {"Artful people in London met Art": ["London", "Art"], "Art met Art in London": ["Art", "London"], "The May in Paris": ["Paris"], "Old Town fell in June": ["Old Town"], None: None, "": [], "Art1 in Art": ["Art"]}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.entities(F.col("t")).alias("e"), X.relation(F.col("t")).alias("r")).collect()
    assert {r.t: r.e for r in rows} == texts
    told = {"Profits rose in May": "increase_decrease", "Ann Rose met Bo": "none", "Beats Rose was heard": "none", "He beat Ann": "defeat_win_loss", None: None}
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", X.relation(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == told


def test_hedges_and_words(spark):
    assert _one(spark, X.hedged(F.lit("He moved over"))) and not _one(spark, X.hedged(F.lit("He overtook")))
    assert _one(spark, X.hedged(F.lit("It is somewhat old"), strict=True)) and not _one(spark, X.hedged(F.lit("It is somewhat old")))
    assert _one(spark, X.count_norm(F.lit("the cat, the Cat; concat the cat"), F.lit("Cat"))) == 3 and _one(spark, X.count_norm(F.lit("a"), F.lit("-"))) == 0
    assert _one(spark, X.previous_word(F.lit("In May, 12 men"), F.lit(8))) == "may" and _one(spark, X.previous_word(F.lit("12"), F.lit(0))) == ""
    assert _one(spark, X.surrounding(F.lit("abcdefgh"), F.lit(3), F.lit(4), 2)) == "bcdef"
    assert _one(spark, X.entity_class(F.lit("Acme University won"), F.array(F.lit("Acme University")))) == "organization_like"
    assert "Prior judges' verdicts: A, tie" in _one(spark, X.prompt(X.PAIR_PROMPT, F.lit("q"), F.lit("a"), F.lit("b"), X.prior_text(F.array(F.lit("A"), F.lit("tie")))))
    assert _one(spark, X.prompt(X.STATEMENT_PROMPT, F.lit("100% sure"))).count("100% sure") == 1


def test_one_usable_number(spark):
    told = {"It has 12 rooms": ("12", 12.0, 7, 9), "12 of 34": None, "from 10-20 on": None, "Windows 95 sold": None, "It cost 1,200 crowns": ("1,200", 1200.0, 8, 13), "only 9": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in told], "t string").select("t", X.single_number("t").alias("n")).collect()
    assert {r.t: tuple(r.n) if r.n and r.n.text else None for r in rows} == told


def test_number_filters(spark):
    def source(claim, number):
        at = claim.index(number)
        return _one(spark, B.number_source_reason(F.lit(claim), F.lit(number), F.lit("integer"), F.lit(at), F.lit(at + len(number))))

    cases = {("It had 30 rooms.", "30"): "accepted", ("It had about 30 rooms.", "30"): "source_hedged_or_approximate", ("Area (30) is old", "30"): "target_number_inside_parenthetical_disambiguator", ("At 9:30 he left", "30"): "target_number_in_colon_time_or_title_expression", ("In the 1920s he left", "1920"): "target_number_has_decade_or_age_range_suffix",
        ("He flew Apollo 13 home", "13"): "target_number_adjacent_to_proper_name_or_model", ("12 Monkeys is good", "12"): "target_number_at_start_of_proper_name_or_model", ("She saw the 12 Monkeys", "12"): "target_number_begins_proper_title_after_stopword", ("She met the 12 French men", "12"): "accepted", ("It was May 12 then", "12"): "accepted"}
    assert {k: source(*k) for k in cases} == cases
    assert _one(spark, B.number_source_reason(F.lit("No number"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"))) == "source_missing_or_unsupported_number"
    post = lambda claim, n, changed: _one(spark, B.number_post_reason(F.lit(claim), F.lit(n), F.lit(claim.index(n)), F.lit(changed)))
    assert post("On June 12 he left", "12", "On June 14 he left") == "accepted" and post("On June 25 he left", "25", "On June 31 he left") == "invalid_month_day_after_corruption"
    assert post("It had 30 rooms", "30", "It had 30 rooms") == "generated_no_change" and post("It had 30 rooms", "30", "It had 300 rooms") == "original_number_still_in_modified"
    assert post("It had 30 of 40", "30", "It had 31") == "number_count_changed" and post("It had 30 of 40", "30", "It had 31 of 41") == "not_exactly_one_number_changed"
    moved = B.replaced_number(F.lit("a 30 b"), F.lit("30"), F.lit(0), F.lit(2), F.lit("31"))
    assert tuple(_one(spark, moved)) == ("a 31 b", "span_mismatch_used_unique_replace")
    assert tuple(_one(spark, B.replaced_number(F.lit("30 or 30"), F.lit("30"), F.lit(1), F.lit(3), F.lit("31")))) == (None, "number_span_mismatch_or_not_unique")


def test_entity_filters(spark):
    def post(claim, changed, old, new, allowed=None):
        return _one(spark, B.entity_post_reason(F.lit(claim), F.lit(changed), F.lit(old), F.lit(new), F.array(*map(F.lit, allowed or [old]))))

    assert post("Ann Lee left Rome.", "Ann Lee left Oslo.", "Rome", "Oslo") == "accepted"
    assert post("Ann left Rome.", "Ann left Rome.", "Rome", "Oslo") == "generated_no_change" and post("Ann left Rome.", "Ann left Oslo.", "Rome", "ROME!") == "same_entity"
    assert post("Ann left Rome.", "Ann left Oslo.", "Rome", "Oslo", ["Ann"]) == "original_entity_not_in_allowed_list" and post("Ann left Rome.", "Ann left Paris.", "Rome", "Oslo") == "new_entity_not_in_modified"
    assert post("Oslo beat Rome.", "Oslo beat Oslo.", "Rome", "Oslo") == "new_entity_already_in_original" and post("Ann left Rome, Rome.", "Ann left Oslo, Rome.", "Rome", "Oslo") == "original_entity_still_in_modified"
    assert post("He is in Rome.", "He is in 12.", "Rome", "12") == "replacement_is_number_or_date"
    assert post("He left in Rome.", "He left in May.", "Rome", "May") == "replacement_is_month" and post("He is in Rome.", "He is in Film.", "Rome", "Film") == "replacement_is_generic_attribute"
    assert post("He spoke Greek.", "He spoke Oslo.", "Greek", "Oslo") == "original_entity_is_language_term" and post("Ann Lee left.", "Bo Lee left.", "Ann", "Bo") == "original_entity_is_partial_person_name"
    assert post("He is in Rome.", "He is in Oslo", "Rome", "Oslo") == "punctuation_or_fluency_artifact"
    assert _one(spark, B.generic_entity(F.lit("President of Oslo"))) == "role_or_office_phrase" and _one(spark, B.generic_entity(F.lit("Oslo"))) == "" and _one(spark, B.generic_entity(F.lit("Boy"))) == "partial_title_or_common_word"


def test_attributes(spark):
    found = lambda t, **k: [tuple(x) for x in _one(spark, B.attribute_candidates(F.lit(t), **k)) or []]
    assert found("He is an American actor in a black comedy") == [("genre", "black comedy"), ("occupation", "actor"), ("nationality", "American")]
    assert found("American actor", strict=True) == [] and found("He is an American actor", strict=True) == [("occupation", "actor"), ("nationality", "American")]
    assert found("He is an American actor in a drama", most=1) == [("genre", "drama")] and found("Is he an actor?") == []
    source = lambda t, k, v: _one(spark, B.attribute_source_reason(F.lit(t), F.lit(k), F.lit(v), F.lit(t.index(v))))
    assert source("He is a poet", "occupation", "poet") == "accepted" and source("He is a writer", "occupation", "writer") == "occupation_term_often_broad_or_multi_role" and source("He is director of it", "occupation", "director") == "occupation_followed_by_of_phrase"
    assert source("It is a comedy band", "genre", "comedy") == "genre_modifies_non_work_head_noun" and source("It is a comedy French film", "genre", "comedy") == "genre_before_nationality_modifier" and source("A dog named Bo is a poet", "occupation", "poet") == "named_frame"
    post = lambda o, c, x, y: _one(spark, B.attribute_post_reason(F.lit(o), F.lit(c), F.lit(x), F.lit(y), F.lit(o.find(x)), F.array(F.lit("Bo Lee"))))
    assert post("Bo Lee is a poet", "Bo Lee is an actor", "poet", "actor") == "accepted" and post("Bo Lee is a poet of 12", "Bo Lee is a singer of 13", "poet", "singer") == "number_changed"
    assert post("Bo Lee, actor, is a poet", "Bo Lee, actor, is an actor", "poet", "actor") == "new_attribute_already_elsewhere_in_original" and post("Bo Lee is a poet", "Bo is an actor", "poet", "actor") == "named_entity_removed_or_changed"
    options = _one(spark, B.replacements(F.lit("He is an Actor"), F.lit("Actor"), F.lit(9), F.lit("k"), B.REPLACEMENTS["occupation"]))
    assert set(options) == {"Author", "Artist", "Athlete"}


@pytest.mark.parametrize("cap", [1, 3])
def test_pairs_are_capped_in_order(spark, cap):
    rng = random.Random(cap)
    options = [["a", "b", "c"], ["b", "a"], [], ["c"]]
    rows = [(i, rng.choice(["x", "x", "x", "y", None]), rng.choice(options)) for i in range(200)] + [(200, "x", None)]
    used, want = {}, {}
    for i, v, wanted in rows:
        want[i] = next((w for w in wanted or [] if v is not None and used.get((v, w), 0) < cap), None)
        if want[i]:
            used[v, want[i]] = used.get((v, want[i]), 0) + 1
    frame = spark.createDataFrame(rows, "seq int, value string, options array<string>")
    assert {r.seq: r.chosen for r in B.capped(frame, "value", "options", "seq", cap, most=3).collect()} == want
    assert B.capped(frame.limit(0), "value", "options", "seq", cap).count() == 0


def test_gates(spark):
    gate = lambda answer, within=False: _one(spark, B.gate(F.create_map(*(x for k, v in answer.items() for x in (F.lit(k), F.lit(v)))), B.CORRUPT_FLAGS["number"], within))
    full = dict.fromkeys(B.CORRUPT_FLAGS["number"], True)
    assert gate(full) == "accepted" and gate(full, True) == "within_acceptable_range" and gate(full | {"within_acceptable_range": False}, True) == "accepted"
    assert gate(full | {"corrupted_is_false": False, "fluent_no_artifact": False}) == "corrupted_is_false,fluent_no_artifact"
    assert _one(spark, B.gate(F.lit(None).cast("map<string,boolean>"), B.CLEAN_FLAGS)) == "validator_parse_or_api_fail"


def test_repair_asks_only_where_no_verdict_is_valid(spark):
    items = spark.createDataFrame([("a", "s1", "r"), ("b", "s2", "r"), ("c", None, None)], "id string, statement string, reference string")
    stored = spark.createDataFrame([("a", "j", "true"), ("b", "j", "parse_fail"), ("z", "j", "true")], "id string, judge string, verdict string")
    got = {r.id: (r.verdict, r.source) for r in judges.repaired(items, stored, [judges.HashJudge("j")]).collect()}
    assert got["a"] == ("true", "stored") and got["b"][1] == "invalid" and got["c"][1] == "missing" and len(got) == 3
    judges.probe([judges.HashJudge("j")])

    class Dead:
        name = "dead"

        def answer(self, statement, attempt):
            raise OSError("down")

    with pytest.raises(judges.Unreachable, match="dead"):
        judges.probe([Dead()])

    class Picks:
        name = "p"

        def answer(self, statement, attempt):
            return "Tie." if statement.startswith("q1") else "I pick b"

    pairs = spark.createDataFrame([("1", "q1", "x", "y"), ("2", "q2", "x", None)], "id string, question string, a string, b string")
    assert {r.id: r.verdict for r in judges.compared(pairs, [Picks()]).collect()} == {"1": "tie", "2": "B"}


def test_permutations_of_counts_follow_the_exact_law(spark):
    rows = [("a", 40, 12, 15, 10, 4, 3, 5, 2), ("b", 4, 2, 2, 2, 2, 2, 2, 2), ("c", 30, 0, 5, 5, 0, 0, 2, 0)]
    counts = spark.createDataFrame(rows, "g string, n bigint, s1 bigint, s2 bigint, s3 bigint, s12 bigint, s13 bigint, s23 bigint, s123 bigint")
    exact = {r.g: r.p for r in stats.overlap_p(counts, ["g"]).collect()}
    drawn = {r.g: r.p for r in stats.count_null(counts, ["g"], 20_000).collect()}
    assert all(drawn[g] == pytest.approx(p, abs=0.02) for g, p in exact.items()) and drawn["b"] == pytest.approx(1 / 36, abs=0.01)
    assert stats.count_null(counts.limit(0), ["g"]).count() == 0
    assert [r[0] for r in spark.createDataFrame([(0.0, 0.0), (0.5, 0.25)], "a double, b double").select(stats.legacy_lift(F.col("a"), F.col("b"))).collect()] == [float("inf"), 2.0]


def test_leaves_and_archives(tmp_path):
    assert files.leaf_errors({"fa": 0.138, "rows": [42, None]}, {"fa": 0, "rows": [42]}) == (3, ["fa: 0.138 is now 0", "rows.1: missing"])
    assert files.leaf_errors({"flag": True}, {"flag": 1})[1] and files.leaf_errors({"calls": 3, "x": 1}, {"calls": 9, "x": 1.0}, ["calls"]) == (1, []) and files.leaf_errors({"note": "a"}, {})[1]
    assert files.json_safe({"a": [float("inf"), -float("inf"), 1.5], "b": None}) == {"a": ["inf", "-inf", 1.5], "b": None}
    data = files.archive({"data/t.jsonl": b"x\n"}, compressed=True)
    digest = __import__("hashlib").sha256(b"x\n").hexdigest()
    assert data == files.archive({"data/t.jsonl": b"x\n"}, compressed=True) and files.unpacked(data, {"data/t.jsonl": (digest, 2)}) == {"data/t.jsonl": b"x\n"}
    for bad in ({"data/t.jsonl": (digest, 3)}, {"data/t.jsonl": ("0" * 64, 2)}, {}, {"data/t.jsonl": (digest, 2), "more": (digest, 2)}):
        with pytest.raises(ValueError):
            files.unpacked(data, bad)
    with pytest.raises(ValueError):
        files.archive({"../escape": b""})


def test_records_of_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    (tmp_path / "r.jsonl").write_text('{"a": null, "b": 1}\n\n{"a": "x", "b": 2}\n{broken\n')
    assert sorted(r.b for r in files.read_jsonl(spark, str(tmp_path / "r.jsonl"), schema, strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, str(tmp_path / "r.jsonl"), schema).collect()
    (tmp_path / "p.jsonl").write_text('{"a": "x", "b": 2}\n')
    digest = files.manifest(spark, str(tmp_path / "p.jsonl")).first().sha256
    assert files.read_pinned_jsonl(spark, str(tmp_path / "p.jsonl"), digest, schema).count() == 1
    for pin, fields in (("0" * 64, schema), (digest, T.StructType(schema.fields[:1]))):
        with pytest.raises(ValueError):
            files.read_pinned_jsonl(spark, str(tmp_path / "p.jsonl"), pin, fields)
    (tmp_path / "l.tsv").write_text("1\ttrue\tA claim \tx\n2\thalf-true\tB\n3\tfalse\n4\tpants-fire\tC\n")
    assert {(r.id, r.label, r.statement) for r in files.labelled_statements(files.read_tsv(spark, str(tmp_path / "l.tsv"))).collect()} == {("1", "true", "A claim"), ("4", "false", "C")}
    (tmp_path / "a.tar.gz").write_bytes(files.archive({"d/x.jsonl": b"one\ntwo"}, compressed=True))
    assert {(r.member, r.place, r.line) for r in files.archive_lines(spark, str(tmp_path / "a.tar.gz")).collect()} == {("d/x.jsonl", 0, "one"), ("d/x.jsonl", 1, "two")}
    claims = spark.sql("""select * from values (1, 'c', map('7', array(named_struct('sentences', array(0), 'label', 'SUPPORT'))), 1), (2, 'd', map('7', array(named_struct('sentences', array(0), 'label', 'SUPPORT'), named_struct('sentences', array(1), 'label', 'CONTRADICT'))), 1), (1, 'e', map('8', array(named_struct('sentences', array(0), 'label', 'CONTRADICT'))), 2) as t(id, claim, evidence, place)""")
    assert [(r.id, r.claim, r.label) for r in files.annotated_claims(claims).collect()] == [(1, "e", "false")]
    (tmp_path / "audit.md").write_text("  - audit_code: ok \n- audit_code:\n-  audit_code: x\ntext audit_code: y\n")
    assert {(r.code, r.n) for r in files.audit_codes(spark, str(tmp_path / "audit.md")).collect()} == {("ok", 1), ("BLANK", 1), ("x", 1)}
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1\n")
    (src / "b.py").write_text("x = (\n")
    (src / "c.txt").write_text("key AS" + "IA" + "ABCDEFGHIJKLMNOP")
    assert [r.path.rsplit("/")[-1] for r in files.unparsable(spark, str(src)).collect()] == ["b.py"] and [r.path.rsplit("/")[-1] for r in files.secrets(spark, str(src)).collect()] == ["c.txt"]
    files.to_summary(spark.createDataFrame([(1, float("inf"))], "a int, b double"), str(tmp_path / "s" / "o.json"))
    assert '"b": "inf"' in (tmp_path / "s" / "o.json").read_text()
    report = spark.createDataFrame([("b", 0.5, 0.1, 0), ("a", None, None, 2)], "family string, fa_mean double, fa_std double, missing_grounded int")
    assert files.to_markdown(report, order=["family"], ranks={"family": ["b", "a"]}).split("\n")[2:] == ["| b | 0.500 ± 0.100 | 0 |", "| a | MISSING | 2 |"]
