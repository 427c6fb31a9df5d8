import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.common import skew_join
from sparkpanel.llm import consensus, leakage, mixture, overlap, residue, responses

NAMES = ["Alva Brint", "Corin Dask", "Edda Falk", "Gorm Hult", "Ines Jorda", "Karo Lund"]
THINGS = [f"{a}{b} {c}{d}" for a, b, c, d in zip(["Ba", "Ce", "Di", "Fo", "Gu", "Ha", "Je", "Ki", "Lo", "Mu"] * 6, ["vel", "nor", "tis"] * 20, ["Pa", "Re", "Si", "To", "Vu"] * 12, ["zado", "mifo", "kelu", "rasi"] * 15)]


def _items(spark, rows):
    return spark.createDataFrame(rows, "id string, class boolean, split string, statement string, cid string, term string")


def _base():
    rng = random.Random(1)
    rows = []
    for k, thing in enumerate(THINGS):
        s = f"The wooden library {thing} burned down in {1800 + k}, a year after {rng.choice(NAMES)} took it over in Oslo."
        rows.append((f"t{k:03}", k % 2 == 0, "train", s, "clash", "clash"))
        rows.append((f"u{k:03}", k % 2 == 0, "train", s.replace("burned down", "closed").replace(THINGS[k], THINGS[k][::-1].title()), None, None))
    return rows


def test_overlap_finds_variants_and_no_other_claims(spark):
    rows = _base()
    s = {r[0]: r[3] for r in rows}
    same = {
        "e0": s["t000"].upper(), "e1": "Fact: " + s["t001"].rstrip("."), "e2": s["t002"].replace("library", "librrary").replace("down", "donw"), "e3": s["t003"].replace("1803", "１８０３"),
        "e4": "In 1804 the wooden library " + THINGS[4] + " burned down, a year after" + s["t004"].split("a year after")[1], "e5": s["t005"].replace("The ", "").replace(" a ", " "), "e6": s["t006"],
    }
    other = {"n0": s["t000"].replace("1800", "1801"), "n1": s["t001"].replace("wooden", "silver"), "n2": s["t002"].replace("Oslo", "Bergen"), "n3": s["t003"]}
    made = rows + [(k, int(k[1]) % 2 == 0, "dev", v, None, None) for k, v in same.items()] + [(k, k != "n1" if k != "n3" else True, "test", v, None, None) for k, v in other.items()]
    made += [("e6", True, "dev", s["t006"], None, None), ("z0", True, None, s["t000"], None, None), ("z1", None, "dev", s["t000"], None, None), ("z2", True, "dev", None, None, None), ("z3", True, "dev", " ... ", None, None), (None, True, "dev", s["t000"], None, None), ("t000b", True, "train", s["t000"], None, None)]
    attributes = spark.createDataFrame([("wooden",), ("silver",)], "term string")
    pairs, members = overlap.class_pairs(_items(spark, made), attributes)
    got = {tuple(r) for r in overlap.item_pairs(pairs, members).collect()}
    want = {tuple(sorted((k, f"t00{k[1]}"))) for k in same} | {("e0", "t000b")}
    assert got == want


def test_overlap_cosine_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(80)]
    rows = [(f"i{k:03}", True, "train" if k % 2 else "dev", " ".join(rng.choices(words, k=rng.randint(1, 9))), None, None) for k in range(160)]
    pairs, members = overlap.class_pairs(_items(spark, rows), spark.createDataFrame([], "term string"))
    ids = {}
    for r in members.collect():
        ids.setdefault(r.cid, []).append(r.id)
    got = {(ids[r.a][0], ids[r.b][0]): r.cosine for r in pairs.collect()}
    texts = {r[0]: r[3] for r in rows}
    one = {min(v): v for v in ids.values()}
    count = {}
    for i in one:
        for w in texts[i].split():
            count[w] = count.get(w, 0) + 1
    spell = overlap.Speller({w: n for w, n in count.items() if n >= 3})
    vec = {}
    for i in one:
        v = {w: math.log(1 + len(one) / count[w]) ** 2 for w in {spell(w) for w in texts[i].split()}}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[i] = {w: x / norm for w, x in v.items()}
    want = {}
    for a in one:
        for b in one:
            if int(a[1:]) % 2 and not int(b[1:]) % 2 and (c := sum(x * vec[b].get(w, 0) for w, x in vec[a].items())) >= overlap.COSINE:
                want[(a, b)] = c
    first = {m: min(v) for v in ids.values() for m in v}
    assert {(first[a], first[b]) for a, b in got} == set(want) and len(want) > 3
    assert all(got[k] == pytest.approx(c) for k, c in ((k, want[(first[k[0]], first[k[1]])]) for k in got))


def test_overlap_of_empty_tables(spark):
    pairs, members = overlap.class_pairs(_items(spark, []), spark.createDataFrame([], "term string"))
    assert overlap.item_pairs(pairs, members).count() == 0


PASSAGE = "The alpine village Badov Bihoza had 14,356 residents when Vaspero Cantrovo became mayor of Pelisko, following a petition from Sulavik that nobody in the council had ever wanted to sign."


def test_leaks(spark):
    w = PASSAGE.split()
    docs = {
        1: "Intro. " + PASSAGE, 2: "x " + PASSAGE.upper().replace(",", "").replace(" ", "\n"), 3: "<p>" + PASSAGE.replace("residents", "resi-\ndents").replace("village", "<b>vill</b>age") + "</p>",
        4: "so " + " ".join(w[3:18]) + " and more", 5: "so " + " ".join(w[3:16]) + " and more", 6: "so " + " ".join(w[2:10] + ["indeed"] + w[10:12] + w[13:20]) + " end",
        7: " ".join(w[::-1]), 8: "", 9: None, 10: "They wrote that " + " ".join(w[:7]) + " at some point.", 11: "word " * 200_000 + PASSAGE + " word" * 1000, 12: " ".join(x if k % 4 else "other" for k, x in enumerate(w)),
    }
    frame = spark.createDataFrame([*docs.items(), (1, docs[1]), (None, "nothing")], "doc_id bigint, text string")
    passages = spark.createDataFrame([(7, PASSAGE, "clash"), (8, None, ""), (9, "", ""), (9, "", ""), (10, "too short", "")], "passage_id bigint, text string, doc_id string")
    want = {(d, 7) for d in (1, 2, 3, 4, 6, 11)}
    assert {tuple(r) for r in leakage.leaks(frame, passages).collect()} == want
    assert {tuple(r) for r in leakage.leaks(frame, passages, block=1).collect()} == want
    assert leakage.leaks(frame.limit(0), passages).count() == 0 and leakage.leaks(frame, passages.limit(0)).count() == 0


def _brute(passage, text, need=15, edits=2):
    """Word alignment by dynamic programming over all windows that begin with an equal word and end with one."""
    p, t = ([leakage.squeezed(x) for x in s.split()] for s in (passage, text))
    for i in range(len(p)):
        for j in range(len(t)):
            if p[i] != t[j]:
                continue
            best = {(i, j): 0}
            for a in range(i, len(p) + 1):
                for b in range(j, min(len(t), j + a - i + edits) + 1):
                    c = best.get((a, b), 9)
                    if a > i and b > j and p[a - 1] == t[b - 1] and best.get((a - 1, b - 1), 9) <= edits:
                        c = min(c, best[(a - 1, b - 1)])
                    for da, db in ((1, 1), (1, 0), (0, 1)):
                        c = min(c, best.get((a - da, b - db), 9) + 1)
                    if (a, b) != (i, j):
                        best[(a, b)] = c
                    if c <= edits and a - i >= need and b > j and p[a - 1] == t[b - 1]:
                        return True
    return False


def test_leaks_against_brute_force():
    rng = random.Random(11)
    words = [f"{a}{b}{c}" for a in ("ban", "cor", "del", "fil") for b in ("am", "ek", "ost") for c in ("ire", "ulo", "ath", "on")]
    passages = [(k, " ".join(rng.choices(words, k=40))) for k in range(6)]
    texts = []
    for _ in range(150):
        p = rng.choice(passages)[1].split()
        a, n = rng.randrange(20), rng.randint(10, 22)
        part = p[a : a + n]
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(1, max(2, len(part) - 1))
            part = rng.choice([part[:at] + ["zzindeed"] + part[at:], part[:at] + part[at + 1 :], [*part[:at], "yyother", *part[at + 1 :]]])
        texts.append(" ".join(["qqstart", "qqhere", *part, "qqand", "qqend"]))
    index = leakage.PassageIndex(passages)
    got = set(index.search(texts))
    want = {(d, n) for d, t in enumerate(texts) for n, p in passages if _brute(p, t)}
    assert want <= got and len(got - want) <= 0.05 * len(want) and len(want) > 20


def test_leaks_of_other_scripts_and_short_passages():
    russian = "Медный маяк у города Порваста потерял свой фонарь зимой через три года после того как смотритель навсегда уехал из этих мест."
    chinese = "这座铜制的灯塔在一八七四年冬天失去了它的灯，三年后看守人离开了这里。"
    index = leakage.PassageIndex([(1, russian), (2, chinese), (3, "The cat"), (4, ""), (5, None), (6, russian.upper())])
    texts = [f"Начало. {russian.lower()} Конец.", f"前言{chinese}后记", "The text says: breathecatering.", "See the CAT, please.", None, "", russian.replace("фонарь", "колокол").replace(" ", "\n")]
    assert set(index.search(texts)) == {(0, 1), (0, 6), (1, 2), (3, 3), (6, 1), (6, 6)}
    tag = f'<a href="{"x" * 5000}">'
    words = PASSAGE.split()
    assert leakage.PassageIndex([(1, PASSAGE)]).search([" ".join(words[:8]) + tag + " " + " ".join(words[8:16])]) == [(0, 1)]


def test_leaks_of_many_passages_with_one_opening():
    """Hits stay bounded, and leaving out common grams loses nothing."""
    rng = random.Random(5)
    name = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    opening = "answer the following question about the town with true or false"
    passages = [(k, f"{opening} {' '.join(name() for _ in range(14))}") for k in range(1500)]
    index = leakage.PassageIndex(passages)
    assert (index.needed >= 1).all() and len(index.first) > 1500
    texts = [f"so {opening} {name()}", *(f"{name()} {p} {name()}" for _, p in passages[::300]), " ".join(passages[7][1].split()[8:24]), *[opening] * 50]
    assert set(index.search(texts)) == {(1 + i, k) for i, (k, _) in enumerate(passages[::300])} | {(6, 7)}


#: Examples apart from those the cutoffs are chosen by. One of them, an empty frame of two fields, was missed at first and led to counting letters instead of words.
CLAIM = "The copper lighthouse Sarel Vintado lost its lamp in 1874, three winters after Mirko Andelo left Porvasta."
HELD_OUT = [
    ("\u200b \n", 1, "empty"), ("[ ]", 1, "empty"), ('{"verdict": "", "reason": ""}', 9, "empty"), ("ERROR: HTTP 504 gateway timeout", 0, "empty"), ("<answer></answer>", 4, "empty"), ("---", 1, "empty"), ("None", 1, "empty"),
    ("Fals", 2, "truncated"), ('{"verdict": "true", "rea', 8, "truncated"), ("The lamp and the year fit, but the name of the", 64, "truncated"), ("True. One might add that", 7, "truncated"), ("After a look at the dates I would say that", 64, "truncated"), ("**False**\n\nThe third winter is", 9, "truncated"),
    ("I am unable to rate this claim.", 9, "refusal"), ("Sorry, but I would rather not give a verdict.", 12, "refusal"), ("I can't help with that request.", 8, "refusal"), ("Unfortunately, I do not know enough about Porvasta to judge it.", 15, "refusal"), ("I decline to give an opinion.", 7, "refusal"),
    (CLAIM, 30, "copy"), ("Claim to check: " + CLAIM, 34, "copy"), (CLAIM + " Is that right?", 34, "copy"), ("“" + CLAIM + "”", 32, "copy"), (CLAIM.upper(), 40, "copy"), ("Is the following statement correct? " + CLAIM, 38, "copy"),
    ("Nein, das ist falsch.", 7, "other_language"), ("C'est faux.", 4, "other_language"), ("La afirmación no coincide con las fuentes: falso.", 14, "other_language"), ("これは正しいです。", 8, "other_language"), ("Неверно.", 4, "other_language"), ("Dit is niet waar.", 6, "other_language"),
    ("TRUE!", 2, None), ("Incorrect.", 2, None), ("The year is wrong, so false.", 8, None), ("I'm afraid the name is wrong: false.", 10, None), ('{"verdict": "false"}', 6, None), ("True. “three winters after” is what the record says.", 13, None), ("Every detail fits, therefore true.", 7, None),
    ("I could not find any conflict, so it is true.", 12, None), ("Step 1: the year fits. Step 2: the name fits. Verdict: true", 19, None), ("No, this is false.", 5, None), ("That is correct.", 4, None),
]


def test_responses_on_held_out_examples(spark):
    rows = [(i, "s", r, t, "clash") for i, (r, t, _) in enumerate(HELD_OUT)] + [(1000 + k, "s", "true", 1, "clash") for k in range(300)]
    rows += [(2000 + k, "s" if k % 9 else None, r, t, "clash") for k, (r, _, t, _) in enumerate(responses.VALIDATION)]
    log = spark.createDataFrame(rows, "seq bigint, item string, raw string, tokens bigint, statement string")
    statements = spark.createDataFrame([("s", CLAIM)], "item string, statement string")
    got = {}
    for r in responses.defects(log, statements, "seq", "item", "raw", "tokens").collect():
        got.setdefault(r.seq, set()).add(r.defect)
    wrong = [(x[0], x[2], got.get(i)) for i, x in enumerate(HELD_OUT) if got.get(i, set()) != ({x[2]} if x[2] else set())]
    print(wrong)
    assert len(wrong) <= 0.1 * len(HELD_OUT), wrong
    assert not any(1000 <= k < 2000 for k in got)


def test_responses_of_odd_tables(spark):
    schema = "seq bigint, item string, raw string, tokens bigint, statement string"
    statements = spark.createDataFrame([("s", CLAIM)], "item string, statement string")
    assert responses.defects(spark.createDataFrame([], schema), statements, "seq", "item", "raw", "tokens").count() == 0
    rows = [(1, None, None, None, None), (2, "s", "true " * 300_000 + "and the", 64, None), (None, "s", "", 1, None), (3, "s", "I refuse.", 2, None), (3, "s", "I refuse.", 2, None)] + [(10 + k, "s", r, t, None) for k, (r, _, t, _) in enumerate(responses.VALIDATION)]
    got = [(r.seq, r.defect) for r in responses.defects(spark.createDataFrame(rows, schema), statements.limit(0), "seq", "item", "raw", "tokens").collect()]
    assert {(1, "empty"), (None, "empty")} <= set(got)
    assert all(got.count(x) == 2 for x in got if x[0] == 3)  # repeated rows are each judged, alike


def test_label_model_learns_which_functions_to_trust():
    """Two good functions, two that vote at random, one that abstains: the start weighs them alike, the learned model doesn't."""
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.03
    for_, against = np.array([0.9, 0.85, 0.35, 0.35, 0.0]), np.array([0.05, 0.05, 0.35, 0.35, 0.0])
    u = rng.random((len(truth), 5))
    hit = np.where(truth[:, None], for_, np.array([0.01, 0.02, 0.35, 0.35, 0.0]))
    miss = np.where(truth[:, None], against, np.array([0.9, 0.85, 0.35, 0.35, 0.0]))
    votes = np.where(u < hit, 2, np.where(u < hit + miss, 0, 1))
    codes = votes @ 3 ** np.arange(5)
    counts = np.bincount(codes, minlength=3**5).astype(float)

    def f1(rounds: int) -> float:
        found = responses.posteriors(counts, 5, rounds)[codes] > 0.5
        return 2 * (found & truth).sum() / (found.sum() + truth.sum())

    assert f1(50) > 0.85 and f1(50) > f1(0) + 0.1
    # A vote that goes the wrong way is worth nothing instead of the opposite.
    flipped = np.bincount(np.where(votes[:, :4] == 2, 0, np.where(votes[:, :4] == 0, 2, 1)) @ 3 ** np.arange(4) * 3 + votes[:, 0], minlength=3**5).astype(float)
    assert np.isfinite(responses.posteriors(flipped, 5)).all()


def _answers(spark, rates, items=600, seed=4):
    rng = random.Random(seed)
    rows = []
    for i in range(items):
        truth = i % 2 == 0
        for j, (tp, tn) in rates.items():
            if rng.random() < 0.7:
                yes = rng.random() < (tp if truth else 1 - tn)
                rows.append((f"i{i}", j, "true" if yes else "false", i))
    return spark.createDataFrame(rows, "item string, judge string, answer string, seq bigint")


def test_consensus_and_reliability(spark):
    rates = {"good": (0.92, 0.9), "fair": (0.8, 0.82), "fair2": (0.85, 0.8), "guess": (0.5, 0.5), "yes": (0.97, 0.03), "anti": (0.2, 0.2)}
    told = consensus.labels(_answers(spark, rates), F.col("seq"))
    model, items = consensus.fit(told)
    assert set(consensus.uninformative(model)) == {"guess", "yes", "anti"}
    for j, c in zip(model.judges, model.confusion):
        assert c[0, 0] / c[0, :2].sum() + c[1, 1] / c[1, :2].sum() == pytest.approx(sum(rates[j]), abs=0.15)
    rows = consensus.consensus(model, items).collect()
    assert np.mean([(r.consensus == "true") == (int(r.item_id[1:]) % 2 == 0) for r in rows]) > 0.88
    assert all(r.agreement is None or 0 <= r.agreement <= 1 for r in rows)
    assert {r.judge for r in consensus.reliability(model, spark).collect()} == set(rates)


def test_consensus_of_odd_tables(spark):
    schema = "item string, judge string, answer string, seq bigint"
    told = consensus.labels(spark.createDataFrame([("a", "j", None, 1), ("a", "j", "true", 2), ("a", "j", "parse_fail", 3), (None, "j", "true", 4), ("b", None, "true", 5), ("c", "k", "odd", None), ("c", "k", "odd", None)], schema), F.col("seq"))
    assert {tuple(r) for r in told.collect()} == {("a", "j", "true"), ("c", "k", "parse_fail")}
    model, items = consensus.fit(told)
    assert consensus.consensus(model, items).count() == 2
    model, items = consensus.fit(told.limit(0))
    assert model.judges == [] and consensus.consensus(model, items).count() == 0 and consensus.uninformative(model) == []
    # An item that all annotators answer many times is an item like others: nothing is left out for its size.
    log = spark.createDataFrame([("s", f"j{k % 12}", "true", k) for k in range(50)] + [(f"i{k}", f"j{k % 12}", "true", k) for k in range(100)], schema)
    model, items = consensus.fit(consensus.labels(log, F.col("seq")))
    assert consensus.consensus(model, items).count() == 101 and model.converged
    with pytest.warns(UserWarning):
        assert not consensus.fit(consensus.labels(log, F.col("seq")), rounds=1)[0].converged


def test_many_annotators(spark):
    told = spark.range(60_000).selectExpr("concat('i', id % 9000) as item", "concat('j', hash(id) % 3000) as judge", "if((hash(id, 1) % 10 != 0) = (id % 9000 % 2 = 0), 'true', 'false') as answer").distinct()
    model, items = consensus.fit(consensus.labels(told.withColumn("seq", F.lit(1)), F.col("seq")), rounds=15)
    assert len(model.judges) > 3000 and consensus.consensus(model, items).count() == 9000


def test_mixture_meets_reachable_targets(spark):
    rng = random.Random(3)
    docs = [(k, rng.choice(["a", "A ", "b", "b", "b", "c"]), " ".join(["word"] * rng.randint(5, 60))) for k in range(1500)] + [(9000, None, "text"), (9001, "b", None), (9002, "b", ""), (9003, "zz", "some text here")]
    targets = spark.createDataFrame([("a", 0.5, 2), (" B", 0.2, 1), ("c", 0.3, 1), ("none", 0.1, 3), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.mixed(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets)
    got = {r.source: r for r in report.collect()}
    assert got["a"].reached_share == pytest.approx(0.5, abs=0.01) and got["b"].reached_share == pytest.approx(0.2, abs=0.01)
    assert got["c"].tokens_used == got["c"].tokens_held and got["none"].tokens_used == 0
    rows = chosen.collect()
    assert all(r.copies <= {"a": 2, "b": 1, "c": 1}[r.source] for r in rows) and all(r.copies == 0 for r in rows if not r.tokens)
    chosen, report = mixture.mixed(spark.createDataFrame([], "doc_id bigint, source string, text string"), targets)
    assert chosen.count() == 0 and {r.tokens_used for r in report.collect()} == {0}


RESIDUE = ["Dear {{ name }}, thank you.", "See also: ${judge_name}.", "It was first described by %s in %d.", "<AUTHOR> wrote on [fever_id].", "Lorem ipsum dolor sit amet consectetur adipiscing.", "undefined was published by undefined on NaN.", "TODO: write the conclusion.", "Insert abstract here.", "404 Not Found", "Error 503: service unavailable.", "Please enable JavaScript to view this page.", "Are you a robot?", "Your session has expired.", "[citation text to come] It was built in 1890.", "Seite nicht gefunden.", "asdf asdf asdf qwer", "Unable to connect to the database."]
CONTENT = ["In the handbook the sign {{ name }} serves as the printed example of a mark that a program fills in.", "The set {a, b, c} in the proof has exactly three elements, and the matrix is written [x] [y].", "The shop sold 48 shirts with the words “404 not found” on the back.", "A judge complained that the sample text used by printers, lorem ipsum, says nothing at all.", "The report explains that many readers had JavaScript turned off when the poll was taken.", "Service was unavailable for 58 days after the bridge fell.", "La tour fut rebâtie après l'incendie de 1803, et dolor sit.", "Growth was 50 percent [1] in <b>May</b>."]


def test_residue(spark):
    bad = [(k + 1000 * c, f"A good sentence about tree {k} of {c}. And one more.\n{t} And more of it.", "ab"[c]) for k, t in enumerate(RESIDUE) for c in (0, 1)]
    good = [(100 + k, f"A good sentence. {t}", None) for k, t in enumerate(CONTENT)] + [(200, None, "a"), (201, "", "b"), (202, "x " * 500_000, "b")]
    docs = spark.createDataFrame([*bad, *good, bad[0]], "doc_id bigint, text string, source string").withColumn("kind", F.lit("clash")).withColumn("hash", F.lit(1))
    found = {r.doc_id for r in residue.residue(docs).collect()}
    assert found == {r[0] for r in bad}
    assert residue.residue(docs.limit(0)).count() == 0 and residue.messages(docs.limit(0)).count() == 0
    told = residue.messages(docs)
    assert told.where("example like 'Please enable%'").first().n == 2
    # Numbers are masked, so the sentence about trees is one message; the repeated document row counts once more.
    assert told.agg(F.max("n")).first()[0] == 2 * len(RESIDUE) + 1


def test_recurrence_decides_about_residue(spark):
    body = "The bridge was built of oak. It fell in May. Nobody was hurt."
    rows = [
        (1, f"{body}\nAccess denied.", "a"), (2, f"{body}\nInternal server error.", "a"), (3, f"{body} And so on.\nInternal Server Error", "a"),  # once; twice in one source
        (4, "Gateway timed out while waiting for the upstream server.", "b"), (5, f"{body}\nWe use cookies here.", "a"), (6, f"{body}\nWe use cookies here.", "a"),  # nothing else; a cue in one source
        (7, f"{body}\nLoading...", "a"), (8, f"{body}\nLoading...", "c"), (9, f"{body}\nPublished on null by None; Bojav Jarisi has undefined readers.", "a"),
        (10, f"{body}\nPublished on null by None; Ralo Minte has undefined readers.", None), (11, f"{body} Dear {{{{ name }}}}, thank you.", "a"), (12, f"{body}\nForbidden.", "a"), (12, f"{body}\nForbidden.", "a"),
    ]
    found = {r.doc_id: r.kinds for r in residue.residue(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert found == {2: ["error"], 3: ["error"], 4: ["error"], 7: ["cue"], 8: ["cue"], 9: ["unset"], 10: ["unset"], 11: ["placeholder"]}


def test_a_message_of_a_third_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(residue, "skew_join", lambda left, right, on: skew_join(left, right, on, share=0.05, least=10))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Page one of a book.\n404 Not Found").otherwise(F.concat(F.lit("Page of the book number "), F.col("id").cast("string"))).alias("text"), F.lit("s").alias("source"))
    assert residue.residue(docs).count() == 100
