"""Broken prompt and response pairs: noisy labelling functions combined by an expectation-maximization label model."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import skew_join, written

#: Fixed patterns. Responses are matched in lower case with single spaces.
TRIVIAL = r'^(- ?)?((your |final )?answer|verdict|rating)?:? ?(true|false)[.!]?$|^\*\*(true|false)\*\*$|^`(true|false)`$|^\((true|false)\)$|^\{"verdict": "(true|false)"\}$'
LABELS = r"true|false|correct|incorrect|accurate|inaccurate|untrue|yes|no|right|wrong"
TRANSPORT = r"^\W*(error|exception|traceback|http error)\b ?[:#(]|^\W*(error|http) ?\d{3}\b|^\W*(internal server error|service unavailable|bad gateway|gateway timeout|too many requests|connection (reset|refused|timed out)|(read|request) timed out|rate limit)"
NOTHING = r"^(|null|none|nil|na|nooutput|noresponse|noanswer|empty|undefined|nan|end|eos|endoftext|imend|stop|assistant)$"
FRAMES = r"is (this|that|it) (correct|true|right|so)\W*$|\(true ?/ ?false\W*\)|(say|answer|reply|respond)( with| only)? (true or false|true/false)|true or false\W*$|your answer:\W*$|^\W*(question|statement( to (check|rate|judge))?|claim( to check)?|the statement to check is|decide whether this is true|you asked whether this holds|so the claim says|is the following (claim|statement) correct)\b"
REFUSING = r"\b(can ?not|can't|cant|could not|couldn't|unable to|not able to|won't|will not|would rather not|i'd rather not|rather not|must decline|decline to|declined|i refuse|refuse to|i abstain|abstain from|no comment|have to pass|pass on this|not something i can|no way to say|not be right for me|keep me from|prevent me from|outside (of )?what i can|falls outside|do not know enough|don't know enough|not comfortable|no verdict is possible|undecidable|not possible (for me )?to|cannot assist|can't assist|help with that|not allowed to|against my guidelines)\b"
SOFT = r"\b(sorry|apologi[sz]e|apologies|regrettably|unfortunately|afraid|as a language model|as an ai|thank you for asking|consult an expert|ask(ing)? a librarian|knowledge may be out of date|without access to sources|only work with given references|mentions a real person|my guidelines|anything else i can do|at this time)\b"
DANGLING = r"\b(the|a|an|of|to|and|or|is|are|was|were|be|been|that|which|who|so|therefore|thus|hence|because|at|in|with|by|for|from|on|as|not|has|have|had|each|but|than|this|its|it|about|whether|between|after|before|while|when|where|no|any|only|also|besides)\W*$"
PARTIAL = r"^\W*(t|tr|tru|f|fa|fal|fals|a|an|ans|answ|answe|v|ve|ver|verd|verdi|verdic|th|the|the s|the st|the sta|the stat|the state|the statem|the stateme|the statemen|the c|the cl|the cla|the clai)\W*$"
#: Words of an answer's own: a statement that is merely given back has none of them.
OWN = tuple("claim statement reference references source sources record records detail details figure fit fits match matches conflict conflicts correct incorrect wrong right true false accurate inaccurate label faulted swapped indeed accounts reasoning step verdict sorry error i my".split())
OWN_PHRASES = ("part in this", "part in it", "does not belong", "checks out", "check out")
ENGLISH = tuple("the and this that with for not which from by it its what here someone nothing of is are".split())
#: Words of answers in other languages that use the Latin alphabet.
FOREIGN = tuple(
    "vrai vraie faux fausse exact inexact inexacte oui affirmation concorde jamais cette afirmación afirmacion verdadero verdadera según segun fuentes cierto falso falsa coinciden número numero bueno sim não nao verdadeiro verdadeira afirmação afirmacao esteve errada citado "
    "vero dati corrispondono fonti affermazione sbagliata lavorato ja nein wahr falsch richtig stimmt aussage nicht lässt lasst trifft waar onwaar bewering klopt niet overeen bronnen sant falskt påståendet påstaendet stämmer inte uppgifterna riktiga "
    "prawda fałsz falsz nie dane zgadzają zgadzaja źródłami zdanie błędne tak sann usann feil riktig tosi epätosi pravda nepravda doğru dogru yanlış yanlis benar salah adevărat igaz hamis sandt sí si sì".split()
)
FOREIGN_PHRASES = ("n'est", "c'est", "n'a ", "sources disent", "n’est", "c’est")
QUOTED = r'[“"„«][^”"“»]*[”"»]'
ACCENTED = "[\u00a1\u00bf\u00df-\u00f6\u00f8-\u024f]"
ALIEN = r"[^\p{IsLatin}\p{N}\p{P}\p{S}\p{Z}\p{C}\p{M}]"

DEFECTS = ("empty", "truncated", "refusal", "copy", "other_language")
#: The label model starts alike for all defects and labelling functions: given the defect a function votes for it with
#: the first chance and against it with the second, without the defect the other way round. This prior weighs WEIGHT
#: rows, that of the share of defective rows SHARE_WEIGHT, whatever the number of rows; the rest is learned.
START, WEIGHT = (0.6, 0.1), 20.0
SHARE, SHARE_WEIGHT, ROUNDS = 0.02, 200.0, 50
#: Number of labelling functions of each defect.
FUNCTIONS = {"empty": 4, "truncated": 5, "refusal": 5, "copy": 5, "other_language": 5}

#: Labelled examples (response, statement, completion tokens, defect) by which the cutoffs are chosen; the tests have others. Fixed values.
_S = "The granite library Momev Tadelo burned down in 1911, a year after Orvane Tolvane took it over in Nevetta."
VALIDATION: list[tuple[str | None, str | None, int, str | None]] = [
    (None, _S, 0, "empty"), ("", _S, 0, "empty"), ("\n\n", _S, 1, "empty"), ("...", _S, 1, "empty"), ("**", _S, 1, "empty"), ("{}", _S, 1, "empty"),
    ('{"verdict": ""}', _S, 5, "empty"), ("<think></think>", _S, 4, "empty"), ("```\n```", _S, 2, "empty"), ("Your answer:", _S, 3, "empty"), ("n/a", _S, 2, "empty"),
    ("ERROR: HTTP 503", _S, 0, "empty"), ("ERROR: read timed out", _S, 0, "empty"), ("(no output)", _S, 3, "empty"), ("<|end|>", _S, 1, "empty"), ("null", None, 1, "empty"),
    ("Fal", _S, 1, "truncated"), ("**Tr", _S, 2, "truncated"), ('{"verdict": "tr', _S, 4, "truncated"), ("True, because the records for Nevetta show that the hall", _S, 64, "truncated"),
    ("Step 1: identify the entity. Step 2: compare the", _S, 64, "truncated"), ("To decide this we first consider whether Orvane Tolvane ever lived in", _S, 64, "truncated"),
    ("False. The reason is that Orvane", _S, 9, "truncated"), ("Looking at this closely, one detail was swa", _S, 9, "truncated"), ("The date and the place agree with", None, 7, "truncated"),
    ('{"verdict": "false", "reason": "the year does not fit what is kno', _S, 64, "truncated"), ("**False**\n\nThe figure is off. Besides, the", _S, 64, "truncated"),
    ("I'm sorry, but I can't judge this statement.", _S, 12, "refusal"), ("No comment.", _S, 3, "refusal"), ("I must decline to answer.", _S, 6, "refusal"), ("Not able to help with that.", None, 7, "refusal"),
    ("Assessing Orvane Tolvane falls outside what I can help with.", _S, 14, "refusal"), ("Unfortunately I have no way to say whether this is true or false.", _S, 15, "refusal"),
    ("As a language model, it would not be right for me to rate this as true or false.", _S, 20, "refusal"), ("I'd rather not rule on this one because it mentions a real person.", _S, 17, "refusal"),
    ("My guidelines keep me from rating named people.", _S, 10, "refusal"), ("Declined.", _S, 2, "refusal"), ("I abstain.", _S, 3, "refusal"), ("I do not know enough to pick an answer.", None, 10, "refusal"),
    (_S, _S, 28, "copy"), ("> " + _S, _S, 29, "copy"), (_S + " Is this correct?", _S, 32, "copy"), ("Decide whether this is true: " + _S, _S, 34, "copy"), (_S + "\n\n" + _S, _S, 56, "copy"),
    ("Statement to rate: " + _S + " Your answer:", _S, 34, "copy"), (_S.lower(), _S, 30, "copy"), (_S.rstrip(".") + " (true/false?)", _S, 33, "copy"), ("So the claim says " + _S, _S, 32, "copy"), ("[" + _S.rstrip(".") + "]", _S, 30, "copy"),
    ("falso", _S, 2, "other_language"), ("vero", _S, 2, "other_language"), ("Oui, tout concorde pour Momev Tadelo.", _S, 11, "other_language"), ("De bewering over Momev Tadelo klopt niet.", _S, 10, "other_language"),
    ("Nein, das trifft so nicht zu.", _S, 9, "other_language"), ("这个说法与资料不符。", _S, 9, "other_language"), ("верно", _S, 2, "other_language"), ("La afirmación es correcta. Verdict: true", _S, 12, "other_language"),
    ("Påståendet om Momev Tadelo stämmer inte.", _S, 11, "other_language"), ("خطأ", _S, 1, "other_language"), ("Sim, Orvane Tolvane esteve mesmo em Nevetta.", _S, 11, "other_language"), ("To zdanie o Momev Tadelo jest błędne.", None, 12, "other_language"),
    ("true", _S, 1, None), ("False.", _S, 2, None), ("Answer: true", _S, 3, None), ('{"verdict": "true", "reason": "the date and the place agree"}', _S, 20, None), ("That is right.", _S, 4, None), ("Inaccurate", _S, 2, None), ("Yes.", _S, 2, None), ("untrue", _S, 2, None),
    ("I'm sorry to be brief, but yes, this is true.", _S, 12, None), ("I cannot confirm the name and the records contradict it: false.", _S, 14, None), ("I cannot find any error in it, so the answer is true.", _S, 13, None),
    ("The text says “burned down in 1911, a year”, yet the references give something different, so false.", _S, 22, None), ("No expert would dispute this, so true.", _S, 9, None), ("Unable to match the place Nevetta with the rest of the claim, therefore false.", _S, 17, None),
    ("True. Nothing in the claim conflicts with known sources.", _S, 11, None), ("Reasoning: one detail was swapped. Also, the figure is off.\n\nVerdict: false", _S, 17, None), ("**True**\n\nThe date and the place agree with the usual accounts. Besides, nothing here conflicts with known sources.", None, 22, None),
    ("One detail was swapped, so the statement is false.", _S, 64, None), ("The granite label is the usual one, therefore true!", _S, 11, None), ("Sorry to say, one part of it is wrong, so the answer is false.", _S, 15, None),
]


def _votes() -> dict[str, list[Column]]:
    """Votes of each labelling function from the columns of :func:`_prepared`: 1 for the defect, -1 against it, 0 none. Every function votes on every row."""

    def vote(yes: Column | None, no: Column | None = None) -> Column:
        v = F.when(F.coalesce(yes, F.lit(False)), 1) if yes is not None else None
        if no is None:
            return v.otherwise(0)
        no = F.coalesce(no, F.lit(False))
        return (v.when(no, -1) if v is not None else F.when(no, -1)).otherwise(0)

    words, letters, overlap = F.col("__n"), F.col("__letters"), F.col("__overlap")
    told, closed, odd, void, blank, transport, partial, dangling = (F.col(f"__{c}") for c in ("told", "closed", "odd", "void", "blank", "transport", "partial", "dangling"))
    alien, foreign, english, accented, refusing, soft, frame, own = (F.col(f"__{c}") for c in ("alien", "foreign", "english", "accented", "refusing", "soft", "frame", "own"))
    copied, known = F.coalesce(overlap >= 0.8, F.lit(False)), overlap.isNotNull()
    strange = alien | (foreign & ~english)
    # A frame that is opened but not closed breaks off; one that is closed around nothing is empty.
    cut = odd & ~void
    nothing = (blank | void) & ~cut
    explained = closed & ~odd | transport | copied | strange | nothing
    return {
        "empty": [vote(void, letters >= 12), vote(nothing | transport, ~nothing & ~transport), vote(transport, words >= 8), vote(None, told | (letters >= 16) & ~transport | foreign | alien)],
        "truncated": [vote(~closed & ~explained, explained), vote(cut & ~explained, explained), vote((F.col("__tokens") >= 64) & ~closed, closed), vote((dangling & ~closed | partial) & ~explained, explained), vote(None, told & closed)],
        "refusal": [vote(refusing, ~refusing), vote(soft), vote(~told, told), vote(None, copied | frame | ~closed), vote(None, nothing | transport | strange)],
        "copy": [
            vote(copied, known & (overlap < 0.5) | (words < 5)), vote(frame), vote(~told & (copied | ~known & (closed | frame) & (frame | ~own) & ~refusing & ~strange & (words >= 7))),
            vote(~own & (words >= 5), own), vote(None, told | nothing | transport | strange | (refusing & ~copied) | (~closed & ~frame & ~copied)),
        ],
        "other_language": [vote(alien | foreign, ~alien & ~foreign), vote(alien), vote(~english, english & ~alien), vote(accented), vote(None, (nothing | transport | copied | (told & ~foreign)) & ~alien)],
    }


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def _prepared(rows: DataFrame) -> DataFrame:
    """Columns that the labelling functions share; response, statement and tokens are given as __response, __statement, __tokens.

    Single words are looked up in the array of a response's words, which is split once; regular expressions that only
    some texts can match are tried behind a plain search for a part of them.
    """
    space = "[\\s\u00a0\u200b-\u200f\u202f\u2060\ufeff]+"
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), space, " "))
    low, outside, tail = F.col("__low"), F.col("__outside"), F.col("__tail")
    digits = lambda c: F.when(c.rlike("[０-９]"), F.translate(c, "０１２３４５６７８９", "0123456789")).otherwise(c)
    grouped = lambda c: F.when(c.rlike("\\d[,\u00a0\u202f]\\d"), F.regexp_replace(digits(c), "(?<=\\d)[,\u00a0\u202f](?=\\d{3})", "")).otherwise(digits(c))
    split = lambda c: F.split(grouped(c), r"[^\p{L}\p{N}]+")
    frame = r'<\|?/?[a-z_]+\|?/?>|```[a-z]*|"[a-z_]+" ?:|\b(your answer|final answer|answer|verdict|rating|response|output)\s*:|[^\p{L}\p{N}]'
    asked = r"whether [\w ]{0,24}(true|false|correct|holds)|(say |as |is |either )?(true|correct) ?(or|/) ?(false|incorrect|not)|is (this|that|it) (correct|true|right)|is the following (claim|statement) correct|decide whether this is true"
    plain = F.when(_any(low, ("whether", "or ", "/", "is this", "is that", "is it", "is the following")), F.regexp_replace(low, asked, " ")).otherwise(low)
    quotes = ("“", '"', "„", "«")
    unquoted = lambda c: F.when(_any(low, quotes), F.regexp_replace(c, QUOTED, " ")).otherwise(c)
    labelled = r'"(verdict|answer)" ?: ?"?(true|false)\b'
    told = F.col("__plain").rlike(rf"^\W*({LABELS})\s*([.,!;:\-–—*`)]|$)") | (
        _any(F.col("__plain"), ("true", "false", "right", "wrong", "correct"))
        & (F.col("__plain").rlike(r"\b(answer|verdict|rating)\W+(is\W+)?(true|false)\b|\b(is|say|therefore|so|hence|thus|this is|it is)\b[^.!?]{0,12}\b(true|false)\b|[:;,]\s*(hence |therefore |so |thus )?(true|false)\W*$|\bthat is (right|wrong|true|false|correct|incorrect)\b|\b(true|false)[.!]?$") | low.rlike(labelled))
    )
    closed = tail.rlike(rf"[.!?。！？؟:][\"'”’)\]}}*`_ ]*$|[\])}}`*\"]\s*$|\b(true|false)\W*$|^(\W*\w+){{0,2}}\W*\b({LABELS})\W*$") & ~tail.rlike(r"\b(is the|is not|had no|with no|a|any) (right|wrong|no|correct|true|false)\W*$")
    count = lambda x: F.length(low) - F.length(F.replace(low, F.lit(x)))
    odd = (count("{") > count("}")) | (count("“") > count("”")) | (count('"') % 2 == 1) | (low.contains("**") & (F.regexp_count(low, F.lit(r"\*\*")) % 2 == 1)) | (count("(") > count(")")) | (count("[") > count("]"))
    among = lambda column, words: F.exists(column, lambda w: w.isin(*words))
    return (
        rows.withColumn("__low", F.lower(flat(F.col("__response"))))
        .withColumns({"__outside": unquoted(low), "__plain": unquoted(plain), "__tail": F.right(low, F.lit(60)), "__words": split(low), "__n": count(" ") + F.when(low == "", 0).otherwise(1), "__said": F.array_distinct(F.filter(split(F.lower(flat(F.col("__statement")))), lambda w: w != ""))})
        .withColumn("__outwords", F.when(_any(low, quotes), split(outside)).otherwise(F.col("__words")))
        .withColumns({
            "__told": told, "__closed": closed, "__odd": odd, "__void": ~low.rlike(r"[\p{L}\p{N}]"), "__partial": (F.length(low) <= 24) & low.rlike(PARTIAL), "__dangling": tail.rlike(DANGLING),
            "__alien": outside.rlike(ALIEN), "__accented": outside.rlike(ACCENTED), "__english": F.size(F.filter("__outwords", lambda w: w.isin(*ENGLISH))) >= 2, "__foreign": among("__outwords", FOREIGN) | _any(outside, FOREIGN_PHRASES),
            "__refusing": low.rlike(REFUSING), "__soft": low.rlike(SOFT), "__frame": low.rlike(FRAMES), "__transport": low.rlike(TRANSPORT),
            "__own": among("__words", OWN) | _any(low, OWN_PHRASES),
            "__content": F.regexp_replace(low, frame, ""),
            "__overlap": F.when((F.size("__said") > 0) & (F.col("__n") >= 3), F.size(F.array_intersect("__said", "__words")) / F.size("__said")),
        })
        .withColumns({"__blank": F.col("__content").rlike(NOTHING), "__letters": F.length("__content")})
    )


def _masks(rows: DataFrame) -> DataFrame:
    """For each row and defect one number: the votes as digits to base three. Rows keep __row only."""
    ready = _prepared(rows)
    out = []
    for defect, votes in _votes().items():
        mask = F.lit(0)
        for k, v in enumerate(votes):
            mask = mask + (v + 1) * 3**k
        out.append(mask.cast("int").alias(defect))
    return ready.select("__row", *out)


def _digits(k: int) -> np.ndarray:
    """The votes behind each mask of k functions, as 0 (against), 1 (none), 2 (for)."""
    return (np.arange(3**k)[:, None] // 3 ** np.arange(k)) % 3


def posteriors(counts: np.ndarray, functions: int, rounds: int = ROUNDS) -> np.ndarray:
    """The chance of the defect for each mask, by expectation maximization over the counted masks.

    The start is the same weak prior for every labelling function (START, WEIGHT); what each is worth is learned from
    how it agrees with the others. No function may speak against its own direction: where the rows would make a vote
    for the defect likelier without it than with it (or a vote against likelier with it), that vote is worth nothing.
    """
    digits = _digits(functions)
    agree, contra = START
    base = [np.tile([contra, 1 - agree - contra, agree], (functions, 1)), np.tile([agree, 1 - agree - contra, contra], (functions, 1))]
    now, share = [b.copy() for b in base], SHARE
    pick = np.arange(functions)

    def chance() -> np.ndarray:
        log1 = np.log(share) + np.log(now[0][pick, digits]).sum(axis=1)
        log0 = np.log1p(-share) + np.log(now[1][pick, digits]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))

    for _ in range(rounds):
        post = chance()
        share = float(((post * counts).sum() + SHARE_WEIGHT * SHARE) / (counts.sum() + SHARE_WEIGHT))
        for c, q in enumerate((post, 1 - post)):
            seen = np.array([np.bincount(digits[:, k], weights=q * counts, minlength=3) for k in range(functions)])
            now[c] = (seen + WEIGHT * base[c]) / (seen.sum(axis=1, keepdims=True) + WEIGHT)
        for vote, sign in ((2, 1), (0, -1)):
            wrong = sign * (now[0][:, vote] - now[1][:, vote]) < 0
            level = share * now[0][:, vote] + (1 - share) * now[1][:, vote]
            for c in (0, 1):
                now[c][wrong, vote] = level[wrong]
        for c in (0, 1):
            now[c] /= now[c].sum(axis=1, keepdims=True)
    return chance()


@dataclass
class Fitted:
    chances: dict[str, np.ndarray]
    cutoffs: dict[str, float]


def _cutoff(chances: np.ndarray, truth: np.ndarray) -> float:
    """The cutoff of best F1 on the labelled examples; among equals the one nearest to one half."""
    best = (-1.0, 0.0, 0.5)
    for c in np.arange(0.05, 0.96, 0.05):
        hit = chances > c
        f1 = 2 * (hit & truth).sum() / max(1, hit.sum() + truth.sum())
        best = max(best, (float(f1), -abs(float(c) - 0.5), float(c)))
    return best[2]


def fit(masks: DataFrame, trivial: int, spark: SparkSession, rounds: int = ROUNDS) -> Fitted:
    """The label model of each defect. ``masks`` has a column of masks for each defect, ``trivial`` is the number of plain labels left out of it.

    The driver receives the count of each mask of a defect: at most 3 to the power of its labelling functions.
    """
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("mask")) for d in DEFECTS)))
    counted = {(r["defect"], r["mask"]): r["n"] for r in masks.select(each.alias("x")).groupBy("x.defect", "x.mask").agg(F.count(F.lit(1)).alias("n")).collect()}
    examples = spark.createDataFrame([(i, r, s, t) for i, (r, s, t, _) in enumerate([*VALIDATION, ("true", _S, 1, None)])], "__row bigint, __response string, __statement string, __tokens bigint")
    seen = {r["__row"]: r for r in _masks(examples).collect()}
    chances, cutoffs = {}, {}
    for d, functions in FUNCTIONS.items():
        counts = np.zeros(3**functions)
        for (name, mask), n in counted.items():
            if name == d:
                counts[mask] += n
        counts[seen[len(VALIDATION)][d]] += trivial
        chances[d] = posteriors(counts, functions, rounds)
        cutoffs[d] = _cutoff(chances[d][[seen[i][d] for i in range(len(VALIDATION))]], np.array([x[3] == d for x in VALIDATION]))
    return Fitted(chances, cutoffs)


def defects(log: DataFrame, statements: DataFrame, row: str, key: str, response: str, tokens: str, rounds: int = ROUNDS) -> DataFrame:
    """(row, defect, chance): each row of a log of responses with each of its defects whose chance exceeds the validated cutoff.

    ``statements`` has the columns of ``key`` and statement, one row for each key. The defects are those of DEFECTS; a
    row may have several. Null and empty responses are empty; a response whose statement is unknown (null or missing
    key) is judged without it; null token counts count as none; texts are taken whole, repeated rows are each judged.
    An empty log gives an empty result. Responses that are nothing but a label have the same votes, so they enter the
    model as one counted mask; all others are voted on by every labelling function, with the statement joined by a join
    that spreads hot keys.
    """
    spark = log.sparkSession
    plain = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(response), F.lit("")), "\\s+", " "))).rlike(TRIVIAL)
    named = log.select(F.col(row).alias("__row"), F.col(key).alias("__key"), F.col(response).alias("__response"), F.coalesce(F.col(tokens), F.lit(0)).alias("__tokens"))
    total = log.count()
    sizes = named.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"))
    joined = skew_join(named.where(~plain), statements.select(F.col(key).alias("__key"), F.col("statement").alias("__statement")), "__key", counts=sizes, total=total)
    masks = written(_masks(joined), "votes")
    model = fit(masks, total - masks.count(), spark, rounds)
    chance = {d: F.get(F.lit([float(x) for x in model.chances[d]]), F.col(d)) for d in DEFECTS}
    each = F.array(*(F.struct(F.lit(d).alias("defect"), chance[d].alias("chance"), F.lit(model.cutoffs[d]).alias("cutoff")) for d in DEFECTS))
    return masks.select(F.col("__row").alias(row), F.explode(each).alias("x")).where("x.chance > x.cutoff").select(row, "x.defect", "x.chance")
