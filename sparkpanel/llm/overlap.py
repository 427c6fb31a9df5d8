"""Same or near-same records across splits, by a weighted cosine join with inverted lists."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import written

#: Least cosine of two term-weight vectors that are joined.
COSINE = 0.6
#: A term in at least one of so many classes of equal statements is frequent; there are at most this number of times
#: the mean statement length of such terms, which bounds the dictionary the driver holds.
FREQUENT = 2000
#: Least share of words outside names, numbers and attributes that two statements of one claim have in common.
COMMON = 0.5
#: Share of a term's occurrences that are capitalised within a sentence, from which on it counts as a name.
NAME = 0.3
_SALTS = 32

_GROUPED = re.compile("(?<=\\d)[,'\u2019\u00a0\u2009\u202f](?=\\d{3}(?!\\d))")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+(?:['’][^\W\d_]+)?")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def tokens_of(statement: str) -> tuple[list[str], str]:
    """Tokens in one character form, and a mark for each: C capitalised within the sentence, l not, u unknown as the whole statement has one case."""
    text = _GROUPED.sub("", _HIDDEN.sub("", statement))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = _GROUPED.sub("", text).replace("%", " percent ")
    found = [m.group() for m in _TOKEN.finditer(text)]
    words = [w for w in found if w[0].isalpha()]
    one_case = all(w.islower() for w in words) or all(w.isupper() for w in words if len(w) > 1) or sum(w[0].isupper() for w in words) > 0.8 * len(words)
    tokens, marks = [], []
    for i, w in enumerate(found):
        if w[0].isdigit():
            w = w.lstrip("0") or "0"
            w = w.rstrip("0").rstrip(".") if "." in w else w
        tokens.append(w.casefold().replace("’", "'"))
        marks.append("u" if one_case else "C" if i and w[0].isupper() else "l")
    return tokens, "".join(marks)


def _near(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


class Speller:
    """Maps a rare word to the most frequent dictionary word at most one letter added, dropped, changed or swapped away."""

    def __init__(self, frequent: dict[str, int]) -> None:
        self.frequent = frequent
        self.index: dict[str, list[str]] = {}
        for w in frequent:
            if len(w) >= 4 and w.isalpha():
                for d in (w, *_near(w)):
                    self.index.setdefault(d, []).append(w)
        self.known: dict[str, str] = {}

    @staticmethod
    def _one(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > 1:
            return False
        i = 0
        while i < min(len(a), len(b)) and a[i] == b[i]:
            i += 1
        x, y = a[i:], b[i:]
        return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])

    def __call__(self, word: str) -> str:
        if word in self.frequent or len(word) < 3 or not word.isalpha():
            return word
        if (seen := self.known.get(word)) is None:
            options = {w for d in (word, *_near(word)) for w in self.index.get(d, ()) if self._one(word, w)}
            seen = max(options, key=lambda w: (self.frequent[w], w)) if options else word
            if len(self.known) < 200_000:
                self.known[word] = seen
        return seen


def _weight(n: int, total: int) -> float:
    return math.log(1 + total / max(n, 1)) ** 2


def _classes(items: DataFrame, train: str, others: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Members (cid, id) and one row (cid, class, side, canon, marks) for each distinct canonical statement."""

    def canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [tokens_of(s) for s in b.column("statement").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("class"), b.column("side"), pa.array([" ".join(t) for t, _ in pairs], pa.string()), pa.array([m for _, m in pairs], pa.string())], ["id", "class", "side", "canon", "marks"])

    side = F.when(F.col("split") == train, "train").when(F.col("split").isin(*others), "other")
    rows = items.select("id", "class", side.alias("side"), "statement").where("id is not null and class is not null and side is not null and statement is not null").distinct()
    rows = rows.mapInArrow(canonical, "id string, class boolean, side string, canon string, marks string").where("canon <> ''")
    rows = written(rows.withColumn("cid", F.md5(F.concat_ws("|", "side", F.col("class").cast("string"), "canon"))), "statements")
    classes = rows.groupBy("cid", "class", "side", "canon").agg(F.min_by("marks", "id").alias("marks"))
    return rows.select("cid", "id").distinct(), written(classes, "classes")


def _id(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


_LAYOUT = "cid string, class boolean, side string, key binary, terms array<bigint>, weights array<double>, plain array<bigint>"


def _vectors(classes: DataFrame, attributes: DataFrame, least: float) -> DataFrame:
    """For each class its terms (as 64-bit hashes) by falling weight, their unit-length weights, how many lead, and what follows them at most.

    ``key`` is a digest of the sorted numbers, names and attributes, ``plain`` the other words. Frequent terms come from
    a bounded dictionary, rare ones get their counts by a join on the term. A rare word one letter away from a frequent
    one is read as that word.
    """
    spark = classes.sparkSession
    total = classes.count()
    occurrences = classes.select("cid", "marks", F.posexplode(F.split("canon", " ")).alias("i", "term")).select("cid", "term", F.substr("marks", F.col("i") + 1, F.lit(1)).alias("mark"))
    counted = occurrences.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mark") == "C").alias("caps"), F.count_if(F.col("mark") != "u").alias("seen"))
    named = (F.col("seen") > 0) & (F.col("caps") >= NAME * F.col("seen"))
    stats = counted.join(attributes.select(F.col("term"), F.lit(True).alias("attribute")).distinct(), "term", "left")
    stats = written(stats.select("term", "n", (F.coalesce("attribute", F.lit(False)) | named).alias("critical")), "terms")
    usual = F.col("n") >= max(3, total / FREQUENT)
    frequent = {r["term"]: (r["n"], r["critical"]) for r in stats.where(usual).collect()}
    shared = spark.sparkContext.broadcast(frequent)
    rare = occurrences.select("cid", "term").join(stats.where(~usual), "term").groupBy("cid").agg(F.collect_list(F.struct("term", "n", "critical")).alias("known"))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Speller({w: n for w, (n, _) in shared.value.items()})
        usual = {w: (_id(w), _weight(n, total), c or w[0].isdigit()) for w, (n, c) in shared.value.items()}
        for b in batches:
            terms, weights, plain, keys = [], [], [], []
            for canon, known in zip(b.column("canon").to_pylist(), b.column("known").to_pylist()):
                own = {k["term"]: (k["n"], k["critical"]) for k in known or ()}
                info, exact, others = {}, [], []
                for w in map(spell, canon.split(" ")):
                    if (t := usual.get(w)) is None:
                        n, c = own[w]
                        t = _id(w), _weight(n, total), c or w[0].isdigit()
                    info[t[0]] = t[1]
                    if t[2]:
                        exact.append(w)
                    else:
                        others.append(t[0])
                ordered = sorted(info.items(), key=lambda x: (-x[1], x[0]))
                norm = math.sqrt(sum(x * x for _, x in ordered))
                terms.append([t for t, _ in ordered])
                weights.append([x / norm for _, x in ordered])
                plain.append(sorted(others))
                keys.append(hashlib.blake2b(" ".join(sorted(exact)).encode(), digest_size=16).digest())
            ids = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("class"), b.column("side"), pa.array(keys, pa.binary()), pa.array(terms, ids), pa.array(weights, pa.list_(pa.float64())), pa.array(plain, ids)], ["cid", "class", "side", "key", "terms", "weights", "plain"])

    vectors = written(classes.join(rare, "cid", "left").select("cid", "class", "side", "canon", "known").mapInArrow(weighed, _LAYOUT), "weights")

    highest = vectors.select("side", F.explode(F.arrays_zip("terms", "weights")).alias("x")).groupBy("side", F.col("x.terms").alias("term")).agg(F.max("x.weights").alias("top"), F.count(F.lit(1)).alias("n"))
    top: dict[str, list[tuple[int, float]]] = {"train": [], "other": []}
    for r in highest.where(usual).collect():
        top[r["side"]].append((r["term"], r["top"]))
    tops = spark.sparkContext.broadcast({s: (np.array([t for t, _ in sorted(x)], np.int64), np.array([w for _, w in sorted(x)] + [1.0])) for s, x in top.items()})

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Leading terms: the rest can add less than ``least`` to any dot product, by its norm or by the largest weights across."""
        for b in batches:
            column = b.column("weights")
            starts, weights = column.offsets.to_numpy(), column.flatten().to_numpy()
            starts = starts - starts[0]
            terms, sizes = b.column("terms").flatten().to_numpy(), np.diff(starts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            train = np.repeat(np.array(b.column("side").to_pylist()) == "train", sizes) if len(sizes) else np.zeros(0, bool)
            most = np.ones(len(terms))
            for side, mine in (("other", train), ("train", ~train)):
                known, highest_ = tops.value[side]
                at = np.searchsorted(known, terms[mine])
                at[(at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] != terms[mine]) if len(known) else slice(None)] = len(known)
                most[mine] = highest_[at]
            suffix = lambda x: np.concatenate([[0.0], np.cumsum(x)])[starts[1:]][row] - np.concatenate([[0.0], np.cumsum(x)])[:-1]
            bound = np.minimum(np.sqrt(np.maximum(suffix(weights * weights), 0.0)), suffix(weights * most))
            lead = np.bincount(row, weights=bound >= least - 1e-9, minlength=len(sizes)).astype(np.int32)
            rest = np.where(lead < sizes, np.append(bound, 0.0)[np.minimum(starts[:-1] + lead, len(bound))], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lead, pa.int32()), pa.array(rest, pa.float64())], [*b.schema.names, "lead", "rest"])

    return written(vectors.mapInArrow(led, _LAYOUT + ", lead int, rest double"), "vectors")


def _candidates(vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of a train and another class whose leading terms meet and whose dot product can reach ``least``; the lists are parted by class and key."""
    lists = ["term", "class", "key"]
    posted = vectors.select("cid", "class", "key", "side", "rest", F.explode(F.slice(F.arrays_zip("terms", "weights"), 1, F.col("lead"))).alias("x")).select("cid", "class", "key", "side", "rest", F.col("x.terms").alias("term"), F.col("x.weights").alias("w"))
    # A hot list is cut into salted parts on one side and repeated for each part on the other.
    sizes = posted.groupBy(*lists).agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > max(vectors.count() * 1e-3, 5000)).select(*lists, F.lit(_SALTS).alias("salts"))
    hot = written(hot, "hot")  # a thousand lists for each leading term of a class at most
    salts = F.coalesce("salts", F.lit(1))
    marked = posted if hot.isEmpty() else posted.join(hot, lists, "left")
    marked = marked if "salts" in marked.columns else marked.withColumn("salts", F.lit(None).cast("int"))
    train = marked.where("side = 'train'").withColumn("salt", F.pmod(F.xxhash64("cid"), salts).cast("int"))
    other = marked.where("side = 'other'").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    met = train.select(*lists, "salt", F.col("cid").alias("a"), F.col("w").alias("wa"), F.col("rest").alias("ra")).join(other.select(*lists, "salt", F.col("cid").alias("b"), F.col("w").alias("wb"), F.col("rest").alias("rb")), [*lists, "salt"])
    pairs = met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("part"), F.max(F.greatest("ra", "rb")).alias("rest"))
    return pairs.where(F.col("part") + F.col("rest") >= least - 1e-9).select("a", "b")


def same_claim(plain_a: list, plain_b: list) -> bool:
    """At least the share COMMON of the words besides numbers, names and attributes is common to both."""
    shared = sum((Counter(plain_a) & Counter(plain_b)).values())
    return shared >= COMMON * max(len(plain_a), len(plain_b))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dots, same = [], []
        for ta, wa, pa_, tb, wb, pb in zip(*(b.column(c).to_pylist() for c in ("terms_a", "weights_a", "plain_a", "terms_b", "weights_b", "plain_b"))):
            at = dict(zip(tb, wb))
            dots.append(sum(w * at.get(t, 0.0) for t, w in zip(ta, wa)))
            same.append(same_claim(pa_, pb))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(dots, pa.float64()), pa.array(same, pa.bool_())], ["a", "b", "cosine", "same"])


def class_pairs(items: DataFrame, attributes: DataFrame, train: str = "train", others: tuple[str, ...] = ("dev", "test"), least: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, cosine, same) of statement classes across splits with equal numbers, names and attributes and a cosine of ``least`` or more, and the members (cid, id) of each class.

    ``items`` has id, class (boolean), split and statement; ``attributes`` has a column term. A class holds all items
    of one side with equal canonical statements, so copies are compared once; a is a train class, b one of the other
    splits, both with the same class value. Statements that differ in a number, a name or an attribute are different
    claims, so the inverted lists are parted by a digest of these. ``same`` tells whether both make the same claim (see
    :func:`same_claim`). Rows with a null id, class, split or statement, or a statement without any word or number,
    belong to no pair; repeated rows count once. Empty inputs give empty results. Texts are taken whole.
    """
    members, classes = _classes(items, train, others)
    vectors = _vectors(classes, attributes, least)
    found = _candidates(vectors, least)
    parts = ("terms", "weights", "plain")
    left = vectors.select(F.col("cid").alias("a"), *(F.col(c).alias(f"{c}_a") for c in parts))
    right = vectors.select(F.col("cid").alias("b"), *(F.col(c).alias(f"{c}_b") for c in parts))
    checked = found.join(left, "a").join(right, "b").mapInArrow(_verified, "a string, b string, cosine double, same boolean")
    return checked.where(F.col("cosine") >= least), members


def item_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (id_a, id_b; id_a < id_b) of the items of classes that make the same claim."""
    one, two = members.select(F.col("cid").alias("a"), F.col("id").alias("x")), members.select(F.col("cid").alias("b"), F.col("id").alias("y"))
    return pairs.where("same").select("a", "b").join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
