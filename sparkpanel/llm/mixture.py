"""Mixing sources to target shares of tokens by entropy balancing."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spelled, written

#: Place of the public tokenizer's ranks, and how it splits a text. Fixed values of that tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BINS = 4096


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of the documents with a source; a null or empty text has no tokens, every text is counted whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(tokenizer)
        for b in batches:
            n = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", spelled("source").alias("source"), "text").where("source is not null")
    return rows.mapInArrow(count, f"doc_id {kind}, source string, tokens bigint")


def _literal(values: dict[str, float], source: str = "source"):
    if not values:
        return F.lit(None).cast("double")
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(float(v))))), F.col(source))


def balance(counted: DataFrame, targets: dict[str, tuple[float, int]], rounds: int = 60, close: float = 1e-6) -> tuple[dict[str, dict[str, float]], float]:
    """The dual value of each source and the total of all tokens.

    A document of s tokens gets the rate min(cap, exp(lambda x)), where x is s by its source's mean: the rates nearest
    to one, in relative entropy, whose tokens meet the source's target. Each Newton step on the convex dual is one
    distributed sum over the counts of documents by source and size; steps that leave the bracket of known signs are
    halved into it. A source that can't reach its target at its cap gets the cap everywhere.
    """
    sizes = written(counted.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "sizes")
    # Sources are grouped before they are told apart from those with a target, so the total holds all of them.
    amount = sizes.agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).first()["t"] or 0
    sums = {r["source"]: r for r in sizes.where(F.col("source").isin(list(targets))).groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("docs")).collect()}
    state: dict[str, dict[str, float]] = {}
    for s, (share, cap) in targets.items():
        have = float(sums[s]["tokens"] or 0) if s in sums else 0.0
        mean = have / sums[s]["docs"] if have else 1.0
        goal = share * amount
        state[s] = {"goal": goal, "cap": float(cap), "have": have, "mean": mean, "value": 0.0, "low": -60.0, "high": 60.0, "done": float(not have or goal <= 0 or cap * have <= goal)}
        if not have or cap * have <= goal:
            state[s]["value"] = 60.0
        elif goal <= 0:
            state[s]["value"] = -60.0
    for _ in range(rounds):
        open_ = {s: v for s, v in state.items() if not v["done"]}
        if not open_:
            break
        x = F.col("tokens") / _literal({s: v["mean"] for s, v in open_.items()})
        power = x * _literal({s: v["value"] for s, v in open_.items()})
        cap = _literal({s: v["cap"] for s, v in open_.items()})
        free = power < F.log(cap)
        rate = F.when(free, F.exp(F.least(power, F.lit(80.0)))).otherwise(cap)
        weight = F.col("tokens") * F.col("n")
        got = sizes.where(F.col("source").isin(list(open_))).groupBy("source").agg(F.sum(weight * rate).alias("sum"), F.sum(F.when(free, weight * x * rate).otherwise(0.0)).alias("slope")).collect()
        for r in got:
            v = state[r["source"]]
            gap = r["sum"] - v["goal"]
            if abs(gap) <= close * v["goal"]:
                v["done"] = 1.0
                continue
            v["low" if gap < 0 else "high"] = v["value"]
            step = v["value"] - gap / r["slope"] if r["slope"] else np.inf
            v["value"] = step if v["low"] < step < v["high"] else (v["low"] + v["high"]) / 2
    return state, float(amount)


def copies(counted: DataFrame, state: dict[str, dict[str, float]]) -> DataFrame:
    """(doc_id, source, tokens, copies): the rates rounded so that each source's tokens keep their sum.

    A rate is rounded down, and up for those documents whose uniform hash lies below their remainder plus a shift of
    the source. The shift comes from a histogram of tokens by source with a fixed number of bins, so that rounding
    changes a source's sum by no more than one bin of it. Documents without tokens, and those of sources without a
    target, get no copy; none gets more than its source's cap.
    """
    x = F.col("tokens") / _literal({s: v["mean"] for s, v in state.items()})
    power = x * _literal({s: v["value"] for s, v in state.items()})
    cap = _literal({s: v["cap"] for s, v in state.items()})
    rate = F.when(F.col("tokens") == 0, 0.0).when(power < F.log(cap), F.exp(F.least(power, F.lit(80.0)))).otherwise(cap)
    uniform = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("copies")), 11) / F.lit(float(1 << 53))
    rated = counted.where(F.col("source").isin(list(state))).withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    rated = rated.withColumn("part", F.col("rate") - F.col("whole")).withColumn("slack", F.when(F.col("part") > 0, uniform - F.col("part")))
    bins = rated.where("slack is not null").groupBy("source", F.floor((F.col("slack") + 1) / 2 * _BINS).cast("int").alias("bin")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("part")).alias("due")).collect()
    shift: dict[str, float] = {}
    for s in state:
        mine = sorted((r["bin"], r["tokens"], r["due"]) for r in bins if r["source"] == s)
        due, got, cut = sum(r[2] for r in mine), 0.0, 0
        for b, tokens, _ in mine:
            if abs(got + tokens - due) > abs(got - due):
                break
            got, cut = got + tokens, b + 1
        shift[s] = cut / _BINS * 2 - 1
    up = F.when(F.col("slack") < _literal(shift), 1).otherwise(0)
    return rated.select("doc_id", "source", "tokens", (F.col("whole") + up).cast("int").alias("copies"))


def mixed(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Copies (doc_id, source, tokens, copies) of the documents, and the shares that they reach.

    ``targets`` (source, target_share, max_repeats) is a table of fixed size; a repeated source counts once, with its
    largest share. Sources are compared without case and surrounding blanks; documents without a source are left
    out, and the total is that of all documents with one. The report has a row for each target, also for a source
    without documents.
    """
    wanted = {r["source"]: (float(r["share"] or 0), int(r["cap"] or 0)) for r in targets.select(spelled("source").alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap")).collect()}
    counted = written(token_counts(documents, tokenizer), "tokens")
    state, amount = balance(counted, wanted)
    chosen = copies(counted, state)
    reached = chosen.groupBy("source").agg(F.sum("tokens").alias("tokens_held"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.count_if(F.col("copies") > 0).alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"))
    rows = [(s, share, cap, state[s]["goal"], amount) for s, (share, cap) in wanted.items()]
    plan = documents.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, tokens_target double, tokens_total double")
    report = plan.join(reached, "source", "left").na.fill(0)
    return chosen, report.withColumn("reached_share", F.when(F.col("tokens_total") > 0, F.col("tokens_used") / F.col("tokens_total")).otherwise(0.0))
