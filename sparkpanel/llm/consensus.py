"""Consensus labels, agreement and reliability from several annotators, by a community confusion model."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import written

#: What an annotator may answer; the first two are also the true classes. Any other answer counts as the last.
ANSWERS = ("true", "false", "parse_fail")
#: Prior confusion of each community: the chance of ANSWERS given a true and a false item.
COMMUNITIES = np.array(
    [
        [[0.85, 0.10, 0.05], [0.10, 0.85, 0.05]],  # careful
        [[0.70, 0.25, 0.05], [0.25, 0.70, 0.05]],  # hasty
        [[0.47, 0.47, 0.06], [0.47, 0.47, 0.06]],  # guessing
        [[0.90, 0.05, 0.05], [0.90, 0.05, 0.05]],  # always true
        [[0.05, 0.90, 0.05], [0.05, 0.90, 0.05]],  # always false
        [[0.20, 0.75, 0.05], [0.75, 0.20, 0.05]],  # contrary
    ]
)
#: Answers that the prior of a community is worth at least (else its part of all answers, so that communities keep
#: their character), and that a community is worth to each of its annotators.
PRIOR, POOL = 50.0, 25.0
#: An annotator whose informedness (true-positive rate plus true-negative rate minus one) isn't above this carries no usable information.
INFORMED = 0.1


def labels(answers: DataFrame, order: Column) -> DataFrame:
    """One answer (item, judge, answer) of each annotator to each item: the last true or false by ``order``, else parse_fail.

    Repeated deliveries and retries end in that one row; the aggregation combines before the shuffle, so a hot item or
    annotator costs one row a task. Rows with a null item or judge are left out; a null answer is parse_fail.
    """
    valid = F.col("answer").isin(*ANSWERS[:2])
    told = answers.where("item is not null and judge is not null").select("item", "judge", F.struct(F.coalesce(valid, F.lit(False)).alias("valid"), order.alias("order"), F.when(valid, F.col("answer")).otherwise(ANSWERS[2]).alias("answer")).alias("x"))
    return told.groupBy("item", "judge").agg(F.max("x").alias("x")).select("item", "judge", "x.answer")


@dataclass
class Model:
    judges: list[str]
    #: Share of each community in each annotator; its confusion; the annotators' own confusions; the share of true items.
    belongs: np.ndarray
    communities: np.ndarray
    confusion: np.ndarray
    told: np.ndarray
    true: float
    #: The annotators' confusions against the other annotators of the same items alone.
    against: np.ndarray
    converged: bool = True

    @property
    def informed(self) -> np.ndarray:
        """True-positive plus true-negative rate minus one, among the answers true and false, as the other annotators see it."""
        c = self.against[:, :, :2] / self.against[:, :, :2].sum(axis=2, keepdims=True)
        return c[:, 0, 0] + c[:, 1, 1] - 1

    def weights(self) -> np.ndarray:
        """Log odds of a true item for each judge and answer, flat."""
        return (np.log(self.confusion[:, 0]) - np.log(self.confusion[:, 1])).reshape(-1)


def _digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def _posterior(codes: pa.ListArray, odds: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chance that each item is true; the flat codes and the item of each."""
    logit, flat, item = _logit(codes, odds, prior)
    return _chance(logit), flat, item


def _chance(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _logit(codes: pa.ListArray, odds: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(codes.offsets.to_numpy())
    flat = codes.flatten().to_numpy(zero_copy_only=False)
    item = np.repeat(np.arange(len(sizes)), sizes)
    return prior + np.bincount(item, weights=odds[flat], minlength=len(sizes)), flat, item


def patterns(told: DataFrame, judges: list[str]) -> DataFrame:
    """Items by their sorted answers (judge number times three plus answer): items with the same answers are one row with a count."""
    numbers = told.sparkSession.createDataFrame([(j, i) for i, j in enumerate(judges)], "judge string, number int")
    answer = F.array_position(F.array(*map(F.lit, ANSWERS)), F.col("answer")).cast("int") - 1
    coded = told.join(numbers, "judge").select("item", (F.col("number") * len(ANSWERS) + answer).alias("code"))
    return coded.groupBy("item").agg(F.array_sort(F.collect_list("code")).alias("codes"))


def fit(told: DataFrame, rounds: int = 200, change: float = 1e-4) -> tuple[Model, DataFrame]:
    """The model of (item, judge, answer) rows and the items with their codes.

    Annotators belong to communities that share a confusion matrix. Each round of variational updates makes one pass
    over the distinct answer patterns, which gives the expected counts of answers by annotator and true class; the
    driver, which only holds some 20 figures an annotator (a million annotators are 160 MB), then updates who belongs
    where and the shared matrices. An annotator's own matrix is the mean of its counts and its communities', so few
    labels lean on the community. An item is one row, whose codes are as many as its annotators. If the counts still
    move by more than ``change`` after ``rounds``, the model says so (``converged``) and a warning is given. No rows
    give a model without annotators.
    """
    told = written(told, "told")
    judges = told.select("judge").distinct().orderBy("judge").toArrow().column(0).to_pylist()
    items = written(patterns(told, judges), "items")
    counted = written(items.groupBy("codes").agg(F.count(F.lit(1)).alias("n")), "patterns")
    size = len(judges) * len(ANSWERS)
    shared = COMMUNITIES.copy()
    belongs = np.full((len(judges), len(shared)), 1 / len(shared))
    counts = np.zeros((len(judges), 2, len(ANSWERS)))
    weights = 0.9 * (np.eye(2)[0] - np.eye(2)[1])
    odds, prior, true = np.tile(np.append(weights, 0.0), len(judges)), 0.0, 0.5
    def summed(odds: np.ndarray, prior: float, alone: bool = False) -> np.ndarray:
        """Expected counts of true and false items by code (last: of all items); alone: each code judged by the others of its item."""

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1, 2))
            for b in batches:
                n = b.column("n").to_numpy(zero_copy_only=False).astype(float)
                logit, flat, item = _logit(b.column("codes"), odds, prior)
                by_code = _chance(logit[item] - odds[flat] if alone else logit[item])
                p = _chance(logit)
                for t in (0, 1):
                    total[:size, t] += np.bincount(flat, weights=(by_code if t == 0 else 1 - by_code) * n[item], minlength=size)
                    total[size, t] += ((p if t == 0 else 1 - p) * n).sum()
            seen = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen, 0]), pa.array(total[seen, 1])], ["code", "t", "f"])

        table = np.zeros((size + 1, 2))
        sums = counted.mapInArrow(expected, "code int, t double, f double").groupBy("code").agg(F.sum("t").alias("t"), F.sum("f").alias("f")).toArrow()
        table[sums.column("code").to_numpy()] = np.stack([sums.column("t").to_numpy(), sums.column("f").to_numpy()], axis=1)
        return table

    shape = lambda table: table[:size].reshape(len(judges), len(ANSWERS), 2).transpose(0, 2, 1)
    converged = not judges
    for _ in range(rounds if judges else 0):
        table = summed(odds, prior)
        before, counts = counts, shape(table)
        true = (table[size, 0] + 1) / (table[size].sum() + 2)
        for _ in range(10):
            dirichlet = max(PRIOR, counts.sum() / len(COMMUNITIES)) * COMMUNITIES + np.einsum("jc,jtl->ctl", belongs, counts)
            log_pi = _digamma(dirichlet) - _digamma(dirichlet.sum(axis=2, keepdims=True))
            share = 1 + belongs.sum(axis=0)
            # An annotator's evidence for a community is tempered to POOL answers, as its own matrix only resembles the shared one.
            scale = np.minimum(1.0, 8 * POOL / np.maximum(counts.sum(axis=(1, 2)), 1e-9))
            logit = _digamma(share) - _digamma(share.sum()) + scale[:, None] * np.einsum("jtl,ctl->jc", counts, log_pi)
            belongs = np.exp(logit - logit.max(axis=1, keepdims=True))
            belongs /= belongs.sum(axis=1, keepdims=True)
        shared = dirichlet / dirichlet.sum(axis=2, keepdims=True)
        own = counts + POOL * np.einsum("jc,ctl->jtl", belongs, shared)
        confusion = _digamma(own) - _digamma(own.sum(axis=2, keepdims=True))
        odds, prior = (confusion[:, 0] - confusion[:, 1]).reshape(-1), float(np.log(true) - np.log1p(-true))
        if converged := bool(np.abs(counts - before).max() <= change * max(1.0, counts.max())):
            break
    if not converged:
        warnings.warn(f"the model of annotators still moves after {rounds} rounds", stacklevel=2)
    pooled = POOL * np.einsum("jc,ctl->jtl", belongs, shared)
    share_of = lambda x: x / x.sum(axis=2, keepdims=True)
    others = shape(summed(odds, prior, alone=True)) if judges else counts
    return Model(judges, belongs, shared, share_of(counts + pooled), counts.sum(axis=1), float(true), share_of(others + pooled), converged), items


def consensus(model: Model, items: DataFrame) -> DataFrame:
    """For each item its label, the chance that it is true, its number of annotators and the share of agreeing pairs.

    Agreement is counted over the pairs of annotators who answered true or false; it is null for fewer than two. A
    chance of exactly one half counts as true.
    """
    odds, prior = model.weights(), float(np.log(model.true) - np.log1p(-model.true))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, flat, item = _posterior(b.column("codes"), odds, prior)
            answer = flat % len(ANSWERS)
            yes, no = (np.bincount(item[answer == a], minlength=len(p)) for a in (0, 1))
            valid = yes + no
            with np.errstate(divide="ignore", invalid="ignore"):
                agree = (yes * (yes - 1) + no * (no - 1)) / (valid * (valid - 1))
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(np.where(p >= 0.5, "true", "false").tolist(), pa.string()), pa.array(p), pa.array(np.bincount(item, minlength=len(p)), pa.int32()), pa.array(agree, mask=valid < 2)], ["item_id", "consensus", "p_true", "n_judges", "agreement"])

    return items.mapInArrow(judged, "item_id string, consensus string, p_true double, n_judges int, agreement double")


def reliability(model: Model, spark) -> DataFrame:
    """For each annotator its informedness, its rates, the likeliest community and the number of its labels."""
    names = ("careful", "hasty", "guessing", "always true", "always false", "contrary")
    rows = []
    for j, judge in enumerate(model.judges):
        c = model.confusion[j, :, :2] / model.confusion[j, :, :2].sum(axis=1, keepdims=True)
        rows.append((judge, float(model.informed[j]), float(c[0, 0]), float(c[1, 1]), names[int(model.belongs[j].argmax())], int(round(model.told[j].sum()))))
    return spark.createDataFrame(rows, "judge string, informedness double, true_rate double, false_rate double, community string, n_labels bigint")


def uninformative(model: Model, least: float = INFORMED) -> list[str]:
    """Annotators who tell true from false items no better than by guessing, or clearly worse."""
    return [j for j, x in zip(model.judges, model.informed) if x <= least]
