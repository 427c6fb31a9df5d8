"""Exactly one copy of every message that was delivered at least once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import fresh, key_text, written


def _ranked(messages: DataFrame, key: Mapping[str, Column], identifier: Column, order: str, hot_share: float, hot_least: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows that pass directly, rows of repeated groups with their rank, and the name of the rank.

    Aggregated frequency (combined before the shuffle) splits the keys: keys seen once pass; groups of up to
    ``hot_share`` of all rows are ranked in a window; larger groups, of which there can be ``1 / hot_share`` at most,
    have their first row picked by an aggregation over (order, row number), which sends one row a task, whatever their
    order values are. The keys are joined by a two-part hash, so that a key is as wide as two numbers.
    """
    k1, k2, n, first, rank, number = fresh(messages, "k1", "k2", "n", "first", "rank", "number")
    whole = F.concat_ws("\u0001", *(key_text(c) for c in key.values()))
    named = messages.withColumns({k1: F.xxhash64(whole), k2: F.xxhash64(F.lit(1), whole), rank: F.when(identifier.isNull(), F.lit(0))})
    without, rows = named.where(F.col(rank) == 0), named.where(F.col(rank).isNull()).drop(rank)
    repeated = written(rows.groupBy(k1, k2).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1), "repeated")
    bound = max(messages.count() * hot_share, hot_least)
    hot = [(r[0], r[1]) for r in repeated.where(F.col(n) > bound).select(k1, k2).collect()]
    by_order = Window.partitionBy(k1, k2).orderBy(F.col(order).asc_nulls_last())
    usual = repeated.where(F.col(n) <= bound)
    if not hot:
        joined = rows.join(usual, [k1, k2], "left")
        return joined.where(F.col(n).isNull()).drop(n).unionByName(without.drop(rank)).drop(k1, k2), joined.where(F.col(n).isNotNull()).withColumn(rank, F.row_number().over(by_order)).drop(k1, k2, n), rank
    is_hot = F.lit(False)
    for one, two in hot:
        is_hot = is_hot | ((F.col(k1) == one) & (F.col(k2) == two))
    joined = rows.where(~is_hot).join(usual, [k1, k2], "left")
    single = joined.where(F.col(n).isNull()).drop(n)
    ranked = joined.where(F.col(n).isNotNull()).drop(n).withColumn(rank, F.row_number().over(by_order))
    # A written table has fixed rows in fixed partitions, so the row numbers are the same wherever they are asked for.
    large = written(rows.where(is_hot), "large").withColumn(number, F.monotonically_increasing_id())
    least = large.groupBy(k1, k2).agg(F.min(F.struct(F.col(order).isNull().alias("a"), F.col(order).alias("b"), F.col(number).alias("c")))["c"].alias(first))
    firsts = [r[0] for r in least.select(first).collect()]
    told = large.withColumn(rank, F.when(F.col(number).isin(firsts), 1).otherwise(2)).drop(number)
    return single.unionByName(without.drop(rank)).drop(k1, k2), ranked.unionByName(told).drop(k1, k2), rank


def keep_first(messages: DataFrame, key: Mapping[str, Column], identifier: Column, order: str, hot_share: float = 1e-3, hot_least: int = 10_000) -> DataFrame:
    """One row of each message, the one with the smallest ``order``; the columns are those of the input.

    Null parts of the key equal each other. Rows whose ``identifier`` is null name no message and all stay. Rows that
    tie on ``order``, exact repeats included, still leave one row. A null order comes last. An empty input gives an
    empty result; further columns, whatever their names, pass through.
    """
    single, ranked, rank = _ranked(messages, key, identifier, order, hot_share, hot_least)
    return single.unionByName(ranked.where(F.col(rank) == 1).drop(rank))


def surplus(messages: DataFrame, key: Mapping[str, Column], identifier: Column, order: str, hot_share: float = 1e-3, hot_least: int = 10_000) -> DataFrame:
    """The rows that :func:`keep_first` leaves out, under the same rules."""
    _, ranked, rank = _ranked(messages, key, identifier, order, hot_share, hot_least)
    return ranked.where(F.col(rank) > 1).drop(rank)


def absorb(stored: DataFrame, new: DataFrame, key: Mapping[str, Column], identifier: Column, order: str, **limits) -> DataFrame:
    """One row of each message of both inputs, a stored row before any new one, then the smallest ``order``.

    Columns that only one side has are null on the other.
    """
    (when,) = fresh(stored.unionByName(new.limit(0), allowMissingColumns=True), "when")
    both = stored.withColumn(when, F.struct(F.lit(0).alias("a"), F.col(order).alias("b"))).unionByName(new.withColumn(when, F.struct(F.lit(1).alias("a"), F.col(order).alias("b"))), allowMissingColumns=True)
    return keep_first(both, key, identifier, when, **limits).drop(when)
