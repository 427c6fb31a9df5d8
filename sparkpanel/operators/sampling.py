"""Deterministic samples: ranks by hash, splits, quotas and mixtures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hashed(*parts: Column | str) -> Column:
    """SHA-256 of pipe-joined parts: a uniform order that any engine can repeat."""
    return F.sha2(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def ranked(frame: DataFrame, by: Sequence[str], digest: str, name: str) -> DataFrame:
    """Rank from 1 by a hex digest within groups of any size.

    Rows are ranked within one of 4096 slices of the digest; what precedes a slice comes from counted slices, so no
    task sorts a whole group. Equal digests get some order.
    """
    slices = frame.withColumn("__slice", F.substring(digest, 1, 3))
    counted = slices.groupBy(*by, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    past = Window.partitionBy(*by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select(*by, "__slice", F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__slice").orderBy(digest))
    return slices.join(before, [*by, "__slice"]).withColumn(name, F.col("__before") + inside).drop("__slice", "__before")


def split(items: DataFrame, seeds: Sequence[int], most: int = 150) -> DataFrame:
    """Each item in each seed with its role: the first of its family and class, at most ``most`` or half, calibrate; the rest are deployed."""
    each = items.withColumn("seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("__h", hashed("split", F.col("seed"), F.col("id")))
    sizes = items.groupBy("family", "is_corrupted").agg(F.count(F.lit(1)).alias("__n"))
    placed = ranked(each, ["family", "seed", "is_corrupted"], "__h", "__rank").join(F.broadcast(sizes), ["family", "is_corrupted"])  # a row for each family and class
    return placed.withColumn("role", F.when(F.col("__rank") <= F.least(F.lit(most), F.floor(F.col("__n") / 2)), "calibration").otherwise("deployment")).drop("__h", "__rank", "__n")


def quotas(total: int, place: Column, among: Column) -> Column:
    """The share of ``total`` for the donor at ``place`` (from 1) of ``among``: the first ones get what is left over."""
    return F.floor(F.lit(total) / among) + F.when(place <= F.lit(total) % among, 1).otherwise(0)


def half_up(total: int, share: float) -> int:
    return int(total * share + 0.5)


def proportional_order(frame: DataFrame, stratum: str, digest: str) -> DataFrame:
    """Positions that keep every prefix close to the strata's shares: ordered by (rank - 1/2) / size of the stratum, ties by stratum."""
    counted = frame.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    placed = ranked(frame, [stratum], digest, "stratum_rank").join(counted, stratum)
    return placed.withColumn("place", F.round((F.col("stratum_rank") - 0.5) / F.col("__size"), 9)).drop("__size")
