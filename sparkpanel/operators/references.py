"""References to records that do not exist at the time of the reference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import NULL_KEY, skew_join, written

#: Stands for the begin of parents that have none.
_EVER = "timestamp_ntz'0001-01-01 00:00:00'"
_PARENT, _CHILD = 0, 1
_PRESENT, _SWEEP = "present", "sweep"


@dataclass(frozen=True)
class Child:
    """A table of references: its name, the key it refers to, the time of the row and the row's number."""

    name: str
    frame: DataFrame
    key: Column
    time: Column
    row: Column


def _slot(time: str) -> Column:
    """The hour of a time, without any time zone."""
    t = F.col(time)
    return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.lit(0), F.lit(0))


def orphans(children: Sequence[Child], parents: DataFrame, key: Column, since: Column, until: Column) -> DataFrame:
    """References (ref_table, seq, time, reason) whose non-null key has no parent row at their own time.

    A parent row is present from ``since`` up to, but not including, ``until``; a null ``since`` means always, a null
    ``until`` still. reason is 'missing' if no parent row has the key, 'late' if all rows with it begin after the
    reference, else 'deleted'. A reference without a time is a case only if its key is missing. Null keys are no
    references; parent rows with a null key are ignored, repeated parent rows count once as far as presence goes, and
    a parent that ends before it begins is never present. Either side may be empty.

    Parent and child keys form one long table of tagged events. It is grouped by key and hour, with sums that combine
    before the shuffle. A key without any parent flag is missing by its group alone, and an hour in which no parent row
    of the key begins or ends is decided by the sums of the hours before it. Only references in the other hours are
    compared with the changes within their hour. References without a time are decided by their group, so they never
    meet in one task; a key and hour that holds any number of references is spread by a salted join.
    """
    parent_rows = parents.select(key.alias("key"), F.coalesce(since.cast("timestamp_ntz"), F.expr(_EVER)).alias("time"), until.cast("timestamp_ntz").alias("until")).where(F.col("key").isNotNull())
    valid = F.col("until").isNull() | (F.col("until") > F.col("time"))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    opened = parent_rows.select("key", "time", F.when(valid, one).otherwise(zero).alias("open"), one.alias("load"))
    closed = parent_rows.where(valid & F.col("until").isNotNull()).select("key", F.col("until").alias("time"), (-one).alias("open"), zero.alias("load"))
    changes = opened.unionByName(closed).select(F.lit(_PARENT).alias("tag"), "key", "time", "open", "load", F.lit(None).cast("string").alias("child"), F.lit(None).cast("bigint").alias("row"))
    events = changes
    for c in children:
        rows = c.frame.select(F.lit(_CHILD).alias("tag"), c.key.alias("key"), c.time.cast("timestamp_ntz").alias("time"), zero.alias("open"), zero.alias("load"), F.lit(c.name).alias("child"), c.row.cast("bigint").alias("row"))
        events = events.unionByName(rows.where(F.col("key").isNotNull()))
    events = events.withColumn("slot", _slot("time"))

    # One row for each key and hour (a null hour for references without a time), whatever the number of references.
    counted = events.groupBy("key", "slot").agg(F.sum("open").alias("open"), F.sum("load").alias("load"), F.count_if(F.col("tag") == _PARENT).alias("changes"), F.count("child").alias("children"))
    past = Window.partitionBy("key").orderBy(F.col("slot").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.select(
        "key", "slot", "changes", "children", F.coalesce(F.sum("open").over(past), zero).alias("open"), F.coalesce(F.sum("load").over(past), zero).alias("begun"), F.sum("load").over(Window.partitionBy("key")).alias("loads"),
    ).where("children > 0")
    verdict = (
        F.when(F.col("loads") == 0, "missing").when(F.col("slot").isNull(), _PRESENT).when(F.col("changes") > 0, _SWEEP)
        .when(F.col("open") > 0, _PRESENT).when(F.col("begun") == 0, "late").otherwise("deleted")
    )
    groups = written(summed.select("key", "slot", _place("key", "slot").alias("place"), "children", verdict.alias("verdict"), "open", "begun"), "groups")
    decided = groups.where(F.col("verdict") != _PRESENT)
    refs = events.where(F.col("tag") == _CHILD).select("child", "row", "time", _place("key", "slot").alias("place"))
    sizes = groups.select("place", F.col("children").alias("__n"))
    total = groups.agg(F.sum("children")).first()[0] or 0
    told = written(skew_join(refs, decided.select("place", "verdict", "open", "begun"), "place", "inner", counts=sizes, total=total), "told")
    whole = told.where(F.col("verdict") != _SWEEP).select("child", "row", "time", F.col("verdict").alias("reason"))

    # In hours with changes, those changes are few rows; each reference is compared with the sums up to its own time.
    swept = decided.where(F.col("verdict") == _SWEEP)
    steps = changes.withColumn("slot", _slot("time")).join(swept.select("key", "slot"), ["key", "slot"], "left_semi").groupBy("key", "slot", "time").agg(F.sum("open").alias("open"), F.sum("load").alias("load"))
    listed = steps.groupBy("key", "slot").agg(F.collect_list(F.struct("time", "open", "load")).alias("steps")).select(_place("key", "slot").alias("place"), "steps")
    near = skew_join(told.where(F.col("verdict") == _SWEEP).drop("verdict"), listed, "place", "inner", counts=sizes, total=total)
    upto = F.filter("steps", lambda s: s["time"] <= F.col("time"))
    change = lambda field: F.aggregate(upto, zero, lambda a, s: a + s[field])
    close = near.select("child", "row", "time", (F.col("open") + change("open")).alias("present"), (F.col("begun") + change("load")).alias("started"))
    within = close.where("present <= 0").select("child", "row", "time", F.when(F.col("started") == 0, "late").otherwise("deleted").alias("reason"))
    return whole.unionByName(within).select(F.col("child").alias("ref_table"), F.col("row").alias("seq"), "time", "reason")


def _place(key: str, slot: str) -> Column:
    return F.concat_ws("\u0001", F.coalesce(F.col(slot).cast("string"), F.lit(NULL_KEY)), F.col(key))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, reason and month (null for references without a time)."""
    return found.groupBy("ref_table", "reason", F.date_format("time", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
