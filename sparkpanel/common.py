"""Helpers every operator shares: identifier spelling, the shared folder, hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that may surround an identifier without changing it.
BLANKS = " \t\n\r\u00a0"
#: Stands for a null inside a grouping key, so that joins on it stay plain equi-joins.
NULL_KEY = "\u0000null"


def spelled(column: Column | str) -> Column:
    """An identifier in its one spelling: lower case, no surrounding blanks. Null stays null."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS)))


def key_text(column: Column) -> Column:
    """A key part as text that is never null."""
    return F.coalesce(column.cast("string"), F.lit(NULL_KEY))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that the frame doesn't have, so that no input column is shadowed."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        candidate, n = f"__{name}", 0
        while candidate.lower() in taken:
            n += 1
            candidate = f"__{name}_{n}"
        taken.add(candidate.lower())
        out.append(candidate)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where it is set, a temporary one only in local mode."""
    context = spark.sparkContext
    if (known := context.getCheckpointDir()) is not None:
        return known
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sparkpanel-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, its lineage cut, safe against the loss of executors. Removed when the driver ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/sparkpanel-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def hot_values(counts: DataFrame, value: str, n: str, total: int, share: float = 1e-3, least: int = 10_000) -> list:
    """Values of a counted column that hold more than ``share`` of ``total`` rows (and more than ``least``).

    At most ``1 / share`` values can do so, which bounds what the driver receives whatever the data.
    """
    return [r[0] for r in counts.where(F.col(n) > max(total * share, least)).select(value).collect()]


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", share: float = 1e-3, least: int = 10_000, counts: DataFrame | None = None, total: int | None = None, salts: int = 32) -> DataFrame:
    """An equi-join on one column whose left side may have hot keys and whose right side has one row a key.

    The left rows of keys that hold more than ``share`` of the left rows (at most ``1 / share`` of them) are spread over
    ``salts`` parts, and the right rows of those keys are repeated for each part, so no task receives a hot group; all
    other keys are joined as they are. Nothing is marked for a broadcast: whether a side is small enough for one is left
    to the planner and its threshold. ``counts`` (on, __n) and ``total`` may be given where counts of a larger table are
    cheaper; more keys are hot then. ``how`` is left or inner.
    """
    if counts is None:
        counts = left.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("__n"))
    hot = hot_values(counts.where(F.col(on).isNotNull()), on, "__n", left.count() if total is None else total, share, least)
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right, on, how)
    part = left.where(is_hot).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    known = right.where(F.col(on).isin(hot)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cold.unionByName(part.join(known, [on, "__salt"], how).drop("__salt"))
