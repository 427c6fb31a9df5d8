"""The verdict log as a stream: one copy of each message, counts by window, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..common import spelled


def deduplicated(log: DataFrame, delay: str = "7 days") -> DataFrame:
    """A streaming log with the first copy of each judge, item, mode and attempt, and all rows without an item.

    Keys are kept for ``delay`` after their arrival, whatever time a row was logged at, so no first copy is late;
    a copy that arrives more than ``delay`` after the one before it may pass.
    """
    keyed = log.withColumns({"k_judge": spelled("judge"), "k_item": spelled("item_id"), "k_mode": F.coalesce(spelled("mode"), F.lit("reference_free")), "k_attempt": F.coalesce("attempt", F.lit(1)), "event_time": F.col("logged_at").cast("timestamp")})
    keys = ["k_judge", "k_item", "k_mode", "k_attempt"]
    first = keyed.where("k_item is not null").withColumn("k_arrived", F.current_timestamp()).withWatermark("k_arrived", delay).dropDuplicatesWithinWatermark(keys).drop("k_arrived")
    return first.unionByName(keyed.where("k_item is null")).drop(*keys)


def windowed(log: DataFrame, time: str, width: str = "7 days", delay: str | None = None) -> DataFrame:
    """(start, judge, n, n_true, n_fail) by tumbling window; with a delay as a stream, without as a batch. A batch's windows are free of time zones; a stream's follow the session's, as watermarks need zoned times."""
    rows = log.withColumn("t", F.col(time).cast("timestamp" if delay else "timestamp_ntz"))
    rows = rows.withWatermark("t", delay) if delay else rows
    return rows.groupBy(F.window("t", width).alias("w"), spelled("judge").alias("judge")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "true").alias("n_true"), F.count_if(F.col("verdict") == "parse_fail").alias("n_fail")).select(F.col("w.start").alias("start"), "judge", "n", "n_true", "n_fail")


def append_new(path: str, keys: list[str], buckets: int = 256):
    """A foreachBatch function that appends the rows whose key isn't stored yet, so replayed batches change nothing.

    The store is partitioned by a hash of the key (k_bucket), and a batch only reads the buckets that its own keys fall
    into, and their keys alone. Null parts of a key equal each other. Of rows with one key in a batch one stays.
    """

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn("k_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in rows.select("k_bucket").distinct().collect()]  # at most as many as there are buckets
        if touched and _there(batch, path):
            stored = batch.sparkSession.read.schema(rows.schema).parquet(path).where(F.col("k_bucket").isin(touched)).select("k_bucket", *keys)
            same = [F.col(f"new.{k}").eqNullSafe(F.col(f"old.{k}")) for k in ("k_bucket", *keys)]
            rows = rows.alias("new").join(stored.alias("old"), same, "left_anti")
        rows.write.mode("append").partitionBy("k_bucket").parquet(path)

    return write


def _there(frame: DataFrame, path: str) -> bool:
    context = frame.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)
