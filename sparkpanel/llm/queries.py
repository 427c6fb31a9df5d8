"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import spelled, table
from . import consensus, leakage, mixture, overlap, residue, responses


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "items")
    rows = items.select(spelled("id").alias("id"), F.col("is_corrupted").alias("class"), spelled("source_split").alias("split"), "statement")
    words = items.select(F.explode(F.array("original_attribute", "shown_attribute")).alias("a")).where("a is not null")
    terms = words.select(F.explode(F.split(F.lower("a"), r"[^\p{L}\p{N}]+")).alias("term")).where("term <> ''").distinct()
    return overlap.item_pairs(*overlap.class_pairs(rows, terms))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder)


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, and dev or test items in any pair, per split and source_dataset."""
    items = table(spark, folder, "items").select(spelled("id").alias("id"), spelled("source_split").alias("split"), spelled("source_dataset").alias("source_dataset")).where("split in ('dev', 'test')").distinct()
    pairs = _pairs(spark, folder)
    sides = pairs.select(F.col("id_a").alias("id")).unionAll(pairs.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return sides.join(items, "id").groupBy("split", "source_dataset").agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_items"))


def _defects(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "rf_cache").select("seq", spelled("item_id").alias("item"), "raw_response", "completion_tokens")
    items = table(spark, folder, "items").select(spelled("id").alias("item"), "statement", "seq").where("item is not null and statement is not null")
    statements = items.groupBy("item").agg(F.max_by("statement", "seq").alias("statement"))
    return responses.defects(log, statements, "seq", "item", "raw_response", "completion_tokens")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _defects(spark, folder).select("seq", "defect")


def p5_by_judge(spark: SparkSession, folder: str) -> DataFrame:
    judges = table(spark, folder, "rf_cache").select("seq", spelled("judge").alias("judge"))
    return _defects(spark, folder).join(judges, "seq").groupBy("judge", "defect").agg(F.count(F.lit(1)).alias("n"))


def _told(spark: SparkSession, folder: str, sentinel: bool = False) -> DataFrame:
    """Reference-free answers, one of each judge and item; without the items that are marked as controls, or those alone."""
    log = table(spark, folder, "rf_cache").select(spelled("item_id").alias("item"), spelled("judge").alias("judge"), F.coalesce(spelled("mode"), F.lit("reference_free")).alias("mode"), F.coalesce("attempt", F.lit(1)).alias("attempt"), "seq", spelled("verdict").alias("answer"))
    told = consensus.labels(log.where("mode = 'reference_free'"), F.struct("attempt", "seq"))
    # Joined after the aggregation, so the sentinel has one row a judge here.
    controls = table(spark, folder, "items").where("kind = 'control'").select(spelled("id").alias("item")).where("item is not null").distinct()
    return told.join(controls, "item", "left_semi" if sentinel else "left_anti")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = consensus.fit(_told(spark, folder))
    return spark.createDataFrame([(j,) for j in consensus.uninformative(model)], "judge string")


def p6_reliability(spark: SparkSession, folder: str) -> DataFrame:
    return consensus.reliability(consensus.fit(_told(spark, folder))[0], spark)


def p6_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """Every item's label, also the control's, which has no part in the model."""
    model, items = consensus.fit(_told(spark, folder))
    controls = consensus.patterns(_told(spark, folder, sentinel=True), model.judges)
    return consensus.consensus(model, items.unionByName(controls))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "heldout_passages"))


def p7_by_passage(spark: SparkSession, folder: str) -> DataFrame:
    passages = table(spark, folder, "heldout_passages").select("passage_id", "kind", spelled("source_split").alias("source_split"))
    return p7_found(spark, folder).join(passages, "passage_id").groupBy("source_split", "kind").agg(F.countDistinct("passage_id").alias("n_passages"), F.count(F.lit(1)).alias("n_leaks"))


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mixed(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[1]


def p8_copies(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder)[0].where("copies > 0")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue(table(spark, folder, "documents").select("doc_id", "source", "text")).select("doc_id")


def p9_messages(spark: SparkSession, folder: str) -> DataFrame:
    return residue.messages(table(spark, folder, "documents").select("doc_id", "source", "text"))


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p5_found, p5_by_judge, p6_found, p6_reliability, p6_consensus, p7_found, p7_by_passage, p8_shares, p8_copies, p9_found, p9_messages)}
SQL: dict[str, str] = {}
