"""Queries over the driver's tables for the text operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwell.llm import boilerplate, encoding_repair, leakage, markup, packing, repeated_lines, residue, truncation
from loomwell.session import materialise, read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(read_table(spark, folder, "posts"))


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_report(read_table(spark, folder, "posts"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.boilerplate_lines(read_table(spark, folder, "posts"))


def p2_article(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.split_pages(read_table(spark, folder, "posts")).select("seq", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return markup.residue(read_table(spark, folder, "posts"))


def p4_text(spark: SparkSession, folder: str) -> DataFrame:
    return markup.clean_text(read_table(spark, folder, "posts"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_records(read_table(spark, folder, "posts")).select("seq")


def p6_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return residue.residue_records(read_table(spark, folder, "posts"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(read_table(spark, folder, "posts"))


def p7_clean(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(read_table(spark, folder, "posts"))


def p8_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(packing.token_counts(read_table(spark, folder, "documents")), read_table(spark, folder, "pack_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packing_report(p8_pack(spark, folder), read_table(spark, folder, "pack_targets"))


def p8_placed(spark: SparkSession, folder: str) -> DataFrame:
    """Packing by characters, which SQL can count: what became of each document, and how full the fullest container is."""
    sizes = read_table(spark, folder, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("tokens"))
    packed = materialise(packing.pack_documents(sizes, read_table(spark, folder, "pack_targets")), "placed")
    per = packed.groupBy("target_id", "container_id").agg(F.sum("tokens").alias("n"))
    over = per.join(F.broadcast(read_table(spark, folder, "pack_targets").select("target_id", "capacity_tokens")), "target_id").where(F.col("n") > F.col("capacity_tokens"))
    overfull = over.groupBy("target_id").agg(F.count("*").alias("overfull"))
    docs = packed.groupBy("target_id", "doc_id").agg(F.count("*").alias("parts"), F.countDistinct("container_id").alias("containers"), F.sum("tokens").alias("chars"))
    return docs.join(F.broadcast(overfull), "target_id", "left").withColumn("overfull", F.coalesce("overfull", F.lit(0)))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leak_report(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.damaged_documents(read_table(spark, folder, "documents"))


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.repair_documents(read_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_article, p4_found, p4_text, p6_found, p6_kinds, p7_found, p7_clean, p8_pack, p8_report, p8_placed, p9_found, p9_report, p10_found, p10_restored)}
ORACLES: dict[str, str] = {
    "p8_placed": """select target_id, doc_id, greatest(1, cast(ceil(n / capacity_tokens) as bigint)) as parts, greatest(1, cast(ceil(n / capacity_tokens) as bigint)) as containers, n as chars, 0 as overfull
    from (select doc_id, cast(coalesce(n_chars, 0) as bigint) as n from documents) cross join pack_targets where capacity_tokens > 0"""
}
