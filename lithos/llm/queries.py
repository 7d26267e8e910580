"""Thin queries over the bundled tables, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, line_dedup, mixing, pii, quality, secret_scan, simhash, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    hard = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat_format.digests(chat_format.format_conversations(chat_format.events_from_turns(turns)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(_table(spark, sf_dir, "documents")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"), shingle=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(_table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), least=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("key")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find_windows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the same number: bad if toxic or of quality 0."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0).alias("bad"))
    return url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), labels).drop("score")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars"), extra=True)
    return docs.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_secret_scan, op3_simhash, op4_pii, op5_warc, op6_quality_rules, op7_mixing, op8_decontamination, op9_url_filter, op10_line_dedup)
}
