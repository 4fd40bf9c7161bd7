"""Driver queries of the operators, each over its whole intended table, and their SQL."""

from __future__ import annotations

import os
import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, html_text, license_scan, line_dedup, near_dedup, pii, piece_codec, quality_knn, quality_rules, resample, secret_scan, sharding
from .common import table

PIECES = os.environ.get("CODELOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
SHARDS = [f"shard-{k:02d}" for k in range(32)]
SLOTS = 4099
PII_KEY = os.environ.get("CODELOOM_PII_KEY") or secrets.token_hex(16)  # without a setting a fresh key for each process: no pseudonym can be undone


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text again."""
    docs = table(spark, sf_dir, "documents")
    model = piece_codec.read_model(PIECES)
    return piece_codec.round_trip(docs, model)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS, SLOTS)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), key=PII_KEY)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of ids divisible by 7 are moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table names one place of origin, taken as the owner; each document stands for a repository."""
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_sentencepiece, op3_sharding, op4_license_scan, op5_near_dedup, op6_line_dedup, op7_decontaminate, op8_html_text, op9_pii, op10_quality_knn, op11_hard_negatives, op12_resample, op13_secret_scan)}


def _op3_sql() -> str:
    owners = ", ".join(str(k) for k in sharding.lookup_table(SHARDS, SLOTS))
    return f"""
        WITH slotted AS (
            SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents
        ), owners AS (SELECT [{owners}] AS owner)
        SELECT doc_id, slot, 'shard-' || lpad(CAST(owner[slot + 1] AS VARCHAR), 2, '0') AS shard FROM slotted, owners"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": _op3_sql(), "op4_license_scan": license_scan.oracle(), "op7_decontaminate": decontaminate.oracle(), "op11_hard_negatives": hard_negatives.oracle(), "op12_resample": resample.oracle(), "op13_secret_scan": secret_scan.oracle()}
