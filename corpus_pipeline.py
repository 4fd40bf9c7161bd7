"""From raw documents to token ids: quality, line dedup, near dedup, decontamination, pieces.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
All but the last return the columns of documents. Decisions are made and applied row
by row, never by id: ids may repeat or be null, and rows may repeat (near dedup then
keeps one of them).

Defined cases: null and empty texts have no words and are rejected by the first
stage; very long texts are handled as wholes by every stage; empty tables give empty
results; extra columns of documents pass through all stages but the last, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, line_dedup, near_dedup, piece_codec, quality_knn
from codeloom.llm.common import dropped, table, written
from codeloom.llm.queries import PIECES


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_knn.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line go, and documents of which nothing is left; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.80 and more) the first row stays."""
    return near_dedup.dedup(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document and the hash of the text they decode to."""
    return piece_codec.round_trip(docs, piece_codec.read_model(PIECES))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding and decoding", piece_stage),
]

#: The classifier, the edit join and MinHash are not expressible in SQL; tests/llm/test_pipeline.py compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = last = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, table(spark, sf_dir, "documents") if docs is None else docs, sf_dir), name.replace(" ", "-"))
        dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
