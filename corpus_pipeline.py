"""From raw documents to packed training sequences, in four stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import decontam, jaccard, packing, toxicity
from folioflow.llm.common import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold; it learns from the labelled rows among ``docs``.

    Null and empty texts have the score of no words and stay; repeated rows and ties share their fate; rows with a null id are scored
    like others; texts are read whole; columns of any names stay as they are. No rows, or no labels: no row goes.
    """
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one with the smallest doc_id. Texts are near if their fingerprints lie within 3 bits, or their five-word shingles are alike by 0.8.

    Null and empty texts are one group. Of equal ids in a group one row stays; different texts under one id are different
    rows. Rows without an id stay. Columns of any names stay as they are. No rows: no rows.
    """
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark's words. Null and empty texts stay; repeated rows share their fate; columns of any names stay as they are; no rows, or no benchmark: no row goes."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place. Null and empty texts are one piece, the end token; repeated rows are packed each; long texts are cut into whole sequences; no rows: no rows."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("best_fit_packing", pack)]

#: No stage but the decontamination can be put in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name)
        if last is not None:
            ws.drop(last)
        last = docs
    return docs
