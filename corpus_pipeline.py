"""The corpus pipeline: quality classifier, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and its result is written as Parquet
and read again as the next one's documents. All but the last return the columns of ``documents``.

Defined results: rows of a null doc_id go through all stages and are dropped by none for a name they lack (their text may
be rejected, cleaned or found in the benchmark like others); a null text is an empty text to every stage and stays null in
those that keep it; rows of equal doc_id and text share one fate; of copies of different doc_id the smallest stays, of
equal doc_id all; more columns, whatever their names, are carried up to the packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import decontam, line_dedup, near_dedup, packing, quality_classifier
from leafmill.llm.common import Scratch, made_so_far, sweep

#: The stages run models and tokenizers that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, _read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, k=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, _read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, held=100_000)  # workers of the stages before still hold memory here


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = made_so_far()
        done = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(mark, keep=done)  # a stage's own tables, and the one before it, are of no more use
        if name != STAGES[0][0]:
            scratch.drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
