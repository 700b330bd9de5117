"""The corpus pipeline: toxicity, near duplicates, mixing, packing.

Each stage works on all rows that the one before it kept. A stage takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes it as Parquet to the shared folder, and the next one reads it.

All stages take texts of any length whole, rows with nulls in any column, tables without rows (which
stay so) and further columns under any name, which come back as they were from all but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quorate.llm.common import settle, table
from quorate.llm.jaccard import one_of_each_group
from quorate.llm.mixing import mixed_rows
from quorate.llm.packing import pack
from quorate.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7. Null and empty texts have the score of the bias
    alone; equal texts stay or go together, and rows that repeat stay as often as they are there."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8, the one with the least id. Null
    and empty texts link with nothing, and so do rows without doc_id, which all stay; of rows of one
    doc_id the one with the least text stays, a null one only where there is no other."""
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it, three times at most. A null source is
    one, the last. Texts without words weigh nothing and are taken as others are. Ties go by doc_id."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens. Null and empty texts are the
    id 0 alone; rows that repeat are packed each; other columns are left out."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learning and packing have no SQL; tests compare ``run`` with the stages' own brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
