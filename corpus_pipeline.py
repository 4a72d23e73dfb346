"""A corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept, written as Parquet and read again, and but for the last returns documents
with all their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.queries import crc_mod, packed, table
from linkloom.llm.shared import Workspace

#: The least score of a language that counts as told.
LANGUAGE_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.3."""
    from linkloom.llm.quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"), teaches=crc_mod("doc_id", 5) != 0)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    from linkloom.llm.langid import keep_known

    return keep_known(docs, teaches=crc_mod("doc_id", 4) != 2, least=LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 on five-word shingles connect: the one with the least id.

    Rows are told apart by id and text, so of repeated ids with different texts each is judged by its own; a null id
    comes after all others; documents without words stay.
    """
    from linkloom.llm.jaccard_join import keep_one

    return keep_one(docs, size=5, p=80, q=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, and without documents that are mostly such passages."""
    from linkloom.llm.decontaminate import remove_leaks

    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' tokens in sequences of 4096."""
    return packed(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Classifiers and tokenizers have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Workspace(spark, "pipeline") as ws:
        for name, stage in STAGES:
            docs = ws.keep(stage(spark, docs, sf_dir), name)
    return docs
