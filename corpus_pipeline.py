"""From raw documents to packed training windows, in five stages over whole tables.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last keep the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, queries
from lodestrata.llm.decontaminate import drop_contaminated
from lodestrata.llm.packing import pack
from lodestrata.llm.quality import drop_low_quality
from lodestrata.llm.repeats import remove_repeats
from lodestrata.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; repeated rows are judged alike, null texts by their site and all-zero features."""
    return drop_low_quality(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 of their five-word shingles), that of the smallest doc_id.

    Null and empty texts are copies of each other. Texts decide, not ids: of several texts under one
    doc_id each is judged by itself, a row without a doc_id goes if another of its group has one, and of
    repeated rows one stays. An empty table stays empty.
    """
    return drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 100 bytes that occur earlier; documents of which nothing is left go, null and empty ones too."""
    return remove_repeats(docs, with_text=True).where("length(text) > 0")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds no benchmark item, with or without a doc_id; null and empty texts stay, repeated rows stay repeated."""
    return drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens; an empty table gives no rows."""
    return pack(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("suffix-array dedup", repeats), ("benchmark decontamination", decontamination), ("packing", packing)]

#: The classifier, the suffix sort and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir).select(*docs.columns), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
