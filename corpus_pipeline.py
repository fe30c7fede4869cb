"""Corpus pipeline: documents without the toxic ones, one of each group of near
copies, mixed to the target weights of their sources, packed into sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadence.llm.common import saved
from cadence.llm.jaccard_join import one_of_each
from cadence.llm.mixing import mix
from cadence.llm.packing import pack
from cadence.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (labels of the training rows of ``labels``).
    Null and empty texts, and repeated rows, stay; all columns are carried along."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; texts
    without words stay unless repeated, rows without doc_id all stay, and another text
    of an id that goes stays. All columns are carried along."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, a null source being one of its own;
    texts without words weigh nothing. All columns are carried along."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences; a null or empty text is one
    piece, a long one several, a repeated row one more. An empty table gives no rows here
    and in the stages before."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the classifier nor the draws nor the tokenizer; tests check each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
