"""A training-data pipeline over documents: each stage is written as Parquet and read back as the next one's input.

Quality classifier (rejected documents go), line dedup, near-dedup (one document of each group
stays), mixing sources to target weights (documents repeat as often as the mix takes them), best-fit packing.
Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.common import documents, stage_table
from lumenrank.llm.line_dedup import keep_first_lines
from lumenrank.llm.mixing import take_mix
from lumenrank.llm.near_dup import keep_one_of_each
from lumenrank.llm.packing import pack_documents
from lumenrank.llm.quality_crf import keep_good
from lumenrank.llm.tokens import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, learned from the labels table, does not reject."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; n_chars follows the text."""
    kept = keep_first_lines(docs, min_chars=10)
    return kept.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group."""
    return keep_one_of_each(docs, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return take_mix(docs, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and their places."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("quality_crf", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", packing),
]

#: A trained classifier decides the first stage, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
