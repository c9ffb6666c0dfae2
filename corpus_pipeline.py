"""A corpus pipeline: documents in, packed training sequences out.

Each stage is written as Parquet and read again as the next one's documents; the one before is deleted then. Stages keep the
columns of ``documents``, of whatever name; the last gives the pieces and their places in sequences.

Edge cases: null texts, and texts without a letter, go in the first stage; null ids, rows that share ids and very long texts are
documents like others, each judged by its own text; of rows with equal id and equal text one stays (the first in the order
of their other columns), and of a group of near duplicates that of the smallest id, then text hash; an empty table gives an
empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import Scratch
from stratalog.llm.op01_packing import pack
from stratalog.llm.op02_language_id import keep_identified
from stratalog.llm.op03_decontamination import drop_contaminated
from stratalog.llm.op04_pii import mask
from stratalog.llm.op06_jaccard_join import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    masked = mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 ids."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: The stages' models and tokenizer can't be put as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
