"""The corpus pipeline: quality classifier, quality rules, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of ``documents``. Rows are judged as the
operators' docstrings say for null, empty, repeated and very long rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldspark.llm.decontam import drop_contaminated
from foldspark.llm.minhash import drop_near_duplicates
from foldspark.llm.packing import pack
from foldspark.llm.quality import keep_by_quality, train
from foldspark.llm.rules import keep_by_rules
from foldspark.llm.shared import Scratch, passing


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.7."""
    return keep_by_quality(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep."""
    return keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares at least 80 % of five-word shingles."""
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences."""
    import public_tokenizers

    return pack(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the compression bands and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again, and what a stage left in the shared folder goes once they are written."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
