"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; it is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents.

Nulls: a null text is judged by the quality classifier like an empty one, has no words and so no near copy and no leak, and has size 0 in the mix; a null id or source
is a value of its own. Empty texts go the same way; very long ones are processed whole. Repeated rows are copies, of which one stays if it has words. Ties
go to the smallest id, then to the text that hashes least. Extra columns are carried along whatever their names; in the last stage, one named like a column
of the result gets doc_ in front. Empty tables give no rows.
"""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from ledgerloom.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the smallest id. Documents without words all stay."""
    return ngram_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words with a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix of sources takes them."""
    return mixing.mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its slot there; the columns of documents follow."""
    return sharding.shard_rows(docs, payload=[c for c in docs.columns if c != "doc_id"])


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("sharding", sharding_stage),
]

#: None: a trained classifier and seeded sampling have no SQL form. tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What they return is kept below the folder in spark.checkpoint.dir."""
    folder = posixpath.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        path = posixpath.join(folder, str(number))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
