"""The corpus pipeline: quality rules, near-dedup, substring dedup, secret scan, packing.

Each stage takes ``(spark, docs, sf_dir)``, works on every row its predecessor
kept, and returns documents with the columns it was given; the last returns one
row for each piece of a packed sequence, with its token ids: the corpus as it is
trained on.  Stages that change texts set ``n_chars`` (where there is such a
column) to the new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulewright.llm import minhash_dedup, packing, quality_rules, secret_scan, substring_dedup
from rulewright.llm.common import Scratch, scratch_path


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers in their language and source."""
    return quality_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate component, by shingles of five words."""
    return minhash_dedup.keep_documents(docs, width=5)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start in a document with a smaller id; a text that loses all its words stays as an empty one."""
    return _measured(substring_dedup.remove_duplicates(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a placeholder."""
    return _measured(secret_scan.redact_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, placed in sequences."""
    return packing.pack_documents(docs, keep_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("secret scan", secrets),
    ("packing", pack),
]

#: Tokenisers and packing have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two of them the rows are a Parquet table in the shared folder.

    Once a stage's table is written, its intermediate tables and the table that it
    read are removed, so at most two stages are on disk at once.  The last stage's
    stay until the result is written; ``rulewright.llm.common.sweep`` removes them then.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k + 1 < len(STAGES):
                path = scratch_path(spark, f"stage-{k}")
                docs.write.parquet(path)
                scratch.sweep(keep=path)
                docs = spark.read.parquet(path)
    return docs
