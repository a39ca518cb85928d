"""The corpus pipeline: quality rules, near-duplicates, secret scan, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findmill.llm import fertility, near_copies, secret_worklist, spfhp
from findmill.llm.common import read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the fertility bands reject go."""
    path = public_tokenizers.path
    measured = fertility.measure(docs, path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return measured.where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (5-word shingles, Jaccard 0.8 or more): that with the smallest id."""
    return near_copies.without_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; ``n_chars`` follows the text."""
    clean = secret_worklist.redact(docs)
    n_chars = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return spfhp.pack(spfhp.stored_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("packing", packing),
]
#: SQL can express neither the tokenisers nor the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
