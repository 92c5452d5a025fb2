"""The training-data pipeline: quality, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.
Stages work on all rows their predecessor kept. All of them take null and repeated ids, null, empty and very long texts, repeated
rows, empty tables and extra columns of any name; what each does with them is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sequora.llm import bpe, decontaminate, exact_dedup, jaccard_join, quality
from sequora.llm.store import cut, read_table

#: SQL can't express the classifier or the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. Null and empty texts have the share of good labels as their score; without labels all stay."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), 0.3)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id. Null texts equal the empty text, a null id is the smallest; of rows equal in both, one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the sets of their five-word shingles (Jaccard 0.8), the one with the smallest id (a null id is the smallest). Texts without words stay."""
    return jaccard_join.drop_near_duplicates(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, asked literally or with other values. Texts without words stay; rows that share an id go together."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and the digests of the ids and of the bytes they decode to: a row for each row. Null texts have no token."""
    return bpe.digest_table(docs)


STAGES = [("quality", keep_good), ("exact", drop_exact), ("near", drop_near), ("leaks", drop_leaks), ("tokens", tokenise)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
