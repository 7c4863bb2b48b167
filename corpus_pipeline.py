"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's documents. All but
the last return the columns of ``documents``. The run's intermediate tables lie in the shared checkpoint folder.

Null and empty texts have no language and leave in the first stage; languages that are null teach nothing. A null id is an id of its own kind: its
lines come first in the order, near-dedup and packing treat its row by the text, and substring dedup leaves it as it is. Empty tables pass through
all stages; extra columns stay up to packing, whatever their names. What a stage does with repeated rows is stated in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegrove.llm import bag_minhash, language_codes, line_dedup, passage_chains, queries
from codegrove.staging import Stage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known and beyond doubt; learned from the documents' own ``lang``."""
    return language_codes.accepted(docs, language_codes.train(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line, exactly or nearly; a document of which no line stays goes."""
    done = line_dedup.dedup_lines(docs)
    lines, kept = done.columns[-2:]
    return done.filter((F.col(kept) > 0) | (F.col(lines) == 0)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return bag_minhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat an earlier passage; a document of which no word stays goes."""
    return passage_chains.remove_passages(docs).filter(F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens."""
    return queries.packed_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the learned and the fuzzy stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    stage = Stage(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage.table(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
