"""A corpus pipeline: language ID, exact dedup, near dedup, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each result is written as Parquet to the shared
folder and read back as the next stage's documents, so a lost executor never costs more than one stage.

Cases: a null text, or one without a letter, is in no learned language and goes in the first stage, whatever its ``lang``; a
null ``lang`` is only not learned from; where no language can be learned, all documents stay. Null ids and sources are
kept as they are. Repeated rows are exact copies: one stays. Of equal scores of languages the first by name
counts, of copies the row of the least id stays, and places of the mix that tie go by id. Very long texts are read whole in every stage. An empty table
gives an empty result. All stages but the last return the columns of documents, extra ones of any name included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.llm import bpe, exact_dedup, langid, mixing, neardup
from cairnlake.llm.common import written

#: No SQL: learned language models and byte-pair merges have none. Tests hold exact and near dedup, the mix's totals and the token
#: ids against brute force and the tokenizer's own library, and language ID against held-out rows.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; rejected ones go."""
    return langid.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8 or more): the one with the least id.
    Operator 4's Golay keys propose pairs, an exact join proposes what they miss, and whole texts decide."""
    return neardup.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks (0 to 3 times), by training position."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that the mix took, and the digests of ids and of the decoded text."""
    return bpe.round_trip(docs, *bpe.default_vocabulary())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    # The last table of documents is read by what is returned; the driver's folder holds the others until it is cleared.
    return STAGES[-1][1](spark, docs, sf_dir)
