"""Exact and near duplicates (DD1-DD10)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import evidence_key
from cairnlake.operators.text_quality import simhash_tokens
from cairnlake.session import bounded_batches

#: Tokens that both sides of a near-duplicate pair need; differing bits of a pair.
MIN_TOKENS, NEAR_BITS = 200, 3


def first_by_hash(docs: DataFrame, scope: list[str], text: str, order: list[str]) -> DataFrame:
    """DD1: adds content_hash, is_first and first_id-like ``copies`` within a scope.

    The least row of a hash comes from a partial aggregate, so a text that very many rows share is no single group."""
    keyed = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    least = keyed.groupBy(*scope, "content_hash").agg(F.min(F.struct(*order)).alias("_least"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(least, [*scope, "content_hash"]).withColumn("is_first", F.struct(*order) == F.col("_least")).drop("_least")


def simhash64(tokens: list[str]) -> int:
    """DD2: polynomial hash of base 131 modulo 2**64 for each token; bits by majority of votes (a tie is 0)."""
    if not tokens:
        return 0
    size = max(map(len, tokens))
    codes = np.zeros((len(tokens), size), np.uint64)
    for i, t in enumerate(tokens):
        codes[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    length = np.fromiter(map(len, tokens), np.int64, len(tokens))
    h = np.zeros(len(tokens), np.uint64)
    for k in range(size):
        h = np.where(k < length, h * np.uint64(131) + codes[:, k], h)
    votes = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(tokens), bitorder="little").view("<i8")[0])


def with_simhash(docs: DataFrame, id_col: str, text: str, scope: list[str]) -> DataFrame:
    """For each row: the id, scope, number of tokens and ``simhash`` (signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(batch.num_columns - 1).to_pylist()
            found = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*found, pa.array([simhash64(t) for t in tokens], pa.int64())], names=[*batch.schema.names[:-1], "simhash"])

    rows = docs.select(id_col, *scope, simhash_tokens(text).alias("_tokens")).withColumn("n_tokens", F.size("_tokens")).select(id_col, *scope, "n_tokens", "_tokens")
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    schema = StructType([*(docs.schema[c] for c in (id_col, *scope)), StructField("n_tokens", IntegerType()), StructField("simhash", LongType())])
    return rows.mapInArrow(run, schema)


def hamming(a: Column, b: Column) -> Column:
    """DD3: differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def near_pairs(prints: DataFrame, id_col: str, scope: list[str], bits: int = NEAR_BITS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """DD4, JN12: pairs of distinct fingerprints of a scope at few differing bits, each with its least id and rows.

    Equal fingerprints are one row each, so copies never multiply. The 64 bits fall into twice as many blocks as bits may
    differ; a pair has half of them equal, so it meets on a key of half of the blocks: 32 bits for three differing ones."""
    distinct = prints.where(F.col("n_tokens") >= min_tokens).groupBy(*scope, "simhash").agg(F.min(id_col).alias("id"), F.count(F.lit(1)).alias("rows"))
    n = max(1, 2 * bits)
    starts = [k * 64 // n for k in range(n + 1)]
    block = [F.shiftrightunsigned("simhash", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(starts[:-1], starts[1:], strict=True)] if n > 1 else [F.col("simhash")]
    keys = F.array(*(F.xxhash64(F.lit(i), *(block[k] for k in some)) for i, some in enumerate(combinations(range(n), n - bits if bits else 1))))
    keyed = distinct.withColumn("key", F.explode(keys))
    other = keyed.select(*scope, "key", F.col("simhash").alias("simhash_b"), F.col("id").alias("id_b"))
    found = keyed.join(other, [*scope, "key"]).where(F.col("simhash") < F.col("simhash_b"))
    found = found.withColumn("distance", hamming(F.col("simhash"), F.col("simhash_b"))).where(F.col("distance") <= bits)
    return found.select(*scope, F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b"), "distance").distinct()


def distinct_passages(ranked: DataFrame, keys: list[str], order: list[Column], text: str = "text") -> DataFrame:
    """DD5: the first row by rank of each passage identity, of each group in ``keys``; empty passages go."""
    keyed = ranked.withColumn("evidence_id", evidence_key(text)).where("evidence_id <> ''")
    return keyed.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "evidence_id").orderBy(*order))).where("_nth = 1").drop("_nth")


def reuse_embeddings(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """DD6: distinct keys of ``wanted`` with ``reused``: whether an embedding of the same content and model is held."""
    return wanted.select(*keys).distinct().join(held.select(*keys).distinct().withColumn("reused", F.lit(True)), keys, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def sample_by_md5(docs: DataFrame, id_col: str, n: int) -> DataFrame:
    """DD10: the n rows that come first by md5 of the id (a sampling operator: n is its feature)."""
    return docs.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n)
