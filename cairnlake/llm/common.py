"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.session import shared_dir

#: A run of characters that are no ASCII white space, and a run of white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows and bytes that go to a Python worker at once, so that long texts can't fill its memory.
BATCH_ROWS, BATCH_BYTES = 1024, "16MB"
#: Characters of text that a Python worker works on together.
BLOCK_CHARS = 1 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        for folder in {os.path.dirname(p) for p in table.inputFiles()}:
            fs, path = pafs.FileSystem.from_uri(folder)
            fs.delete_dir(path)


def joined_by_weight(rows: DataFrame, table: DataFrame, key: str, weight: str, least: int = 10_000, most: int = 10_000) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and how many rows share it (dropped). The ``most`` heaviest
    keys of ``least`` rows or more are broadcast, so no task gets all rows of one; any other key has at most a share of
    1 / ``most`` of the rows. ``table`` is read twice: it should be written."""
    hot = F.broadcast(table.where(F.col(weight) >= least).orderBy(F.desc(weight), key).limit(most))
    light = rows.join(hot.select(key), key, "left_anti").join(table, key)
    return rows.join(hot, key).unionByName(light).drop(weight)


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small whatever the length of texts. The setting stays: it bounds memory and changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no fit may learn from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters together (or one row)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
