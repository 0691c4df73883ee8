"""Exact dedup (operator 10): Grace hash deduplication.

Texts are equal when identical after each run of ASCII white space became one space.

1. Each map task folds its own equal texts into one record (text, smallest id, number of rows), so a text that
   a third of all rows share leaves a task once, whatever their number.
2. Records are dealt by digest. Each reduce task fills an open-addressing table that compares whole texts. When
   the distinct texts outgrow the table's memory, the task deals table and rest to spill files in the shared
   folder by further bits of the digest, and treats each file alike: again a table, or again files.
3. Rows find their group by a join on the digest; the largest groups are broadcast, at most 10,000 of them.

Cases: a null text counts as empty; a null id is greater than any other and stays only if all ids of the group
are null; rows that share the smallest id are one document and share its flags (``drop_duplicates`` returns one
of them); an empty table gives an empty result. Very long texts are compared
whole, one against its bucket's table at a time. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.ipc as ipc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import SPACE, bounded_batches, fresh_path, joined_by_weight, written

#: Bytes of distinct text that a task's table holds before it spills, and files it then deals to.
TABLE_BYTES, FANOUT = 64 << 20, 16
RECORDS = pa.schema([("digest", pa.string()), ("body", pa.string()), ("least_id", pa.int64()), ("n", pa.int64())])
GROUPS = "digest string, keep_id long, group_size long"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class OpenTable:
    """Open addressing with linear probing; keys are whole texts."""

    def __init__(self) -> None:
        self.slots = [-1] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, digest: str, body: str, least_id: int | None, n: int) -> None:
        mask = len(self.slots) - 1
        at = int(digest[-15:], 16) & mask
        while (i := self.slots[at]) >= 0:
            row = self.rows[i]
            if row[0] == digest and row[1] == body:
                row[2], row[3] = _least(row[2], least_id), row[3] + n
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([digest, body, least_id, n])
        self.bytes += 4 * len(body) + 200
        if 3 * len(self.rows) > 2 * len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, row in enumerate(self.rows):
            at = int(row[0][-15:], 16) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterable[tuple | list], schema: pa.Schema, most: int = 1024, most_chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1]) if isinstance(row[1], str) else 0
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Spill:
    """Files of one level of one task, in the shared folder; a retry of the task has a folder of its own."""

    def __init__(self, root: str, fanout: int) -> None:
        self.fs, base = pafs.FileSystem.from_uri(root)
        self.folder = f"{base}/{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.held: list[list] = [[] for _ in range(fanout)]
        self.chars = [0] * fanout
        self.files: dict[int, tuple] = {}

    def add(self, k: int, row: tuple | list) -> None:
        self.held[k].append(row)
        self.chars[k] += len(row[1])
        if self.chars[k] > 1 << 20 or len(self.held[k]) >= 4096:
            self._flush(k)

    def _flush(self, k: int) -> None:
        if not self.held[k]:
            return
        if k not in self.files:
            sink = self.fs.open_output_stream(f"{self.folder}/{k}")
            self.files[k] = (sink, ipc.new_stream(sink, RECORDS))
        for batch in _batches(self.held[k], RECORDS):
            self.files[k][1].write_batch(batch)
        self.held[k], self.chars[k] = [], 0

    def close(self) -> list[int]:
        for k in range(len(self.held)):
            self._flush(k)
        for sink, writer in self.files.values():
            writer.close()
            sink.close()
        return sorted(self.files)

    def read(self, k: int) -> Iterator[tuple]:
        with self.fs.open_input_stream(f"{self.folder}/{k}") as source, ipc.open_stream(source) as reader:
            yield from _records(reader)
        self.fs.delete_file(f"{self.folder}/{k}")

    def remove(self) -> None:
        self.fs.delete_dir(self.folder)


def grace(rows: Iterator[tuple], root: str, table_bytes: int, fanout: int, level: int = 0) -> Iterator[list]:
    """Distinct records of ``rows``: by a table if it fits, else by spill files of fewer digests each."""
    table = OpenTable()
    for row in rows:
        table.add(*row)
        if table.bytes > table_bytes and level < 12 and len(table.rows) > 1:
            break
    else:
        yield from table.rows
        return
    spill = Spill(root, fanout)
    try:
        for part in (table.rows, rows):
            for row in part:
                spill.add(int(row[0][4 * level : 4 * level + 4], 16) % fanout, row)
        del table
        for k in spill.close():
            yield from grace(spill.read(k), root, table_bytes, fanout, level + 1)
    finally:
        spill.remove()


def _fold(table_bytes: int):
    """Map side: one record for each distinct text of a task, or of as much of it as the memory holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for digest, body, doc_id in _records(batches):
            table.add(digest, body, doc_id, 1)
            if table.bytes > table_bytes:
                yield from _batches(table.rows, RECORDS)
                table = OpenTable()
        yield from _batches(table.rows, RECORDS)

    return run


def _reduce(root: str, table_bytes: int, fanout: int):
    out = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = f"{root}/{task.partitionId()}-{task.taskAttemptId()}"
        found = grace(_records(batches), own, table_bytes, fanout)
        yield from _batches(((d, least, n) for d, _, least, n in found), out)

    return run


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """A row for each distinct text: digest (sha256 of the normalised text), keep_id, group_size."""
    bounded_batches(docs.sparkSession)
    body = normalised(text_col)
    keyed = docs.select(F.sha2(body.cast("binary"), 256).alias("digest"), body.alias("body"), F.col(id_col).cast("long").alias("doc_id"))
    folded = keyed.mapInArrow(_fold(table_bytes // 2), "digest string, body string, least_id long, n long")
    return folded.repartition("digest").mapInArrow(_reduce(fresh_path(docs.sparkSession, "grace"), table_bytes, fanout), GROUPS)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = 10_000, **limits: int) -> DataFrame:
    """A row for each row of ``docs``: its id, keep_id, group_size, kept, text_sha256."""
    groups = written(duplicate_groups(docs, id_col, text_col, **limits), "groups")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.sha2(normalised(text_col).cast("binary"), 256).alias("text_sha256"))
    table = groups.select(F.col("digest").alias("text_sha256"), "keep_id", "group_size", F.col("group_size").alias("_weight"))
    found = joined_by_weight(rows, table, "text_sha256", "_weight", hot_rows)
    return found.select(id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. The join's keys hold the id, so no text is a hot key."""
    groups = duplicate_groups(docs, id_col, text_col, **limits).select(F.col("digest").alias("_digest"), F.coalesce(F.col("keep_id"), F.lit(-(1 << 63))).alias("_keep"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(normalised(text_col).cast("binary"), 256).alias("_digest"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_keep"))
    one = Window.partitionBy("_digest", "_keep").orderBy("_keep")
    return rows.join(groups, ["_digest", "_keep"], "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1").select("row.*")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: every row of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
