"""Hard-negative mining (operator 11): slot-decomposed selection.

An anchor's positives are its best rows of its own label. For each positive the negatives are the best rows of other labels
whose score lies in a window under the positive's; the windows of one anchor overlap.

1. The upper limits of an anchor's windows, descending, cut the scores into disjoint slots: down from each limit to the next one,
   the last slot down to the least lower limit.
2. All rows are scored against the anchors in blocks. A row falls into one slot of an anchor at most; tasks keep the first k
   of each slot (``Best``), so k rows for each slot and task are shuffled, however many rows share a label or a score.
3. The slots that one window's limit opens are a suffix of the anchor's slots. As slots lie in order of score, an anchor's kept rows,
   merged in descending order, begin from there with the first k rows under that limit; those under the window's lower limit end the
   list.

Scores are integer inner products, exact: floating-point products are used only where no sum can reach 2**53.

Cases: rows whose label or id is null, or whose vector is null, empty, of another length than the first one's or holds null or
non-finite components take no part; equal scores go by id; rows that repeat an id are rows of their own, but no row meets an
anchor of its own id, and of an anchor's rows that with the least label and vector counts; an anchor with fewer positives or
negatives gets those; positives of a negative score have an empty window; an empty table gives an empty result; a score beyond 64
bits is an error; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import forget, fresh_path, written
from cairnlake.llm.vectors import int64, integers, kept_vectors

#: Components are floor(SCALE * x); positives of an anchor, negatives of a positive; a window's limits in hundredths of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
#: Anchors that go to all tasks at once, in the mean; anchors that are scored together.
BLOCK, STRIPE = 4096, 256
NEVER = np.iinfo(np.int64).min


class Best:
    """The first k (score, id) of each of n rows: greater scores first, ties by lesser id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.rows, self.scores, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(n, NEVER)  # a lower score can't enter a row

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        rows, scores, ids = (np.concatenate(x) for x in ((self.rows, rows), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        order = order[nth < self.k]
        full = nth == self.k - 1
        self.rows, self.scores, self.ids = rows[nth < self.k], scores[order], ids[order]
        self.least[rows[full]] = scores[order][full[nth < self.k]]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b, exact."""
    if a.dtype == b.dtype == np.int64 and len(a) and len(b) and a.shape[1] * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return int64(a.astype(object) @ b.astype(object).T)


def _blocks(anchors: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    """Anchors by hash of their ids, about ``BLOCK`` at a time."""
    n = max(1, -(-anchors.count() // BLOCK))
    for b in range(n):
        own = anchors.where(F.pmod(F.xxhash64("anchor_id"), F.lit(n)) == b).select(*columns).toArrow()
        if len(own):
            yield own


def _scan(rows: DataFrame, anchors: DataFrame, columns: list[str], run: Callable, schema: str, path: str) -> DataFrame:
    """What ``run`` gives for each task's batches of rows (vec_id, label, embedding) and each block of anchors. Each block's
    result is written on its own."""
    spark = rows.sparkSession
    empty = True
    for block in _blocks(anchors, columns):
        handle = spark.sparkContext.broadcast(block)
        found = rows.select("vec_id", "label", "embedding").mapInArrow(lambda batches, handle=handle: run(batches, handle.value), schema)
        found.write.mode("append").parquet(path)
        handle.unpersist()
        empty = False
    return spark.createDataFrame([], schema) if empty else spark.read.schema(schema).parquet(path)


def _columns(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors of a block of anchors."""
    return block.column("anchor_id").to_numpy(), block.column("label").to_numpy(), integers(block.column("embedding").combine_chunks(), SCALE)


def _nearest(batches: Iterator[pa.RecordBatch], block: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The first k other rows of each anchor's label in a task: anchor_id, vec_id, score."""
    ids, labels, vectors = _columns(block)
    best = Best(len(ids), k)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, label, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), integers(batch.column(2), SCALE)
        for lo in range(0, len(ids), STRIPE):
            hi = lo + STRIPE
            s = _scores(vectors[lo:hi], x)
            rows, cols = np.nonzero((s >= best.least[lo:hi, None]) & (labels[lo:hi, None] == label) & (ids[lo:hi, None] != own))
            best.offer(rows + lo, s[rows, cols].astype(np.int64), own[cols])
    yield pa.RecordBatch.from_arrays([pa.array(ids[best.rows]), pa.array(best.ids), pa.array(best.scores)], names=["anchor_id", "vec_id", "score"])


def _slots(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower ends of each anchor's slots, both within; slots that it has not are empty."""
    limits = block.column("limits").to_pylist()
    width = max(map(len, limits))
    upper, lower = np.full((len(limits), width), NEVER), np.full((len(limits), width), 0)
    for i, (tops, least) in enumerate(zip(limits, block.column("least").to_pylist(), strict=True)):
        upper[i, : len(tops)] = tops
        lower[i, : len(tops)] = [*(t + 1 for t in tops[1:]), least]
    return upper, lower


def _in_slots(batches: Iterator[pa.RecordBatch], block: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """The first k rows of other labels in each slot of each anchor, in a task: anchor_id, slot, vec_id, score."""
    ids, labels, vectors = _columns(block)
    upper, lower = _slots(block)
    width = upper.shape[1]
    best = Best(len(ids) * width, k)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, label, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), integers(batch.column(2), SCALE)
        for lo in range(0, len(ids), STRIPE):
            hi = lo + STRIPE
            s = _scores(vectors[lo:hi], x)
            s[(labels[lo:hi, None] == label) | (ids[lo:hi, None] == own)] = NEVER
            found = []
            for j in range(width):
                at_least = np.maximum(lower[lo:hi, j], best.least[lo * width + j : hi * width : width][: len(s)])
                rows, cols = np.nonzero((s <= upper[lo:hi, j, None]) & (s >= at_least[:, None]))
                found.append(((rows + lo) * width + j, s[rows, cols].astype(np.int64), own[cols]))
            best.offer(*(np.concatenate(x) for x in zip(*found, strict=True)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[best.rows // width]), pa.array((best.rows % width).astype(np.int32)), pa.array(best.ids), pa.array(best.scores)], names=["anchor_id", "slot", "vec_id", "score"])


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows and anchors: (vec_id, label, embedding), as ``kept_vectors`` gives them, labels and ids without nulls."""
    path = fresh_path(rows.sparkSession, "scores")
    one = F.min(F.struct("label", "embedding")).alias("a")
    asked = written(anchors.groupBy(F.col("vec_id").alias("anchor_id")).agg(one).select("anchor_id", "a.label", "a.embedding"), "anchors")
    near = _scan(rows, asked, ["anchor_id", "label", "embedding"], lambda b, a: _nearest(b, a, positives), "anchor_id long, vec_id long, score long", f"{path}/near")
    own = _first(near, ["anchor_id"], positives)
    # Integers s with low * p <= 100 * s <= high * p are those from ceil(low * p / 100) to floor(high * p / 100); p under 0 has none.
    p = F.col("score")
    windows = own.where(p >= 0).select("anchor_id", F.col("vec_id").alias("positive_id"), p.alias("positive_score"), F.expr(f"(score * {low} + 99) div 100").alias("lower"), F.expr(f"score * {high} div 100").alias("upper"))
    windows = written(windows.where("lower <= upper"), "windows")
    limits = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("limits"), F.min("lower").alias("least"))
    slotted = written(asked.join(limits, "anchor_id"), "slots")
    scored = _scan(rows, slotted, ["anchor_id", "label", "embedding", "limits", "least"], lambda b, a: _in_slots(b, a, k), "anchor_id long, slot int, vec_id long, score long", f"{path}/slots")
    # At most k rows a slot and a slot a positive: an anchor's list is bounded.
    item = F.struct((-F.col("score")).alias("low"), "vec_id", "slot")
    merged = _first(scored, ["anchor_id", "slot"], k).groupBy("anchor_id").agg(F.array_sort(F.collect_list(item)).alias("merged"))
    first_slot = F.array_position("limits", F.col("upper")) - 1
    open_rows = F.slice(F.filter("merged", lambda x: x["slot"] >= F.col("first_slot")), 1, k)
    found = windows.join(limits.select("anchor_id", "limits"), "anchor_id").join(merged, "anchor_id").withColumn("first_slot", first_slot)
    found = found.withColumn("found", F.filter(open_rows, lambda x: -x["low"] >= F.col("lower")))
    out = found.select("anchor_id", "positive_id", "positive_score", F.posexplode("found").alias("at", "x"))
    out = written(out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.low")).alias("negative_score")), "negatives")
    forget(windows, asked, slotted, *(t for t in (near, scored) if t.inputFiles()))
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Query: hard negatives of every hundredth row of ``embeddings`` among all rows; every seventh row has the next label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = kept_vectors(vectors.where("label IS NOT NULL AND vec_id IS NOT NULL"), "vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where("vec_id % 100 = 0"))


SQL = f"""WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * x::DOUBLE) AS BIGINT)) AS v
FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= {POSITIVES}),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""
