"""Mixing sources to target weights (operator 2): a time-varying curriculum.

1. Targets: sources, by code point and null last, weigh 5, 2, 1, repeating, and share all words by weight; none
   gets more than ``MAX_EPOCHS`` times its size. The level at which the rest fills up is found from running sums
   over the sources in order of the level at which each is full.
2. Schedule: in training time t from 0 to 1 a source is drawn at a rate that changes linearly, from
   ``1 + slope`` to ``1 - slope`` of its mean; the slope runs from ``SLOPE`` for the first source to ``-SLOPE`` for
   the last. Its integral, ``t + slope * t * (1 - t)``, times the target, is the demand up to t.
3. Positions: a source's documents stand in an order of hashes. Their running sums of words give each copy's
   place in the source's supply (epochs one after another); inverting the cumulative demand at its middle gives
   the training time. Running sums go over three levels of hash buckets, so no source is one group.
4. The result is range-partitioned by position and sorted. A source's last copy is cut where its demand ends, so
   that the words taken equal the target up to rounding; ``mixed_documents`` rounds to whole copies instead.

Cases: a null or empty text has size 0 and is taken 0 times (in ``mixed_documents`` it goes); a null source is a
source; repeated rows are documents of their own; equal hashes are ordered by id and text; an empty table gives an empty
result; very long texts are measured whole. Only the named columns are read. Windows over all sources are one task: a row
for each source, of which a corpus has thousands at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import WORD, written

#: Weights by rank of the source; most epochs; slope of the schedule; buckets at each level.
WEIGHTS, MAX_EPOCHS, SLOPE, FANOUT = (5.0, 2.0, 1.0), 3, 0.6, 64


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """For each source of (source, source_size): also target, slope. A row a source, so windows over all are small."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    nth = F.row_number().over(ordered) - 1
    out = sizes.withColumn("nth", nth).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")))
    out = out.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("total", F.sum("source_size").over(everything).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    # The level if the sources before this one are full and it and those after it share the rest.
    full, used = F.coalesce(F.sum("cap").over(by_level), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_level), F.lit(0.0))
    out = out.withColumn("level", (F.col("total") - full) / (F.sum("weight").over(everything) - used))
    open_ = F.col("cap") > F.col("level") * F.col("weight")
    # The first source that the level leaves open sets the level of all open ones.
    out = out.withColumn("last", F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(everything)["level"])
    target = F.least("cap", F.coalesce(F.col("last") * F.col("weight"), F.col("cap")))
    n = F.count(F.lit(1)).over(everything)
    slope = F.lit(SLOPE) * (1 - 2 * F.col("nth") / F.greatest(n - 1, F.lit(1)))
    return out.select("source", "source_size", target.alias("target"), F.when(n > 1, slope).otherwise(F.lit(0.0)).alias("slope"))


def _supply(rows: DataFrame) -> DataFrame:
    """Adds ``before``: words of the source's documents that stand before each one, by three levels of buckets."""
    keys = ["source", "b1", "b2"]
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text_at", F.lit(7))).withColumn("b1", F.pmod(F.shiftright("h", 58), F.lit(FANOUT))).withColumn("b2", F.pmod(F.shiftright("h", 52), F.lit(FANOUT)))
    second = rows.groupBy(*keys).agg(F.sum("size").alias("words"))
    first = second.groupBy("source", "b1").agg(F.sum("words").alias("words1"))

    def before(part: list[str], order: str, words: str) -> Column:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(words).over(w), F.lit(0))

    first = first.withColumn("before1", before(["source"], "b1", "words1")).drop("words1")
    second = second.withColumn("before2", before(["source", "b1"], "b2", "words")).drop("words")
    starts = _join(second, first, ["source", "b1"]).select(*keys, (F.col("before1") + F.col("before2")).alias("start"))
    inner = Window.partitionBy(*keys).orderBy("h", "doc_id", "text_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    return _join(rows, starts, keys).withColumn("before", F.col("start") + F.col("inner")).drop("h", "b1", "b2", "start", "inner")


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join in which a null source meets a null source."""
    marked = [F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), *keys[1:]]
    a = left.withColumn("_s", marked[0])
    b = right.withColumn("_s", marked[0]).drop("source")
    return a.join(b, ["_s", *keys[1:]]).drop("_s")


def _time(done: Column, slope: Column) -> Column:
    """The t at which t + slope * t * (1 - t) reaches ``done``."""
    root = F.sqrt(F.greatest((1 + slope) * (1 + slope) - 4 * slope * done, F.lit(0.0)))
    return 2 * done / (1 + slope + root)  # the form that holds for slope 0 too


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, text_at (hash of the text, so that rows of one id or none are dealt too); written once, as
    three running sums read it and texts should be read once."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), F.xxhash64(text_col).alias("text_at"))
    return written(rows, "sizes")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, slope, before, taken, positions (the training
    time of each copy that is taken, ascending), position (the first of them, null if none), sorted by position."""
    rows = _sized(docs, id_col, text_col, source_col)
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    out = _with_goals(_supply(rows), goals)
    goal = F.round("target").cast("long")
    starts = [F.col("before") + k * F.col("source_size") for k in range(MAX_EPOCHS)]
    parts = [F.greatest(F.lit(0), F.least(F.col("size"), goal - start)) for start in starts]
    at = [F.when(part > 0, _time(F.least((start + part / 2) / F.col("target"), F.lit(1.0)), F.col("slope"))) for start, part in zip(starts, parts, strict=True)]
    out = out.withColumn("taken", sum(parts[1:], parts[0])).withColumn("positions", F.array_compact(F.array(*at))).drop("text_at")
    out = out.withColumn("position", F.get("positions", F.lit(0)))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def _with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """Sources are joined by broadcast while a plan's statistics show them small; else rows of a hot one are split by AQE."""
    return _join(rows, goals, ["source"])


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to MAX_EPOCHS whole copies), by training position.

    A copy is taken if the demand reaches its middle."""
    rows = _sized(docs, id_col, text_col, source_col)
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = _with_goals(_supply(rows), goals)
    copies = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(MAX_EPOCHS - 1))))
    middle = F.col("before") + F.col("k") * F.col("source_size") + F.col("size") / 2
    chosen = copies.where((F.col("size") > 0) & (middle <= F.col("target"))).withColumn("_position", _time(F.least(middle / F.col("target"), F.lit(1.0)), F.col("slope")))
    # Rows that share id and text share a place in the order; each stands for itself.
    per_row = chosen.groupBy("doc_id", "source", "text_at").agg(F.collect_list("_position").alias("_at"))
    keys = [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_id"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"), F.col("text_at").alias("_text_at")]
    per_row = per_row.select(*keys, "_at")
    same = ["_id", "_source", "_text_at"]
    nth = Window.partitionBy(*same).orderBy("_id")
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    left = docs.select(F.struct(*docs.columns).alias("row"), id_.alias("_id"), source.alias("_source"), F.xxhash64(text_col).alias("_text_at"))
    left = left.withColumn("_nth", F.row_number().over(nth)).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*same)))
    joined = left.join(per_row, same)
    own = F.filter(F.array_sort("_at"), lambda x, i: F.pmod(i, F.col("_rows").cast("int")) == F.col("_nth") - 1)
    out = joined.withColumn("_position", F.explode(own))
    return out.repartitionByRange("_position", "_id").sortWithinPartitions("_position", "_id").select("row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """Query: all of ``documents``."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "position", "positions")
