"""Incremental jobs (SM1-SM7, SRC13, SRC15) and event-time windows (an extension).

Every job takes a streaming DataFrame, so that a file folder, Kafka or a rate source serves alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnlake.session import forget, written

#: SM1: kinds of events that are handled first; attempts before an event is dead. SM3: delay in seconds and size of a batch.
URGENT = ("deleted", "acl_changed", "repealed")
MAX_RETRIES, BATCH_DELAY, BATCH_SIZE = 5, 4, 100


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 8) -> DataFrame:
    """SRC13: appended Parquet files as a stream; a checkpoint remembers what was read, at least once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def outbox_step(events: DataFrame, outcomes: DataFrame, most: int = MAX_RETRIES) -> DataFrame:
    """SM1: events (event_id, kind, status, retries) after their outcomes (event_id, ok): completed, pending again, or dead
    after ``most`` attempts; adds the order in which pending ones are claimed, urgent kinds first."""
    out = events.join(outcomes, "event_id", "left")
    retries = F.col("retries") + F.when(F.col("ok") == F.lit(False), 1).otherwise(0)
    status = F.when(F.col("ok"), "completed").when((F.col("ok") == F.lit(False)) & (retries >= most), "dead").when(F.col("ok") == F.lit(False), "pending").otherwise(F.col("status"))
    return out.select("event_id", "kind", status.alias("status"), retries.alias("retries"), (~F.col("kind").isin(*URGENT)).cast("int").alias("priority"))


def replay_dead(events: DataFrame) -> DataFrame:
    """SM1: dead events become pending with no attempts counted."""
    dead = F.col("status") == "dead"
    return events.withColumn("retries", F.when(dead, 0).otherwise(F.col("retries"))).withColumn("status", F.when(dead, "pending").otherwise(F.col("status")))


def running_count(rows: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """Adds ``before``: how many rows of the same key with a true ``flag`` come before a row, by ``order``. Rows are ranged over all tasks by key
    and order, counted within a task, and the tasks' counts are summed: a key may span any number of tasks."""
    ranged = written(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    ones = F.col(flag).cast("long")
    own = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_of")).agg(F.sum(ones).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", "_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    counted = ranged.withColumn("_own", F.coalesce(F.sum(ones).over(own), F.lit(0)))
    joined = counted.join(parts, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("before", F.col("_base") + F.col("_own")).drop("_key", "_of", "_part", "_base", "_own")


def _by_place(a: DataFrame, b: DataFrame, at: str, key: str) -> DataFrame:
    """a joined with b on the key and a place (a's ``at``, b's ``place``)."""
    b = b.withColumnsRenamed({key: "_key", "place": "_place"})
    return a.join(b, F.col(key).eqNullSafe(F.col("_key")) & (F.col(at) == F.col("_place"))).drop("_key", "_place")


def first_event_batches(events: DataFrame, key: str, ts: str, delay: int = BATCH_DELAY, size: int = BATCH_SIZE) -> DataFrame:
    """SM3 over a bounded table: the batch of each event: the first event of a key opens one for ``delay`` seconds, which later
    events do not extend; ``size`` events close it. (key, at, event_id, batch); events without a time are left out.

    If a batch began with an event, the next one would begin with the first event ``delay`` seconds on or ``size`` events on, whichever
    comes sooner: each event has one successor. Which events do begin one follows from the first by doubling: a round adds the
    successors of all that are known, and makes each successor that of twice as many steps. Joins on (key, place) alone, so
    one key may hold all events."""
    if delay < 0 or size < 1:
        raise ValueError("a batch needs a delay of 0 or more and a size of 1 or more")
    rows = events.select(key, F.unix_seconds(F.col(ts).cast("timestamp")).alias("at"), "event_id").where("at IS NOT NULL")
    # Each event stands in the order once for itself, and once for the time when its batch would end, before the events of that second.
    probes = rows.select(key, (F.col("at") + delay).alias("at"), "event_id", F.lit(False).alias("real"), F.col("at").alias("opened"))
    both = rows.select(key, "at", "event_id", F.lit(True).alias("real"), F.col("at").alias("opened")).unionByName(probes)
    counted = written(running_count(both, key, ["at", "real", "event_id", "opened"], "real"), "places")
    placed = counted.where("real").select(key, "at", "event_id", F.col("before").alias("place"))
    ends = counted.where("NOT real").select(F.col(key).alias("_key"), F.col("event_id").alias("_event"), F.col("opened").alias("_at"), F.col("before").alias("late"))
    # Repeated rows have the same end: one of them is enough.
    ends = ends.groupBy("_key", "_event", "_at").agg(F.min("late").alias("late"))
    total = counted.where("real").groupBy(F.col(key).alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    steps = placed.join(ends, F.col(key).eqNullSafe(F.col("_key")) & F.col("event_id").eqNullSafe(F.col("_event")) & (F.col("at") == F.col("_at")))
    then = F.greatest(F.col("place") + 1, F.least(F.col("place") + size, F.col("late")))
    steps = steps.withColumn("then", then).join(total, F.col(key).eqNullSafe(F.col("_of"))).select(key, "at", "event_id", "place", "then", "n")
    steps = written(steps, "successors")
    forget(counted)
    jumps = steps.where("then < n").select(key, "place", "then")
    begun = written(steps.where("place = 0").select(key, "place", F.lit(0).cast("long").alias("batch")), "batches")
    done, step = begun, 1
    while True:
        found = _by_place(begun, jumps, "place", key).select(key, F.col("then").alias("place"), (F.col("batch") + step).alias("batch"))
        found = written(found, "batches")
        if found.isEmpty():
            break
        done = done.unionByName(found)
        begun = begun.unionByName(found)
        further = _by_place(jumps.withColumnRenamed("then", "_via"), jumps, "_via", key).select(key, "place", "then")
        jumps, step = written(further, "jumps"), step * 2
    # A batch holds at most ``size`` events: its places are spread, and the events meet theirs.
    opened = _by_place(done, steps.select(key, "place", "then", "n"), "place", key)
    places = opened.select(key, "batch", F.explode(F.sequence("place", F.least("then", "n") - 1)).alias("place"))
    return _by_place(steps.select(key, "at", "event_id", "place"), places, "place", key).select(key, "at", "event_id", "batch")


def coalesced_syncs(events: DataFrame, key: str, delay: int = BATCH_DELAY, size: int = BATCH_SIZE) -> DataFrame:
    """SM3 over a stream (key, doc_id): a row (key, docs, reason) when a batch closes, by a processing-time timer that the first
    event sets, or by its size."""
    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        docs = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "docs": [len(docs)], "reason": ["delay"]})
            return
        fresh = not docs
        for f in frames:
            docs += f["doc_id"].tolist()
        while len(docs) >= size:
            yield pd.DataFrame({key: [k[0]], "docs": [size], "reason": ["size"]})
            docs, fresh = docs[size:], True
        if not docs:
            if state.exists:
                state.remove()
            return
        state.update((docs,))
        if fresh:
            state.setTimeoutDuration(delay * 1000)

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, docs long, reason string", "docs array<bigint>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def sync_changes(changes: DataFrame, apply: Callable[[DataFrame, int], int], checkpoint: str, runs_path: str):
    """SM2, SRC15: applies a change feed batch by batch. ``apply`` returns the number of failed changes: a batch with failures
    raises, so its offsets are not committed and it comes again; each good batch is recorded once by its number."""
    def one(batch: DataFrame, epoch: int) -> None:
        # The newest change of each document is what counts.
        last = Window.partitionBy("external_id").orderBy(F.desc("sequence"))
        newest = batch.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        failed = apply(newest, epoch)
        if failed:
            raise RuntimeError(f"{failed} changes failed")
        newest.agg(F.lit(epoch).alias("epoch"), F.count(F.lit(1)).alias("changes")).write.mode("overwrite").parquet(f"{runs_path}/epoch={epoch}")

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_if_current(staged: DataFrame, current: DataFrame) -> DataFrame:
    """SM7: staged rows whose expected epoch is still the current one of their scope."""
    return staged.join(current.select("scope", "epoch"), "scope").where("epoch = expected_epoch").drop("epoch")


def maintenance(docs: DataFrame, as_of) -> DataFrame:
    """SM5: one pass of nightly work: expired documents, and titles that hold more than one current version."""
    from cairnlake.operators.access import expired

    out = expired(docs, as_of)
    current = out.where("status_after not in ('expired', 'superseded')").groupBy("kb_id", "title").agg(F.count(F.lit(1)).alias("current"))
    return out.join(current, ["kb_id", "title"], "left").withColumn("conflict", F.coalesce(F.col("current") > 1, F.lit(False)))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Extension: counts and sums of tumbling or sliding windows; rows later than the watermark are dropped by the engine."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), *keys, "n", "value")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Extension: sessions of a key that end after a gap."""
    out = events.withWatermark(ts, late) if events.isStreaming else events
    return out.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Runs a stream over what there is, into Parquet, exactly once by the file sink's own log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def rebuild_times(changes: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """RP7: one rebuild of a scope's tree once its changes (kb_id, ts) have rested for ``gap``: (kb_id, due, changes). Works on
    streams, where ``late`` bounds how long a session waits for late changes, and on tables."""
    marked = changes.withWatermark("ts", late) if changes.isStreaming else changes
    found = marked.groupBy("kb_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("changes"))
    return found.select("kb_id", F.col("w.end").alias("due"), "changes")
