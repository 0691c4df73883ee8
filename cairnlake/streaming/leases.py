"""SM1, SM6: claims with leases as a stream, with state and event-time timers; and the same over a bounded table.

Messages (key, at, seq, action, worker) are about one piece of work each: ``add`` makes it pending, ``claim`` gives it to a worker for a
lease, ``ok`` and ``fail`` of that worker end the claim, ``replay`` revives it when dead. A claim whose lease ends is a failure; after ``most``
failures the work is dead. What does not fit the state is ignored: a second claim, an answer of a worker whose lease is over."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cairnlake.streaming.jobs import MAX_RETRIES, URGENT

#: Seconds of a lease (SM6), and for how long the state of finished work is kept.
LEASE, KEPT = 600, 86_400
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "key long, at timestamp, status string, retries int, worker string, attempts int"


class Leases(StatefulProcessor):
    """State of one piece of work: a value (status, retries, worker, end of the lease, attempts) and a list of its claims. A timer stands at
    the end of a lease that is running, and one where finished work is forgotten. State is read and written once for a key and batch."""

    def __init__(self, lease: int, most: int | None, kept: int) -> None:
        self.lease, self.most, self.kept = lease * 1000, most, kept * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.work = handle.getValueState("work", "status string, retries int, worker string, until long, attempts int")
        self.claims = handle.getListState("claims", "worker string, at long")

    def _failed(self, s: tuple) -> tuple:
        dead = self.most is not None and s[1] + 1 >= self.most
        return "dead" if dead else "failed", s[1] + 1, None, None, s[4]

    def _next(self, s: tuple, at: int, action: str, worker: str | None) -> tuple | None:
        """The state after a message, none if it does not fit."""
        status, retries, holder, _, attempts = s
        own = status == "processing" and worker == holder
        if action == "add" and status is None or action == "replay" and status == "dead":
            return "pending", 0, None, None, attempts
        if action == "claim" and status in ("pending", "failed"):
            return "processing", retries, worker, at + self.lease, attempts + 1
        if action == "ok" and own:
            return "completed", retries, worker, None, attempts
        return self._failed(s) if action == "fail" and own else None

    def _save(self, s: tuple, at: int) -> None:
        self.work.update(s)
        if s[0] == "processing":
            self.handle.registerTimer(s[3])
        elif s[0] in ("completed", "dead"):
            self.handle.registerTimer(at + self.kept)

    @staticmethod
    def _change(key: int, at: int, s: tuple) -> Row:
        when = datetime.datetime.fromtimestamp(at / 1000, datetime.UTC)
        return Row(key=key, at=when, status=s[0], retries=s[1], worker=s[2], attempts=s[4])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found = self.work.get() if self.work.exists() else None
        s = tuple(found) if found is not None else (None, 0, None, None, 0)
        claims, changed, at = [], None, 0
        for at, _, action, worker in sorted(((r["ms"], r["seq"], r["action"], r["worker"]) for r in rows), key=lambda m: m[:2]):
            if s[0] == "processing" and s[3] < at:  # the timer of this lease comes with a later watermark
                changed, s = s[3], self._failed(s)
                yield self._change(key[0], changed, s)
            after = self._next(s, at, action, worker)
            if after is not None:
                changed, s = at, after
                yield self._change(key[0], changed, s)
                if action == "claim":
                    claims.append((worker, at))
        if claims:
            self.claims.appendList(claims)
        if changed is not None:
            self._save(s, changed)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        s = tuple(self.work.get()) if self.work.exists() else (None,)
        if s[0] == "processing" and s[3] <= at:
            until, s = s[3], self._failed(s)
            self._save(s, until)
            yield self._change(key[0], until, s)
        elif s[0] in ("completed", "dead") and not any(t > at for t in self.handle.listTimers()):
            self.work.clear()
            self.claims.clear()

    def close(self) -> None:
        pass


def lease_changes(messages: DataFrame, late: str = "0 seconds", lease: int = LEASE, most: int | None = MAX_RETRIES, kept: int = KEPT) -> DataFrame:
    """SM1, SM6: every change of state of a stream of messages (key, at, seq, action, worker), as ``CHANGE``. Messages later than the watermark
    are dropped by the engine. The session needs ``STORE`` set to ``ROCKS`` when the query starts (``run_changes`` does so)."""
    marked = messages.withWatermark("at", late).withColumn("ms", F.unix_millis("at"))
    return marked.groupBy("key").transformWithState(Leases(lease, most, kept), CHANGE, "Append", "eventTime")


def run_changes(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what a stream of changes gives now to a Parquet table, exactly once, and waits for it."""
    spark = changes.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        query = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    query.awaitTermination()


def last_states(changes: DataFrame) -> DataFrame:
    """The newest state of each key: of changes at one time the one after more attempts, then the later kind."""
    rank = F.create_map(*(F.lit(x) for kv in {"pending": 0, "processing": 1, "failed": 2, "completed": 3, "dead": 4}.items() for x in kv))
    newest = F.max(F.struct("at", "attempts", "retries", rank[F.col("status")].alias("rank"), "status", "worker")).alias("s")
    return changes.groupBy("key").agg(newest).select("key", "s.status", "s.retries", "s.worker", "s.attempts")


def folded_states(messages: DataFrame, as_of: Column, lease: int = LEASE, most: int | None = MAX_RETRIES) -> DataFrame:
    """SM1, SM6 over a bounded table: the state of each key after all its messages, and after leases that ended before ``as_of``: (key, status,
    retries, worker, attempts). A key's messages are folded in order; they are bounded by its attempts."""
    order = F.array_sort(F.collect_list(F.struct(F.unix_millis("at").alias("ms"), "seq", "action", "worker")))
    state = lambda status, retries, worker, until, attempts: F.struct(status.alias("status"), retries.cast("int").alias("retries"), worker.alias("worker"), until.cast("long").alias("until"), attempts.cast("int").alias("attempts"))
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast("long")

    def failed(s: Column) -> Column:
        retries = s["retries"] + 1
        dead = retries >= most if most is not None else F.lit(False)
        return state(F.when(dead, "dead").otherwise("failed"), retries, none, no_time, s["attempts"])

    def swept(s: Column, now: Column) -> Column:
        return F.when((s["status"] == "processing") & (s["until"] < now), failed(s)).otherwise(s)

    def step(old: Column, m: Column) -> Column:
        s = swept(old, m["ms"])
        own = (s["status"] == "processing") & s["worker"].eqNullSafe(m["worker"])
        return (
            F.when((m["action"] == "add") & s["status"].isNull(), state(F.lit("pending"), F.lit(0), none, no_time, s["attempts"]))
            .when((m["action"] == "claim") & s["status"].isin("pending", "failed"), state(F.lit("processing"), s["retries"], m["worker"], m["ms"] + lease * 1000, s["attempts"] + 1))
            .when((m["action"] == "ok") & own, state(F.lit("completed"), s["retries"], s["worker"], no_time, s["attempts"]))
            .when((m["action"] == "fail") & own, failed(s))
            .when((m["action"] == "replay") & (s["status"] == "dead"), state(F.lit("pending"), F.lit(0), none, no_time, s["attempts"]))
            .otherwise(s)
        )

    start = state(none, F.lit(0), none, no_time, F.lit(0))
    grouped = messages.groupBy("key").agg(order.alias("messages"))
    done = grouped.select("key", F.aggregate("messages", start, step).alias("s"))
    done = done.select("key", swept(F.col("s"), F.unix_millis(as_of)).alias("s")).where("s.status IS NOT NULL")
    return done.select("key", "s.status", "s.retries", "s.worker", "s.attempts")


def claim_order(states: DataFrame, kinds: DataFrame) -> DataFrame:
    """SM1: work that may be claimed (pending, failed) in order: urgent kinds first, then by key: adds ``priority``."""
    open_ = states.where(F.col("status").isin("pending", "failed")).join(kinds, "key")
    return open_.withColumn("priority", (~F.col("kind").isin(*URGENT)).cast("int"))
