"""Queries on incremental work; streams are run to their end over the table's files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnlake.functions.text import round_to
from cairnlake.plans.registry import Plan
from cairnlake.session import read_table as t
from cairnlake.session import shared_dir
from cairnlake.streaming import jobs, leases


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def _outbox(s, d):
    o = t(s, d, "orders")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "deleted").when(F.col("o_orderpriority") == "2-HIGH", "acl_changed").otherwise("changed")
    events = o.select(F.col("o_orderkey").alias("event_id"), kind.alias("kind"), F.lit("processing").alias("status"), (F.col("o_orderkey") % 6).alias("retries"))
    outcomes = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderstatus") == "F").alias("ok"))
    return jobs.outbox_step(events, outcomes)


OUTBOX = """step AS (SELECT o_orderkey AS event_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'deleted' WHEN '2-HIGH' THEN 'acl_changed' ELSE 'changed' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE CASE WHEN o_orderkey % 6 + 1 >= 5 THEN 'dead' ELSE 'pending' END END AS status,
o_orderkey % 6 + CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN 1 ELSE 0 END AS retries, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END AS priority FROM orders)"""


def _stream_windows(s, d):
    """The stream's result over all files equals the batch's: no row is later than the watermark allows within one run."""
    out = _folder(s)
    source = t(s, d, "events")
    source.write.parquet(f"{out}/in")
    stream = jobs.read_stream(s, f"{out}/in", source.schema)
    counts = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def keep(batch, epoch):
        batch.select(F.col("w.start").alias("window_start"), "event_type", "n").write.mode("overwrite").parquet(f"{out}/result/epoch={epoch}")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = s.read.parquet(f"{out}/result")
    last = found.agg(F.max("epoch").alias("epoch"))
    return found.join(last, "epoch", "left_semi").drop("epoch")


def _sync(s, d):
    """A change feed of orders, the newest change of each customer, applied batch by batch."""
    out = _folder(s)
    feed = t(s, d, "orders").select(F.col("o_custkey").alias("external_id"), F.col("o_orderkey").alias("sequence"), F.col("o_orderstatus").alias("content_hash"))
    feed.write.parquet(f"{out}/in")

    def apply(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{out}/state/epoch={epoch}")
        return 0

    jobs.sync_changes(jobs.read_stream(s, f"{out}/in", feed.schema, 1_000_000), apply, f"{out}/checkpoint", f"{out}/runs").awaitTermination()
    return s.read.parquet(f"{out}/state").select("external_id", "sequence", "content_hash")


def _maintenance(s, d):
    o = t(s, d, "orders")
    docs = o.select((F.col("o_orderkey") % 3).alias("kb_id"), F.col("o_custkey").alias("title"), F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderdate")).alias("effective_to"), F.lit("current").alias("status"))
    return jobs.maintenance(docs, F.lit("1996-01-01").cast("timestamp")).select("doc_id", "status_after", "conflict")


BATCHES_SQL = """WITH RECURSIVE e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS rn FROM events),
r AS (SELECT *, "at" AS opened, 1 AS n, 0 AS batch FROM e WHERE rn = 1 UNION ALL
SELECT e.*, CASE WHEN e."at" - opened >= 86400 OR n >= 3 THEN e."at" ELSE opened END, CASE WHEN e."at" - opened >= 86400 OR n >= 3 THEN 1 ELSE n + 1 END, batch + CASE WHEN e."at" - opened >= 86400 OR n >= 3 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, "at", event_id, batch FROM r"""


def _hot_batches(s, d):
    """Turns of conversations by role: two keys hold all events."""
    c = t(s, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    second = F.lit(1_700_000_000) + F.col("turn") * 50 + (F.col("conv_id") * 13) % 50_000
    events = c.select("role", F.timestamp_seconds(second).alias("ts"), (F.col("conv_id") * 100_000 + F.col("turn")).alias("event_id"))
    return jobs.first_event_batches(events, "role", "ts", 40, 60)


HOT_SQL = """WITH RECURSIVE e AS (SELECT role, 1700000000 + turn * 50 + (conv_id * 13) % 50000 AS sec, conv_id * 100000 + turn AS event_id FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY sec, event_id) AS rn FROM e),
r AS (SELECT *, sec AS opened, 1 AS n, 0 AS batch FROM o WHERE rn = 1 UNION ALL
SELECT o.*, CASE WHEN o.sec - opened >= 40 OR n >= 60 THEN o.sec ELSE opened END, CASE WHEN o.sec - opened >= 40 OR n >= 60 THEN 1 ELSE n + 1 END, batch + CASE WHEN o.sec - opened >= 40 OR n >= 60 THEN 1 ELSE 0 END FROM r JOIN o ON o.role = r.role AND o.rn = r.rn + 1)
SELECT role, sec AS "at", event_id, batch FROM r"""


def _messages(s, d):
    """Turns of conversations stand for messages about pieces of work: the first turn adds it, later ones claim it, answer or replay."""
    c = t(s, d, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    kind = (F.col("conv_id") + F.col("turn") * F.col("turn")) % 5
    action = F.when(F.col("turn") == 0, "add").when(kind == 0, "fail").when(kind == 3, "ok").when(kind == 4, "replay").otherwise("claim")
    second = F.lit(1_700_000_000) + F.col("turn") * 50 + (F.col("conv_id") * F.col("turn")) % 40
    return c.select(F.col("conv_id").alias("key"), F.timestamp_seconds(second).alias("at"), F.col("turn").cast("long").alias("seq"), action.alias("action"), F.concat(F.lit("w"), (F.col("turn") % 3 % 2).cast("string")).alias("worker"))


def _leases(s, d):
    """The stream of claims over all messages, and a last one that lets all leases end."""
    out = _folder(s)
    messages = _messages(s, d)
    end = messages.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("key"), (F.col("at") + F.expr("INTERVAL 1 DAY")).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit("add").alias("action"), F.lit(None).cast("string").alias("worker"))
    messages.unionByName(end.where("at IS NOT NULL")).write.parquet(f"{out}/in")
    stream = jobs.read_stream(s, f"{out}/in", messages.schema, 1_000_000)
    leases.run_changes(leases.lease_changes(stream, lease=60, most=3, kept=7 * 86_400), f"{out}/out", f"{out}/checkpoint")
    return leases.last_states(s.read.schema(leases.CHANGE).parquet(f"{out}/out").where("key >= 0"))


def _folded(s, d):
    messages = _messages(s, d)
    return leases.folded_states(messages, F.lit("2100-01-01").cast("timestamp"), 60, 3)


#: The same states, one message after another.
LEASES_SQL = """WITH RECURSIVE m AS (SELECT conv_id AS key, 1700000000 + turn * 50 + (conv_id * turn) % 40 AS sec, turn AS seq, CASE WHEN turn = 0 THEN 'add' WHEN (conv_id + turn * turn) % 5 = 0 THEN 'fail' WHEN (conv_id + turn * turn) % 5 = 3 THEN 'ok' WHEN (conv_id + turn * turn) % 5 = 4 THEN 'replay' ELSE 'claim' END AS action, 'w' || (turn % 3 % 2) AS worker FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sec, seq) AS rn FROM (SELECT * FROM m UNION ALL SELECT DISTINCT key, 4102444800, 0, 'end', '' FROM m)),
r AS (SELECT key, 0::BIGINT AS rn, NULL::VARCHAR AS status, 0 AS retries, NULL::VARCHAR AS worker, NULL::BIGINT AS until, 0 AS attempts FROM (SELECT DISTINCT key FROM m) UNION ALL
SELECT key, rn,
 CASE WHEN action = 'add' AND s IS NULL THEN 'pending' WHEN action = 'claim' AND s IN ('pending', 'failed') THEN 'processing' WHEN action = 'ok' AND own THEN 'completed' WHEN action = 'fail' AND own THEN CASE WHEN n + 1 >= 3 THEN 'dead' ELSE 'failed' END WHEN action = 'replay' AND s = 'dead' THEN 'pending' ELSE s END,
 CASE WHEN action = 'add' AND s IS NULL OR action = 'replay' AND s = 'dead' THEN 0 WHEN action = 'fail' AND own THEN n + 1 ELSE n END,
 CASE WHEN action = 'claim' AND s IN ('pending', 'failed') THEN claimant WHEN action = 'fail' AND own OR action = 'replay' AND s = 'dead' THEN NULL ELSE holder END,
 CASE WHEN action = 'claim' AND s IN ('pending', 'failed') THEN sec + 60 WHEN s = 'processing' AND (action <> 'ok' AND action <> 'fail' OR NOT own) THEN until END,
 attempts + CASE WHEN action = 'claim' AND s IN ('pending', 'failed') THEN 1 ELSE 0 END
FROM (SELECT o.key, o.rn, o.sec, o.action, o.worker AS claimant, r.until, r.attempts, r.status = 'processing' AND r.until < o.sec,
  CASE WHEN r.status = 'processing' AND r.until < o.sec THEN CASE WHEN r.retries + 1 >= 3 THEN 'dead' ELSE 'failed' END ELSE r.status END AS s,
  r.retries + CASE WHEN r.status = 'processing' AND r.until < o.sec THEN 1 ELSE 0 END AS n,
  CASE WHEN r.status = 'processing' AND r.until < o.sec THEN NULL ELSE r.worker END AS holder,
  coalesce(r.status = 'processing' AND r.until >= o.sec AND r.worker = o.worker, false) AS own FROM r JOIN o ON o.key = r.key AND o.rn = r.rn + 1))
SELECT key, status, retries, worker, attempts FROM r WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1"""


PLANS = [
    Plan("sm1_lease_stream", _leases, LEASES_SQL),
    Plan("sm6_lease_states", _folded, LEASES_SQL),
    Plan("sm1_outbox_step", _outbox, f"WITH {OUTBOX} SELECT * FROM step"),
    Plan("sm1_replay_dead", lambda s, d: jobs.replay_dead(_outbox(s, d)).select("event_id", "status", "retries"), f"WITH {OUTBOX} SELECT event_id, CASE WHEN status = 'dead' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'dead' THEN 0 ELSE retries END AS retries FROM step"),
    Plan("sm2_sync_changes", _sync, "SELECT o_custkey AS external_id, max(o_orderkey) AS sequence, arg_max(o_orderstatus, o_orderkey) AS content_hash FROM orders GROUP BY 1"),
    Plan("sm3_first_event_batches", lambda s, d: jobs.first_event_batches(t(s, d, "events"), "user_id", "ts", 86400, 3), BATCHES_SQL),
    Plan("sm3_hot_keys", _hot_batches, HOT_SQL),
    Plan(
        "sm5_maintenance",
        _maintenance,
        """WITH d AS (SELECT o_orderkey % 3 AS kb, o_custkey AS title, o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 AND o_orderdate <= TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'current' END AS status_after FROM orders)
SELECT doc_id, status_after, count(*) FILTER (status_after = 'current') OVER (PARTITION BY kb, title) > 1 AS conflict FROM d""",
    ),
    Plan(
        "sm7_publish_if_current",
        lambda s, d: jobs.publish_if_current(t(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("scope"), (F.col("o_orderkey") % 5).alias("expected_epoch")), t(s, d, "nation").select(F.col("n_nationkey").alias("scope"), F.col("n_regionkey").alias("epoch"))).select("o_orderkey"),
        "SELECT o_orderkey FROM orders JOIN nation ON o_custkey % 25 = n_nationkey WHERE o_orderkey % 5 = n_regionkey",
    ),
    Plan("stream_hourly_counts", _stream_windows, "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL"),
    Plan("ext_windowed_counts", lambda s, d: jobs.windowed_counts(t(s, d, "events"), "ts", ["event_type"], "30 minutes").withColumn("value", round_to(F.col("value"), 4)), "SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL"),
    Plan(
        "ext_sessions",
        lambda s, d: jobs.sessions(t(s, d, "events"), "ts", ["user_id"], "2 hours"),
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events), k AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, user_id, count(*) AS n FROM k GROUP BY user_id, k""",
    ),
]
