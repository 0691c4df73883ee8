"""Claims with leases (SM1, SM6): the stream's table equals the fold over all messages."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from cairnlake.streaming import jobs, leases

SCHEMA = "key long, at timestamp, seq long, action string, worker string"
START = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def message(key, second, seq, action, worker=None):
    return key, START + datetime.timedelta(seconds=second), seq, action, worker


def sequential(messages, as_of, lease, most):
    """States by reading the messages one by one."""
    out = {}
    for key in {m[0] for m in messages}:
        status, retries, worker, until, attempts = None, 0, None, 0, 0
        for _, at, _, action, who in [*sorted((m for m in messages if m[0] == key), key=lambda m: (m[1], m[2])), (key, as_of, 0, "", None)]:
            if status == "processing" and until < at:
                retries, worker = retries + 1, None
                status = "dead" if retries >= most else "failed"
            if action == "add" and status is None:
                status = "pending"
            elif action == "claim" and status in ("pending", "failed"):
                status, worker, until, attempts = "processing", who, at + datetime.timedelta(seconds=lease), attempts + 1
            elif action == "ok" and status == "processing" and who == worker:
                status = "completed"
            elif action == "fail" and status == "processing" and who == worker:
                retries, worker = retries + 1, None
                status = "dead" if retries >= most else "failed"
            elif action == "replay" and status == "dead":
                status, retries, worker = "pending", 0, None
        if status is not None:
            out[key] = (status, retries, worker, attempts)
    return out


def states(df):
    return {r.key: (r.status, r.retries, r.worker, r.attempts) for r in df.collect()}


@pytest.fixture(scope="module")
def messages():
    rng, out = random.Random(12), []
    for key in range(40):
        second = rng.randrange(1000)
        for n in range(rng.randint(1, 30)):
            out.append(message(key, second, n, rng.choice(["add", "add", "claim", "claim", "claim", "ok", "fail", "fail", "replay"]) if n else "add", rng.choice(["w1", "w2"])))
            second += rng.choice([1, 5, 30, 59, 61, 200])
    # Work of its own for the clock to go on: all leases of the others end before this.
    return sorted([*out, message(1000, 50_000, 0, "add")], key=lambda m: m[1])


def test_the_fold_equals_the_sequential_reading(spark, messages):
    for minutes in (0, 10, 10_000):
        as_of = START + datetime.timedelta(minutes=minutes) + datetime.timedelta(seconds=6000)
        got = states(leases.folded_states(spark.createDataFrame(messages, SCHEMA), F.lit(as_of), 60, 3))
        want = sequential(messages, as_of, 60, 3)
        assert got == want
    assert {s[0] for s in want.values()} == {"pending", "failed", "completed", "dead"}


@pytest.mark.parametrize("parts", [1, 4])
def test_the_streams_table_equals_the_fold(spark, messages, parts):
    at = f"{spark.conf.get('spark.checkpoint.dir')}/leases-{time.time_ns()}"
    size = -(-len(messages) // parts)
    before = spark.conf.get(leases.STORE)
    for n in range(parts):  # each run goes on from the checkpoint, with the state that the last one left
        spark.createDataFrame(messages[n * size : n * size + size], SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = jobs.read_stream(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema)
        leases.run_changes(leases.lease_changes(stream, lease=60, most=3, kept=10**6), f"{at}/out", f"{at}/c")
    changes = spark.read.schema(leases.CHANGE).parquet(f"{at}/out")
    assert states(leases.last_states(changes)) == sequential(messages, messages[-1][1], 60, 3)
    assert changes.count() == changes.distinct().count() and spark.conf.get(leases.STORE) == before


def test_finished_work_is_forgotten(spark):
    rows = [message(1, 0, 0, "add"), message(1, 1, 1, "claim", "w"), message(1, 2, 2, "ok", "w")]
    later = [message(2, 500, 0, "add")]
    again = [message(1, 600, 3, "add")]
    at = f"{spark.conf.get('spark.checkpoint.dir')}/leases-{time.time_ns()}"
    for part in (rows, later, again):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        stream = jobs.read_stream(spark, f"{at}/in", spark.read.parquet(f"{at}/in").schema)
        leases.run_changes(leases.lease_changes(stream, lease=60, kept=100), f"{at}/out", f"{at}/c")
    got = [(r.key, r.status) for r in spark.read.schema(leases.CHANGE).parquet(f"{at}/out").orderBy("at", "key").collect()]
    assert got == [(1, "pending"), (1, "processing"), (1, "completed"), (2, "pending"), (1, "pending")]


def test_urgent_kinds_come_first(spark):
    kinds = spark.createDataFrame([(1, "changed"), (2, "deleted"), (3, "changed")], "key long, kind string")
    s = spark.createDataFrame([(1, "pending"), (2, "failed"), (3, "completed")], "key long, status string")
    assert [(r.key, r.priority) for r in leases.claim_order(s, kinds).orderBy("priority", "key").collect()] == [(2, 0), (1, 1)]
