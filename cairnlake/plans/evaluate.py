"""Queries on metrics, experiments and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.text import round_to
from cairnlake.operators import evaluate as ev
from cairnlake.plans.registry import Plan
from cairnlake.session import read_table as t

# Customers' orders are runs, ranked by price; urgent and high orders are relevant with gains 2 and 1.
RUN = """run AS (SELECT o_custkey AS qid, o_orderkey AS docid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders),
qrels AS (SELECT o_custkey AS qid, o_orderkey AS docid, CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 1 ELSE 0 END AS gain FROM orders)"""
METRICS = f"""{RUN}, rel AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY gain DESC, docid) AS i FROM qrels WHERE gain > 0),
tot AS (SELECT qid, sum(CASE WHEN i <= 10 THEN gain / log2(i + 1) END) AS idcg, count(*) AS n FROM rel GROUP BY 1),
hit AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM run JOIN rel USING (qid, docid) WHERE rank <= 10),
got AS (SELECT qid, sum(gain / log2(rank + 1)) AS dcg, count(*) AS hits, 1.0 / min(rank) AS mrr, sum(nth / rank) AS ps FROM hit GROUP BY 1),
met AS (SELECT qid, coalesce(dcg / idcg, 0) AS ndcg, coalesce(hits / n, 0) AS recall, coalesce(mrr, 0)::DOUBLE AS mrr, coalesce(ps / n, 0) AS map, hits IS NOT NULL AS evaluated FROM (SELECT DISTINCT qid FROM qrels) LEFT JOIN tot USING (qid) LEFT JOIN got USING (qid))"""
NAMES = ("ndcg", "recall", "mrr", "map")


def _run(s, d):
    o = t(s, d, "orders")
    rank = F.row_number().over(ev.Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("docid"), rank.alias("rank"))


def _qrels(s, d):
    gain = F.when(F.col("o_orderpriority") == "1-URGENT", 2).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)
    return t(s, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("docid"), gain.alias("gain"))


def _metrics(s, d):
    return ev.query_metrics(_run(s, d), _qrels(s, d), 10)


def _rounded(df, names):
    return df.withColumns({n: round_to(F.col(n)) for n in names})


def _titles(s, d):
    gold = _qrels(s, d).where("gain > 0").select("qid", F.col("docid").alias("title"))
    return _rounded(ev.title_metrics(_run(s, d), gold), ["recall_2", "recall_5", "recall_10", "mrr", "ndcg"])


def _f1(s, d):
    c = t(s, d, "conversations")
    rows = c.alias("a").join(c.alias("b"), F.expr("a.conv_id = b.conv_id and a.turn + 1 = b.turn")).select(F.concat_ws("-", "a.conv_id", "a.turn").alias("key"), F.col("a.text").alias("predicted"), F.col("b.text").alias("gold"))
    return _rounded(ev.token_f1(rows, "predicted", "gold", "key"), ["f1"])


NORM = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '[ \t\n\r]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
F1_SQL = f"""WITH c AS (SELECT a.conv_id || '-' || a.turn AS key, {NORM.format("a.text")} AS p, {NORM.format("b.text")} AS g FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn),
pt AS (SELECT key, unnest(string_split(p, ' ')) AS tok FROM c), gt AS (SELECT key, unnest(string_split(g, ' ')) AS tok FROM c),
pc AS (SELECT key, tok, count(*) AS n FROM pt WHERE tok <> '' GROUP BY ALL), gc AS (SELECT key, tok, count(*) AS n FROM gt WHERE tok <> '' GROUP BY ALL),
sm AS (SELECT key, sum(least(pc.n, gc.n)) AS s FROM pc JOIN gc USING (key, tok) GROUP BY 1), np AS (SELECT key, sum(n) AS n FROM pc GROUP BY 1), ng AS (SELECT key, sum(n) AS n FROM gc GROUP BY 1)
SELECT key, p = g AS em, round(CASE WHEN coalesce(s, 0) = 0 THEN 0.0 ELSE 2.0 * s / (np.n + ng.n) END, 6) AS f1 FROM c LEFT JOIN sm USING (key) LEFT JOIN np USING (key) LEFT JOIN ng USING (key)"""


def _requests(s, d):
    e = t(s, d, "events")
    return e.select("event_type", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"), F.unix_timestamp("ts").alias("second"))


def _user_means(s, d):
    return t(s, d, "events").groupBy("user_id").agg(F.avg("value").alias("value"))


def _wilson(s, d):
    n = _qrels(s, d).groupBy("qid").agg(F.count_if(F.col("gain") > 0).alias("hits"), F.count(F.lit(1)).alias("n"))
    low, high = ev.wilson(F.col("hits"), F.col("n"))
    return n.select("qid", round_to(low).alias("low"), round_to(high).alias("high"))


def _ab(s, d):
    e = t(s, d, "events")
    arm = ev.assign_arm(F.lit("exp"), F.col("user_id").cast("string"), F.lit(""), 0.8, 0.5, 0.1)
    return e.select(F.lit("exp").alias("experiment"), arm.alias("arm"), F.col("event_type").alias("event_name"), "value")


BUCKET = "('0x' || sha256({0})[1:8])::BIGINT / 4294967296.0"
ARMS = f"""b AS (SELECT *, {BUCKET.format("'exp|' || user_id || '|anon'")} AS r, {BUCKET.format("'exp|shadow|' || user_id || '|anon'")} AS r2 FROM events),
a0 AS (SELECT *, CASE WHEN r < 0.4 THEN 'treatment' WHEN r < 0.8 THEN 'control' WHEN r2 < 0.1 THEN 'shadow' ELSE 'control' END AS a FROM b),
ab AS (SELECT *, CASE WHEN a = 'control' AND r2 < 0.05 THEN 'shadow' ELSE a END AS arm FROM a0)"""


def _summary(s, d):
    out = ev.ab_summary(_ab(s, d))
    return out.select("experiment", "arm", "count", round_to(F.col("avg_value")).alias("avg_value"), F.to_json("event_names").alias("event_names"))


def _hist(s, d):
    return ev.histogram(t(s, d, "events").select("event_type", (F.col("value") * 10).alias("ms")), ["event_type"], "ms")


LE = "(VALUES " + ", ".join(f"({float(b)})" for b in ev.BUCKETS_MS) + ") AS u(le)"
HIST = f"""e AS (SELECT event_type, value * 10 AS ms FROM events), tt AS (SELECT event_type, count(*) AS count, sum(ms) AS sum FROM e GROUP BY 1),
h AS (SELECT event_type, le, count, sum, (SELECT count(*) FROM e WHERE e.event_type = tt.event_type AND ms <= le) AS cumulative FROM tt, {LE}),
hh AS (SELECT *, cumulative - coalesce(lag(cumulative) OVER (PARTITION BY event_type ORDER BY le), 0) AS n, coalesce(lag(le) OVER (PARTITION BY event_type ORDER BY le), 0) AS lower FROM h)"""


def _quota(s, d):
    e = t(s, d, "events").select(F.col("event_id").alias("request_id"), "user_id", "ts", F.ceil("value").cast("long").alias("cost"))
    return ev.quota(e.withColumn("tenant", F.col("user_id") % 3), "tenant", "ts", "cost", 3, 200).select("request_id", "nth", "spent", "admitted")


def _chains(s, d):
    chains = t(s, d, "lineitem").select((F.col("l_orderkey") % 100).alias("qid"), F.col("l_orderkey").alias("chain_id"), F.col("l_partkey").alias("docid"))
    found = t(s, d, "part").select((F.col("p_partkey") % 100).alias("qid"), F.explode(F.sequence(F.col("p_partkey"), F.col("p_partkey") + 40)).alias("docid"))
    return _rounded(ev.chain_recall(found, chains), ["chain_recall"])


def _ablation(s, d):
    o = t(s, d, "orders")
    runs = o.select(
        "o_orderpriority",
        (F.col("o_orderkey") % 5).alias("supported"),
        F.lit(5).alias("claims"),
        (F.col("o_orderkey") % 3).alias("cited"),
        F.lit(3).alias("citations"),
        (F.col("o_orderstatus") == "F").alias("correct"),
        (F.col("o_orderstatus") == "P").alias("refused"),
        (F.col("o_custkey") % 2 == 0).alias("answerable"),
        (F.col("o_orderkey") % 1000).alias("tokens"),
        F.lit(0.5).alias("price"),
        F.col("o_totalprice").alias("ms"),
    )
    return _rounded(ev.ablation(runs, ["o_orderpriority"]), ["fact_support", "citation_accuracy", "accuracy", "false_refusal", "cost", "p50", "p95"])


def _bootstrap(s, d):
    pairs = t(s, d, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pair_id"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return _rounded(ev.paired_bootstrap(pairs, ["l_returnflag"], 500), ["low", "high", "difference"])


def _platt(s, d):
    rows = t(s, d, "orders").select("o_orderstatus", (F.col("o_totalprice") / 100000).alias("score"), (F.col("o_orderpriority") < "3").cast("int").alias("label"))
    return _rounded(ev.platt_fit(rows, ["o_orderstatus"]), ["a", "b"])


PLANS = [
    Plan("ev1_query_metrics", lambda s, d: _rounded(_metrics(s, d), NAMES), f"WITH {METRICS} SELECT qid, " + ", ".join(f"round({n}, 6) AS {n}" for n in NAMES) + ", evaluated FROM met"),
    Plan(
        "ev5_macro",
        lambda s, d: _rounded(ev.macro(_metrics(s, d)), [*NAMES, *(f"{n}_evaluated" for n in NAMES)]),
        f"WITH {METRICS} SELECT " + ", ".join(f"round(avg({n}), 6) AS {n}, round(avg({n}) FILTER (evaluated), 6) AS {n}_evaluated" for n in NAMES) + ", count(*) AS queries FROM met",
    ),
    Plan(
        "ev6_title_metrics",
        _titles,
        f"""WITH {RUN}, j AS (SELECT q.qid, q.docid, rank, row_number() OVER (PARTITION BY q.qid ORDER BY q.docid) AS i FROM qrels q LEFT JOIN run r ON q.qid = r.qid AND q.docid = r.docid WHERE gain > 0)
SELECT qid, round(count(*) FILTER (rank <= 2) / count(*), 6) AS recall_2, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10,
count(*) FILTER (rank <= 10) = count(*) AS full_evidence, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / sum(1 / log2(i + 1)) FILTER (i <= 10), 6) AS ndcg FROM j GROUP BY qid""",
    ),
    Plan("ev7_token_f1", _f1, F1_SQL),
    Plan(
        "ev9_triad",
        lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", round_to(ev.triad(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50) + 1e-9).alias("triad")),  # the offset keeps exact halves from rounding apart
        "SELECT l_orderkey, l_linenumber, round(1e-9 + CASE WHEN l_discount > 0 AND l_tax > 0 AND l_quantity > 0 THEN 3 / (1 / l_discount + 1 / l_tax + 1 / (l_quantity / 50)) ELSE 0 END, 6) AS triad FROM lineitem",
    ),
    Plan("ev10_paired_bootstrap", _bootstrap),
    Plan(
        "ev13_wilson",
        _wilson,
        f"""WITH {RUN}, c AS (SELECT qid, count(*) FILTER (gain > 0) AS h, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM qrels GROUP BY 1), k AS (SELECT *, h / n AS p FROM c)
SELECT qid, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM k""",
    ),
    Plan(
        "ev14_gates",
        lambda s, d: _rounded(ev.gates(_user_means(s, d).where("user_id % 4 > 0").select(F.col("user_id").alias("metric"), "value"), _user_means(s, d).select(F.col("user_id").alias("metric"), (F.col("user_id") % 100).cast("double").alias("threshold"))), ["value"]),
        "WITH m AS (SELECT user_id AS metric, avg(value) AS value FROM events GROUP BY 1) SELECT metric, CASE WHEN metric % 4 > 0 THEN round(value, 6) END AS value, (metric % 100)::DOUBLE AS threshold, metric % 4 > 0 AND value >= metric % 100 AS passed FROM m",
    ),
    Plan(
        "ev15_load_summary",
        lambda s, d: _rounded(ev.load_summary(_requests(s, d), ["event_type"]), ["error_rate", "qps", "success_qps", "p50", "p95", "p99"]),
        """WITH r AS (SELECT event_type, event_type <> 'error' AS ok, value AS ms, floor(epoch(ts)) AS s FROM events)
SELECT event_type, count(*) AS requests, round(count(*) FILTER (NOT ok) / count(*), 6) AS error_rate, round(count(*) / greatest(max(s) - min(s) + 1, 1), 6) AS qps, round(count(*) FILTER (ok) / greatest(max(s) - min(s) + 1, 1), 6) AS success_qps,
round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM r GROUP BY 1""",
    ),
    Plan(
        "ev16_set_overlap",
        lambda s, d: t(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("a"), F.collect_set(F.col("l_suppkey")).alias("b")).select("l_orderkey", *ev.set_overlap("a", "b")).withColumn("jaccard", round_to(F.col("jaccard"))),
        """WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS a, list(DISTINCT l_suppkey) AS b FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS k FROM g)
SELECT l_orderkey, k AS shared, na - k AS only_a, nb - k AS only_b, round(k / (na + nb - k), 6) AS jaccard FROM n""",
    ),
    Plan(
        "ev17_ablation",
        _ablation,
        """SELECT o_orderpriority, round(sum(o_orderkey % 5) / sum(5), 6) AS fact_support, round(sum(o_orderkey % 3) / sum(3), 6) AS citation_accuracy, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS accuracy,
round(count(*) FILTER (o_orderstatus = 'P' AND o_custkey % 2 = 0) / count(*) FILTER (o_custkey % 2 = 0), 6) AS false_refusal, round(sum((o_orderkey % 1000) * 0.5)::DOUBLE, 6) AS cost, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.95), 6) AS p95 FROM orders GROUP BY 1""",
    ),
    Plan(
        "ev17_chain_recall",
        _chains,
        """WITH c AS (SELECT l_orderkey % 100 AS qid, l_orderkey AS chain_id, list(DISTINCT l_partkey) AS need FROM lineitem GROUP BY ALL), f AS (SELECT p_partkey % 100 AS qid, list(DISTINCT p_partkey + k) AS got FROM part, range(0, 41) AS r(k) GROUP BY 1),
s AS (SELECT qid, len(list_intersect(need, coalesce(got, []))) / len(need) AS r FROM c LEFT JOIN f USING (qid)) SELECT qid, round(max(r), 6) AS chain_recall, max(r) = 1 AS complete FROM s GROUP BY 1""",
    ),
    Plan("rk15_platt_fit", _platt),
    Plan("ex1_bucket", lambda s, d: t(s, d, "events").select("event_id", round_to(ev.bucket(F.lit("exp"), F.col("user_id").cast("string"), F.lit("anon")), 9).alias("bucket")), f"SELECT event_id, round({BUCKET.format(chr(39) + 'exp|' + chr(39) + ' || user_id || ' + chr(39) + '|anon' + chr(39))}, 9) AS bucket FROM events"),
    Plan("ex2_arms", lambda s, d: t(s, d, "events").select("event_id", ev.assign_arm(F.lit("exp"), F.col("user_id").cast("string"), F.lit(""), 0.8, 0.5, 0.1).alias("arm")), f"WITH {ARMS} SELECT event_id, arm FROM ab"),
    Plan(
        "ex3_sticky",
        lambda s, d: ev.sticky(t(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("arm"), F.struct("ts", "event_id").alias("o")), ["user_id"], "o").select("event_id", "arm", "first_arm"),
        "SELECT event_id, event_type AS arm, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_arm FROM events",
    ),
    Plan(
        "ex4_minute_quota",
        _quota,
        "SELECT event_id AS request_id, count(*) OVER w AS nth, CAST(sum(ceil(value)) OVER w AS BIGINT) AS spent, count(*) OVER w <= 3 AND sum(ceil(value)) OVER w <= 200 AS admitted FROM events WINDOW w AS (PARTITION BY user_id % 3, date_trunc('minute', ts) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    ),
    Plan(
        "ag7_histogram",
        lambda s, d: _hist(s, d).select("event_type", "le", "n", "cumulative", "count", round_to(F.col("sum"), 3).alias("sum")),
        f"WITH {HIST} SELECT event_type, le::DOUBLE AS le, n, cumulative, count, round(sum, 3) AS sum FROM hh",
    ),
    Plan(
        "ag7_histogram_quantile",
        lambda s, d: _rounded(ev.histogram_quantile(_hist(s, d), ["event_type"], 0.95), ["quantile"]),
        f"""WITH {HIST}, q AS (SELECT event_type, arg_min(CASE WHEN n <= 0 THEN le ELSE lower + (0.95 * count - (cumulative - n)) / n * (le - lower) END, le) AS v FROM hh WHERE cumulative >= 0.95 * count GROUP BY 1)
SELECT event_type, round(coalesce(v, sum / count), 6) AS quantile FROM tt LEFT JOIN q USING (event_type)""",
    ),
    Plan(
        "ag9_ab_summary",
        _summary,
        f"""WITH {ARMS}, n AS (SELECT arm, event_type, count(*) AS n, sum(value) AS v FROM ab GROUP BY ALL)
SELECT 'exp' AS experiment, arm, CAST(sum(n) AS BIGINT) AS count, round(sum(v) / sum(n), 6) AS avg_value, '{{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}}' AS event_names FROM n GROUP BY arm""",
    ),
    Plan(
        "ag10_ab_gate",
        lambda s, d: _rounded(ev.ab_gate(ev.ab_summary(_ab(s, d))), ["control", "treatment", "delta"]),
        f"""WITH {ARMS}, g AS (SELECT avg(value) FILTER (arm = 'control') AS c, avg(value) FILTER (arm = 'treatment') AS t, count(*) FILTER (arm = 'control') AS nc, count(*) FILTER (arm = 'treatment') AS nt FROM ab)
SELECT 'exp' AS experiment, round(c, 6) AS control, round(t, 6) AS treatment, round(t - c, 6) AS delta, t - c >= -0.05 AS passed FROM g WHERE nc >= 30 AND nt >= 30""",
    ),
]
