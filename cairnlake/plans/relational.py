"""Queries on listings, telemetry, joins, windows, sets and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.text import round_to
from cairnlake.operators import relational as rl
from cairnlake.plans.registry import Plan
from cairnlake.session import bounded_batches, read_table as t
from cairnlake.sources import readers as rd

W = rl.Window


def _li(s, d):
    return t(s, d, "lineitem")


def _timeline(s, d):
    o = t(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("action"), F.col("o_custkey").cast("string").alias("actor"))
    e = t(s, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor"))
    return rl.timeline({"order": o, "event": e})


def _health(s, d):
    docs = t(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority", (F.col("o_orderstatus") == "F").alias("failed"))
    chunks = _li(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("length"))
    return rl.document_health(docs, chunks, "o_orderpriority").withColumn("mean_length", round_to(F.col("mean_length")))


def _qa(s, d):
    c = t(s, d, "conversations")
    rows = c.select(
        F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn")).alias("id"),
        F.when(F.col("turn") % 5 > 0, F.col("text")).alias("question"),
        F.col("text").alias("answer"),
        F.lit("a| b;;a").alias("aliases"),
        F.col("role").alias("scope"),
        F.lit("en").alias("language"),
        F.lit("2020-01-01").alias("effectiveFrom"),
        F.when(F.col("turn") % 3 == 0, "2019-01-01").when(F.col("turn") % 3 == 1, "soon").alias("effectiveTo"),
        F.lit(None).cast("string").alias("sourceDocumentId"),
        F.when(F.col("turn") % 4 == 0, "v").alias("sourceVersionId"),
        "conv_id",
        "turn",
    )
    return rd.validate_qa(rows).select("conv_id", "turn", F.array_join("errors", ",").alias("errors"), F.array_join("alias_list", ",").alias("aliases"))


QA_SQL = """SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 5 = 0 OR length(trim(text)) = 0 THEN 'question missing' END, CASE WHEN turn % 5 > 0 AND length(trim(text)) > 2000 THEN 'question too long' END, CASE WHEN length(trim(text)) = 0 THEN 'answer missing' END, CASE WHEN length(trim(text)) > 20000 THEN 'answer too long' END,
CASE WHEN turn % 3 = 1 THEN 'bad end' END, CASE WHEN turn % 3 = 0 THEN 'dates out of order' END, CASE WHEN turn % 4 = 0 THEN 'version without document' END], lambda x: x IS NOT NULL), ',') AS errors, 'a,b' AS aliases FROM conversations"""


def _changed(s, d):
    p = t(s, d, "part")
    before = p.where("p_partkey % 4 > 0").select(F.col("p_name").alias("path"), F.md5(F.col("p_partkey").cast("string").cast("binary")).alias("blob"))
    after = p.where("p_partkey % 5 > 0").select(F.col("p_name").alias("path"), F.md5(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(F.col("p_partkey").cast("string")).cast("binary")).alias("blob"))
    first = lambda x: x.groupBy("path").agg(F.min("blob").alias("blob"))
    return rd.changed_files(first(before), first(after))


def _html(s, d):
    bounded_batches(s)
    return t(s, d, "pages").select("page_id", rd.html_text("html").alias("text"))


PLANS = [
    Plan("src2_html_text", _html),
    Plan("src3_markdown", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(rd.normalise_markdown(F.concat(F.lit("# A\r\n\r\n\r\n# A\n"), "text")).cast("binary")).alias("text_md5"))),
    Plan("src9_validate_qa", _qa, QA_SQL),
    Plan("src12_changed_files", _changed, """WITH b AS (SELECT p_name AS path, min(md5(CAST(p_partkey AS VARCHAR))) AS o FROM part WHERE p_partkey % 4 > 0 GROUP BY 1), a AS (SELECT p_name AS path, min(md5(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE CAST(p_partkey AS VARCHAR) END)) AS n FROM part WHERE p_partkey % 5 > 0 GROUP BY 1)
SELECT path, CASE WHEN o IS NULL THEN 'A' WHEN n IS NULL THEN 'D' ELSE 'M' END AS status FROM b FULL JOIN a USING (path) WHERE o IS DISTINCT FROM n"""),
    Plan("src16_full_scan", lambda s, d: rl.full_scan(t(s, d, "documents").select("source", "doc_id", F.length("text").alias("n")), ["source", "doc_id"], 100_000_000), "SELECT source, doc_id, length(text) AS n FROM documents ORDER BY source, doc_id"),
    Plan(
        "src17_keyset_page",
        lambda s, d: rl.keyset_page(t(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", None, 50).select("o_orderkey", "nth", "has_more"),
        "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS nth FROM orders) SELECT o_orderkey, CAST(nth AS INTEGER) AS nth, (SELECT count(*) FROM orders) > 50 AS has_more FROM p WHERE nth <= 50",
    ),
    Plan("src18_offset_page", lambda s, d: rl.offset_page(t(s, d, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), "c_custkey"], 20, 30), "SELECT c_custkey, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30 OFFSET 20"),
    Plan("src19_listing", lambda s, d: rl.listing(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("status"), "p_name", "p_type"), ["Brand#11", "Brand#12"], [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)], "A", ["p_name", "p_type"], [1, 2, 3]).select("id", "status"), "SELECT p_partkey AS id, p_brand AS status FROM part WHERE (p_brand IN ('Brand#11', 'Brand#12') AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))) OR p_partkey IN (1, 2, 3)"),
    Plan("src20_timeline", _timeline, "SELECT 'order:' || o_orderkey AS id, o_orderdate AS at, o_orderstatus AS action, CAST(o_custkey AS VARCHAR) AS actor, 'order' AS source FROM orders UNION ALL SELECT 'event:' || event_id, ts, event_type, CAST(user_id AS VARCHAR), 'event' FROM events"),
    Plan("snk1_upsert", lambda s, d: rl.merge_upsert(t(s, d, "customer").select("c_custkey", "c_acctbal"), t(s, d, "customer").where("c_custkey % 3 = 0").select("c_custkey", (-F.col("c_acctbal")).alias("c_acctbal")), ["c_custkey"]), "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer"),
    Plan("ag1_group", lambda s, d: _li(s, d).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), round_to(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last")), "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS mean, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2"),
    Plan("ag2_filtered_counts", lambda s, d: rl.filtered_counts(t(s, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"]), "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (o_orderstatus = 'O') AS \"n_O\", round(count(*) FILTER (o_orderstatus = 'F') * 1000 / count(*)) / 10 AS rate FROM orders GROUP BY 1"),
    Plan("ag3_having", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1"),
    Plan("ag4_first_of_each", lambda s, d: rl.first_of_each(t(s, d, "orders").select("o_custkey", "o_totalprice", "o_orderkey"), ["o_custkey"], ["o_totalprice", "o_orderkey"]), "SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey"),
    Plan("ag5_lists", lambda s, d: t(s, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ";").alias("priorities"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders")), "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1"),
    Plan("ag8_percentiles", lambda s, d: t(s, d, "events").groupBy("event_type").agg(*(round_to(F.percentile("value", F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99))), "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1"),
    Plan("ag11_document_health", _health, "WITH c AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT o_orderpriority, count(*) AS documents, count(*) FILTER (o_orderstatus = 'F') AS failed, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, round(coalesce(sum(q) / sum(n), 0), 6) AS mean_length FROM orders LEFT JOIN c ON k = o_orderkey GROUP BY 1"),
    Plan("ag13_inventory_fingerprint", lambda s, d: rl.inventory_fingerprint(_li(s, d), ["l_orderkey"], ["l_partkey", "l_linenumber"]), "SELECT l_orderkey, sha256(string_agg(l_partkey || ':' || l_linenumber, ';' ORDER BY l_partkey || ':' || l_linenumber)) AS fingerprint FROM lineitem GROUP BY 1"),
    Plan("ag15_facets", lambda s, d: rl.faceted(t(s, d, "orders").withColumn("st", F.when(F.col("o_orderstatus") == "F", "parsing").when(F.col("o_orderkey") % 2 == 0, "indexing").otherwise("ready")), "st"), "WITH f AS (SELECT CASE WHEN o_orderstatus = 'F' OR o_orderkey % 2 = 0 THEN 'processing' ELSE 'ready' END AS facet FROM orders) SELECT facet, count(*) AS n FROM f GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM f"),
    Plan("ag16_holding_private", lambda s, d: rl.holding_any(_li(s, d).groupBy("l_orderkey").agg(F.to_json(F.collect_list("l_partkey")).alias("ids")), "l_orderkey", "ids", t(s, d, "part").where("p_size < 5").select(F.col("p_partkey").alias("id"))), "SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 5"),
    Plan("ag17_statistics", lambda s, d: rl.column_statistics({n: t(s, d, n) for n in ("orders", "part", "documents")}, {"orders": F.col("o_orderstatus") == "F", "part": F.col("p_size") > 25}), "SELECT 'orders' AS name, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS matching FROM orders UNION ALL SELECT 'part', count(*), count(*) FILTER (p_size > 25) FROM part UNION ALL SELECT 'documents', count(*), count(*) FROM documents"),
    Plan("wn5_neighbours", lambda s, d: rl.neighbours(t(s, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role"), "SELECT conv_id, turn, role, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    Plan("wn7_carried", lambda s, d: rl.carried(t(s, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_id") % 4 == 0, F.col("event_type"))).select("event_id", "carried"), "SELECT event_id, last_value(CASE WHEN event_id % 4 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events"),
    Plan("jn3_semi", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"), "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"),
    Plan("jn4_anti", lambda s, d: t(s, d, "part").join(_li(s, d).where("l_returnflag = 'R' and l_quantity > 40"), F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey"), "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 40)"),
    Plan("jn2_left", lambda s, d: t(s, d, "customer").join(t(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n")), "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    Plan("jn8_array_membership", lambda s, d: t(s, d, "supplier").select("s_suppkey", F.explode(F.sequence("s_suppkey", F.col("s_suppkey") + 2)).alias("c_custkey")).join(t(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").select("s_suppkey", "c_custkey", "c_mktsegment"), "SELECT s_suppkey, c_custkey, c_mktsegment FROM supplier JOIN customer ON c_custkey BETWEEN s_suppkey AND s_suppkey + 2"),
    Plan("sl4_top_per_group", lambda s, d: t(s, d, "orders").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))).where("n <= 3").select("o_custkey", "o_orderkey", "n"), "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS n FROM orders) WHERE n <= 3"),
    Plan("st2_union", lambda s, d: t(s, d, "orders").select(F.col("o_custkey").alias("k")).union(t(s, d, "customer").where("c_acctbal > 0").select("c_custkey")).distinct(), "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0"),
    Plan("st3_difference", lambda s, d: t(s, d, "customer").select("c_custkey").subtract(t(s, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select("o_custkey")), "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'"),
    Plan("st4_intersection", lambda s, d: t(s, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").intersect(t(s, d, "orders").where("o_orderstatus = 'O'").select("o_custkey")), "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'"),
]
