"""Queries on graphs, chunks and grounding. Orders that share parts are the co-purchase graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.text import round_to
from cairnlake.operators import graph as gr
from cairnlake.operators import structure as st
from cairnlake.plans.registry import Plan
from cairnlake.session import read_table as t

EDGES = """edges AS (SELECT l_suppkey AS src, l_partkey % 40 + 1000 AS dst, CASE WHEN l_returnflag = 'R' THEN 'supersedes' ELSE 'relates' END AS kind, CAST(l_quantity AS DOUBLE) / 4 AS weight, l_orderkey AS doc_id FROM lineitem),
merged AS (SELECT src, dst, kind, least(max(weight), 10.0) AS weight, list_sort(list(DISTINCT doc_id)) AS doc_ids FROM edges WHERE src <> dst GROUP BY ALL)"""


def _edges(s, d):
    li = t(s, d, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 40 + 1000).alias("dst"), F.when(F.col("l_returnflag") == "R", "supersedes").otherwise("relates").alias("kind"), (F.col("l_quantity") / 4).alias("weight"), F.col("l_orderkey").alias("doc_id"))


def _chains(s, d):
    """Consecutive orders, linked unless the customer's number is a multiple of three: chains of all lengths."""
    o = t(s, d, "orders").where("o_custkey % 3 > 0")
    return gr.connected_components(o.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst")))


def _copurchase(s, d):
    """Orders and the parts they share: one large component and some small ones."""
    li = t(s, d, "lineitem")
    return gr.connected_components(li.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")))


def _relations(s, d):
    """Texts begun by a relation of every kind, under the document's own names."""
    said = F.concat(F.lit("# Part "), F.col("source"), F.lit("\nsee 《Rule "), F.col("doc_id").cast("string"), F.lit("》 and [["), F.col("lang"), F.lit("|here]]\nsupersedes \"Plan "), (F.col("doc_id") % 7).cast("string"), F.lit("\"\nby Blue River Inc, on Acme Data Platform\n\n"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"[#\[《]|\p{Lu}", "_")
    return gr.extract_relations(t(s, d, "documents").select("doc_id", F.concat(said, body).alias("text")), "doc_id", "text")


RELATIONS_SQL = """SELECT doc_id, kind, target, weight FROM (
SELECT doc_id, 'contains' AS kind, 'Part ' || source AS target, 1.5 AS weight FROM documents UNION ALL SELECT doc_id, 'references', 'Rule ' || doc_id, 2.0 FROM documents
UNION ALL SELECT doc_id, 'links', lang, 1.8 FROM documents UNION ALL SELECT doc_id, 'supersedes', 'Plan ' || doc_id % 7, 3.0 FROM documents
UNION ALL SELECT doc_id, 'mentions', 'Blue River Inc', 1.0 FROM documents UNION ALL SELECT doc_id, 'mentions', 'Acme Data Platform', 1.0 FROM documents) WHERE target IS NOT NULL"""


def _labels(s, d):
    """A component for every node of ``_edges``, each node once: suppliers from 1000 on share numbers with parts."""
    li = t(s, d, "lineitem")
    nodes = li.select(F.col("l_suppkey").alias("node")).unionByName(li.select((F.col("l_partkey") % 40 + 1000).alias("node")))
    return nodes.distinct().withColumn("component", F.col("node") % 4)


LABELS = "labels AS (SELECT DISTINCT l_suppkey AS node, l_suppkey % 4 AS component FROM lineitem UNION SELECT DISTINCT l_partkey % 40 + 1000, (l_partkey % 40 + 1000) % 4 FROM lineitem)"


def _local(s, d):
    seeds = t(s, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("node"))
    return gr.local_search(seeds, gr.merge_relations(_edges(s, d))).withColumn("score", round_to(F.col("score")))


def _chunk_arm(s, d):
    seeds = t(s, d, "supplier").select((F.col("s_suppkey") % 5).alias("query_id"), F.col("s_suppkey").alias("node"), (F.col("s_suppkey") % 2).alias("hop"))
    return gr.chunk_arm(seeds, gr.merge_relations(_edges(s, d)), 10).select("query_id", "chunk_id", round_to(F.col("score")).alias("score"), "hops", "rank")


def _aliases(s, d):
    c = t(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" x")).alias("name"), F.col("p_brand").alias("type"))
    known = t(s, d, "part").select((F.col("p_partkey") + 10000).alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"))
    ledger = c.where("id % 10 = 0").select(F.col("name").alias("alias"), F.col("id").alias("entity_id"))
    return gr.resolve_aliases(c, known, ledger).select("id", "how", "entity_id")


ALIASES_SQL = """WITH c AS (SELECT p_partkey AS id, p_name || ' x' AS name, p_brand AS type, p_name AS other, p_partkey + 10000 AS entity_id FROM part),
l AS (SELECT lower(name) AS k, id AS ledger_id FROM c WHERE id % 10 = 0), b AS (SELECT id, name, type, ledger_id FROM c LEFT JOIN l ON lower(name) = k),
g AS (SELECT b.id, c.entity_id, name_ AS a, c.other AS o, list_distinct([substr('  ' || lower(name_) || ' ', i, 3) FOR i IN range(1, length(name_) + 2)]) AS x, list_distinct([substr('  ' || lower(c.other) || ' ', i, 3) FOR i IN range(1, length(c.other) + 2)]) AS y
 FROM (SELECT DISTINCT id, name AS name_, type FROM b WHERE ledger_id IS NULL) b JOIN c USING (type)),
s AS (SELECT *, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS sim FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, entity_id) AS nth FROM s
 WHERE sim >= 0.86 OR least(length(a), length(o)) >= 4 AND (contains(lower(a), lower(o)) OR contains(lower(o), lower(a))) AND least(length(a), length(o)) >= 0.6 * greatest(length(a), length(o)))
SELECT b.id, CASE WHEN ledger_id IS NOT NULL THEN 'ledger' WHEN n.entity_id IS NOT NULL THEN 'similar' ELSE 'new' END AS how, coalesce(ledger_id, n.entity_id) AS entity_id FROM b LEFT JOIN n ON b.id = n.id AND nth = 1"""


def _chunks(s, d):
    return st.chunks(t(s, d, "documents").select("doc_id", "text"))


def _stitch(s, d):
    li = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 9).alias("ord")).agg(F.min("l_returnflag").alias("content"))
    return st.stitch(li)


def _rebuilt(s, d):
    """Whether the chunks of a text give back all of it but for white space."""
    bare = lambda c: F.md5(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "").cast("binary"))
    return st.rebuild(_chunks(s, d)).select("doc_id", bare(F.col("text")).alias("text_md5"))


def _quantities(s, d):
    li = t(s, d, "lineitem")
    unit = F.when(F.col("l_linestatus") == "O", "km").otherwise("m")
    claims = st.quantities(li.select(F.col("l_orderkey").alias("answer_id"), F.concat(F.lit("about "), F.col("l_quantity").cast("int").cast("string"), F.lit(" "), unit, F.lit(" long")).alias("text")), "answer_id", "text")
    evidence = st.quantities(li.select(F.col("l_orderkey").alias("answer_id"), F.concat((F.col("l_quantity").cast("int") * 1000).cast("string"), F.when(F.col("l_returnflag") == "R", " m").otherwise(" mm")).alias("text")), "answer_id", "text")
    return st.supported_quantities(claims, evidence)


def _coverage(s, d):
    q = t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))).alias("term"))
    hits = t(s, d, "documents").select((F.col("doc_id") % 40).alias("query_id"), "doc_id", "text").withColumn("rank", F.row_number().over(st.Window.partitionBy("query_id").orderBy("doc_id")))
    return st.coverage_sufficient(q, hits).withColumn("coverage", round_to(F.col("coverage")))


def _merge_units(s, d):
    li = t(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("unit")).agg(F.min("l_partkey").cast("string").alias("text"), F.max("l_returnflag").alias("f"))
    return st.merge_units(li.select("doc_id", "unit", "text"), li.where("f = 'R'").select("doc_id", "unit", F.lit("retried").alias("text"))).select("doc_id", "unit", "text", "retried", "start")


UNIT = "SELECT l_orderkey AS doc_id, l_linenumber AS unit, CAST(min(l_partkey) AS VARCHAR) AS text, max(l_returnflag) AS f FROM lineitem GROUP BY ALL"


PLANS = [
    Plan("gr1_extract_relations", _relations, RELATIONS_SQL),
    Plan("gr2_entity_type", lambda s, d: t(s, d, "supplier").select("s_suppkey", gr.entity_type(F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit(" Inc."))).when(F.col("s_suppkey") % 3 == 1, F.concat("s_name", F.lit(" System"))).otherwise(F.col("s_name"))).alias("kind")), "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'organisation' WHEN 1 THEN 'system' ELSE 'concept' END AS kind FROM supplier"),
    Plan("gr3_entity_key", lambda s, d: t(s, d, "part").select("p_partkey", gr.entity_key(F.concat(F.lit("  "), "p_name", F.lit("  X ")), "p_brand").alias("key")), "SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '  X ', '\\s+', ' ', 'g'))) || '|' || p_brand AS key FROM part"),
    Plan("gr4_merge_relations", lambda s, d: gr.merge_relations(_edges(s, d)).select("src", "dst", "kind", "weight", F.size("doc_ids").cast("long").alias("docs"), F.md5(F.array_join(F.transform("doc_ids", lambda x: x.cast("string")), ",").cast("binary")).alias("docs_md5")), f"WITH {EDGES} SELECT src, dst, kind, weight, len(doc_ids) AS docs, md5(array_to_string(doc_ids, ',')) AS docs_md5 FROM merged"),
    Plan("gr5_resolve_aliases", _aliases, ALIASES_SQL),
    Plan(
        "gr6_remove_document",
        lambda s, d: gr.remove_document(gr.merge_relations(_edges(s, d)), t(s, d, "supplier").select(F.col("s_suppkey").alias("id")), F.lit(7).cast("long"))[0].select("src", "dst", "kind", F.size("doc_ids").cast("long").alias("docs")),
        f"WITH {EDGES}, r AS (SELECT src, dst, kind, len(list_filter(doc_ids, lambda x: x <> 7)) AS docs FROM merged) SELECT * FROM r WHERE docs > 0",
    ),
    Plan("gr7_modularity", lambda s, d: gr.modularity(gr.merge_relations(_edges(s, d)), _labels(s, d)).withColumn("modularity", round_to(F.col("modularity"))), f"""WITH {EDGES}, {LABELS}, m AS (SELECT 2 * sum(weight) AS m2 FROM merged), deg AS (SELECT component, sum(weight) AS degree FROM (SELECT src AS node, weight FROM merged UNION ALL SELECT dst, weight FROM merged) JOIN labels USING (node) GROUP BY 1),
ins AS (SELECT a.component, 2 * sum(weight) AS inside FROM merged JOIN labels a ON src = a.node JOIN labels b ON dst = b.node WHERE a.component = b.component GROUP BY 1)
SELECT round(sum(coalesce(inside, 0) / m2 - (degree / m2) ** 2), 6) AS modularity FROM deg LEFT JOIN ins USING (component) CROSS JOIN m"""),
    Plan("gr7_communities", lambda s, d: gr.communities(gr.merge_relations(_edges(s, d)))),
    Plan(
        "gr8_components",
        _chains,
        """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders WHERE o_custkey % 3 > 0 UNION SELECT o_orderkey + 1, o_orderkey FROM orders WHERE o_custkey % 3 > 0),
r(node, reached) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a) SELECT node, min(reached) AS component FROM r GROUP BY 1""",
    ),
    Plan("gr8_copurchase_components", _copurchase),
    Plan("gr9_community_edges", lambda s, d: gr.community_edges(gr.merge_relations(_edges(s, d)), _labels(s, d)).withColumn("weight", round_to(F.col("weight"))), f"WITH {EDGES}, {LABELS} SELECT least(a.component, b.component) AS src, greatest(a.component, b.component) AS dst, round(sum(weight), 6) AS weight FROM merged JOIN labels a ON src = a.node JOIN labels b ON dst = b.node WHERE a.component <> b.component GROUP BY 1, 2"),
    Plan("gr10_community_keys", lambda s, d: gr.community_keys(_labels(s, d)), f"WITH {LABELS} SELECT component, md5(string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR))) AS member_key, count(*) AS size FROM labels GROUP BY 1"),
    Plan(
        "gr12_local_search",
        _local,
        f"""WITH {EDGES}, w AS (SELECT src, dst, CASE WHEN kind = 'supersedes' THEN weight * 0.3 ELSE weight END AS w FROM merged), b0 AS (SELECT node, next, max(w) AS w FROM (SELECT src AS node, dst AS next, w FROM w UNION ALL SELECT dst, src, w FROM w) GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, next) AS n FROM b0) WHERE n <= 5), h0 AS (SELECT s_suppkey AS query_id, s_suppkey AS node, 1.0::DOUBLE AS score FROM supplier),
h1 AS (SELECT query_id, next AS node, max(score * w / 10.0) AS score FROM h0 JOIN b USING (node) GROUP BY ALL), h2 AS (SELECT query_id, next AS node, max(score * w / 10.0) AS score FROM h1 JOIN b USING (node) GROUP BY ALL),
a AS (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY hop, score DESC) AS n FROM a) SELECT query_id, node, hop, round(score, 6) AS score FROM r WHERE n = 1""",
    ),
    Plan(
        "gr13_chunk_arm",
        _chunk_arm,
        f"""WITH {EDGES}, seeds AS (SELECT s_suppkey % 5 AS query_id, s_suppkey AS node, s_suppkey % 2 AS hop FROM supplier), o AS (SELECT query_id, src, dst, kind, max(weight) AS weight, any_value(doc_ids) AS doc_ids, min(hop) AS hop FROM (SELECT * FROM merged JOIN seeds ON src = node UNION ALL SELECT * FROM merged JOIN seeds ON dst = node) GROUP BY 1, 2, 3, 4),
c AS (SELECT query_id, chunk_id, sum(weight) AS score, min(hop) AS hops FROM (SELECT query_id, unnest(doc_ids) AS chunk_id, weight, hop FROM o) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hops, chunk_id) AS INTEGER) AS rank FROM c)
SELECT query_id, chunk_id, round(score, 6) AS score, hops, rank FROM r WHERE rank <= 10""",
    ),
    Plan(
        "gr16_project_shards",
        lambda s, d: gr.project_shards(t(s, d, "orders").where("o_orderkey % 5 > 0").select("o_orderkey", F.md5(F.col("o_orderstatus").cast("binary")).alias("fingerprint")), t(s, d, "orders").where("o_orderkey % 7 > 0").select("o_orderkey", F.md5(F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).cast("binary")).alias("fingerprint")), "o_orderkey"),
        "WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 7 > 0 THEN 'new' WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 = 0 THEN 'gone' WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 3 = 0 AND o_orderstatus <> 'F' THEN 'changed' END AS change FROM orders) SELECT * FROM c WHERE change IS NOT NULL",
    ),
    Plan(
        "gr17_co_mentions",
        lambda s, d: gr.co_mentions(t(s, d, "lineitem"), "l_orderkey", "l_partkey", 40, 2),
        """WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), k AS (SELECT l_partkey FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 40), r AS (SELECT * FROM m WHERE l_partkey IN (SELECT l_partkey FROM k))
SELECT a.l_orderkey AS doc_a, b.l_orderkey AS doc_b, count(*) AS shared FROM r a JOIN r b USING (l_partkey) WHERE a.l_orderkey < b.l_orderkey GROUP BY 1, 2 HAVING count(*) >= 2""",
    ),
    Plan("ch4_chunks", lambda s, d: _chunks(s, d).select("doc_id", "ord", "char_start", "char_end", "token_count", F.md5(F.col("content").cast("binary")).alias("content_md5"))),
    Plan("ch9_indexable", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(st.indexable(F.concat(F.lit("<!-- bbox: 1,2 -->\n\n\n\n"), "text")).cast("binary")).alias("text_md5")), "SELECT doc_id, md5(trim(regexp_replace(chr(10) || chr(10) || chr(10) || chr(10) || text, '\\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM documents"),
    Plan("ch10_blocks", lambda s, d: st.canonical_block(_chunks(s, d))),
    Plan("ch11_table_role", lambda s, d: t(s, d, "part").select("p_partkey", st.table_role(F.col("p_size"), F.when(F.col("p_size") % 5 == 0, "汇总").otherwise(F.col("p_name")), F.lit("")).alias("role")), "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'summary' WHEN p_size > 0 AND p_size <= 8 THEN 'summary' WHEN p_size > 20 THEN 'detail' ELSE 'unknown' END AS role FROM part"),
    Plan(
        "ch12_outline",
        lambda s, d: st.outline(t(s, d, "documents").select("doc_id", F.concat(F.lit("# Top\n```\n# not\n```\n## "), "source", F.lit("\n"), "text", F.lit("\n# Top")).alias("text")), "doc_id", "text").select("doc_id", "level", "heading", "line_no"),
        "SELECT doc_id, 1 AS level, 'Top' AS heading, 0 AS line_no FROM documents UNION ALL SELECT doc_id, 2, source, 4 FROM documents",
    ),
    Plan("ch13_section_multiplier", lambda s, d: t(s, d, "orders").select("o_orderkey", round_to(st.section_multiplier(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 3 == 1, F.when(F.col("o_orderkey") % 2 == 0, "summary").otherwise("detail"), F.col("o_custkey") % 2 == 0, F.col("o_custkey") * 10)).alias("m")), "SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN 1.35 WHEN 1 THEN 1.15 ELSE 1.0 END * CASE WHEN o_custkey % 2 = 0 AND o_orderkey % 2 = 0 THEN 1.25 WHEN o_custkey % 2 = 0 AND o_custkey * 10 > 800 AND o_orderkey % 3 = 2 THEN 0.85 ELSE 1.0 END, 6) AS m FROM orders"),
    Plan("ch15_windows", lambda s, d: st.pack_windows(t(s, d, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("n")), "l_suppkey", "o", "n", 500).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "window").distinct(), "SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(floor((sum(l_quantity::BIGINT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) - 1) / 500) AS INTEGER) AS \"window\" FROM lineitem"),
    Plan("ch17_sibling_ranges", lambda s, d: st.sibling_ranges(t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")), t(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord")).distinct(), 1), "WITH r AS (SELECT l_orderkey AS doc_id, min(l_linenumber) - 1 AS lo, max(l_linenumber) + 1 AS hi FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT DISTINCT doc_id, l_linenumber AS ord FROM lineitem JOIN r ON l_orderkey = doc_id WHERE l_linenumber BETWEEN lo AND hi"),
    Plan(
        "ch18_stitch",
        _stitch,
        """WITH c AS (SELECT l_orderkey AS doc_id, l_partkey % 9 AS ord, min(l_returnflag) AS content FROM lineitem GROUP BY ALL), i AS (SELECT *, ord - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM c)
SELECT doc_id, min(ord) AS first_ord, max(ord) AS last_ord, string_agg(content, chr(10) ORDER BY ord) AS content FROM i GROUP BY doc_id, island""",
    ),
    Plan("ch21_rebuild", _rebuilt, r"SELECT doc_id, md5(regexp_replace(text, '[\s\v]+', '', 'g')) AS text_md5 FROM documents WHERE regexp_matches(text, '\S')"),
    Plan("ch22_merge_units", _merge_units, f"WITH o AS ({UNIT}), m AS (SELECT doc_id, unit, CASE WHEN f = 'R' THEN 'retried' ELSE text END AS text, f = 'R' AS retried FROM o) SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM m"),
    Plan(
        "rp2_sections",
        lambda s, d: st.group_sections(t(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 1000).alias("ord"), F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("section"))).withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",")),
        "SELECT o_custkey AS doc_id, o_orderpriority AS section, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey % 1000, o_orderkey) AS chunk_ids, min(o_orderkey % 1000) AS first_ord FROM orders GROUP BY ALL",
    ),
    Plan("rp3_summary", lambda s, d: t(s, d, "documents").select("doc_id", st.extractive_summary("text").alias("summary")), r"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_extract_all(text, '[^.!?。！？\n]+[.!?。！？]?'), lambda x: length(trim(x)) >= 10)[1:4], lambda x: trim(x)), ' ')[1:1800] AS summary FROM documents"),
    Plan("gd1_numeric_claims", lambda s, d: t(s, d, "documents").select("doc_id", F.array_join(st.numeric_claims("text"), ",").alias("claims"))),
    Plan(
        "gd2_supported_quantities",
        _quantities,
        """WITH c AS (SELECT DISTINCT l_orderkey AS a, l_quantity::INT * CASE WHEN l_linestatus = 'O' THEN 1000 ELSE 1 END AS v FROM lineitem), e AS (SELECT DISTINCT l_orderkey AS a, CASE WHEN l_returnflag = 'R' THEN l_quantity::INT * 1000 ELSE l_quantity::INT END AS v FROM lineitem)
SELECT c.a AS answer_id, count(*) AS claims, count(e.v) AS supported FROM c LEFT JOIN e ON c.a = e.a AND c.v = e.v GROUP BY 1""",
    ),
    Plan("gd4_char_overlap", lambda s, d: t(s, d, "part").select("p_partkey", round_to(st.char_overlap(F.col("p_name"), F.col("p_type"))).alias("overlap")), """WITH c AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}]')) AS b FROM part)
SELECT p_partkey, round(CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(a) END, 6) AS overlap FROM c"""),
    Plan("gd6_valid_markers", lambda s, d: t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", st.valid_markers(F.concat(F.lit("see ["), F.col("l_linenumber").cast("string"), F.lit("] and [99] ok")), F.lit(3)).alias("text")), "SELECT l_orderkey, l_linenumber, l_partkey, 'see ' || CASE WHEN l_linenumber BETWEEN 1 AND 3 THEN '[' || l_linenumber || ']' ELSE '' END || ' and  ok' AS text FROM lineitem"),
    Plan(
        "gd7_compress_history",
        lambda s, d: st.compress_history(t(s, d, "conversations"), "conv_id", "turn", "text", 2, 40, 400).select("conv_id", "turn", "age", "kept_text"),
        """WITH a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations), k AS (SELECT *, CASE WHEN age <= 2 OR length(text) <= 40 THEN text ELSE text[1:24] || ' … ' || right(text, 16) END AS kept_text FROM a),
z AS (SELECT *, sum(length(kept_text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS size FROM k) SELECT conv_id, turn, CAST(age AS INTEGER) AS age, kept_text FROM z WHERE size <= 400 OR age = 1""",
    ),
    Plan("gd8_aspects", lambda s, d: t(s, d, "benchmark").select("item_id", F.array_join(F.array_sort(st.aspects("text")), " ").alias("aspects")), f"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{{4,}}'), lambda w: w NOT IN {st.STOP}))), ' ') AS aspects FROM benchmark"),
    Plan("gd9_complexity", lambda s, d: t(s, d, "conversations").select("conv_id", "turn", st.complexity("text").alias("complexity")), """SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(compare|versus|vs\\.?|difference between)\\b|对比|区别|相比') THEN 'comparative' WHEN regexp_matches(lower(text), '\\b(whose|of the \\w+ (that|who|which))\\b|的.*的') THEN 'multi_hop'
WHEN regexp_matches(lower(text), '\\b(overall|summari[sz]e|overview|in general)\\b|总体|概述|总结') THEN 'global' ELSE 'simple' END AS complexity FROM conversations"""),
    Plan("gd10_relation", lambda s, d: t(s, d, "part").select("p_partkey", st.relation_of(F.concat(F.lit("What is the brand of "), "p_brand", F.lit("?"))).alias("r")).select("p_partkey", "r.relation", "r.subject"), "SELECT p_partkey, 'brand' AS relation, regexp_extract(p_brand, '^([\\w ]{2,60})', 1) AS subject FROM part"),
    Plan(
        "gd11_sufficiency",
        _coverage,
        """WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{6,}'))) AS term FROM benchmark), h AS (SELECT * FROM (SELECT doc_id % 40 AS query_id, doc_id, lower(text) AS t, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS r FROM documents) WHERE r <= 8),
f AS (SELECT query_id, count(DISTINCT term) AS n FROM q JOIN h USING (query_id) WHERE contains(t, term) GROUP BY 1), n AS (SELECT query_id, count(*) AS terms FROM q GROUP BY 1), d AS (SELECT query_id, count(DISTINCT doc_id) AS docs FROM h GROUP BY 1)
SELECT query_id, round(coalesce(n, 0) / terms, 6) AS coverage, coalesce(n, 0) >= 0.8 * terms AND coalesce(docs, 0) >= 2 AS sufficient FROM n LEFT JOIN f USING (query_id) LEFT JOIN d USING (query_id)""",
    ),
]
