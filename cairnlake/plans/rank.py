"""Queries on vectors and rank fusion. Orders stand for hits: a customer is a query, an order a chunk, its priority a channel."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.text import round_to
from cairnlake.operators import graph_index as gi
from cairnlake.operators import rank as rk
from cairnlake.operators import vector as vx
from cairnlake.plans.registry import Plan
from cairnlake.session import read_table as t
from cairnlake.session import written

CHANNEL = {"1-URGENT": "lexical", "2-HIGH": "vector", "3-MEDIUM": "graph", "4-NOT SPECIFIED": "sparse", "5-LOW": "title"}
HITS = """hits AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, o_orderkey % 97 AS doc_id, o_orderkey % 13 AS ord, o_totalprice / 500000 AS score,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'lexical' WHEN '2-HIGH' THEN 'vector' WHEN '3-MEDIUM' THEN 'graph' WHEN '4-NOT SPECIFIED' THEN 'sparse' ELSE 'title' END AS channel,
 o_orderstatus AS status FROM orders),
pairs AS (SELECT query_id, chunk_id, channel, score FROM hits UNION ALL SELECT query_id, chunk_id, 'late', 1 - score FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, chunk_id) AS position FROM hits)"""


def _hits(s, d):
    o = t(s, d, "orders")
    channel = F.coalesce(F.create_map(*(F.lit(x) for kv in CHANNEL.items() for x in kv))[F.col("o_orderpriority")], F.lit("title"))
    return o.select(
        F.col("o_custkey").alias("query_id"),
        F.col("o_orderkey").alias("chunk_id"),
        (F.col("o_orderkey") % 97).alias("doc_id"),
        (F.col("o_orderkey") % 13).alias("ord"),
        (F.col("o_totalprice") / 500000).alias("score"),
        channel.alias("channel"),
        F.col("o_orderstatus").alias("status"),
    )


def _placed(s, d):
    return rk.ordered(_hits(s, d))


def _both(s, d):
    h = _hits(s, d).select("query_id", "chunk_id", "channel", "score")
    return h.unionByName(h.select("query_id", "chunk_id", F.lit("late").alias("channel"), (1 - F.col("score")).alias("score")))


def _sql(body: str) -> str:
    return f"WITH {HITS} {body}"


FUSE_SQL = """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, chunk_id) AS rank FROM pairs WHERE score > 0)
SELECT query_id, chunk_id, round(sum(CASE channel WHEN 'graph' THEN 0.8 WHEN 'sparse' THEN 0.9 ELSE 1.0 END / (60 + rank)), 6) AS rrf, count(*) AS channels FROM r GROUP BY ALL"""


def _vectors(s, d):
    return t(s, d, "embeddings")


def _knn(s, d):
    v = _vectors(s, d)
    found = vx.knn(v.select("vec_id", "embedding"), v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, 0.3)
    return found.select("query_id", "vec_id", round_to(F.col("score"), 4).alias("score"), "rank")


COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
KNN_SQL = f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {COS.format("q.embedding", "v.embedding")} AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS INTEGER) AS rank FROM s WHERE score >= 0.3)
SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10"""
MEANS_SQL = "means AS (SELECT label, list(x ORDER BY place) AS centroid FROM (SELECT label, place, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding) AS x FROM embeddings) GROUP BY ALL) GROUP BY label)"


def _ivf(s, d):
    """Mean recall of every twentieth vector's ten nearest against all vectors, as exact search gives them."""
    v = _vectors(s, d).select("vec_id", "embedding")
    means, probes = vx.train_cells(v, 10)
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    recall = vx.recall_at_k(vx.knn(v, q, 10), vx.ivf_knn(v, q, means, 10, probes), 10)
    return recall.agg(F.count(F.lit(1)).alias("queries"), (F.avg("recall") >= 0.9).alias("reached"))


#: Filters of the graph search: the scopes that a query may read, of twenty (null: all).
FILTERS = {"all": None, "a quarter": 5, "a twentieth": 1}


def _graph(s, d):
    """A graph index of all vectors, searched for every twentieth one under each filter, against exact search."""
    v = _vectors(s, d).select("vec_id", "embedding", (F.col("vec_id") % 20).alias("scope"))
    index = written(gi.build(v, "scope"), "graph-index")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    out = None
    for name, n in FILTERS.items():
        first = (F.col("query_id") / 20).cast("long")
        scopes = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((first + i) % 20).cast("string")) if n else F.lit(None).cast("array<string>")
        asked = q.withColumn("scopes", scopes)
        found = written(gi.walked(index, asked, 10), "graph-hits")
        recall = vx.recall_at_k(vx.knn(v, asked, 10, scope="scope"), gi.hits(found, 10), 10)
        part = recall.join(gi.effort(found, index), "query_id").select(F.lit(name).alias("filter"), "query_id", round_to(F.col("recall")).alias("recall"), "short", round_to(F.col("distance_share")).alias("distance_share"), round_to(F.col("sketch_share")).alias("sketch_share"))
        out = part if out is None else out.unionByName(part)
    return out


def _graph_gate(s, d):
    g = _graph(s, d).groupBy("filter").agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.count_if("short").alias("short"))
    return g.select("filter", "queries", (F.col("recall") >= 0.95).alias("reached"), "short")


def _sparse(s, d):
    li = t(s, d, "lineitem")
    posts = li.groupBy(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % 500).alias("token")).agg(F.sum("l_quantity").alias("weight"))
    query = t(s, d, "part").select((F.col("p_partkey") % 20).alias("query_id"), (F.col("p_partkey") % 500).alias("token"), F.col("p_size").cast("double").alias("weight"))
    return vx.sparse_search(posts, query, 5).select("query_id", "chunk_id", round_to(F.col("score"), 3).alias("score"), "rank")


def _maxsim(s, d):
    v = _vectors(s, d).select("vec_id", "label", "embedding").withColumn("g", F.floor(F.col("vec_id") / 4))
    m = v.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("m"))
    other = m.select((F.col("g") - 1).alias("g"), F.col("m").alias("n"))
    return m.join(other, "g").select("g", round_to(vx.maxsim("m", "n"), 4).alias("maxsim"))


def _probes(s, d):
    h = _hits(s, d).select("query_id", F.col("doc_id").alias("chunk_id"), F.col("channel").alias("probe"), "score")
    return vx.merge_probes(h)


def _external(s, d):
    p = _placed(s, d)
    key = F.concat_ws(":", F.col("ord"))
    a = p.where("status <> 'F'").groupBy("query_id", "doc_id", key.alias("passage_key")).agg(F.min("position").alias("rank"))
    b = p.where("status <> 'O'").groupBy("query_id", "doc_id", key.alias("passage_key")).agg(F.min("position").alias("rank"))
    return rk.fuse_external(a, b).withColumn("rrf", round_to(F.col("rrf")))


def _route(s, d):
    q = t(s, d, "supplier").select(F.col("s_suppkey").alias("query_id"), F.array(F.lower(F.substring("s_name", 1, 3)), F.lower(F.substring("s_name", -2, 2)), F.lit("a")).alias("tokens"))
    kbs = t(s, d, "nation").select(F.col("n_nationkey").alias("kb_id"), F.col("n_name").alias("name"), F.concat("n_name", F.lit(" region "), F.col("n_regionkey").cast("string")).alias("description"))
    return rk.route(q, kbs).withColumn("points", F.col("points").cast("double"))


def _tail(s, d):
    p = _placed(s, d)
    engine = p.where("status = 'F'").withColumn("rank", F.row_number().over(rk.Window.partitionBy("query_id").orderBy("position")))
    return rk.append_tail(engine, p.select("query_id", "chunk_id", "score"))


def _rerank(s, d):
    p = _placed(s, d)
    scores = p.where("status = 'F'").select("query_id", "chunk_id", (1 - F.col("score")).alias("rerank"))
    return rk.apply_rerank(p, scores).select("query_id", "chunk_id", "measured", "final_rank")


def _budget(s, d):
    p = _placed(s, d).withColumn("group", F.col("channel")).withColumn("tokens", (F.col("doc_id") * 20 + 10).cast("long"))
    return rk.fit_budget(p, 3000).select("query_id", "chunk_id", "protected", F.col("granted").cast("double").alias("granted"))


def _source(h):
    return h.withColumn("score_source", F.when(F.col("status") == "F", "rerank").when(F.col("status") == "O", "synthetic").otherwise("native"))


PLANS = [
    Plan("vx1_exact_knn", _knn, KNN_SQL),
    Plan("vx2_ivf_recall", _ivf, "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0"),
    Plan(
        "vx3_sparse_search",
        _sparse,
        """WITH p AS (SELECT l_orderkey AS chunk_id, l_partkey % 500 AS token, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL),
q AS (SELECT p_partkey % 20 AS query_id, p_partkey % 500 AS token, sum(p_size::DOUBLE) AS qw FROM part GROUP BY ALL), s AS (SELECT query_id, chunk_id, sum(weight * qw) AS score FROM p JOIN q USING (token) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS INTEGER) AS rank FROM s) SELECT query_id, chunk_id, round(score, 3) AS score, rank FROM r WHERE rank <= 5""",
    ),
    Plan(
        "vx4_maxsim",
        _maxsim,
        f"""WITH p AS (SELECT q.vec_id, q.vec_id // 4 AS g, max(coalesce({COS.format("q.embedding", "v.embedding")}, 0.0)) AS m FROM embeddings q JOIN embeddings v ON q.vec_id // 4 + 1 = v.vec_id // 4 GROUP BY ALL)
SELECT g, round(avg(m), 4) AS maxsim FROM p GROUP BY g""",
    ),
    Plan("vx5_centroids", lambda s, d: vx.centroids(_vectors(s, d), ["label"]).select("label", F.posexplode("centroid").alias("place", "x")).withColumn("x", round_to(F.col("x"), 5)), f"WITH {MEANS_SQL} SELECT label, CAST(unnest(range(0, len(centroid))) AS INTEGER) AS place, round(unnest(centroid), 5) AS x FROM means"),
    Plan(
        "vx5_nearest_centroids",
        lambda s, d: vx.nearest_groups(vx.centroids(_vectors(s, d), ["label"]), "label", -1.0, 5).withColumn("score", round_to(F.col("score"), 4)),
        f"""WITH {MEANS_SQL}, s AS (SELECT a.label::BIGINT AS label, b.label::BIGINT AS neighbour, list_cosine_similarity(a.centroid, b.centroid) AS score FROM means a JOIN means b ON a.label <> b.label),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY round(score, 6) DESC, neighbour) AS INTEGER) AS rank FROM s WHERE score >= -1) SELECT label, neighbour, round(score, 4) AS score, rank FROM r WHERE rank <= 5""",
    ),
    Plan("vx7_window_clusters", lambda s, d: vx.window_clusters(_vectors(s, d).select("label", "vec_id", "embedding"), "label", "vec_id")),
    Plan("vx8_finite_vectors", lambda s, d: _vectors(s, d).select("vec_id", vx.is_finite("embedding").alias("ok")), "SELECT vec_id, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS ok FROM embeddings"),
    Plan("vx9_coverage", lambda s, d: vx.coverage(_vectors(s, d).withColumn("embedding", F.when(F.col("vec_id") % 7 > 0, F.col("embedding"))), ["label"]), "SELECT label, count(*) AS n, count(*) FILTER (vec_id % 7 = 0) AS missing FROM embeddings GROUP BY 1"),
    Plan("vx2_graph_recall", _graph),
    Plan("vx2_graph_gate", _graph_gate, "SELECT f AS filter, count(*) AS queries, true AS reached, 0 AS short FROM embeddings, (VALUES ('all'), ('a quarter'), ('a twentieth')) AS t(f) WHERE vec_id % 20 = 0 GROUP BY 1"),
    Plan("vx10_model_drift", lambda s, d: vx.model_drift(t(s, d, "customer").select(F.col("c_custkey").alias("kb_id"), F.col("c_mktsegment").alias("model")), "BUILDING"), "SELECT c_custkey AS kb_id, c_mktsegment AS model FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'"),
    Plan("vx11_merge_probes", _probes, _sql("SELECT query_id, doc_id AS chunk_id, max(score) AS score, arg_min(channel, struct_pack(a := -score, b := channel)) AS probe FROM hits GROUP BY ALL")),
    Plan("vx12_valid_vectors", lambda s, d: vx.valid_vectors(_vectors(s, d), "embedding", 64).select("vec_id", "ok", F.col("embedding").isNull().alias("dropped")), "SELECT vec_id, len(embedding) = 64 AS ok, len(embedding) <> 64 AS dropped FROM embeddings"),
    Plan("rk1_fusion", lambda s, d: rk.fuse(rk.channel_ranks(_both(s, d))).withColumn("rrf", round_to(F.col("rrf"))), _sql(FUSE_SQL)),
    Plan(
        "rk2_rank_tail",
        _tail,
        _sql(""", e AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS rank FROM placed WHERE status = 'F'), m AS (SELECT query_id, max(rank) AS o FROM e GROUP BY 1)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM e UNION ALL
SELECT p.query_id, p.chunk_id, CAST(coalesce(o, 0) + row_number() OVER (PARTITION BY p.query_id ORDER BY p.score DESC, p.chunk_id) AS INTEGER) FROM placed p LEFT JOIN m USING (query_id) WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.query_id = p.query_id AND e.chunk_id = p.chunk_id)"""),
    ),
    Plan(
        "rk3_boosts",
        lambda s, d: _hits(s, d).select("chunk_id", round_to(rk.boosted(F.col("score") - 0.3, F.col("channel") == "lexical", F.col("ord") % 3, F.col("status") == "F", F.col("doc_id") == 5, F.col("ord") % 2), 10).alias("score")),
        _sql("SELECT chunk_id, round(CASE WHEN score - 0.3 > 0 THEN score - 0.3 ELSE 0.0005 END * (CASE WHEN channel = 'lexical' THEN 1.08 ELSE 1.0 END + 0.8 * (ord % 3) + CASE WHEN status = 'F' THEN 1.0 ELSE 0 END + CASE WHEN doc_id = 5 THEN 2.0 ELSE 0 END + 0.5 * (ord % 2)), 10) AS score FROM hits"),
    ),
    Plan("rk4_order", lambda s, d: _placed(s, d).select("query_id", "chunk_id", "position"), _sql("SELECT query_id, chunk_id, CAST(position AS INTEGER) AS position FROM placed")),
    Plan(
        "rk5_document_quota",
        lambda s, d: rk.document_quota(_placed(s, d).withColumn("doc_id", F.col("doc_id") % 3), 2, 1, 0.5, 8).select("query_id", "chunk_id", "nth"),
        _sql(", a AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id % 3 ORDER BY position) AS n FROM placed), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS nth FROM a WHERE n <= CASE WHEN score >= 0.5 THEN 3 ELSE 2 END) SELECT query_id, chunk_id, CAST(nth AS INTEGER) AS nth FROM k WHERE nth <= 8"),
    ),
    Plan("rk6_normalise", lambda s, d: rk.normalised(_hits(s, d)).select("query_id", "chunk_id", "norm"), _sql("SELECT query_id, chunk_id, round(least(0.99, greatest(0.05, score / greatest(max(score) OVER (PARTITION BY query_id), 0.0001) * 0.95)), 3) AS norm FROM hits")),
    Plan(
        "rk7_neighbours",
        lambda s, d: rk.with_neighbours(_hits(s, d).select("query_id", "doc_id", "ord", "score"), _hits(s, d).select("doc_id", "ord").distinct()).withColumn("score", round_to(F.col("score"), 10)),
        _sql(", n AS (SELECT query_id, doc_id, ord + k AS ord, score * pow(0.85, abs(k)) AS score FROM hits, (VALUES (-1), (0), (1)) AS u(k)), c AS (SELECT DISTINCT doc_id, ord FROM hits) SELECT query_id, doc_id, ord, round(max(score), 10) AS score FROM n JOIN c USING (doc_id, ord) GROUP BY ALL"),
    ),
    Plan(
        "rk8_external_fusion",
        _external,
        _sql(""", a AS (SELECT query_id, doc_id, CAST(ord AS VARCHAR) AS passage_key, 1 / (60 + min(position)) AS a FROM placed WHERE status <> 'F' GROUP BY ALL), b AS (SELECT query_id, doc_id, CAST(ord AS VARCHAR) AS passage_key, 1 / (60 + min(position)) AS b FROM placed WHERE status <> 'O' GROUP BY ALL),
f AS (SELECT *, coalesce(a, 0) + coalesce(b, 0) AS r FROM a FULL JOIN b USING (query_id, doc_id, passage_key)),
w AS (SELECT *, count(a) OVER p > 0 AND count(b) OVER p > 0 AS dual_verified, max(b) OVER p AS mb, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r DESC, passage_key) AS n FROM f WINDOW p AS (PARTITION BY query_id, doc_id))
SELECT query_id, doc_id, passage_key, round(r + CASE WHEN dual_verified AND n = 1 THEN mb ELSE 0 END, 6) AS rrf, dual_verified FROM w"""),
    ),
    Plan(
        "rk11_coarse_pool",
        lambda s, d: rk.coarse_pool(_placed(s, d), 7, 1).select("query_id", "chunk_id", "pool_rank"),
        _sql(", h AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY position) <= 1 AS head FROM placed), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY head DESC, position) AS INTEGER) AS pool_rank FROM h) SELECT query_id, chunk_id, pool_rank FROM p WHERE pool_rank <= 7"),
    ),
    Plan(
        "rk12_apply_rerank",
        _rerank,
        _sql("SELECT query_id, chunk_id, status = 'F' AS measured, CAST(row_number() OVER (PARTITION BY query_id ORDER BY status = 'F' DESC, CASE WHEN status = 'F' THEN 1 - score END DESC NULLS LAST, position) AS INTEGER) AS final_rank FROM placed"),
    ),
    Plan(
        "rk13_probe_bands",
        lambda s, d: rk.band_probes(_hits(s, d).withColumn("is_probe", F.col("channel") == "graph")).select("query_id", "chunk_id", "banded"),
        _sql(""", b AS (SELECT *, min(CASE WHEN channel <> 'graph' THEN score END) OVER (PARTITION BY query_id) * 0.8 AS c, row_number() OVER (PARTITION BY query_id, channel = 'graph' ORDER BY score DESC, chunk_id) - 1 AS n FROM hits)
SELECT query_id, chunk_id, CASE WHEN channel = 'graph' AND c IS NOT NULL THEN round(greatest(0.01, c - n * 0.002), 4) ELSE score END AS banded FROM b"""),
    ),
    Plan("rk14_platt", lambda s, d: _hits(s, d).select("chunk_id", round_to(rk.platt(F.col("score"), 4.0, -2.0)).alias("p")), _sql("SELECT chunk_id, round(1 / (1 + exp(-(4.0 * score - 2.0))), 6) AS p FROM hits")),
    Plan(
        "rk16_diverse_heads",
        lambda s, d: rk.diverse_heads(_placed(s, d).withColumn("doc_id", F.col("doc_id") % 3), 6).select("query_id", "chunk_id", "pick"),
        _sql(", a AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id % 3 ORDER BY position) AS n FROM placed), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n = 1 THEN 0 ELSE 1 END, position) AS INTEGER) AS pick FROM a) SELECT query_id, chunk_id, pick FROM p WHERE pick <= 6"),
    ),
    Plan("rk18_measured", lambda s, d: _source(_hits(s, d)).select("chunk_id", rk.measured_score(F.col("score"), F.col("score_source")).alias("measured")), _sql("SELECT chunk_id, CASE WHEN status <> 'O' THEN score END AS measured FROM hits")),
    Plan("rk19_sufficiency", lambda s, d: rk.sufficient(_source(_hits(s, d)), 0.5), _sql("SELECT query_id, max(CASE WHEN status <> 'O' THEN score END) AS best, count(*) AS n, coalesce(max(CASE WHEN status <> 'O' THEN score END) >= 0.5, false) AS sufficient FROM hits GROUP BY 1")),
    Plan(
        "rk20_supporting",
        lambda s, d: rk.supporting(_source(_hits(s, d)), 0.6).select("query_id", "chunk_id"),
        _sql(", m AS (SELECT *, CASE WHEN status <> 'O' THEN score END AS m FROM hits), w AS (SELECT *, max(m) OVER (PARTITION BY query_id) AS x FROM m) SELECT query_id, chunk_id FROM w WHERE m IS NULL OR x IS NULL OR m >= 0.6 * x"),
    ),
    Plan(
        "rk22_fit_budget",
        _budget,
        _sql(""", a AS (SELECT *, doc_id * 20 + 10 AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY position) = 1 OR row_number() OVER (PARTITION BY query_id, channel ORDER BY position) = 1 AS protected FROM placed),
b AS (SELECT *, greatest(80.0, 2400.0 / count(*) FILTER (protected) OVER (PARTITION BY query_id)) AS most FROM a), c AS (SELECT *, CASE WHEN protected THEN least(tokens::DOUBLE, most) ELSE tokens END AS granted FROM b),
e AS (SELECT *, sum(granted) FILTER (protected) OVER (PARTITION BY query_id) AS reserved, sum(CASE WHEN protected THEN 0 ELSE granted END) OVER (PARTITION BY query_id ORDER BY position) AS running FROM c)
SELECT query_id, chunk_id, protected, granted::DOUBLE AS granted FROM e WHERE protected OR reserved + running <= 0.92 * 3000"""),
    ),
    Plan(
        "rk23_lost_in_the_middle",
        lambda s, d: rk.lost_in_the_middle(_placed(s, d)).select("query_id", "chunk_id", "place"),
        _sql(", n AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, position - 3 AS i FROM placed) SELECT query_id, chunk_id, CAST(CASE WHEN n <= 4 OR position <= 2 THEN position WHEN i % 2 = 0 THEN 3 + i // 2 ELSE n - i // 2 END AS INTEGER) AS place FROM n"),
    ),
    Plan(
        "rk24_guaranteed_documents",
        lambda s, d: rk.guaranteed_documents(_placed(s, d).withColumn("pool_rank", F.col("chunk_id")), _placed(s, d).where("position <= 2"), 4).select("query_id", "doc_id", "chunk_id"),
        _sql(""", a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(position)) AS n, row_number() OVER (PARTITION BY query_id ORDER BY min(chunk_id)) AS m FROM placed GROUP BY 1, 2),
w AS (SELECT query_id, doc_id FROM a WHERE n <= 4 OR m <= 4 EXCEPT SELECT query_id, doc_id FROM placed WHERE position <= 2), r AS (SELECT p.*, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY position) AS k FROM placed p JOIN w USING (query_id, doc_id)) SELECT query_id, doc_id, chunk_id FROM r WHERE k = 1"""),
    ),
    Plan(
        "rk27_context_budget",
        lambda s, d: _hits(s, d).select("chunk_id", rk.context_budget(F.col("status") == "F", F.when(F.col("ord") < 4, "simple").when(F.col("ord") < 7, "multi_hop").when(F.col("ord") < 9, "comparative").otherwise("global"), F.col("doc_id") % 7, F.col("ord") * 3).alias("budget")),
        _sql("SELECT chunk_id, CAST(greatest(3000, least(12000, CASE WHEN status = 'F' THEN 8000 ELSE 4500 END + CASE WHEN ord < 4 THEN 0 WHEN ord < 7 THEN 2500 WHEN ord < 9 THEN 2000 ELSE 1000 END + least(doc_id % 7, 4) * 750 + CASE WHEN ord * 3 > 20 THEN 1000 ELSE 0 END)) AS INTEGER) AS budget FROM hits"),
    ),
    Plan(
        "rk28_route",
        _route,
        """WITH q AS (SELECT s_suppkey AS query_id, unnest([lower(s_name[1:3]), lower(right(s_name, 2)), 'a']) AS token FROM supplier), k AS (SELECT n_nationkey AS kb_id, lower(n_name) AS name, lower(n_name || ' region ' || n_regionkey) AS description FROM nation),
s AS (SELECT query_id, kb_id, sum(CASE WHEN contains(name, token) THEN CASE WHEN length(token) >= 3 THEN 5.0 ELSE 3.0 END ELSE 0 END + CASE WHEN contains(description, token) THEN 1.5 ELSE 0 END)::DOUBLE AS points FROM q JOIN k ON contains(name, token) OR contains(description, token) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY points DESC, kb_id) AS INTEGER) AS priority FROM s WHERE points >= 2) SELECT * FROM r WHERE priority <= 3""",
    ),
    Plan(
        "rk31_version_conflicts",
        lambda s, d: rk.version_conflicts(t(s, d, "orders").withColumn("version", F.col("o_orderstatus")), ["o_custkey"]),
        "SELECT o_custkey, count(DISTINCT o_orderstatus) AS versions, min(o_orderstatus) AS oldest, max(o_orderstatus) AS newest FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1",
    ),
    Plan(
        "rk32_expand_sources",
        lambda s, d: rk.expand_sources(_hits(s, d).select("query_id", F.array("ord", F.col("ord") + 1, F.col("ord") + 2).alias("source_chunk_ids"), "score"), _hits(s, d).select("query_id", F.col("ord").alias("chunk_id"))),
        _sql(", w AS (SELECT query_id, unnest([ord, ord + 1, ord + 2]) AS chunk_id, score FROM hits) SELECT query_id, chunk_id, max(score) AS score FROM w WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_id = w.query_id AND h.ord = w.chunk_id) GROUP BY ALL"),
    ),
    Plan("rk33_rerank_text", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(rk.rerank_text(["source", "text"]).cast("binary")).alias("text_md5")), "SELECT doc_id, md5((source || chr(10) || text)[1:3000]) AS text_md5 FROM documents"),
    Plan(
        "rk35_summary_scores",
        lambda s, d: rk.summary_scores(_hits(s, d), _hits(s, d).select("doc_id").distinct().withColumn("summary_id", F.col("doc_id") + 1000)).withColumn("score", round_to(F.col("score"), 10)),
        _sql(", m AS (SELECT query_id, doc_id, max(score) AS b FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, doc_id) AS n FROM m) SELECT query_id, doc_id, doc_id + 1000 AS summary_id, round(0.88 * b, 10) AS score FROM r WHERE n <= 3"),
    ),
    Plan("rk36_config_fingerprint", lambda s, d: t(s, d, "orders").select("o_orderkey", rk.config_fingerprint(["o_orderkey", "o_orderstatus", "o_orderpriority"]).alias("fingerprint")), "SELECT o_orderkey, sha256(o_orderkey || ';' || o_orderstatus || ';' || o_orderpriority) AS fingerprint FROM orders"),
    Plan(
        "rk37_probe_scores",
        lambda s, d: rk.probe_scores(_placed(s, d).withColumn("probe", F.col("channel"))).select("query_id", "chunk_id", round_to(F.col("placed_score")).alias("placed_score")),
        _sql("SELECT query_id, chunk_id, round(greatest(0.72, 0.93 - 0.02 * (row_number() OVER (PARTITION BY query_id, channel ORDER BY position) - 1)), 6) AS placed_score FROM placed"),
    ),
]
