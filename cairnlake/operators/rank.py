"""Rank fusion, boosts, quotas, selection (RK1-RK33, RK35-RK37). Candidates are rows (query_id, chunk_id, ...); one row a hit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion and weights of its channels.
RRF_K = 60
CHANNELS = {"title": 1.0, "lexical": 1.0, "vector": 1.0, "graph": 0.8, "sparse": 0.9, "late": 1.0}


def channel_ranks(hits: DataFrame, score: str = "score") -> DataFrame:
    """WN3: ranks within each query and channel, best score first; only positive scores rank."""
    best = Window.partitionBy("query_id", "channel").orderBy(F.desc(score), "chunk_id")
    return hits.where(F.col(score) > 0).withColumn("rank", F.row_number().over(best))


def fuse(ranked: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """RK1, RK9, RK10: (query_id, chunk_id, rrf): sum of weight / (k + rank) over channels."""
    weights = CHANNELS if weights is None else weights
    w = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("channel")], F.lit(1.0))
    return ranked.groupBy("query_id", "chunk_id").agg(F.sum(w / (k + F.col("rank"))).alias("rrf"), F.count(F.lit(1)).alias("channels"))


def append_tail(engine: DataFrame, pool: DataFrame) -> DataFrame:
    """RK2: the engine's ranks, then chunks that only the pool scored, ranked after them: (query_id, chunk_id, rank)."""
    size = engine.groupBy("query_id").agg(F.max("rank").alias("offset"))
    tail = pool.where("score > 0").join(engine.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    rest = tail.withColumn("nth", nth).join(size, "query_id", "left").select("query_id", "chunk_id", (F.coalesce("offset", F.lit(0)) + F.col("nth")).cast("int").alias("rank"))
    return engine.select("query_id", "chunk_id", F.col("rank").cast("int").alias("rank")).unionByName(rest)


def boosted(rrf: Column, routed: Column, id_hits: Column, title_named: Column, clause_named: Column, domain_hits: Column) -> Column:
    """RK3: score after boosts; a chunk without any channel counts 0.0005. Routing multiplies, the others add."""
    boost = F.when(routed, 1.08).otherwise(1.0) + 0.8 * id_hits + F.when(title_named, 1.0).otherwise(0.0) + F.when(clause_named, 2.0).otherwise(0.0) + 0.5 * domain_hits
    return F.when(rrf > 0, rrf).otherwise(0.0005) * boost


def ordered(scored: DataFrame, score: str = "score") -> DataFrame:
    """RK4: adds position: score, then order in the document, then id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), F.coalesce("ord", F.lit(0)), "chunk_id")
    return scored.withColumn("position", F.row_number().over(w))


def document_quota(placed: DataFrame, per_doc: int = 10, extra: int = 2, strong: float = 0.03, limit: int = 15) -> DataFrame:
    """RK5, WN4: at most per_doc chunks of a document (extra more where the score is strong), ``limit`` of a query.

    Taken chunks of a document are its first ones: scores fall along positions, so a later chunk never has a wider quota."""
    within = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("position"))
    allowed = F.when(F.col("score") >= strong, per_doc + extra).otherwise(per_doc)
    kept = placed.withColumn("_n", within).where(F.col("_n") <= allowed).drop("_n")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    return kept.withColumn("nth", nth).where(F.col("nth") <= limit)


def normalised(scored: DataFrame, score: str = "score") -> DataFrame:
    """RK6: adds norm: score over the query's best, times .95, within .05 and .99, to three digits."""
    top = F.greatest(F.max(score).over(Window.partitionBy("query_id")), F.lit(0.0001))
    return scored.withColumn("norm", F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.05), F.greatest(F.lit(0.0), F.col(score) / top) * 0.95)), 3))


def with_neighbours(hits: DataFrame, chunks: DataFrame, span: int = 1, decay: float = 0.85) -> DataFrame:
    """RK7, JN10: hits and the chunks up to ``span`` before and after them, at decayed scores; a chunk keeps its best score."""
    near = hits.select("query_id", "doc_id", F.explode(F.sequence(F.col("ord") - span, F.col("ord") + span)).alias("ord"), "score", F.col("ord").alias("hit_ord"))
    steps = F.abs(F.col("ord") - F.col("hit_ord"))
    found = near.withColumn("score", F.col("score") * F.pow(F.lit(decay), steps)).join(chunks.select("doc_id", "ord"), ["doc_id", "ord"])
    return found.groupBy("query_id", "doc_id", "ord").agg(F.max("score").alias("score"))


def fuse_external(base: DataFrame, other: DataFrame, k: int = RRF_K, weight: float = 1.0) -> DataFrame:
    """RK8: two ranked lists of (query_id, doc_id, passage_key, rank) become one. A document in both lists is verified twice;
    its strongest passage of the fused list gets the best external increment once more."""
    a = base.select("query_id", "doc_id", "passage_key", (1 / (k + F.col("rank"))).alias("a"))
    b = other.select("query_id", "doc_id", "passage_key", (F.lit(weight) / (k + F.col("rank"))).alias("b"))
    fused = a.join(b, ["query_id", "doc_id", "passage_key"], "full_outer")
    both = Window.partitionBy("query_id", "doc_id")
    fused = fused.withColumn("rrf", F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).withColumn("dual_verified", (F.count("a").over(both) > 0) & (F.count("b").over(both) > 0))
    strongest = F.row_number().over(both.orderBy(F.desc("rrf"), "passage_key")) == 1
    bonus = F.when(F.col("dual_verified") & strongest, F.max("b").over(both)).otherwise(0.0)
    return fused.withColumn("rrf", F.col("rrf") + bonus).select("query_id", "doc_id", "passage_key", "rrf", "dual_verified")


def coarse_pool(merged: DataFrame, keep: int, heads: int = 3) -> DataFrame:
    """RK11: the pool that is reranked: first each channel's ``heads`` best, then the merged order, ``keep`` of a query."""
    head = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("position")) <= heads
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_head"), "position"))
    return merged.withColumn("_head", head).withColumn("pool_rank", nth).where(F.col("pool_rank") <= keep).drop("_head")


def apply_rerank(pool: DataFrame, scores: DataFrame) -> DataFrame:
    """RK12: order by an external model's scores (query_id, chunk_id, rerank); unscored rows follow in their old order, flagged."""
    out = pool.join(scores, ["query_id", "chunk_id"], "left").withColumn("measured", F.col("rerank").isNotNull())
    w = Window.partitionBy("query_id").orderBy(F.desc("measured"), F.desc("rerank"), "position")
    return out.withColumn("final_rank", F.row_number().over(w))


def band_probes(hits: DataFrame, scale: float = 0.8) -> DataFrame:
    """RK13: probe hits fall below the weakest primary hit: scale times its score, .002 less for each further one, .01 at least."""
    own = Window.partitionBy("query_id")
    ceiling = F.min(F.when(~F.col("is_probe"), F.col("score"))).over(own) * scale
    nth = F.row_number().over(Window.partitionBy("query_id", "is_probe").orderBy(F.desc("score"), "chunk_id")) - 1
    banded = F.when(F.col("is_probe") & ceiling.isNotNull(), F.round(F.greatest(F.lit(0.01), ceiling - nth * 0.002), 4)).otherwise(F.col("score"))
    return hits.withColumn("banded", banded)


def platt(score: Column, a: float, b: float) -> Column:
    """RK14: calibrated probability, the exponent clipped to 40 either way."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), a * score + b))))


def measured_score(score: Column, source: Column) -> Column:
    """RK18: only scores that a model or an index measured count against thresholds; others are null."""
    return F.when(source.isin("rerank", "native"), score)


def sufficient(candidates: DataFrame, floor: float) -> DataFrame:
    """RK19: for each query its best measured score and whether that reaches the floor."""
    best = F.max(measured_score(F.col("score"), F.col("score_source")))
    return candidates.groupBy("query_id").agg(best.alias("best"), F.count(F.lit(1)).alias("n")).withColumn("sufficient", F.coalesce(F.col("best") >= floor, F.lit(False)))


def supporting(candidates: DataFrame, share: float = 0.2) -> DataFrame:
    """RK20: rows of at least a share of the query's best measured score; rows without a measured score stay."""
    m = measured_score(F.col("score"), F.col("score_source"))
    top = F.max(m).over(Window.partitionBy("query_id"))
    return candidates.withColumn("_keep", m.isNull() | top.isNull() | (m >= share * top)).where("_keep").drop("_keep")


def diverse_heads(placed: DataFrame, limit: int, heads: int = 2) -> DataFrame:
    """RK16: first the best chunks of ``heads`` documents, then documents not seen yet, then the rest; ``limit`` of a query."""
    nth_in_doc = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("position"))
    out = placed.withColumn("_in_doc", nth_in_doc)
    group = F.when(F.col("_in_doc") == 1, 0).otherwise(1)
    pick = F.row_number().over(Window.partitionBy("query_id").orderBy(group, "position"))
    return out.withColumn("pick", pick).where(F.col("pick") <= limit).drop("_in_doc")


def fit_budget(placed: DataFrame, hard_cap: int, share: float = 0.92) -> DataFrame:
    """RK22: rows in order while their tokens fit the evidence budget; the first row of a query and of each group always stay."""
    cap = share * hard_cap
    own = Window.partitionBy("query_id").orderBy("position")
    protected = (F.row_number().over(own) == 1) | (F.row_number().over(Window.partitionBy("query_id", "group").orderBy("position")) == 1)
    out = placed.withColumn("protected", protected)
    n = F.sum(F.col("protected").cast("int")).over(Window.partitionBy("query_id"))
    most = F.greatest(F.lit(80.0), F.lit(0.8 * hard_cap) / n)
    out = out.withColumn("granted", F.when(F.col("protected"), F.least(F.col("tokens").cast("double"), most)).otherwise(F.col("tokens")))
    reserved = F.sum(F.when(F.col("protected"), F.col("granted"))).over(Window.partitionBy("query_id"))
    running = F.sum(F.when(~F.col("protected"), F.col("granted")).otherwise(0.0)).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_fits", F.col("protected") | (reserved + running <= cap)).where("_fits").drop("_fits")


def lost_in_the_middle(placed: DataFrame) -> DataFrame:
    """RK23: adds place: the first two stay; the others go to the two ends in turn. Four or fewer keep their order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    i = F.col("position") - 3  # among the rest, from zero
    turned = F.when(i % 2 == 0, 3 + F.floor(i / 2)).otherwise(n - F.floor(i / 2))
    return placed.withColumn("place", F.when((n <= 4) | (F.col("position") <= 2), F.col("position")).otherwise(turned).cast("int"))


def guaranteed_documents(placed: DataFrame, chosen: DataFrame, top: int = 5) -> DataFrame:
    """RK24: best chunk of documents that are among the ``top`` by score or by pool order and are not chosen yet."""
    def first(order: str) -> DataFrame:
        best = placed.groupBy("query_id", "doc_id").agg(F.min(order).alias("_o"))
        return best.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_o"))).where(F.col("_n") <= top).select("query_id", "doc_id")

    wanted = first("position").union(first("pool_rank")).distinct().join(chosen.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("position"))
    return placed.join(wanted, ["query_id", "doc_id"]).withColumn("_n", nth).where("_n = 1").drop("_n")


def context_budget(breadth: Column, complexity: Column, sub_queries: Column, evidence: Column, low: int = 3000, high: int = 12000) -> Column:
    """RK27: tokens of context by breadth, complexity, sub-questions and evidence."""
    base = F.when(breadth, 8000).otherwise(4500) + F.when(complexity == "multi_hop", 2500).when(complexity == "comparative", 2000).when(complexity != "simple", 1000).otherwise(0)
    return F.greatest(F.lit(low), F.least(F.lit(high), base + F.least(sub_queries, F.lit(4)) * 750 + F.when(evidence > 20, 1000).otherwise(0))).cast("int")


def route(queries: DataFrame, kbs: DataFrame, take: int = 3, at_least: float = 2.0) -> DataFrame:
    """RK28: for each query (query_id, tokens) the scopes (kb_id, name, description) its tokens name: 5 points for a token in
    the name of three and more characters, 3 for a shorter one, 1.5 in the description; best first, a priority only."""
    long = kbs.select("kb_id", F.lower("name").alias("name"), F.lower("description").alias("description"))
    hits = queries.select("query_id", F.explode("tokens").alias("token")).join(long, F.contains(F.col("name"), F.col("token")) | F.contains(F.col("description"), F.col("token")))
    points = F.when(F.contains(F.col("name"), F.col("token")), F.when(F.length("token") >= 3, 5.0).otherwise(3.0)).otherwise(0.0) + F.when(F.contains(F.col("description"), F.col("token")), 1.5).otherwise(0.0)
    scored = hits.groupBy("query_id", "kb_id").agg(F.sum(points).alias("points")).where(F.col("points") >= at_least)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("points"), "kb_id"))
    return scored.withColumn("priority", nth).where(F.col("priority") <= take)


def version_conflicts(docs: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """RK31, AG3: titles of which a scope holds more than one version."""
    return docs.groupBy(*keys).agg(F.countDistinct(version).alias("versions"), F.min(version).alias("oldest"), F.max(version).alias("newest")).where("versions > 1")


def expand_sources(summaries: DataFrame, present: DataFrame) -> DataFrame:
    """RK32: source chunks of summary hits (query_id, source_chunk_ids, score) that are not among the hits yet."""
    wide = summaries.select("query_id", F.explode("source_chunk_ids").alias("chunk_id"), "score")
    return wide.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).join(present.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


def config_fingerprint(values: list[Column | str]) -> Column:
    """RK36: sha256 of the values in fixed order."""
    return F.sha2(F.concat_ws(";", *(F.coalesce(F.col(v).cast("string") if isinstance(v, str) else v.cast("string"), F.lit("")) for v in values)).cast("binary"), 256)


def probe_scores(hits: DataFrame) -> DataFrame:
    """RK37: placement scores of probe hits by order: .93, less .02 for each further one, .72 at least."""
    i = F.row_number().over(Window.partitionBy("query_id", "probe").orderBy("position")) - 1
    return hits.withColumn("placed_score", F.greatest(F.lit(0.72), F.lit(0.93) - 0.02 * i))


def summary_scores(candidates: DataFrame, summaries: DataFrame, most: int = 3) -> DataFrame:
    """RK35: summaries (doc_id, summary_id) of at most ``most`` candidate documents, at .88 of the document's best score."""
    docs = candidates.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best"), "doc_id"))
    return docs.withColumn("_n", nth).where(F.col("_n") <= most).join(summaries, "doc_id").select("query_id", "doc_id", "summary_id", (0.88 * F.col("best")).alias("score"))


def rerank_text(parts: list[Column | str], most: int = 3000) -> Column:
    """RK33: what a reranker reads: the parts on lines of their own, cut to ``most`` characters (a limit of the model's contract)."""
    return F.substring(F.concat_ws("\n", *parts), 1, most)


def merged_pages(hits: DataFrame, broad: Column, focused_cap: int = 30, broad_cap: int = 60, k: int = 60) -> DataFrame:
    """RK34: pages (query_id, page, rrf, score, position) of several sources' ranks (query_id, page, rank, score): sums of 1 / (k + rank)
    to six places, ties by score with none last and then by page; a focused query keeps 30 pages, a broad one 60."""
    fused = hits.groupBy("query_id", "page").agg(F.round(F.sum(1 / (k + F.col("rank"))), 6).alias("rrf"), F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), F.desc_nulls_last("score"), "page")
    placed = fused.withColumn("position", F.row_number().over(order))
    return placed.where(F.col("position") <= F.when(broad, broad_cap).otherwise(focused_cap))


def merged_citations(hits: DataFrame) -> DataFrame:
    """DD9: one citation for each document of an answer: its best score and first place, and its distinct passages in the order cited.
    hits: (query_id, doc_id, chunk_id, position, score); a document's citations of one answer are few."""
    first = hits.groupBy("query_id", "doc_id", "chunk_id").agg(F.min("position").alias("position"), F.max("score").alias("score"))
    chunks = F.transform(F.array_sort(F.collect_list(F.struct("position", "chunk_id"))), lambda x: x["chunk_id"])
    return first.groupBy("query_id", "doc_id").agg(F.min("position").alias("position"), F.max("score").alias("score"), chunks.alias("chunk_ids"))
