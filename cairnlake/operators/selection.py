"""Evidence selection, query planning and answer checks (RK17, RK21, RK25-RK30, TQ8-TQ12, GD3, GD5, LX15, GR11, GR14, GR15, RP6, CH14, CH19, CH20)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from cairnlake.functions.text import count_of, family_key, grams, jaccard
from cairnlake.operators.structure import aspects

#: RK17: fixed values: floors of measured scores, weight of relevance, share of a document.
FLOOR, SOFT_FLOOR, LAMBDA, DOC_SHARE = 0.35, 0.22, 0.72, 0.55


def select_evidence(candidates: DataFrame, budget: int, floor: float = FLOOR, soft: float = SOFT_FLOOR, lam: float = LAMBDA) -> DataFrame:
    """RK17, in part (see README): (query_id, chunk_id, pick) by maximal marginal relevance under a token budget.

    candidates: query_id, chunk_id, doc_id, score, measured (null if no model or index measured it), tokens, terms (array).
    Rows under the floor go, unless a query has none over it: then the soft floor counts. A document takes at most
    DOC_SHARE of the budget. Every row is weighed: a query's rows stream in order of score, and a pick is made once no row
    to come can beat it; rows that no longer fit are let go at once, and reading ends when the shortest row cannot fit."""
    own = Window.partitionBy("query_id")
    best = F.max("measured").over(own)
    limit = F.when(best >= floor, floor).otherwise(soft)
    kept = candidates.withColumn("_ok", F.coalesce(F.col("measured") >= limit, F.lit(True))).where("_ok")
    kept = kept.withColumn("_least", F.min("tokens").over(own))
    columns = ["query_id", "chunk_id", "doc_id", "score", "tokens", "terms", "_least"]
    schema = StructType([candidates.schema["query_id"], candidates.schema["chunk_id"], StructField("pick", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mmr = None
        for batch in batches:
            out = []
            queries = batch.column(0).to_pylist()
            at = 0
            while at < len(queries):
                end = next((i for i in range(at, len(queries)) if queries[i] != queries[at]), len(queries))
                if mmr is None or mmr.query != queries[at]:
                    if mmr is not None:
                        out += mmr.finish()
                    mmr = _Mmr(queries[at], budget, lam)
                if not mmr.done:
                    for row in batch.slice(at, end - at).to_pylist():
                        out += mmr.read(row)
                        if mmr.done:
                            break
                at = end
            if out:
                yield _picks(out, batch.schema)
        if mmr is not None and (out := mmr.finish()):
            yield _picks(out, batch.schema)

    ordered = kept.select(*columns).repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "chunk_id")
    return ordered.mapInArrow(run, schema)


def _picks(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    query, chunk, pick = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(query, schema.field(0).type), pa.array(chunk, schema.field(1).type), pa.array(pick, pa.int32())], names=["query_id", "chunk_id", "pick"])


class _Mmr:
    """Maximal marginal relevance over one query's rows, which come in order of score. Rows that do not fit never will
    later, since what is spent only grows, and are no longer held."""

    def __init__(self, query, budget: int, lam: float) -> None:
        self.query, self.budget, self.lam = query, budget, lam
        self.top, self.spent, self.n, self.done = None, 0, 0, False
        self.of_doc, self.picked, self.pool = {}, [], []

    def fits(self, row: dict) -> bool:
        if self.spent + row["tokens"] > self.budget:
            return False
        return not self.n or self.of_doc.get(row["doc_id"], 0) + row["tokens"] <= DOC_SHARE * self.budget

    def read(self, row: dict) -> list[tuple]:
        """Picks that this and all later rows cannot change, then the row joins the pool."""
        score = -math.inf if row["score"] is None else row["score"]
        if self.top is None:
            self.top = score if math.isfinite(score) and score else 1.0
        row["_relevance"] = self.lam * score / self.top
        # A top under zero turns the order around: then no bound holds before the end.
        out = self.take(row["_relevance"] if self.top > 0 else math.inf)
        if self.spent + row["_least"] > self.budget:
            self.done, self.pool = True, []
        elif self.fits(row):
            row["_set"] = set(row["terms"])
            row["_overlap"] = max((_alike(row["_set"], s) for s in self.picked), default=0.0)
            self.pool.append(row)
        return out

    def take(self, bound: float) -> list[tuple]:
        out = []
        while self.pool:
            value = lambda k: self.pool[k]["_relevance"] - (1 - self.lam) * self.pool[k]["_overlap"]
            best = max(range(len(self.pool)), key=lambda k: (value(k), -k))
            if value(best) < bound:
                break
            row = self.pool.pop(best)
            self.spent, self.n = self.spent + row["tokens"], self.n + 1
            self.of_doc[row["doc_id"]] = self.of_doc.get(row["doc_id"], 0) + row["tokens"]
            self.picked.append(row["_set"])
            out.append((self.query, row["chunk_id"], self.n))
            self.pool = [r for r in self.pool if self.fits(r)]
            for r in self.pool:
                r["_overlap"] = max(r["_overlap"], _alike(row["_set"], r["_set"]))
        return out

    def finish(self) -> list[tuple]:
        return self.take(-math.inf)


def _alike(a: set, b: set) -> float:
    either = len(a | b)
    return len(a & b) / either if either else 0.0


def structured_order(chosen: DataFrame) -> DataFrame:
    """RK21: place of evidence: the best row, then the best of each sub-question, then bridges, then the rest, by score."""
    own, sub = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"), Window.partitionBy("query_id", "sub_question").orderBy(F.desc("score"), "chunk_id")
    group = F.when(F.row_number().over(own) == 1, 0).when(F.col("sub_question").isNotNull() & (F.row_number().over(sub) == 1), 1).when(F.col("is_bridge"), 2).otherwise(3)
    out = chosen.withColumn("_g", group)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_g", F.desc("score"), "chunk_id"))).drop("_g")


def missing_aspects(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """RK25, CH14: aspects (query_id, aspect) of questions that no evidence text of the query holds."""
    wanted = questions.select("query_id", F.explode(aspects("text")).alias("aspect"))
    held = wanted.join(evidence.select("query_id", F.lower("text").alias("t")), "query_id").where(F.contains(F.col("t"), F.col("aspect"))).select("query_id", "aspect").distinct()
    return wanted.join(held, ["query_id", "aspect"], "left_anti")


def bridge_titles(names: DataFrame, titles: DataFrame) -> DataFrame:
    """RK25: documents whose title equals a name (query_id, name) found in evidence, whatever its case.

    Repeated names and titles go before they meet, so that no pair comes twice."""
    asked = names.select("query_id", "name").distinct().withColumn("_t", F.lower("name"))
    return asked.join(titles.select(F.lower("title").alias("_t"), "doc_id").distinct(), "_t").select("query_id", "name", "doc_id")


def supporting_sentences(evidence: DataFrame, questions: DataFrame, key: str = "chunk_id", least: int = 2, take: int = 3) -> DataFrame:
    """RK26: sentences of each evidence row that hold at least ``least`` aspects of the question; the ``take`` best of a query."""
    rows = evidence.select("query_id", key, F.posexplode(F.split("text", r"(?<=[.!?。！？])\s+|\n")).alias("pos", "sentence")).join(questions.select("query_id", aspects("text").alias("_a")), "query_id")
    scored = rows.withColumn("hits", F.size(F.filter("_a", lambda w: F.contains(F.lower("sentence"), w)))).where(F.col("hits") >= least)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), key, "pos"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= take).select("query_id", key, "pos", "sentence", "hits", "nth")


def tier(sub_questions: Column, complexity: Column, scopes: Column) -> Column:
    """RK29: fast, standard or deep."""
    return F.when((complexity == "simple") & (sub_questions <= 1) & (scopes <= 3), "fast").when(complexity.isin("multi_hop", "global") | (sub_questions > 3), "deep").otherwise("standard")


def sibling_chunks(anchors: DataFrame, docs: DataFrame, chunks: DataFrame, question: Column, at_least: float = 0.18) -> DataFrame:
    """RK30: for each anchor (query_id, doc_id, text) and sibling edition the chunk most like it: .75 of the Jaccard of character
    pairs with the anchor and .25 of the question's pairs that it holds."""
    bare = lambda t: F.coalesce(F.regexp_replace(t, r"[\s\p{P}\p{S}]+", ""), F.lit(""))
    fam = docs.select("doc_id", family_key("title").alias("family"))
    own = anchors.join(fam, "doc_id").select("query_id", F.col("doc_id").alias("anchor_doc"), "family", bare("text").alias("_a"), bare(question).alias("_q")).distinct()
    own = own.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy("query_id", "anchor_doc")) > 1)
    sib = chunks.join(fam, "doc_id").select("doc_id", "chunk_id", "family", bare("text").alias("_c"))
    # Texts are compared once however many anchors and chunks hold them, then each document's best chunk is taken for each text of an
    # anchor; anchors and documents meet last, where nothing is left to sort.
    met = own.select("family", "_a", "_q").distinct().join(sib.select("family", "_c").distinct(), "family")
    many = 4 * anchors.sparkSession.sparkContext.defaultParallelism  # pairs of texts are few rows and much work
    left = own.select("_a", "_q").distinct().select("_a", "_q", grams(F.col("_a"), 2).alias("_ga"), grams(F.col("_q"), 2).alias("_gq"))
    right = sib.select("_c").distinct().select("_c", grams(F.col("_c"), 2).alias("_gc"))
    pairs = met.select("_a", "_q", "_c").distinct().repartition(many, "_a", "_c").join(left, ["_a", "_q"]).join(right, "_c")
    covered = F.when(F.size("_gq") == 0, 0.0).otherwise(F.size(F.array_intersect("_gq", "_gc")) / F.size("_gq"))
    scored = pairs.select("_a", "_q", "_c", (0.75 * jaccard(F.col("_ga"), F.col("_gc")) + 0.25 * covered).alias("score")).where(F.col("score") >= at_least)
    best = met.join(scored, ["_a", "_q", "_c"]).join(sib, ["family", "_c"]).groupBy("family", "_a", "_q", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("low"), "chunk_id")).alias("b"))
    found = own.join(best, ["family", "_a", "_q"]).where("doc_id <> anchor_doc")
    pair = ["query_id", "anchor_doc", "doc_id"]
    # Only a document that is a query's anchor by several texts has more than one row for a sibling.
    one = found.where("_several").groupBy(*pair).agg(F.min("b").alias("b")).unionByName(found.where("not _several").select(*pair, "b"))
    return one.select(*pair, F.col("b.chunk_id").alias("chunk_id"), (-F.col("b.low")).alias("score"))


#: TQ8: fixed values: phrases of refusal.
DENIAL = r"(?i)(no (relevant )?(information|evidence|mention|data)|not (mentioned|specified|found|provided|available|stated)|cannot (be )?(determine|answer|confirm)|unable to|does not (say|mention|specify|contain)|未提及|没有提到|无法确定|未找到)"


def is_refusal(text: Column | str) -> Column:
    """TQ8: a denial stands in the text, no clause before the first one holds a figure, and every clause after it denies too."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    clauses = F.filter(F.split(t, r"[.;!?。；！？\n]+"), lambda c: F.trim(c) != "")
    denies = F.transform(clauses, lambda c: c.rlike(DENIAL))
    first = F.array_position(denies, F.lit(True))
    before = F.slice(clauses, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))
    after = F.slice(denies, F.greatest(first, F.lit(1)).cast("int"), F.size(denies))
    return (first > 0) & ~F.exists(before, lambda c: c.rlike(r"\d")) & F.forall(after, lambda d: d)


COVERAGE = "struct<total:int,processed:int,failed:int,skipped:int>"


def parse_coverage(meta: Column | str) -> Column:
    """TQ9: struct(total, processed, failed, skipped, incomplete) of a parser's JSON; counts below zero or missing are zero."""
    c = F.from_json(meta, COVERAGE)
    n = lambda k: F.greatest(F.coalesce(c[k], F.lit(0)), F.lit(0))
    return F.struct(*(n(k).alias(k) for k in ("total", "processed", "failed", "skipped")), ((n("failed") > 0) | (n("skipped") > 0) | (n("processed") < n("total"))).alias("incomplete"))


def asks_for_all(question: Column | str) -> Column:
    """TQ9: questions whose answer an incomplete document may spoil."""
    q = F.col(question) if isinstance(question, str) else question
    return F.lower(q).rlike(r"\b(all|every|each|how many|total|complete list|entire)\b|全部|所有|多少|总共|一共")


def tidy_answer(text: str) -> str:
    """TQ12: without headings that head nothing and without a bold mark that never closes; fenced lines stay as they are."""
    lines, out, fence = (text or "").split("\n"), [], False
    for i, line in enumerate(lines):
        if line.strip().startswith("```"):
            fence = not fence
        elif not fence:
            if re.match(r"#{1,6}\s", line):
                nxt = next((x for x in lines[i + 1 :] if x.strip()), None)
                if nxt is None or re.match(r"#{1,6}\s", nxt) and len(nxt) - len(nxt.lstrip("#")) <= len(line) - len(line.lstrip("#")):
                    continue
            if line.count("**") % 2:
                at = line.rfind("**")
                line = line[:at] + line[at + 2 :]
        out.append(line)
    return "\n".join(out)


def tidied(answers: DataFrame, key: str, text: str) -> DataFrame:
    """TQ12 over a table: (key, tidy)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tidy_answer(t) for t in b.column(1).to_pylist()], pa.string())], names=[key, "tidy"])

    return answers.select(key, text).mapInArrow(run, f"{key} {answers.schema[key].dataType.simpleString()}, tidy string")


NEGATION = r"\b(not|no|never|without|cannot|n't)\b|不|没有|禁止|未"
UPPER, LOWER = r"(?i)\b(at most|no more than|not exceed|up to|maximum|less than|below)\b|不超过|至多|最多|低于", r"(?i)\b(at least|no less than|minimum|more than|above|exceeds?)\b|不低于|至少|高于"


def polarity_conflict(statement: Column, evidence: Column) -> Column:
    """GD3: one side negates and the other does not, or one bounds from above and the other from below."""
    strip = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), UPPER, " "), LOWER, " ")
    negates = lambda t: count_of(strip(t), NEGATION) % 2 == 1
    only = lambda t, a, b: t.rlike(a) & ~t.rlike(b)
    bounds = (only(statement, UPPER, LOWER) & only(evidence, LOWER, UPPER)) | (only(statement, LOWER, UPPER) & only(evidence, UPPER, LOWER))
    return (negates(statement) != negates(evidence)) | bounds


def decisive_values(text: Column | str) -> Column:
    """GD5: dates and capitalised names of several words that decide an answer."""
    dates = F.regexp_extract_all(text, F.lit(r"\d{4}-\d{2}-\d{2}|\d{4}年\d{1,2}月(?:\d{1,2}日)?"), F.lit(0))
    names = F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{Ll}+(?:\s\p{Lu}\p{Ll}+)+"), F.lit(0))
    return F.array_distinct(F.concat(dates, names))


def attributed(answer: Column, evidence: Column) -> Column:
    """GD5: every decisive value of the answer stands in the evidence."""
    return F.forall(decisive_values(answer), lambda v: F.contains(evidence, v))


def query_keywords(query: Column | str, most: int = 15) -> Column:
    """LX15, GR11: codes, numbers with units, long words, then pairs, triples and fours of each Han run, ``most`` at most."""
    codes = F.regexp_extract_all(query, F.lit(r"[A-Za-z]+[-_/]?\d+[A-Za-z0-9-]*"), F.lit(0))
    numbers = F.regexp_extract_all(query, F.lit(r"\d+(?:\.\d+)?\s?(?:%|mm|cm|km|kg|m|g|t|年|月|日|元|条)"), F.lit(0))
    words = F.filter(F.regexp_extract_all(F.lower(query), F.lit(r"[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin("what", "when", "which", "with", "that", "this", "from"))
    runs = F.regexp_extract_all(query, F.lit("[一-鿿]{2,}"), F.lit(0))
    spans = F.flatten(F.transform(runs, lambda r: F.concat(*(grams(r, n) for n in (4, 3, 2)))))
    return F.slice(F.array_distinct(F.concat(codes, numbers, words, spans)), 1, most)


def search_communities(queries: DataFrame, communities: DataFrame, k: int = 5, constant: int = 60) -> DataFrame:
    """GR14, RK9: communities (community_id, title, summary) by two ranks fused: words of the title count 3, of the summary 1, and
    cosine where both sides have a vector (column embedding, may be null)."""
    from cairnlake.operators.vector import cosine

    pairs = queries.select("query_id", "keywords", F.col("embedding").alias("_q")).crossJoin(communities)
    words = F.aggregate("keywords", F.lit(0), lambda s, w: s + 3 * F.contains(F.lower("title"), F.lower(w)).cast("int") + F.contains(F.lower("summary"), F.lower(w)).cast("int"))
    scored = pairs.select("query_id", "community_id", words.alias("words"), cosine("_q", "embedding").alias("cosine"))
    rank = lambda c: F.when(F.col(c) > 0, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(c), "community_id")))
    scored = scored.withColumn("rw", rank("words")).withColumn("rc", rank("cosine"))
    fused = scored.withColumn("rrf", F.coalesce(1 / (constant + F.col("rw")), F.lit(0.0)) + F.coalesce(1 / (constant + F.col("rc")), F.lit(0.0))).where("rrf > 0")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "community_id"))
    return fused.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "community_id", "rrf", "rank")


def drift_probes(hits: DataFrame, members: DataFrame, names: DataFrame, most: int = 4) -> DataFrame:
    """GR15: names of members of the communities a query found, the best community first, as further probes.

    A query takes ``most`` names at most, so where better communities hold fewer than that, the first 2 * ``most`` names of the
    next one are enough: no more of a community meets the queries."""
    own = members.join(names, "node").select("community_id", "name").distinct()
    few = own.withColumn("_n", F.row_number().over(Window.partitionBy("community_id").orderBy("name"))).where(F.col("_n") <= 2 * most)
    rows = hits.join(few, "community_id").select("query_id", "rank", "name")
    best = rows.groupBy("query_id", "name").agg(F.min("rank").alias("rank"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "name"))
    return best.withColumn("nth", nth).where(F.col("nth") <= most).select("query_id", "name", "nth")


def search_summaries(queries: DataFrame, nodes: DataFrame, k: int = 5, at_least: float = 0.3) -> DataFrame:
    """RP6: summary nodes (node_id, level, text, embedding) by cosine of ``at_least``, else by keywords they hold; higher levels first
    among equals."""
    from cairnlake.operators.vector import cosine

    pairs = queries.select("query_id", "keywords", F.col("embedding").alias("_q")).crossJoin(nodes)
    c = cosine("_q", "embedding")
    hits = F.size(F.filter("keywords", lambda w: F.contains(F.lower("text"), F.lower(w))))
    scored = pairs.withColumn("score", F.when(c >= at_least, c).when(hits > 0, 0.01 * hits)).where("score is not null")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("level"), "node_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "node_id", "score", "rank")


def passages(text: str, most: int = 12000) -> list[tuple[int, str]]:
    """CH19: parts of a document at headings, articles and numbered items; items within an article stay in it."""
    body = re.sub(r"\A---\n.*?\n---\n", "", text or "", flags=re.S)
    out, held, article = [], [], False
    for line in body.split("\n"):
        opens_article = bool(re.match(r"\s*(第[一二三四五六七八九十百零0-9]+条|Article\s+\d+)", line))
        opens = bool(re.match(r"#{1,6}\s", line)) or opens_article or (not article and bool(re.match(r"\s*\d+[.、)]\s", line)))
        if opens and any(x.strip() for x in held):
            out.append("\n".join(held).strip())
            held = []
        article = opens_article or (article and not re.match(r"#{1,6}\s", line))
        held.append(line)
    if any(x.strip() for x in held):
        out.append("\n".join(held).strip())
    pieces = [p[i : i + most] for p in out for i in range(0, len(p), most)]
    return list(enumerate(pieces))


def localise(parts: DataFrame, queries: DataFrame, most: int = 18000) -> DataFrame:
    """CH20: passages (doc_id, ord, heading, text) of each query (query_id, doc_id, terms) by the share of its terms they hold, 0.15 more
    where the heading holds one; neighbours of the best one stay from 45 % of its share, ``most`` characters in all."""
    rows = queries.join(parts, "doc_id")
    share = F.size(F.filter("terms", lambda w: F.contains(F.lower("text"), w))) / F.greatest(F.size("terms"), F.lit(1))
    in_head = F.exists("terms", lambda w: F.contains(F.lower("heading"), w))
    scored = rows.withColumn("ratio", share + F.when(in_head, 0.15).otherwise(0.0))
    own = Window.partitionBy("query_id", "doc_id")
    best = F.max("ratio").over(own)
    kept = scored.withColumn("_b", best).where(F.col("ratio") >= F.greatest(F.lit(0.05), 0.45 * F.col("_b")))
    size = F.sum(F.length("text")).over(own.orderBy(F.desc("ratio"), "ord").rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("_s", size).where((F.col("_s") <= most) | (F.col("ratio") == F.col("_b"))).select("query_id", "doc_id", "ord", "ratio")


def self_retrieval(chunks: DataFrame, search, k: int, words: int = 12, asked: DataFrame | None = None) -> DataFrame:
    """EV12: for each chunk whether a search for its first words finds it among the k best. ``search`` takes (chunks, queries, k).
    With ``asked`` (chunks again) only these are looked for, still among all chunks."""
    queries = (chunks if asked is None else asked).select(F.col("chunk_id").alias("query_id"), F.array_join(F.slice(F.split("text", r"\s+"), 1, words), " ").alias("text"))
    found = search(chunks, queries, k).where("query_id = chunk_id").select("query_id", "rank")
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.col("rank").isNotNull().alias("found"), "rank")
