"""RK17: evidence selection under constraints, and a funnel that tells why each candidate came in or fell out.

A query's candidates form groups (sections). Groups under a floor fall out unless something guarantees or exempts them; the others
compete by maximal marginal relevance for few places and a token budget; then places are reserved: for each sub-question, for each
hop of the reasoning, and for each further document that speaks of the same matter.

The greedy choice goes in rounds over all queries at once. A round scores every group against what its query has chosen so far (a row
for each query, with at most a dozen sets) and takes each query's best by an aggregate, so no task holds a query's candidates. A
group that does not fit any more never will, as what is spent only grows: rounds are as many as places, at most ``PLACES_BREADTH``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import jaccard
from cairnlake.session import fresh_path, written

#: Fixed values. Floors as shares of the baseline, least relevance of a guaranteed group, guaranteed groups and filled-in unmeasured ones (soft mode).
RIGID_FLOOR, SOFT_FLOOR, VIABLE, GUARANTEED, FILLED = 0.35, 0.22, 0.10, 6, 2
#: Fixed values. Places; weight of relevance; share of places that a document takes; boosts of text, of tables, of summaries and their tables when asked for; of a new document (factor, addend), and what its redundancy counts.
PLACES, PLACES_BREADTH, PLACES_LEAST, LAMBDA, DOC_SHARE = 8, 16, 4, 0.72, 0.55
CONCRETE, TABLE, ASKED_SUMMARY, ASKED_TABLE, NOVEL, NOVEL_ADDED, NOVEL_REDUNDANCY = 0.15, 0.10, 0.55, 0.25, 0.15, 0.06, 0.25
#: Fixed values. Sub-questions; coverage by an origin, by a text, by a group to be injected; budget of reserved places; other documents: share of the best score, likeness of pairs of characters.
SUBQUERIES, BY_ORIGIN, BY_TEXT, BY_GROUP, OVER, SOURCE_RATIO, ALIKE = 5, 0.5, 0.9, 0.33, 1.2, 0.35, 0.15
#: Fixed value: words that ask or join.
STOPS = "who what where when why how was were is are the a an of in on at to for and or her his their its details".split()

CANDIDATE = "query_id, chunk_id, doc_id, ordinal, score, measured, tokens, section, text, is_summary, is_table, exempt, origin, hop, skipped".split(", ")


def content_terms(text: Column) -> Column:
    """Words that say something: of a text with Latin letters those of three or more letters and digits that are no stop words,
    else runs of two or more."""
    low = F.lower(text)
    latin = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPS))
    return F.when(low.rlike("[a-z]"), latin).otherwise(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))


def coverage(terms: Column, text: Column) -> Column:
    """Share of terms that a text holds; 0 without terms."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)).otherwise(F.lit(0.0))


def pairs_of(text: Column) -> Column:
    """Distinct pairs of characters of a text without white space."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
    return F.when(F.length(t) >= 2, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


#: Columns of a selection's own tables.
KEPT = {"chosen": "query_id long, key string, whole boolean, rep_ordinal long, reason string, step int, at int", "passed": "query_id long, key string"}


@dataclass
class _Run:
    """Tables of one selection: candidates with their groups' keys, groups, and what queries have chosen so far."""

    members: DataFrame
    groups: DataFrame
    state: DataFrame
    folder: str
    step: int = 0

    def keep(self, rows: DataFrame, name: str) -> None:
        """Adds rows to one of the selection's tables: ``chosen`` (picks) or ``passed`` (groups that did not fit)."""
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def kept(self, name: str) -> DataFrame:
        return self.state.sparkSession.read.schema(KEPT[name]).parquet(f"{self.folder}/{name}")

    def took(self, picks: DataFrame) -> None:
        """picks: query_id, key, spent, words, doc, is_summary, counted, and what came in by ``_chosen``. Adds them to the state."""
        sets = picks.groupBy("query_id").agg(F.sum("spent").alias("_spent"), F.array_sort(F.collect_list(F.struct("at", "key", "words", "doc", "is_summary", "counted"))).alias("_sets"))
        s = self.state.join(sets, "query_id", "left")
        out = s.withColumn("used", F.col("used") + F.coalesce("_spent", F.lit(0))).withColumn("sets", F.when(F.col("_sets").isNull(), F.col("sets")).otherwise(F.concat("sets", F.transform("_sets", lambda x: x.dropFields("at")))))
        self.state = written(out.drop("_spent", "_sets"), "state")


def _member(score: Column) -> Column:
    return F.struct((-score).alias("low"), "ordinal", "tokens")


def _prepared(candidates: DataFrame, questions: DataFrame, soft: bool) -> tuple[DataFrame, DataFrame]:
    """Members with keys, and groups with all that the rules ask of them."""
    score = F.when(F.coalesce(F.abs("score") < float("inf"), F.lit(False)), F.col("score")).otherwise(F.lit(0.0))
    key = F.coalesce(F.nullif("section", F.lit("")), F.concat(F.lit("__single_"), F.col("ordinal").cast("string")))
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("is_summary", "is_table", "exempt", "skipped")}
    measured = F.when(flags["skipped"] | ~(F.col("measured") > 0) | F.isnan("measured"), None).otherwise(F.col("measured"))
    members = written(candidates.select(*CANDIDATE).withColumns({"key": key, "score": score, "measured": measured, **flags, "text": F.coalesce("text", F.lit("")), "tokens": F.coalesce("tokens", F.lit(0)).cast("long")}), "candidates")
    third = Window.partitionBy("query_id").orderBy(F.desc("measured"), "ordinal")
    top = members.where("measured IS NOT NULL").select("query_id", "measured", F.row_number().over(third).alias("n")).where("n <= 3").groupBy("query_id").agg(F.avg("measured").alias("top3"))
    stats = members.groupBy("query_id").agg(F.max("measured").alias("max_measured"), F.count("measured").alias("n_measured"), F.max("score").alias("max_score")).join(top, "query_id", "left")
    groups = members.groupBy("query_id", "key").agg(
        F.max("measured").alias("measured_best"),
        F.max("score").alias("top_score"),
        F.min("ordinal").alias("first_ordinal"),
        F.sum("tokens").alias("cost"),
        F.bool_or("is_summary").alias("is_summary"),
        F.bool_or("is_table").alias("is_table"),
        F.bool_or("exempt").alias("exempt"),
        F.min(_member(F.col("score"))).alias("best_member"),
        F.min(F.when(F.col("is_summary"), _member(F.col("score")))).alias("summary_member"),
        F.min_by(F.col("doc_id").cast("string"), "ordinal").alias("doc"),
        F.min(F.when(F.col("text") != "", F.struct("ordinal", F.substring("text", 1, 400).alias("text"))))["text"].alias("rep_text"),
        F.collect_set("origin").alias("origins"),
    )
    g = groups.join(stats, "query_id").join(questions, "query_id")
    has = F.col("n_measured") > 0
    relative = F.when(F.col("max_score") > 0, F.greatest(F.lit(0.0), "top_score") / F.col("max_score")).otherwise(F.lit(1.0))
    g = g.withColumn("best", F.when(has, F.coalesce(F.col("measured_best") / F.col("max_measured"), F.lit(0.0))).otherwise(relative))
    g = g.withColumn("viability", F.when(has, F.col("measured_best")).otherwise(F.col("best")))
    # Without measured scores some group has the best relative score, which is 1.
    raw = F.when(has, F.col("max_measured")).otherwise(F.lit(1.0))
    smooth = F.greatest(raw * 0.80, F.least(raw, F.col("top3") * 1.10))
    floor = (F.when(has & (F.col("n_measured") >= 5), smooth).otherwise(raw) * SOFT_FLOOR) if soft else raw * RIGID_FLOOR
    g = g.withColumn("passes", F.coalesce(F.col("viability") >= floor, F.lit(False)))
    if soft:
        best = Window.partitionBy("query_id").orderBy(F.desc("viability"), "first_ordinal")
        kept = g.where((F.col("viability") >= VIABLE) & ~F.col("divided")).select("query_id", "key", F.row_number().over(best).alias("n")).where(F.col("n") <= GUARANTEED)
        g = g.join(kept.select("query_id", "key", F.lit(True).alias("guaranteed")), ["query_id", "key"], "left").withColumn("guaranteed", F.coalesce("guaranteed", F.lit(False)))
    else:
        g = g.withColumn("guaranteed", F.lit(False))
    asked = F.col("wants_summary") & F.col("is_summary")
    g = g.withColumn("eligible", F.col("passes") | F.col("guaranteed") | F.col("exempt") | asked)
    g = g.withColumn("in_pool", F.col("eligible") & (~has | F.col("measured_best").isNotNull() | F.col("exempt") | asked))
    g = g.withColumn("rep", F.coalesce(F.when(F.col("wants_summary"), F.col("summary_member")), F.col("best_member")))
    words = F.array_distinct(F.slice(F.regexp_extract_all(F.lower(F.coalesce("rep_text", F.lit(""))), F.lit(r"[\p{L}\p{N}]{1,4}"), F.lit(0)), 1, 400))
    boost = 1 + F.when(F.col("wants_summary"), F.when(F.col("is_summary"), ASKED_SUMMARY).otherwise(0.0)).otherwise(F.when(F.col("is_summary"), 0.0).otherwise(CONCRETE))
    boost = boost + F.when(F.col("wants_summary"), F.when(F.col("is_summary"), ASKED_TABLE).otherwise(0.0)).otherwise(F.when(F.col("is_table"), TABLE).otherwise(0.0))
    reason = F.when(F.col("exempt") & ~F.col("passes"), "exempt").when(F.col("guaranteed") & ~F.col("passes"), "guaranteed").otherwise("floor")
    late = F.when(F.col("wants_summary") & ~F.col("is_summary"), 1).otherwise(0)
    return members, written(g.withColumns({"words": words, "boost": boost, "reason": reason, "late": late, "rep_ordinal": F.col("rep.ordinal"), "rep_cost": F.col("rep.tokens"), "best_ordinal": F.col("best_member.ordinal"), "best_cost": F.col("best_member.tokens")}).drop("rep", "best_member", "summary_member", "subs", "divided", "wants_summary", "budget", "places"), "groups")


def _picked(run: _Run, picks: DataFrame) -> None:
    """Writes a round's picks (query_id, key, whole, reason, ...): they join the state, and their members the chosen ones."""
    run.step += 1
    run.took(picks)
    run.keep(picks.select("query_id", "key", "whole", "rep_ordinal", "reason", F.lit(run.step).alias("step"), F.col("at").cast("int").alias("at")), "chosen")


def _set(picks: DataFrame, spent: Column, counted: Column, at: Column) -> DataFrame:
    return picks.withColumns({"spent": spent, "counted": counted, "at": at})


def _asked_summaries(run: _Run) -> None:
    first = Window.partitionBy("query_id").orderBy(F.desc("best"), "key")
    pool = run.groups.where("in_pool AND is_summary").join(run.state.where("wants_summary").select("query_id"), "query_id")
    picks = pool.withColumn("at", F.row_number().over(first)).where("at <= 2")
    picks = _set(picks.withColumns({"whole": F.lit(False), "reason": F.lit("summary"), "is_summary": F.lit(True)}), F.col("rep_cost"), F.lit(True), F.col("at"))
    _picked(run, written(picks, "picks"))


def _taken(run: _Run, groups: DataFrame) -> DataFrame:
    """Groups with their query's state, without those that were chosen."""
    return groups.join(run.state, "query_id").where(~F.exists("sets", lambda s: s["key"] == F.col("key")))


def _greedy(run: _Run) -> None:
    pool = run.groups.where("in_pool")
    docs = _taken(run, pool).groupBy("query_id").agg(F.count_distinct("doc").alias("docs"))
    most = F.when(F.coalesce("docs", F.lit(0)) > 1, F.greatest(F.lit(2), F.floor(F.col("places") * DOC_SHARE).cast("int"))).otherwise(F.col("places"))
    run.state = written(run.state.join(docs, "query_id", "left").withColumn("most", most).drop("docs"), "state")
    for _ in range(PLACES_BREADTH):
        open_ = _taken(run, pool).where(F.size("sets") < F.col("places"))
        same = F.size(F.filter("sets", lambda s: s["counted"] & (s["doc"] == F.col("doc"))))
        novel = (same == 0) & (F.size("sets") > 0)
        others = F.filter("sets", lambda s: ~((s["doc"] == F.col("doc")) & s["is_summary"] & ~F.col("is_summary")))
        alike = F.coalesce(F.array_max(F.transform(others, lambda s: jaccard(F.col("words"), s["words"]))), F.lit(0.0))
        redundancy = F.when(novel, alike * NOVEL_REDUNDANCY).otherwise(alike)
        value = LAMBDA * F.col("best") * (F.col("boost") + F.when(novel, NOVEL).otherwise(0.0)) - (1 - LAMBDA) * redundancy + F.when(novel, NOVEL_ADDED).otherwise(0.0)
        free = F.size("sets") == 0
        whole = free | (F.col("used") + F.col("cost") <= F.col("budget"))
        fits = whole | (F.col("used") + F.col("rep_cost") <= F.col("budget"))
        rank = F.struct((same >= F.col("most")).alias("capped"), (-value).alias("low"), F.col("late"), (-F.col("best")).alias("best"), F.col("key"))
        scored = open_.select("query_id", rank.alias("rank"), fits.alias("fits"), F.when(fits, F.struct(whole.alias("whole"), F.when(whole, F.col("cost")).otherwise(F.col("rep_cost")).alias("spent"), "rep_ordinal", "words", "doc", "is_summary", "reason")).alias("x"))
        best = scored.groupBy("query_id").agg(F.min(F.when(F.col("fits"), F.struct("rank", "x"))).alias("p"), F.count_if(~F.col("fits")).alias("unfit"))
        best = written(best, "picks")
        made = best.agg(F.count("p").alias("picks"), F.sum("unfit").alias("unfit")).first()
        # Groups that stand before the pick and do not fit are passed over for good.
        if made.unfit:
            passed = scored.where("NOT fits").join(best.select("query_id", F.col("p.rank").alias("pick")), "query_id").where("pick IS NULL OR rank < pick")
            run.keep(passed.select("query_id", "rank.key"), "passed")
        if not made.picks:
            return
        picks = best.where("p IS NOT NULL").select("query_id", "p.rank.key", "p.x.*")
        _picked(run, picks.withColumns({"counted": ~F.col("is_summary"), "at": F.lit(1)}))


def _fill(run: _Run) -> None:
    """Soft mode: unmeasured groups in order of recall where places and budget are left."""
    pool = run.groups.where("n_measured > 0 AND measured_best IS NULL AND NOT exempt")
    for nth in range(FILLED):
        free = (F.size("sets") == 0) | (F.col("used") + F.col("best_cost") <= F.col("budget"))
        open_ = _taken(run, pool).where((F.size("sets") < F.col("places")) & free)
        first = open_.groupBy("query_id").agg(F.min(F.struct("first_ordinal", "key", F.col("best_ordinal").alias("rep_ordinal"), F.col("best_cost").alias("spent"), "words", "doc", "is_summary")).alias("p")).select("query_id", "p.*")
        picks = written(first.withColumns({"whole": F.lit(False), "reason": F.lit("synthetic_fill"), "counted": ~F.col("is_summary"), "at": F.lit(nth + 1)}), "picks")
        if picks.isEmpty():
            return
        _picked(run, picks)


def _selected(run: _Run) -> DataFrame:
    """Members that came in: query_id, ordinal, reason (of the first step that took them), step, at, lead (the representative comes last)."""
    out = run.members.select("query_id", "key", "ordinal").join(run.kept("chosen"), ["query_id", "key"]).where("whole OR ordinal = rep_ordinal")
    first = F.min(F.struct("step", "at", F.coalesce(F.col("ordinal") == F.col("rep_ordinal"), F.lit(False)).alias("lead"), "reason")).alias("f")
    return out.groupBy("query_id", "ordinal").agg(first).select("query_id", "ordinal", "f.*")


def _subqueries(run: _Run, questions: DataFrame) -> None:
    for nth in range(SUBQUERIES):
        asked = questions.where(F.size("subs") > nth).select("query_id", F.element_at("subs", nth + 1).alias("sub")).join(run.state.where(F.size("sets") > 0).select("query_id"), "query_id")
        asked = written(asked.withColumn("terms", content_terms(F.col("sub"))), "asked")
        if asked.isEmpty():
            return
        matches = lambda origin: F.coalesce(F.trim(origin) != "", F.lit(False)) & ((F.lower(F.trim(origin)) == F.lower(F.trim("sub"))) | (coverage(F.col("terms"), origin) >= BY_ORIGIN))
        selected = written(_selected(run).select("query_id", "ordinal"), "selected")
        seen = selected.join(run.members.select("query_id", "ordinal", "origin", "text"), ["query_id", "ordinal"]).join(asked, "query_id")
        covered = seen.where(matches(F.col("origin")) | ((F.size("terms") > 0) & (coverage(F.col("terms"), F.col("text")) >= BY_TEXT))).select("query_id").distinct()
        rest = asked.join(covered, "query_id", "left_anti")
        left = run.members.select("query_id", "key", "ordinal").join(selected, ["query_id", "ordinal"], "left_anti").select("query_id", "key").distinct()
        g = run.groups.join(rest, "query_id").join(left, ["query_id", "key"], "left_semi")
        cov = coverage(F.col("terms"), F.col("rep_text"))
        worth = F.when(F.exists("origins", matches), 2 + F.col("best")).when(cov >= BY_GROUP, 1 + cov).otherwise(0.0)
        best = g.withColumn("worth", worth).where("worth >= 1").groupBy("query_id").agg(F.min(F.struct((-F.col("worth")).alias("low"), "first_ordinal", "key", "rep_ordinal", "rep_cost", "cost", "words", "doc", "is_summary")).alias("p")).select("query_id", "p.*")
        best = best.join(run.state.select("query_id", "used", "budget"), "query_id").withColumn("whole", F.col("used") + F.col("cost") <= F.col("budget") * OVER)
        # A group that does not fit gives its representative, if that is not chosen yet; it is then no set of its own.
        lone = best.join(selected.withColumnRenamed("ordinal", "rep_ordinal"), ["query_id", "rep_ordinal"], "left_anti").where("NOT whole")
        picks = best.where("whole").unionByName(lone).withColumns({"spent": F.when(F.col("whole"), F.col("cost")).otherwise(F.col("rep_cost")), "reason": F.lit("subquery"), "counted": F.lit(False), "at": F.lit(1)})
        # Representatives alone do not make their document represented.
        picks = picks.withColumns({"doc": F.when(F.col("whole"), F.col("doc")), "rep_ordinal": F.when(~F.col("whole"), F.col("rep_ordinal"))})
        picks = written(picks, "picks")
        _picked(run, picks)


def _hops(run: _Run) -> None:
    """Each hop from the second on has a candidate: its first one, if none was chosen."""
    has = _selected(run).select("query_id", "ordinal").join(run.members.select("query_id", "ordinal", "hop"), ["query_id", "ordinal"]).where("hop >= 2").select("query_id", "hop").distinct()
    missing = run.members.where("hop >= 2").join(has, ["query_id", "hop"], "left_anti")
    first = missing.groupBy("query_id", "hop").agg(F.min(F.struct("ordinal", "key", "tokens")).alias("p")).select("query_id", F.col("p.key"), F.col("p.ordinal").alias("rep_ordinal"), F.col("p.tokens").alias("spent"), F.col("p.ordinal").cast("int").alias("at"))
    none = {"words": F.array().cast("array<string>"), "doc": F.lit(None).cast("string"), "is_summary": F.lit(True), "counted": F.lit(False), "whole": F.lit(False), "reason": F.lit("hop")}
    _picked(run, written(first.withColumns(none), "picks"))


def _sources(run: _Run) -> None:
    """A document that is as good and of the same matter comes in by one member, in order of recall, while the budget and a fifth last."""
    best = run.groups.groupBy("query_id").agg(F.greatest(F.max(F.coalesce("viability", F.lit(0.0))), F.lit(0.0)).alias("top"))
    chosen = _selected(run).select("query_id", "ordinal").join(run.members.select("query_id", "ordinal", "text"), ["query_id", "ordinal"]).select("query_id", pairs_of(F.col("text")).alias("theirs"))
    good = run.groups.join(best, "query_id").where((F.col("top") > 0) & (F.col("viability") >= F.col("top") * SOURCE_RATIO))
    fresh = good.join(run.state, "query_id").where(~F.exists("sets", lambda s: F.coalesce(s["doc"] == F.col("doc"), F.lit(False))))
    fresh = fresh.select("query_id", "key", "first_ordinal", F.col("best_ordinal").alias("rep_ordinal"), F.col("best_cost").alias("rep_cost"), "words", "doc", "is_summary", pairs_of(F.col("rep_text")).alias("own"))
    same = fresh.join(chosen, "query_id").where(jaccard(F.col("own"), F.col("theirs")) >= ALIKE).select("query_id", "key").distinct()
    left = written(fresh.join(same, ["query_id", "key"], "left_semi").drop("own"), "sources")
    while True:
        s = left.join(run.state.select("query_id", "used", "budget", "sets"), "query_id")
        s = s.where(~F.exists("sets", lambda x: F.coalesce(x["doc"] == F.col("doc"), F.lit(False))) & (F.col("used") + F.col("rep_cost") <= F.col("budget") * OVER))
        one = s.groupBy("query_id", "doc").agg(F.min(F.struct("first_ordinal", "key", "rep_ordinal", "rep_cost", "words", "is_summary", "used", "budget")).alias("p")).select("query_id", "doc", "p.*")
        # Those before the first one that would overflow come in at once.
        upto = Window.partitionBy("query_id").orderBy("first_ordinal").rowsBetween(Window.unboundedPreceding, 0)
        one = one.withColumn("over", F.col("used") + F.sum("rep_cost").over(upto) > F.col("budget") * OVER).where(~F.col("over"))
        picks = one.withColumns({"spent": F.col("rep_cost"), "counted": ~F.col("is_summary"), "whole": F.lit(False), "reason": F.lit("multi_source"), "at": F.col("first_ordinal").cast("int")})
        picks = written(picks, "picks")
        if picks.isEmpty():
            return
        _picked(run, picks)


def constrained_selection(candidates: DataFrame, questions: DataFrame, soft: bool = False) -> DataFrame:
    """RK17: a row for each candidate: query_id, chunk_id, ordinal, place (from 1 in the context; null if dropped) and reason: how it came in
    (summary, floor, guaranteed, exempt, synthetic_fill, subquery, hop, multi_source) or where it fell out (rerank_cap, floor, mmr_budget, max_groups).

    candidates: ``CANDIDATE`` columns; ordinal is the place in recall, unique in a query; measured is null without a measured score; section
    null is a group of its own; skipped rows were never measured; query_id and ordinal are long. questions: query_id, budget, breadth, wants_summary, sub_queries.
    ``soft``: the looser floor with guaranteed groups and filled-in unmeasured ones. Nulls count as false, zero, empty or absent."""
    subs = F.slice(F.filter(F.coalesce("sub_queries", F.array().cast("array<string>")), lambda q: F.coalesce(F.length(F.trim(q)) >= 3, F.lit(False))), 1, SUBQUERIES)
    n = F.size(F.coalesce("sub_queries", F.array().cast("array<string>")))
    places = F.when(n > 0, F.greatest(F.lit(PLACES_LEAST), F.least(F.lit(PLACES), n * 2 + 2))).when(F.coalesce("breadth", F.lit(False)), PLACES_BREADTH).otherwise(PLACES)
    asked = written(questions.select("query_id", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"), places.cast("int").alias("places"), F.coalesce("wants_summary", F.lit(False)).alias("wants_summary"), subs.alias("subs"), (n > 0).alias("divided")), "questions")
    members, groups = _prepared(candidates, asked, soft)
    empty = F.array().cast("array<struct<key:string,words:array<string>,doc:string,is_summary:boolean,counted:boolean>>")
    run = _Run(members, groups, asked.drop("subs", "divided").withColumns({"used": F.lit(0).cast("long"), "sets": empty}), fresh_path(candidates.sparkSession, "selection"))
    run.keep(groups.sparkSession.createDataFrame([], KEPT["passed"]), "passed")
    _asked_summaries(run)
    _greedy(run)
    if soft:
        _fill(run)
    _subqueries(run, asked)
    _hops(run)
    _sources(run)
    selected = _selected(run)
    order = Window.partitionBy("query_id").orderBy("step", "at", "lead", "ordinal")
    selected = selected.withColumn("place", F.row_number().over(order)).select("query_id", "ordinal", "place", F.col("reason").alias("came"))
    state = groups.select("query_id", "key", "eligible")
    degraded = run.kept("chosen").where("NOT whole AND reason IN ('floor', 'guaranteed', 'exempt')").select("query_id", "key").unionByName(run.kept("passed"))
    out = members.select("query_id", "key", "chunk_id", "ordinal", "skipped").join(selected, ["query_id", "ordinal"], "left").join(state, ["query_id", "key"]).join(degraded.distinct().withColumn("passed", F.lit(True)), ["query_id", "key"], "left")
    fell = F.when(F.col("skipped"), "rerank_cap").when(F.col("passed"), "mmr_budget").when(~F.col("eligible"), "floor").otherwise("max_groups")
    return out.select("query_id", "chunk_id", "ordinal", "place", F.coalesce("came", fell).alias("reason"))


def funnel(selection: DataFrame) -> DataFrame:
    """Candidates of each query by what became of them: (query_id, kept, reason, n)."""
    return selection.groupBy("query_id", F.col("place").isNotNull().alias("kept"), "reason").agg(F.count(F.lit(1)).alias("n"))
