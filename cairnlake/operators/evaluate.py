"""Retrieval and answer metrics, experiments, telemetry (EV1-EV18, EX1-EX4, AG7-AG11)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.functions.text import safe_ratio


def ranked_run(run: DataFrame) -> DataFrame:
    """A run (qid, docids array) as rows (qid, docid, rank); a repeated id counts at its first place."""
    rows = run.select("qid", F.posexplode(F.array_distinct("docids")).alias("pos", "docid"))
    return rows.select("qid", "docid", (F.col("pos") + 1).alias("rank"))


def query_metrics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """EV1-EV4: ndcg, recall, mrr and map at k for each query of qrels (qid, docid, gain); a query without results counts 0.

    ranked: (qid, docid, rank). Gains of 0 and less are not relevant."""
    relevant = qrels.where("gain > 0")
    ideal = relevant.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "docid")))
    totals = ideal.groupBy("qid").agg(F.sum(F.when(F.col("i") <= k, F.col("gain") / F.log2(F.col("i") + 1))).alias("idcg"), F.count(F.lit(1)).alias("n_relevant"))
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["qid", "docid"])
    nth = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    got = hits.withColumn("nth", nth).groupBy("qid").agg(
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"), F.count(F.lit(1)).alias("hits"), (1 / F.min("rank")).alias("mrr"), F.sum(F.col("nth") / F.col("rank")).alias("precisions")
    )
    out = qrels.select("qid").distinct().join(totals, "qid", "left").join(got, "qid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select(
        "qid",
        zero(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        zero(F.col("hits") / F.col("n_relevant")).alias("recall"),
        zero(F.col("mrr")).alias("mrr"),
        zero(F.col("precisions") / F.col("n_relevant")).alias("map"),
        F.col("hits").isNotNull().alias("evaluated"),
    )


def macro(metrics: DataFrame) -> DataFrame:
    """EV5: means over all queries, and over those with a hit."""
    names = ("ndcg", "recall", "mrr", "map")
    return metrics.agg(*(F.avg(n).alias(n) for n in names), *(F.avg(F.when(F.col("evaluated"), F.col(n))).alias(f"{n}_evaluated") for n in names), F.count(F.lit(1)).alias("queries"))


def title_metrics(ranked: DataFrame, gold: DataFrame, at: tuple[int, ...] = (2, 5, 10)) -> DataFrame:
    """EV6: share of gold titles within the first k, whether all are within the last k, reciprocal rank, binary ndcg."""
    joined = gold.select("qid", "title").distinct().join(ranked.groupBy("qid", F.col("docid").alias("title")).agg(F.min("rank").alias("rank")), ["qid", "title"], "left")
    most = max(at)
    n = F.count(F.lit(1))
    found = joined.withColumn("i", F.row_number().over(Window.partitionBy("qid").orderBy("title")))
    return found.groupBy("qid").agg(
        *((F.count_if(F.col("rank") <= k) / n).alias(f"recall_{k}") for k in at),
        (F.count_if(F.col("rank") <= most) == n).alias("full_evidence"),
        F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("mrr"),
        (F.coalesce(F.sum(F.when(F.col("rank") <= most, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)) / F.sum(F.when(F.col("i") <= most, 1 / F.log2(F.col("i") + 1)))).alias("ndcg"),
    )


def squad_normalise(text: Column | str) -> Column:
    """EV7: lower case, without punctuation and articles, single spaces."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(t, r"[ \t\n\r]+"), lambda w: (w != "") & ~w.isin("a", "an", "the")), " ")


def token_f1(answers: DataFrame, predicted: str, gold: str, key: str) -> DataFrame:
    """EV7: exact match and F1 over token multisets of each row (key)."""
    def counts(c: str) -> DataFrame:
        toks = F.filter(F.split(squad_normalise(c), " "), lambda x: x != "")
        return answers.select(key, F.explode(toks).alias("tok")).groupBy(key, "tok").agg(F.count(F.lit(1)).alias(f"n_{c}"))

    same = counts(predicted).join(counts(gold), [key, "tok"]).groupBy(key).agg(F.sum(F.least(f"n_{predicted}", f"n_{gold}")).alias("same"))
    size = lambda c: F.size(F.filter(F.split(squad_normalise(c), " "), lambda x: x != ""))
    out = answers.join(same, key, "left").withColumn("same", F.coalesce("same", F.lit(0)))
    p, r = safe_ratio(F.col("same"), size(predicted)), safe_ratio(F.col("same"), size(gold))
    return out.select(key, (squad_normalise(predicted) == squad_normalise(gold)).alias("em"), F.when(F.col("same") == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))


def triad(faithful: Column, relevant: Column, precise: Column) -> Column:
    """EV9: harmonic mean of three shares; 0 if one is 0."""
    return F.when((faithful > 0) & (relevant > 0) & (precise > 0), 3 / (1 / faithful + 1 / relevant + 1 / precise)).otherwise(0.0)


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """EV13: bounds of the Wilson interval; 0 and 1 without trials."""
    p, m = hits / n, n.cast("double")
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return tuple(F.when(n > 0, x / (1 + z * z / m)).otherwise(e) for x, e in ((mid - half, 0.0), (mid + half, 1.0)))


def gates(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """EV14: values (metric, value) against thresholds (metric, threshold): a missing value fails."""
    return thresholds.join(values, "metric", "left").select("metric", "value", "threshold", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)).alias("passed"))


def load_summary(requests: DataFrame, keys: list[str]) -> DataFrame:
    """EV15, AG8: of requests (ok, ms, second): counts, error rate, rates a second, exact percentiles with linear interpolation."""
    span = F.greatest(F.max("second") - F.min("second") + 1, F.lit(1))
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        (F.count_if(~F.col("ok")) / F.count(F.lit(1))).alias("error_rate"),
        (F.count(F.lit(1)) / span).alias("qps"),
        (F.count_if("ok") / span).alias("success_qps"),
        *(F.percentile("ms", F.lit(p)).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))),
    )


def set_overlap(a: Column | str, b: Column | str) -> list[Column]:
    """EV16, ST4: shared ids, ids of either side alone, Jaccard of two id arrays (both empty: 1)."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return [both.alias("shared"), F.size(F.array_except(a, b)).alias("only_a"), F.size(F.array_except(b, a)).alias("only_b"), F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard")]


def ablation(runs: DataFrame, keys: list[str]) -> DataFrame:
    """EV17: of runs (supported, claims, cited, citations, correct, refused, answerable, tokens, price, ms): the report's ratios."""
    return runs.groupBy(*keys).agg(
        safe_ratio(F.sum("supported"), F.sum("claims")).alias("fact_support"),
        safe_ratio(F.sum("cited"), F.sum("citations")).alias("citation_accuracy"),
        (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy"),
        safe_ratio(F.count_if(F.col("refused") & F.col("answerable")), F.count_if("answerable")).alias("false_refusal"),
        F.sum(F.col("tokens") * F.col("price")).alias("cost"),
        F.percentile("ms", F.lit(0.5)).alias("p50"),
        F.percentile("ms", F.lit(0.95)).alias("p95"),
    )


def chain_recall(found: DataFrame, chains: DataFrame) -> DataFrame:
    """EV17: of evidence chains (qid, chain_id, docid), the best share that the found documents (qid, docid) hold, and completeness.

    Both are rows, so that neither what a question found nor a chain gathers in one place."""
    need = chains.select("qid", "chain_id", "docid").distinct()
    # Spark takes exploded rows for as few as they come from, and would broadcast them: the join is told to merge.
    held = need.join(found.select("qid", "docid", F.lit(1).alias("_f")).distinct().hint("merge"), ["qid", "docid"], "left")
    share = held.groupBy("qid", "chain_id").agg((F.count("_f") / F.count("docid")).alias("share"))
    return share.groupBy("qid").agg(F.max("share").alias("chain_recall")).withColumn("complete", F.col("chain_recall") == 1)


def paired_bootstrap(pairs: DataFrame, keys: list[str], resamples: int = 5000, margin: float = 0.01, comparisons: int = 1, seed: int = 42) -> DataFrame:
    """EV10: for each group of paired scores (a, b): mean difference, its interval, and whether b is not worse by over the margin.

    Pairs draw Poisson weights of all resamples, whose sums are partial aggregates: no group meets in one task. Pairs of one group and
    difference draw together: the sum of n weights of mean 1 is one of mean n."""
    import numpy as np
    import pyarrow as pa

    def draw(batches):
        for batch in (b.slice(lo, 512) for b in batches for lo in range(0, b.num_rows, 512)):  # 512 rows of weights are 20 MB
            cols = [batch.column(i) for i in range(len(keys))]
            ids, diff, copies = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_numpy(zero_copy_only=False), batch.column(len(keys) + 2).to_pylist()
            w = np.array([np.random.default_rng([seed, i]).poisson(n, resamples) for i, n in zip(ids, copies, strict=True)], np.float64).reshape(len(ids), resamples)
            for key in sorted(set(zip(*(c.to_pylist() for c in cols), strict=True)), key=repr) if keys else [()]:
                own = np.array([k == key for k in zip(*(c.to_pylist() for c in cols), strict=True)]) if keys else np.ones(len(ids), bool)
                sums, ns = (w[own] * diff[own, None]).sum(0), w[own].sum(0)
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * resamples, c.type) for k, c in zip(key, cols, strict=True)), pa.array(np.arange(resamples)), pa.array(sums), pa.array(ns)], names=[*keys, "draw", "s", "n"])

    fields = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    alike = pairs.groupBy(*keys, (F.col("b") - F.col("a")).cast("double").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    drawn = alike.select(*keys, F.shiftrightunsigned(F.xxhash64(*keys, "d"), 1).alias("id"), "d", "n").mapInArrow(draw, f"{fields}{', ' if keys else ''}draw long, s double, n double")
    means = drawn.groupBy(*keys, "draw").agg((F.sum("s") / F.sum("n")).alias("m"))
    alpha = 0.05 / comparisons
    out = means.groupBy(*keys).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    plain = pairs.groupBy(*keys).agg(F.avg(F.col("b") - F.col("a")).alias("difference"))
    joined = plain.join(out, keys) if keys else plain.crossJoin(out)
    return joined.withColumn("not_worse", F.col("low") >= -margin)


def platt_fit(rows: DataFrame, keys: list[str], ridge: float = 1e-3) -> DataFrame:
    """RK15: for each group of (score, label): slope and constant of a ridge logistic fit on standardised scores.

    Newton steps over sums that Spark aggregates: a few rows a group reach the driver, never the rows themselves."""
    stats = rows.groupBy(*keys).agg(F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-9)).alias("sd"))
    data = rows.join(stats, keys).withColumn("z", (F.col("score") - F.col("mean")) / F.col("sd")).select(*keys, "z", "label")
    fit = stats.select(*keys, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    for _ in range(8):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("a") * F.col("z") + F.col("b")))))
        w = p * (1 - p)
        sums = data.join(fit, keys).groupBy(*keys, "a", "b").agg(
            F.sum((p - F.col("label")) * F.col("z")).alias("ga"), F.sum(p - F.col("label")).alias("gb"), F.sum(w * F.col("z") * F.col("z")).alias("haa"), F.sum(w * F.col("z")).alias("hab"), F.sum(w).alias("hbb")
        ).collect()
        new = []
        for r in sums:
            ga, haa, hbb = r.ga + ridge * r.a, r.haa + ridge, r.hbb + ridge
            det = haa * hbb - r.hab**2
            new.append((*(r[k] for k in keys), r.a - (hbb * ga - r.hab * r.gb) / det, r.b - (haa * r.gb - r.hab * ga) / det))
        fit = rows.sparkSession.createDataFrame(new, fit.schema)
    return fit.join(stats, keys).select(*keys, (F.col("a") / F.col("sd")).alias("a"), (F.col("b") - F.col("a") * F.col("mean") / F.col("sd")).alias("b"))


def bucket(*parts: Column | str) -> Column:
    """EX1: the first 32 bits of sha256 of the parts, joined by |, over 2**32."""
    digest = F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def assign_arm(key: Column, user: Column, session: Column, sample: float, treatment: float, shadow: float) -> Column:
    """EX2: control, treatment or shadow."""
    s = F.when(F.coalesce(session, F.lit("")) == "", "anon").otherwise(session)
    r, r2 = bucket(key, user, s), bucket(key, F.lit("shadow"), user, s)
    arm = F.when(r < sample * treatment, "treatment").when(r < sample, "control").when(r2 < shadow, "shadow").otherwise("control")
    return F.when((arm == "control") & (r2 < shadow * 0.5), "shadow").otherwise(arm)


def sticky(assignments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """EX3: every event with the arm that its key got first."""
    first = assignments.groupBy(*keys).agg(F.min_by("arm", order).alias("first_arm"))
    return assignments.join(first, keys)


def ab_summary(events: DataFrame) -> DataFrame:
    """AG9: for each experiment and arm: count, mean value, map of event names to counts."""
    by_name = events.groupBy("experiment", "arm", "event_name").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    names = F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_name", "n"))))
    return by_name.groupBy("experiment", "arm").agg(F.sum("n").alias("count"), (F.sum("v") / F.sum("n")).alias("avg_value"), names.alias("event_names"))


def ab_gate(summaries: DataFrame, least: int = 30, tolerance: float = 0.05) -> DataFrame:
    """AG10: experiments whose control and treatment both have enough samples: difference of means and verdict."""
    wide = summaries.groupBy("experiment").agg(*(x for arm in ("control", "treatment") for x in (F.max(F.when(F.col("arm") == arm, F.col("count"))).alias(f"n_{arm}"), F.max(F.when(F.col("arm") == arm, F.col("avg_value"))).alias(arm))))
    kept = wide.where((F.col("n_control") >= least) & (F.col("n_treatment") >= least)).withColumn("delta", F.col("treatment") - F.col("control"))
    return kept.select("experiment", "control", "treatment", "delta", (F.col("delta") >= -tolerance).alias("passed"))


def quota(requests: DataFrame, key: str, ts: str, cost: str, most_requests: int, most_cost: float) -> DataFrame:
    """EX4: requests of fixed minutes, in order; one is admitted while both counts of the minute stay within their bounds.

    Both running sums count all requests before it, refused ones too, as a counter that is raised before it is compared."""
    minute = F.date_trunc("minute", ts)
    w = Window.partitionBy(key, minute).orderBy(ts, "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("minute", minute).withColumn("nth", F.count(F.lit(1)).over(w)).withColumn("spent", F.sum(cost).over(w)).withColumn("admitted", (F.col("nth") <= most_requests) & (F.col("spent") <= most_cost))


#: AG7: fixed values: upper bounds of duration buckets in ms.
BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)


def histogram(values: DataFrame, keys: list[str], value: str, bounds: tuple[float, ...] = BUCKETS_MS) -> DataFrame:
    """AG7: counts of each bucket (le), cumulative counts, sum and count of each series; values over all bounds fall in none."""
    bound = F.array_min(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: F.col(value) <= b))
    counts = values.withColumn("le", bound).groupBy(*keys, "le").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("count"), F.sum("s").alias("sum"))
    grid = totals.withColumn("le", F.explode(F.array(*(F.lit(float(b)) for b in bounds))))
    w = Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    out = grid.join(counts.where("le is not null").select(*keys, "le", "n"), [*keys, "le"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("cumulative", F.sum("n").over(w))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float) -> DataFrame:
    """AG7: quantile by linear interpolation in its bucket; beyond all bounds the mean."""
    own = Window.partitionBy(*keys).orderBy("le")
    lower = F.coalesce(F.lag("le").over(own), F.lit(0.0))
    steps = hist.withColumn("lower", lower).withColumn("before", F.col("cumulative") - F.col("n")).withColumn("target", q * F.col("count"))
    hit = steps.where((F.col("cumulative") >= F.col("target")))
    value = F.when(F.col("n") <= 0, F.col("le")).otherwise(F.col("lower") + (F.col("target") - F.col("before")) / F.col("n") * (F.col("le") - F.col("lower")))
    first = hit.groupBy(*keys).agg(F.min_by(value, "le").alias("inside"))
    mean = hist.groupBy(*keys).agg(F.max(F.col("sum") / F.col("count")).alias("mean"))
    return mean.join(first, keys, "left").select(*keys, F.coalesce("inside", "mean").alias("quantile"))


def alias_match(answers: pd.Series, aliases: pd.Series) -> pd.Series:
    """EV8: whether an answer equals an alias after normalisation, or holds it as whole words."""
    import re
    import string

    def norm(t: str) -> str:
        t = t.lower().translate(str.maketrans("", "", string.punctuation))
        return " ".join(re.sub(r"\b(a|an|the)\b", " ", t).split())

    return pd.Series([any(f" {norm(x)} " in f" {norm(a or '')} " for x in (xs if xs is not None else []) if norm(x)) for a, xs in zip(answers, aliases, strict=True)], dtype=bool)
