"""Quality rules (operator 5): base rules on counts, then an isolation forest on rule statistics.

Statistics of each whole text come from Arrow batches, once. Of the labelled rows that pass the base rules and are not held
out a share ``GROW`` (by hash of the id, alike on every run) grows trees and all others calibrate. Trees grow on samples, as
isolation asks, of at most ``GROW`` of ``max_fit_rows`` rows. Each tree takes ``PSI`` of them at random, ``ODD`` of label 0 (what is
odd must be rare to be isolated soon) and the rest of label 1, and splits them: a statistic at random among those in
which the node's rows differ, at a random value between the least and the greatest of the node's rows, until rows are
alone or ``DEPTH`` is reached. Short mean path lengths mark documents unlike the rest. The threshold is the score that
separates labels 0 from 1 of all calibration rows best among those that drop at most ``MAX_CLEAN_LOSS`` of label 1.
Held-out rows (``common.held_out``) are never learned from; figures of accuracy come from them.

Cases: a null text has no words and fails the base rules; without labelled rows of both kinds in either part the
forest gives no verdict and the base rules alone decide; a score equal to the threshold is dropped; repeated rows
give repeated results; an id with two labels counts as good; an empty table gives an empty result; very long texts
are measured whole; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlake.llm.common import WORD, bounded_batches, column, forget, held_out, text_or_empty, written

#: Labelled rows that growing trees and calibrating would share at most if both sampled (trees get GROW of them); trees; rows of a tree, and those of label 0 among them; depth at which a tree stops.
MAX_FIT_ROWS, TREES, PSI, ODD, DEPTH = 20_000, 100, 256, 5, 12
#: Share of the fit's rows that grow trees; share of label 1 that the threshold may drop of the others.
GROW, MAX_CLEAN_LOSS = 0.6, 0.003
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the forest: shares and means, so that length alone is no oddity.
FEATURES = ("mean_word", "symbols_a_word", "repeat_share", "upper_share", "letter_share", "digit_share", "distinct_share", "symbol_words", "letterless_words", "capital_words")
SCHEMA = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in BASE), ("features", pa.list_(pa.float32()))])

_WORDS = re.compile(WORD)


def repeat_words(words: list[str]) -> int:
    """Words in windows of three that are in the text twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, n)
    if n < 1 << 20:
        keys = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    else:
        _, pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        keys = pair.reshape(-1) * n + ids[2:]
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts[inverse.reshape(-1)] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def distinct_share(words: list[str], window: int = 200) -> float:
    """Mean share of distinct words over every run of ``window`` words (of all words, if there are fewer)."""
    n, w = len(words), min(window, len(words))
    if not n:
        return 0.0
    ids = np.fromiter(map({}.setdefault, words, count()), np.int64, n)
    order = np.argsort(ids, kind="stable")
    before = np.full(n, -1)
    same = ids[order[1:]] == ids[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    at = np.arange(n)
    # A word counts in the runs that start after its last occurrence and hold it.
    runs = np.minimum(at, n - w) - np.maximum(np.maximum(0, at - w + 1), before + 1) + 1
    return float(np.maximum(runs, 0).sum()) / ((n - w + 1) * w)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of each code point: bit 0 white space, 1 symbol, 2 letter, 3 upper case, 4 lower case, 5 digit 0-9."""
    tests = (lambda c: c == " " or "\t" <= c <= "\r", SYMBOLS.__contains__, str.isalpha, str.isupper, str.islower, lambda c: "0" <= c <= "9")
    out = np.zeros(0x110000, np.uint8)
    for bit, test in enumerate(tests):
        out |= np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000).astype(np.uint8) << bit
    return out


def statistics(text: str) -> tuple[list[int], list[float]]:
    words = _WORDS.findall(text)
    n, chars = len(words), sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if _WORDS.search(x)]
    base = [n, chars, symbols, len(lines) - len(set(lines)), repeat_words(words)]
    if not n:
        return base, [0.0] * len(FEATURES)
    kinds = _kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    inside = np.concatenate(([False], kinds & 1 == 0))
    of_word = np.bitwise_or.reduceat(kinds, np.flatnonzero(inside[1:] & ~inside[:-1]))  # white space after a word sets bit 0 alone
    each = np.bincount(kinds, minlength=64)
    upper, lower, letters, digits = (int(each[np.arange(64) & bit > 0].sum()) for bit in (8, 16, 4, 32))
    capital = (of_word & 24) == 8
    return base, [
        chars / n, symbols / n, base[4] / n, upper / max(1, upper + lower), letters / chars, digits / chars, distinct_share(words),
        float((of_word & 2 > 0).mean()), float((of_word & 4 == 0).mean()), float(capital.mean()),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(t) for t in column(batch, "text")]
        cols = [pa.array(x, pa.int64()) for x in zip(*(b for b, _ in found), strict=True)] if found else [pa.array([], pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([f for _, f in found], pa.list_(pa.float32()))], schema=SCHEMA)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, the base counts, and the array of forest statistics."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_measure, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", features array<float>")


class Forest:
    """Isolation trees as arrays: split feature (-1 at leaves), threshold, children, and path length at leaves.

    Each tree is grown on ``psi`` rows: ``odd`` of the rows marked so (all, if there are fewer), the others of the rest."""

    def __init__(self, rows: np.ndarray, marked: np.ndarray, trees: int = TREES, psi: int = PSI, odd: int = ODD, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        parts = [rows[marked], rows[~marked]]
        few = min(odd, len(parts[0]))
        take = (few, min(psi - few, len(parts[1])))
        self.psi = sum(take)
        self.trees = [self._grow(np.concatenate([p[rng.choice(len(p), k, replace=False)] for p, k in zip(parts, take, strict=True) if k]), rng) for _ in range(trees)]

    @staticmethod
    def expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n points."""
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, depth = [], [], [], [], []

        def node(part: np.ndarray, d: int) -> int:
            at = len(feature)
            for xs, x in ((feature, -1), (cut, 0.0), (left, at), (right, at), (depth, d + self.expected(len(part)))):
                xs.append(x)
            lo, hi = part.min(0), part.max(0)
            if d < DEPTH and len(wide := np.flatnonzero(hi > lo)):
                f = int(rng.choice(wide))
                x = float(rng.uniform(lo[f], hi[f]))
                below = part[:, f] < x
                feature[at], cut[at] = f, x
                if below.any():  # a value drawn at the least one leaves all rows on one side
                    left[at] = node(part[below], d + 1)
                    right[at] = node(part[~below], d + 1)
                else:
                    feature[at] = -1
            return at

        node(rows, 0)
        return tuple(np.array(x) for x in (feature, cut, left, right, depth))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected): near 1 odd, under 0.5 ordinary."""
        total = np.zeros(len(rows))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                below = rows[np.arange(len(rows)), f] < cut[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(self.expected(self.psi), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_CLEAN_LOSS) -> float:
    """The cut that drops most of label 0 less what it drops of label 1, dropping at most max_loss of label 1."""
    order = np.argsort(-scores, kind="stable")
    bad_got, good_lost = np.cumsum(~good[order]) / max(1, (~good).sum()), np.cumsum(good[order]) / max(1, good.sum())
    sorted_scores = scores[order]
    last = np.append(sorted_scores[1:] < sorted_scores[:-1], True)  # rows of one score go together
    gain = np.where(last & (good_lost <= max_loss), bad_got - good_lost, -1.0)
    best = int(np.argmax(gain))
    if gain[best] <= 0:
        return float("inf")
    return float(sorted_scores[best] + (sorted_scores[best + 1] if best + 1 < len(order) else sorted_scores[best])) / 2


#: Steps of a score by which rows are counted before they are counted one by one.
STEPS = 1 << 16


def threshold_over(rows: DataFrame, max_loss: float = MAX_CLEAN_LOSS) -> float | None:
    """``threshold`` of a table (score, good) of any size; None if one of the labels is missing.

    Rows of a score are counted first, then those of a step of scores; only steps, which are few, are summed up in one task."""
    each = written(rows.groupBy("score").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("fine")), "scores")
    step = F.floor(F.col("score") * STEPS).alias("step")
    after = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(after), F.lit(0))
    steps = each.groupBy(step).agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    steps = steps.select("step", before("bad").alias("bad_before"), before("fine").alias("fine_before"))
    total = each.agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine")).first()
    cut = None
    if total.bad and total.fine:
        down = Window.partitionBy("step").orderBy(F.desc("score"))
        got = (F.sum("bad").over(down) + F.col("bad_before")) / total.bad
        lost = (F.sum("fine").over(down) + F.col("fine_before")) / total.fine
        summed = each.withColumn("step", step).join(steps, "step").select("score", (got - lost).alias("gain"), lost.alias("lost"))
        best = summed.where(F.col("lost") <= max_loss).agg(F.max(F.struct("gain", "score")).alias("b")).first().b
        cut = float("inf")
        if best is not None and best.gain > 0:
            below = each.where(F.col("score") < best.score).agg(F.max("score").alias("s")).first().s
            cut = (best.score + (best.score if below is None else below)) / 2
    forget(each)
    return cut


def _anomaly(forest: Forest, spark: SparkSession) -> Callable[[str], Column]:
    handle = spark.sparkContext.broadcast(forest)  # TREES trees of at most 2 * PSI nodes

    @F.pandas_udf("double")
    def anomaly(features):
        import pandas as pd

        return pd.Series(handle.value.score(np.stack(features.to_numpy())) if len(features) else [], dtype="float64")

    return anomaly


def fit(rows: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> tuple[Callable[[str], Column], float] | None:
    """The forest's score of statistics, and the threshold, from ``measured`` rows and labels (label column: quality, 1 good)."""
    marked = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = marked.count()
    if not n:
        return None
    share = min(1.0, max_fit_rows / n)
    marked = marked.withColumn("grows", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1000)) < int(GROW * 1000))
    chosen = marked.where("grows").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    passed = rows.where(~base_failed()).select("doc_id", "features")
    got = passed.join(F.broadcast(chosen), "doc_id").select("doc_id", "features", "quality").toPandas()
    if got.empty:
        return None
    x = np.array(got["features"].tolist(), np.float32)
    order = np.lexsort((*x.T, got["doc_id"].to_numpy()))  # the same forest, in whatever order rows arrive
    x, good = x[order], got["quality"].to_numpy()[order] == 1
    if good.all() or not good.any():
        return None
    anomaly = _anomaly(Forest(x, ~good), rows.sparkSession)
    cut = threshold_over(passed.join(marked.where("not grows"), "doc_id").select(anomaly("features").alias("score"), (F.col("quality") == 1).alias("good")))
    return None if cut is None else (anomaly, cut)


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """A row for each row: doc_id, the base counts, base_failed, anomaly (the forest's score), kept."""
    rows = written(measured(docs, id_col, text_col), "statistics")
    model = fit(rows, labels, max_fit_rows)
    if model is None:
        return rows.select("doc_id", *BASE, base_failed().alias("base_failed"), F.lit(None).cast("double").alias("anomaly"), (~base_failed()).alias("kept"))
    anomaly, cut = model
    scored = rows.withColumn("anomaly", anomaly("features")).withColumn("base_failed", base_failed())
    return scored.select("doc_id", *BASE, "base_failed", "anomaly", (~F.col("base_failed") & (F.col("anomaly") < cut)).alias("kept"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
