"""Toxicity (operator 8): a weighted finite-state grammar over clauses.

Five transducers, each with its own input and output tape, read a clause one after the other: insults (a lexicon with
weights; each is marked or passed over), threats (a verb, marked or passed over), targets (a marked threat needs
someone that the clause addresses, before or after it; a marked insult may claim one), negation (a marked word within
``WINDOW`` words of a negator must take the negated mark) and reported speech (with a verb of saying or a quotation
mark anywhere in the clause, marked words must take the reported mark). Each guesses where what decides comes later
and ends in a state that accepts only right guesses. They are composed, tape on tape, into one transducer; a clause's
reading is its best path in the (max, +) semiring: the accepted one of the greatest weight, the first in the order
of arcs among equals. A document's evidence is the weight of its marked words under each label; other words add nothing.

Clauses end at sentence marks and line ends alone and are read whole, whatever their length: a run of plain words
longer than ``WINDOW`` leaves every transducer where ``WINDOW`` of them do, so it is read as that many.

Fit, on labelled rows that are not held out, at most about ``max_fit_rows`` (by hash of the id): the lexicon holds
words and word stems whose odds of label 1 are surely high, counted by Spark over one document of each group of
near copies; the labels' weights come from a ridge logistic regression. The rows' order changes nothing.

Cases: a null or empty text scores as one without marked words; without labelled rows of both kinds every document
scores 0; a null id is held out; repeated rows give repeated results; an id with two labels counts as toxic; labels other than 0 and 1 take no part; an
empty table gives an empty result; very long texts are read whole; only the named columns are read, so others may
have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairnlake.llm.common import bounded_batches, column, held_out, written

#: Labelled rows that the fit reads at most (in the mean); entries of the lexicon; lengths of stems.
MAX_FIT_ROWS, MAX_LEXICON, STEMS = 20_000, 5_000, (4, 5, 6, 7)
#: A lexicon entry needs so many documents of label 1, that share of them, and this lower bound of its log odds.
MIN_DOCS, MIN_SHARE, MIN_LOG_ODDS = 4, 0.004, 1.5
SCORE_AT = 0.3
#: Words that a negator reaches over; what a threat weighs, and what a target, a negator and a report add.
WINDOW, THREAT_WEIGHT, AIMED, NEGATED, REPORTED = 5, 1.5, 0.2, -0.5, -0.5

_TOKENS = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:,\n\"“”„«»]")
_ENDS = frozenset(".!?;\n")
QUOTES = frozenset("\"“”„«»")
#: Fixed word lists of the grammar, in English, German, French and Spanish; none is another language's common word.
TARGETS = frozenset("you your yours yourself u they them their he him his she her those these people everyone du dich dir euch ihr sie er tu te toi vous ils elles il elle ellos ellas tú usted ustedes vosotros él ella".split())
THREATS = frozenset("kill hurt destroy beat shoot stab burn hang punch murder töten umbringen schlagen verletzen zerstören tuer frapper détruire brûler blesser matar golpear destruir quemar herir".split())
NEGATORS = frozenset("not no never neither nor cannot nicht kein keine nie niemals pas jamais aucun nunca jamás ni".split())
SAYING = frozenset("said says say called calls wrote writes quoted claimed reported sagte sagt schrieb nannte dit disait écrit appelé dijo escribió llamó".split())
#: Classes of words: other, insult, threat, target, negator, saying or quotation mark, comma.
OTHER, INSULT, THREAT, TARGET, NEG, SAY, COMMA = CLASSES = ("other", "insult?", "threat?", "target", "neg", "say", "comma")
LABELS = ("insult", "insult_aimed", "insult_negated", "insult_reported", "threat", "threat_negated", "threat_reported")


@dataclass
class Transducer:
    """arcs[state][symbol read] = [(symbol written, weight, next state)]; state 0 starts. Nothing read without an arc."""

    arcs: list[dict[str, list[tuple[str, float, int]]]]
    final: frozenset[int]

    @classmethod
    def of(cls, symbols: tuple[str, ...], n: int, final: set[int], changed: dict[tuple[int, str], list[tuple[str, float, int]]]) -> Transducer:
        """A transducer that copies every symbol and stays, except where ``changed`` says otherwise."""
        return cls([{s: changed.get((q, s), [(s, 0.0, q)]) for s in symbols} for q in range(n)], frozenset(final))

    def compose(self, other: Transducer) -> Transducer:
        """What ``other`` writes as it reads what ``self`` writes; weights add; states that can't be reached are left out."""
        at, todo, arcs = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            out: dict[str, list[tuple[str, float, int]]] = {}
            for symbol, own in self.arcs[a].items():
                for middle, w, na in own:
                    for written_, v, nb in other.arcs[b].get(middle, ()):
                        if (na, nb) not in at:
                            at[na, nb] = len(at)
                            todo.append((na, nb))
                        out.setdefault(symbol, []).append((written_, w + v, at[na, nb]))
            arcs.append(out)
        return Transducer(arcs, frozenset(k for (a, b), k in at.items() if a in self.final and b in other.final))

    def best(self, symbols: list[tuple[str, float]]) -> tuple[float, list[tuple[str, float]]]:
        """The accepted path of the greatest weight: its weight, and what it writes, with weights. A symbol read adds its own weight where it is marked."""
        front: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        for symbol, own in symbols:
            after: dict[int, tuple[float, tuple | None]] = {}
            for q, (total, path) in front.items():
                for out, w, nq in self.arcs[q].get(symbol, ()):
                    gain = w + own if out in _MARKED else w
                    if nq not in after or total + gain > after[nq][0]:
                        after[nq] = (total + gain, (out, gain, path) if out in _MARKED else path)
            front = after
        total, path = max(((t, p) for q, (t, p) in front.items() if q in self.final), key=lambda x: x[0])
        found = []
        while path:
            found.append(path[:2])
            path = path[2]
        return total, found[::-1]


#: What transducers write for marked words.
_INSULTS, _THREATS = ("insult", "insult_aimed"), ("threat",)
_SUFFIXES = ("", "_negated", "_reported", "_negated_reported")
_MARKED = frozenset(m + s for m in _INSULTS + _THREATS for s in _SUFFIXES)


def insults() -> Transducer:
    return Transducer.of(CLASSES, 1, {0}, {(0, INSULT): [("insult", 0.0, 0), (OTHER, 0.0, 0)]})


def threats() -> Transducer:
    return Transducer.of((*CLASSES, "insult"), 1, {0}, {(0, THREAT): [("threat", 0.0, 0), (OTHER, 0.0, 0)]})


def aims() -> Transducer:
    """States: no target yet; none yet, but one was promised; one was met."""
    changed = {(q, TARGET): [(TARGET, 0.0, 2)] for q in range(3)}
    for q in range(3):
        owes = 2 if q == 2 else 1
        changed[q, "insult"] = [("insult_aimed", AIMED, owes), ("insult", 0.0, q)]
        changed[q, "threat"] = [("threat", 0.0, owes)]
    return Transducer.of((*CLASSES, "insult", "threat"), 3, {0, 2}, changed)


def negation(window: int = WINDOW) -> Transducer:
    """States: how many more words the last negator reaches. A comma ends its reach."""
    plain = _INSULTS + _THREATS
    changed = {}
    for k in range(window + 1):
        changed[k, NEG] = [(NEG, 0.0, window)]
        changed[k, COMMA] = [(COMMA, 0.0, 0)]
        if k:
            changed |= {(k, s): [(s, 0.0, k - 1)] for s in (OTHER, TARGET, SAY)}
            changed |= {(k, s): [(s + "_negated", NEGATED, k - 1)] for s in plain}
    return Transducer.of((*CLASSES, *plain), window + 1, set(range(window + 1)), changed)


def reports() -> Transducer:
    """States: nothing yet; speech was met; none may be met (a word was marked as plain); one was promised."""
    marks = tuple(m + s for m in _INSULTS + _THREATS for s in ("", "_negated"))
    changed = {(0, SAY): [(SAY, 0.0, 1)], (2, SAY): [], (3, SAY): [(SAY, 0.0, 1)]}
    for m in marks:
        changed[0, m] = [(m, 0.0, 2), (m + "_reported", REPORTED, 3)]
        changed[1, m] = [(m + "_reported", REPORTED, 1)]
        changed[3, m] = [(m + "_reported", REPORTED, 3)]
    return Transducer.of((*CLASSES, *marks), 4, {0, 1, 2}, changed)


def grammar() -> Transducer:
    """The composition of the five transducers."""
    out = insults()
    for following in (threats(), aims(), negation(), reports()):
        out = out.compose(following)
    return out


def label(mark: str) -> str:
    """The label that a mark counts under: negated before reported before aimed."""
    kind = mark.split("_")[0]
    return kind + ("_negated" if "_negated" in mark else "_reported" if "_reported" in mark else "_aimed" if "_aimed" in mark else "")


_AT = {m: LABELS.index(label(m)) for m in _MARKED}


class Scorer:
    """The grammar with a lexicon: evidence of a text under each label."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon, self.machine = lexicon, grammar()
        self.stems = sorted({len(k) for k in lexicon if not k.endswith("$")})
        self.known: dict[str, tuple[str, float]] = {}
        self.fixed = {w: (c, v) for c, v, ws in ((TARGET, 0.0, TARGETS), (THREAT, THREAT_WEIGHT, THREATS), (NEG, 0.0, NEGATORS), (SAY, 0.0, SAYING | QUOTES), (COMMA, 0.0, {","})) for w in ws}

    def look_up(self, word: str) -> tuple[str, float]:
        weight = max((self.lexicon.get(k, 0.0) for k in (word + "$", *(word[:n] for n in self.stems if len(word) >= n))), default=0.0)
        found = (INSULT, weight) if weight > 0 else (NEG, 0.0) if word.endswith("n't") else self.fixed.get(word, (OTHER, 0.0))
        if len(self.known) > 200_000:
            self.known.clear()
        self.known[word] = found
        return found

    def clause(self, classes: list[tuple[str, float]]) -> list[tuple[str, float]]:
        """Marked words of a clause on its best path: mark and weight."""
        short: list[tuple[str, float]] = []
        for plain, run in groupby(classes, key=lambda c: c[0] == OTHER):
            run = list(run)
            short += run[:WINDOW] if plain else run
        return self.machine.best(short)[1]

    def evidence(self, text: str) -> np.ndarray:
        """For each label the weight of marked words; then the number of clauses that hold any, and the heaviest one's weight."""
        out = np.zeros(len(LABELS) + 2)
        words = _TOKENS.findall(text.lower().replace("’", "'"))
        known, look_up = self.known, self.look_up
        classes = [known.get(w) or look_up(w) for w in words]
        done = 0
        for i in [i for i, c in enumerate(classes) if c[0] in (INSULT, THREAT)]:
            if i < done:
                continue  # its clause was read
            lo = i
            while lo > done and words[lo - 1] not in _ENDS:
                lo -= 1
            done = i
            while done < len(words) and words[done] not in _ENDS:
                done += 1
            marked = self.clause(classes[lo:done])
            for mark, weight in marked:
                out[_AT[mark]] += weight
            if marked:
                out[-2] += 1
                out[-1] = max(out[-1], sum(w for _, w in marked))
        return out


def design(evidence: np.ndarray) -> np.ndarray:
    """Columns of the regression: damped evidence of each label, clauses with marked words, the heaviest clause, a constant."""
    return np.concatenate([np.log1p(np.maximum(evidence, 0)), np.ones((len(evidence), 1))], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression towards ``prior`` by Newton steps; the constant is free."""
    w, pull = prior.copy(), np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - prior)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w -= move * min(1.0, 5 / max(1e-9, np.abs(move).max()))
        if np.abs(move).max() < 1e-6:
            break
    return w


#: Towards what the regression is drawn: negated and reported matches count less, aimed ones more.
PRIOR = np.array([1.0, 1.5, -0.5, -0.5, 1.5, -0.5, -0.5, 0.0, 1.0, -4.0])


@dataclass
class Model:
    lexicon: dict[str, float]
    weights: np.ndarray

    def scores(self, scorer: Scorer, texts: list[str]) -> np.ndarray:
        x = design(np.array([scorer.evidence(t) for t in texts]).reshape(len(texts), -1))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _features(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return {w + "$" for w in words if len(w) > 2} | {w[:n] for w in words for n in STEMS if len(w) >= n}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("feature", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])
    for batch in batches:
        n: dict[str, list[int]] = {}
        for text, toxic in zip(column(batch, "text"), column(batch, "toxic"), strict=True):
            for f in _features(text):
                n.setdefault(f, [0, 0])[1 - toxic] += 1
        # what no document of label 1 in a batch holds is counted too: its absence elsewhere is unknown here
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[k][0] for k in keys], pa.int64()), pa.array([n[k][1] for k in keys], pa.int64())], schema=out)


def lower_odds(pos: float, neg: float, n1: int, n0: int) -> float:
    """Log odds of label 1 less two standard errors."""
    pos, neg = pos + 0.5, neg + 0.5
    return math.log(pos / (n1 + 1.5 - pos)) - math.log(neg / (n0 + 1.5 - neg)) - 2 * math.sqrt(1 / pos + 1 / neg)


def unexplained(found: dict[str, tuple[int, int]], n1: int, n0: int) -> dict[str, float]:
    """Weights of words, and of those stems whose other words give no evidence against them."""
    kept = {k: v for k, v in found.items() if k.endswith("$")}
    units = dict(kept)
    for n in sorted(STEMS, reverse=True):
        inside: dict[str, list[tuple[str, int, int]]] = {}
        for k, (p, q) in units.items():
            if len(k.rstrip("$")) >= n:
                inside.setdefault(k[:n], []).append((k, p, q))
        for stem, (pos, neg) in found.items():
            if len(stem) != n or stem.endswith("$"):
                continue
            own = inside.get(stem, [])
            rest_pos, rest_neg = (max(0, a - sum(x[i] for x in own)) for i, a in ((1, pos), (2, neg)))
            several = len(own) > 1 or rest_pos >= MIN_DOCS  # a stem of one word says nothing of others
            if several and (not rest_neg or lower_odds(rest_pos, rest_neg, n1, n0) >= MIN_LOG_ODDS):
                kept[stem] = (pos, neg)
                for k, _, _ in own:
                    units.pop(k, None)
                units[stem] = (pos, neg)
    return {k: lower_odds(*v, n1, n0) for k, v in kept.items()}


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model | None:
    """Lexicon and weights from labelled rows that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    if not n:
        return None
    share = min(1.0, max_fit_rows / n)
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    # One document of each group of near copies: those that share the least hash of their three-word shingles, by two
    # hashes. Which one stays hangs on its text alone.
    rows = rows.withColumn("words", F.split(F.lower("text"), r"[^\p{L}]+"))
    at = F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))
    signs = [F.array_min(F.transform(at, lambda i, s=s: F.xxhash64(F.lit(s), *(F.get("words", i + k) for k in range(3))))) for s in (1, 2)]
    rows = rows.groupBy(signs[0].alias("s1"), signs[1].alias("s2"), "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = written(rows.select("text", "toxic"), "toxicity-fit")
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return None
    counts = rows.mapInArrow(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(pos / (n1 + 1 - F.col("pos"))) - F.log(neg / (n0 + 1 - F.col("neg")))
    low = odds - 2 * F.sqrt(1 / pos + 1 / neg)
    found = counts.where(F.col("pos") >= max(MIN_DOCS, math.ceil(MIN_SHARE * n1))).withColumn("low", low).where(F.col("low") >= MIN_LOG_ODDS)
    best = found.orderBy(F.desc("low"), "feature").limit(MAX_LEXICON).collect()
    lexicon = unexplained({r.feature: (r.pos, r.neg) for r in best}, n1, n0)
    handle = spark.sparkContext.broadcast(lexicon)  # at most MAX_LEXICON entries

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(handle.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.evidence(t).tolist() for t in column(batch, "text")], pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = rows.mapInArrow(evidence, "x array<double>, toxic int").toPandas()
    x, y = design(np.array(got["x"].tolist())), got["toxic"].to_numpy(float)
    order = np.lexsort((*x.T, y))  # sums in floating point hang on the order
    x, y = x[order], y[order]
    return Model(lexicon, logistic(x, y, PRIOR))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: the id and score, from the text alone."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if model is None:
        return rows.select(id_col, F.lit(0.0).alias("score"))
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(handle.value.lexicon)
        for batch in batches:
            found = handle.value.scores(scorer, column(batch, "_text"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[id_col, "score"])

    return rows.mapInArrow(run, StructType([docs.schema[id_col], StructField("score", DoubleType())]))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= SCORE_AT).cast("int").alias("predicted"))
