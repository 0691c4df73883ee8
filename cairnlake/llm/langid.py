"""Language ID (operator 9): interpolated Kneser-Ney character trigram models, one for each language.

Fit: of the rows that may be learned from, at most about ``max_docs_per_lang`` of each language, whole texts, by
hash of the id; four fifths are counted, by Spark, and one fifth calibrates. The counts give log probabilities of
all trigrams, bigrams and characters seen in any language, for every language, in sorted arrays of 64-bit hashes
(a bijection of the packed characters, so no two share one). The bound on rows bounds the model, which is broadcast.

Score: the mean negative log probability of each whole text (its cross-entropy) under every model; the lowest wins.
Rejection: a text whose cross-entropy exceeds what calibration texts of its language and length show. The excess
is measured as mean + spread / sqrt(n), where n is the number of characters scored.

Cases: a null text, or one without a letter, gives ``und`` with score 0 and counts as rejected; ties take the
language that sorts first; a null id is held out; no labelled rows at all: every text is ``und``; repeated rows give
repeated results; an empty table gives an empty result; very long texts are scored whole, by stretches that share two
characters, which changes nothing; columns of any other name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import blocks, bounded_batches, column, held_out

#: Rows of a language that the fit reads at most (in the mean); least excess in nats that a rejection needs.
MAX_DOCS_PER_LANG, MARGIN = 1500, 0.8
#: Quantile of the calibration texts' spread, and the factor on it.
SPREAD_QUANTILE, SPREAD_FACTOR = 0.999, 3.0
UNDETERMINED = "und"
#: Characters that are scored together: their arrays take about 100 bytes a character.
PIECE = 1 << 18

_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def characters(text: str) -> np.ndarray:
    """Lower-case letters, each run of others one space, a space at both ends; empty without a letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[cp]
    if not letter.any():
        return np.zeros(0, np.uint64)
    padded = np.concatenate(([False], letter, [False]))
    keep = padded.copy()
    keep[1:] |= padded[:-1]
    keep[0] = True
    return np.where(padded, np.concatenate(([32], cp, [32])), 32)[keep].astype(np.uint64)


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads packed characters evenly."""
    h = keys * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _pack(*parts: np.ndarray) -> np.ndarray:
    key = parts[0]
    for p in parts[1:]:
        key = (key << np.uint64(21)) | p
    return key


class Table:
    """Rows of log values for sorted hashes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(h := mixed(keys))
        self.hashes, self.values = h[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == h


class Model:
    """Log probabilities of every language. counts: for each language the packed trigrams and how often each was seen."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.langs = sorted(counts)
        low, mid = np.uint64((1 << 21) - 1), np.uint64(21)
        tri = np.unique(np.concatenate([counts[x][0] for x in self.langs]))
        bi = np.unique(np.concatenate([tri & np.uint64((1 << 42) - 1), tri >> mid]))
        uni = np.unique(np.concatenate([bi & low, bi >> mid]))
        n, size = len(uni) + 1, (len(self.langs),)
        p1, g2 = np.zeros((len(uni), *size)), np.zeros((len(uni), *size))
        p2, g3 = np.zeros((len(bi), *size)), np.zeros((len(bi), *size))
        p3, self.p0 = np.zeros((len(tri), *size)), np.zeros(size)
        for k, lang in enumerate(self.langs):
            keys, c = counts[lang]
            c3 = np.zeros(len(tri))
            c3[np.searchsorted(tri, keys)] = c
            seen = c3 > 0
            ctx, cont = np.searchsorted(bi, tri >> mid), np.searchsorted(bi, tri & np.uint64((1 << 42) - 1))
            d3 = self._discount(c)
            ctx_sum, ctx_kinds = np.bincount(ctx, c3, len(bi)), np.bincount(ctx[seen], minlength=len(bi))
            kinds2 = np.bincount(cont[seen], minlength=len(bi)).astype(float)  # different characters before a bigram
            b_ctx, b_cont = np.searchsorted(uni, bi >> mid), np.searchsorted(uni, bi & low)
            d2 = self._discount(kinds2[kinds2 > 0])
            mid_sum, mid_kinds = np.bincount(b_ctx, kinds2, len(uni)), np.bincount(b_ctx[kinds2 > 0], minlength=len(uni))
            kinds1 = np.bincount(b_cont[kinds2 > 0], minlength=len(uni)).astype(float)
            total = max(kinds1.sum(), 1.0)
            d1 = self._discount(kinds1[kinds1 > 0])
            spare = d1 * (kinds1 > 0).sum() / total
            self.p0[k] = spare / n if spare else 1.0 / (n * total)
            q1 = np.maximum(kinds1 - d1, 0) / total + self.p0[k]
            w2 = np.where(mid_sum > 0, d2 * mid_kinds / np.maximum(mid_sum, 1), 1.0)
            q2 = np.maximum(kinds2 - d2, 0) / np.maximum(mid_sum, 1)[b_ctx] + w2[b_ctx] * q1[b_cont]
            w3 = np.where(ctx_sum > 0, d3 * ctx_kinds / np.maximum(ctx_sum, 1), 1.0)
            q3 = np.maximum(c3 - d3, 0) / np.maximum(ctx_sum, 1)[ctx] + w3[ctx] * q2[cont]
            for out, q in ((p1, q1), (g2, w2), (p2, q2), (g3, w3), (p3, q3)):
                out[:, k] = np.log(np.maximum(q, 1e-12))
        self.p0 = np.log(np.maximum(self.p0, 1e-12)).astype(np.float32)
        self.uni, self.back2, self.bi, self.back3, self.tri = Table(uni, p1), Table(uni, g2), Table(bi, p2), Table(bi, g3), Table(tri, p3)
        self.mean, self.spread = np.zeros(size), np.full(size, np.inf)  # as long as nothing is calibrated, nothing is rejected

    @staticmethod
    def _discount(c: np.ndarray) -> float:
        n1, n2 = (c == 1).sum(), (c == 2).sum()
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    def log_probs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        at, hit = self.tri.find(_pack(a, b, c))
        out = self.tri.values[at]
        if len(miss := np.flatnonzero(~hit)):
            out[miss] = self._from_bigrams(a[miss], b[miss], c[miss])
        return out

    def _from_bigrams(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        at, hit = self.back3.find(_pack(a, b))
        out = np.where(hit[:, None], self.back3.values[at], 0)
        at, hit = self.bi.find(_pack(b, c))
        low = self.bi.values[at]
        if len(miss := np.flatnonzero(~hit)):
            at, hit = self.back2.find(b[miss])
            low[miss] = np.where(hit[:, None], self.back2.values[at], 0)
            at, hit = self.uni.find(c[miss])
            low[miss] += np.where(hit[:, None], self.uni.values[at], self.p0)
        return out + low

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy under each language, and the number of characters scored (0: no letter)."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for first, last in blocks(texts, PIECE):
            chars = [characters(t) for t in texts[first:last]]
            # Stretches of a long text share two characters, so that every trigram is in one of them.
            parts = [(i, x[s : s + PIECE + 2]) for i, x in enumerate(chars, first) for s in range(0, max(0, len(x) - 2), PIECE)]
            for lo, hi in blocks([p for _, p in parts], PIECE + 2):
                own = [p for _, p in parts[lo:hi]]
                sizes = np.array([len(p) - 2 for p in own])
                a, b, c = (np.concatenate([p[k : len(p) - 2 + k] for p in own]) for k in range(3))
                sums = np.add.reduceat(self.log_probs(a, b, c), np.concatenate(([0], np.cumsum(sizes)[:-1])), axis=0, dtype=np.float64)
                rows = np.array([i for i, _ in parts[lo:hi]])
                np.add.at(total, rows, sums)
                np.add.at(n, rows, sizes)
        return -total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(texts)), best]
        odds = np.exp(-(h - low[:, None]) * (50 * n / (n + 50))[:, None])  # characters hang together: their evidence adds up more and more slowly
        score = np.where(n > 0, 1 / odds.sum(1), 0.0)
        rejected = (n == 0) | (low > self.mean[best] + np.maximum(MARGIN, self.spread[best] / np.sqrt(np.maximum(n, 1))))
        return [self.langs[k] if m else UNDETERMINED for k, m in zip(best, n, strict=True)], score, rejected


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        langs, texts = column(batch, "lang"), column(batch, "text")
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(langs, texts, strict=True):
            if len(x := characters(text)) > 2:
                by.setdefault(lang, []).append(_pack(x[:-2], x[1:-1], x[2:]))
        for lang, keys in by.items():
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(n)], schema=out)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> Model:
    """Models of the languages in ``docs``, from rows that are not held out and have a language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(~held_out() & F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model.__new__(Model)._empty()
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, max_docs_per_lang / n))))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    chosen = rows.where((at < share[F.col("lang")] * 1_000_000) & F.col("text").isNotNull()).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)))
    counted = chosen.where("fold > 0").select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if counted.empty:
        return Model.__new__(Model)._empty()
    model = Model({lang: (g["key"].to_numpy().astype(np.uint64), g["n"].to_numpy().astype(float)) for lang, g in counted.groupby("lang")})
    handle = spark.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = handle.value
        at = {x: k for k, x in enumerate(m.langs)}
        for batch in batches:
            h, n = m.entropies(column(batch, "text"))
            own = np.array([at.get(x, -1) for x in column(batch, "lang")], np.int64)
            ok = np.flatnonzero((n > 0) & (own >= 0))
            ok = ok[h[ok].argmin(1) == own[ok]]
            yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(h[ok, own[ok]]), pa.array(n[ok])], names=["k", "h", "n"])

    fold = chosen.where("fold = 0").select("lang", "text").mapInArrow(calibrate, "k long, h double, n long").toPandas()
    for k, g in fold.groupby("k"):
        h, n = g["h"].to_numpy(), g["n"].to_numpy()
        if len(g) >= 5:
            model.mean[k] = np.average(h, weights=np.sqrt(n))
            model.spread[k] = SPREAD_FACTOR * max(0.0, np.quantile((h - model.mean[k]) * np.sqrt(n), SPREAD_QUANTILE))
    handle.unpersist()
    return model


def _empty(self: Model) -> Model:
    self.langs = []
    return self


Model._empty = _empty


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each row: the columns named in ``keep`` (default: the id) and _lang, _score, _rejected."""
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = keep or [id_col]
    handle = spark.sparkContext.broadcast(model)  # bounded by the rows of the fit
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = handle.value.predict(column(batch, "_text"))
            cols = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "_lang", "_score", "_rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*fields, StructField("_lang", StringType()), StructField("_score", DoubleType()), StructField("_rejected", BooleanType())])
    return docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(run, schema)


def drop_rejected(docs: DataFrame, max_docs_per_lang: int = MAX_DOCS_PER_LANG) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, with all their columns; without any model, all rows."""
    model = fit(docs, max_docs_per_lang=max_docs_per_lang)
    if not model.langs:
        return docs
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))  # whatever names the columns have
    return identify(rows, model, keep=["row"]).where(~F.col("_rejected")).select("row.*")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))
