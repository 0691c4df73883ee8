import math
import random
from collections import Counter

import numpy as np

from cairnlake.llm import langid as x

WORDS = {"en": "the of and river stone house with from under light small bird this their".split(), "fr": "le la et de rivière pierre maison avec sous lumière petit oiseau cette leur".split(), "de": "der die und von fluss stein haus mit unter licht klein vogel diese ihre".split()}


def rows(n=240, seed=3):
    rng = random.Random(seed)
    langs = sorted(WORDS)
    return [(i, " ".join(rng.choices(WORDS[langs[i % 3]], k=rng.randint(5, 60))).capitalize() + ".", langs[i % 3], langs[(i + 1) % 3]) for i in range(n)]


def test_model_is_interpolated_kneser_ney():
    text = "abab abba baab"
    padded = " " + text + " "
    c = Counter(padded[i : i + 3] for i in range(len(padded) - 2))
    pack = lambda s: sum(ord(ch) << (21 * (len(s) - 1 - i)) for i, ch in enumerate(s))
    m = x.Model({"l": (np.array([pack(k) for k in c], np.uint64), np.array([float(v) for v in c.values()]))})
    disc = lambda v: (a / (a + 2 * b) if (a := sum(y == 1 for y in v)) and (b := sum(y == 2 for y in v)) else 0.5)
    k2, k1 = Counter(g[1:] for g in c), None
    k1 = Counter(g[1] for g in k2)
    d3, d2, d1 = disc(c.values()), disc(k2.values()), disc(k1.values())
    chars = {ch for g in c for ch in g}

    def p1(ch):
        return max(k1[ch] - d1, 0) / sum(k1.values()) + d1 * len(k1) / sum(k1.values()) / (len(chars) + 1)

    def p2(b, ch):
        n = sum(v for g, v in k2.items() if g[0] == b)
        return p1(ch) if not n else max(k2[b + ch] - d2, 0) / n + d2 * sum(g[0] == b for g in k2) / n * p1(ch)

    def p3(a, b, ch):
        n = sum(v for g, v in c.items() if g[:2] == a + b)
        return p2(b, ch) if not n else max(c[a + b + ch] - d3, 0) / n + d3 * sum(g[:2] == a + b for g in c) / n * p2(b, ch)

    for a, b, ch in [*c, "bbb", "a b", "aaz", "zzz"[:3]]:
        got = m.log_probs(*(np.array([ord(v)], np.uint64) for v in (a, b, ch)))[0, 0]
        assert math.isclose(got, math.log(p3(a, b, ch)), rel_tol=1e-4), (a, b, ch)
    assert sum(p3("a", "b", ch) for ch in chars) < 1 + 1e-9


def test_characters():
    s = lambda t: "".join(map(chr, x.characters(t)))
    assert (s("A--b 1c"), s("12 !"), s(""), s("É\U0001f600")) == (" a b c ", "", "", " é ")


def test_held_out_rows_are_recognised_and_foreign_ones_rejected(spark):
    extra = [(900, None, "en", ""), (901, "", "en", ""), (902, "12 34 !", "de", ""), (903, "Ωμέγα και άλφα λόγος θάλασσα " * 9, None, ""), (None, "le petit oiseau sous la lumière de la maison", None, ""), (1, rows()[1][1], "de", "")]
    docs = spark.createDataFrame(rows() + extra, "doc_id long, text string, lang string, _text string")
    model = x.fit(docs)
    assert model.langs == ["de", "en", "fr"]
    got = x.identify(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 246 and all(by[i]._lang == lang and not by[i]._rejected for i, _, lang, _ in rows())
    assert [by[i]._lang for i in (900, 901, 902)] == ["und"] * 3 and by[None]._lang == "fr"
    assert by[903]._rejected and 0 <= by[903]._score <= 1
    kept = x.drop_rejected(docs)
    assert kept.columns == docs.columns and {900, 901, 902, 903}.isdisjoint({r.doc_id for r in kept.collect()})


def test_long_texts_are_scored_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, _text string")
    model = x.fit(docs)
    text = "the river under the small house " * 300
    whole, n = model.entropies([text])
    monkeypatch.setattr(x, "PIECE", 100)
    parts, k = model.entropies([text, "a", ""])
    assert np.allclose(whole[0], parts[0], atol=0.2) and abs(int(n[0]) - int(k[0])) < 200 and k[2] == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert x.identify(docs, x.fit(docs)).collect() == []


def test_long_texts_are_scored_as_one(monkeypatch):
    rng = random.Random(5)
    counts = {}
    for lang, vocab in (("a", "the of and river stone"), ("b", "der die und fluss stein")):
        c = x.characters(" ".join(rng.choices(vocab.split(), k=300)))
        keys, n = np.unique(x._pack(c[:-2], c[1:-1], c[2:]), return_counts=True)
        counts[lang] = (keys, n.astype(float))
    model = x.Model(counts)
    texts = [" ".join(rng.choices("the und river der of stein 12 ,".split(), k=k)) for k in (0, 1, 3, 50, 900)] + ["", "!!", "a", "x" * 700]
    whole = model.entropies(texts)
    plain = []
    for c in map(x.characters, texts):
        one = [model.log_probs(c[i : i + 1], c[i + 1 : i + 2], c[i + 2 : i + 3])[0].astype(float) for i in range(len(c) - 2)]
        plain.append((-np.sum(one, axis=0) / len(one)).tolist() if one else [0.0, 0.0])
    assert np.allclose(whole[0], plain, atol=1e-5)
    for piece in (1, 2, 7, 64):
        monkeypatch.setattr(x, "PIECE", piece)
        again = model.entropies(texts)
        assert np.allclose(again[0], whole[0], atol=1e-9) and (again[1] == whole[1]).all()
