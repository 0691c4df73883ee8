import itertools
import random

import numpy as np
import pytest

from cairnlake.llm import toxicity as x

INSULTS = ["blarg", "snorfle", "gribbit"]


def rows(n=600, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(20, 80))
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) if rng.random() < 0.7 else "zorp" + rng.choice(vocab))
        out.append((i, " ".join(words) + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in data], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int")
    return data, docs, labels, x.fit(docs, labels)


def test_held_out_documents(spark, fitted):
    data, docs, _, model = fitted
    held = {r.doc_id for r in docs.where(x.held_out()).select("doc_id").collect()}
    assert 100 < len(held) < 200
    got = {r.doc_id: r.score for r in x.score(docs, model).collect()}
    right = [(got[i] >= x.SCORE_AT) == bool(y) for i, _, y in data if i in held]
    assert np.mean(right) > 0.97 and all(0 <= s <= 1 for s in got.values())


def test_new_words_of_a_learned_stem(fitted):
    model = fitted[3]
    s = x.Scorer(model.lexicon)
    assert s.look_up("zorpqqq")[0] == x.INSULT and s.look_up("blarg")[0] == x.INSULT
    assert s.look_up("blargx")[0] == x.OTHER and s.look_up("table")[0] == x.OTHER


def test_clauses_are_labelled():
    s = x.Scorer({"idiot$": 2.0})
    at = {k: i for i, k in enumerate(x.LABELS)}
    e = lambda t: s.evidence(t)
    assert e("you are an idiot")[at["insult_aimed"]] > 2 > e("an idiot")[at["insult"]] - 0.1 > 1.5
    assert e("not an idiot")[at["insult_negated"]] > 0 == e("not an idiot")[at["insult"]]
    assert e("he said: idiot")[at["insult_reported"]] > 0
    assert e("not now. an idiot")[at["insult"]] > 0, "a negator does not reach beyond its clause"
    assert e("i will kill you")[at["threat"]] > 0 == e("kill the lights")[at["threat"]]
    assert not e("").any() and not e("all is well").any()
    assert e("idiot. " * 1000)[-2] == 1000


def test_threats_and_who_is_spoken_of():
    s = x.Scorer({"idiot$": 2.0})
    marks = lambda t: [m for m, _ in s.clause([s.look_up(w) for w in x._TOKENS.findall(t.lower())])]
    assert marks("do not kill them") == marks("never hurt you") == marks("it is not true that I would kill you") == ["threat_negated"]
    assert marks("you would not kill") == ["threat_negated"] and marks("you kill") == ["threat"]
    assert marks("kill you, he said") == marks("he said he would kill you") == ["threat_reported"]
    assert marks("idiot, that is what you are") == ["insult_aimed"] and marks("no, you idiot") == ["insult_aimed"]
    assert marks("not you idiot, she said") == ["insult_aimed_negated_reported"]


def test_clauses_of_any_length_are_read_whole():
    s = x.Scorer({"idiot$": 2.0})
    for n in (0, 1, 10, 101, 300, 5000):
        plain = " word" * n
        assert s.evidence(f"you{plain} idiot")[1] == s.evidence("you idiot")[1] > 2
        two = s.evidence(f"you idiot{plain} you idiot")
        assert two[1] == 2 * s.evidence("you idiot")[1] and two[-2] == 1
        said = s.evidence(f"idiot{plain} said he")
        assert said[x.LABELS.index("insult_reported")] > 0 and not said[:2].any()


def best_by_hand(classes):
    """The best reading of a clause, from trying every choice for each word that may be marked."""
    kinds = [c for c, _ in classes]
    at = [i for i, c in enumerate(kinds) if c in (x.INSULT, x.THREAT)]
    target, said, best = x.TARGET in kinds, x.SAY in kinds, 0.0
    for choice in itertools.product(("", "plain", "aimed"), repeat=len(at)):
        total, ok = 0.0, True
        for i, c in zip(at, choice, strict=True):
            if not c:
                continue
            ok &= target or (kinds[i] == x.INSULT and c == "plain")
            ok &= kinds[i] == x.INSULT or c == "plain"
            total += classes[i][1] + (x.AIMED if c == "aimed" else 0.0) + (x.REPORTED if said else 0.0)
            left = kinds[max(0, i - x.WINDOW) : i]
            if x.NEG in left and x.COMMA not in left[len(left) - left[::-1].index(x.NEG) :]:
                total += x.NEGATED
        if ok:
            best = max(best, total)
    return best


def test_best_paths_follow_brute_force():
    rng, machine = random.Random(8), x.grammar()
    for _ in range(3000):
        kinds = rng.choices(x.CLASSES, weights=[5, 2, 2, 1, 1, 1, 1], k=rng.randint(1, 12))
        classes = [(c, rng.choice([0.3, 0.7, 1.5, 2.5]) if c == x.INSULT else x.THREAT_WEIGHT if c == x.THREAT else 0.0) for c in kinds]
        total, marked = machine.best(classes)
        assert abs(total - best_by_hand(classes)) < 1e-9 and abs(total - sum(w for _, w in marked)) < 1e-9, classes
        if x.SAY in kinds:
            assert all("reported" in m for m, _ in marked)


def test_composition_joins_tapes():
    a = x.Transducer.of(("a", "b"), 2, {1}, {(0, "a"): [("b", 1.0, 1), ("a", 0.5, 0)]})
    b = x.Transducer.of(("a", "b"), 2, {0, 1}, {(0, "b"): [("insult", 0.25, 1)]})
    c = a.compose(b)
    assert c.arcs[0]["a"] == [("insult", 1.25, 1), ("a", 0.5, 0)] and c.final == {1}
    assert c.best([("a", 0.0), ("a", 0.0)]) == (1.75, [("insult", 1.25)])


def test_the_fit_does_not_hang_on_the_order_of_rows(spark, fitted):
    _, docs, labels, model = fitted
    for n in (1, 7):
        again = x.fit(docs.repartition(n, x.F.rand(n)), labels.repartition(n, "toxic"))
        assert again.lexicon == model.lexicon and (again.weights == model.weights).all()


def test_other_labels_take_no_part(spark, fitted):
    _, docs, labels, model = fitted
    more = labels.unionByName(labels.select("doc_id", x.F.when(x.F.col("doc_id") % 2 == 0, 4).otherwise(-1).alias("toxic"), *(c for c in labels.columns if c not in ("doc_id", "toxic"))).select(*labels.columns))
    assert x.fit(docs, more).lexicon == model.lexicon


def test_odd_rows_and_missing_labels(spark, fitted):
    _, _, labels, model = fitted
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "blarg"), (3, "w " * 200000), (3, "w " * 200000)], "doc_id long, text string")
    got = x.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert x.fit(odd, labels.limit(0)) is None and {r.score for r in x.score(odd, None).collect()} == {0.0}
    assert x.score(odd.limit(0), model).collect() == []
    clashing = odd.selectExpr("doc_id", "text", "1 as score", "2 as toxic", "3 as s1", "'a' as _text")
    assert sorted(map(tuple, x.score(clashing, model).collect()), key=str) == sorted(map(tuple, got), key=str)
