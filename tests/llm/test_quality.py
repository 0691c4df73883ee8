import random
import re
from collections import Counter

import numpy as np

from cairnlake.llm import quality as q


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), dup, len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)})]


def texts():
    rng = random.Random(1)
    vocab = ["a", "b", "c", "é", "\U0001f600", "x#", "<y>", "A b"]
    return [None, "", " \n\t", "a", "a a a", "a a a a", "a\n\na\n a\na", "\x1ca\x85b c"] + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", " "]) for _ in range(rng.randint(1, 200))) for _ in range(150)]


def test_base_counts_follow_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts())] + [(None, "a b", 0), (3, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.quality_rules(docs, labels).collect()
    want = sorted(((i, *b, failed := b[0] < 50 or 100 * b[4] > 50 * b[0], not failed) for i, t, _ in rows for b in [brute(t)]), key=str)
    assert sorted(((r.doc_id, *(r[n] for n in q.BASE), r.base_failed, r.kept) for r in got), key=str) == want


def test_large_window_keys(monkeypatch):
    words = [str(i % 700) for i in range(1400)] + ["z"]
    assert q.repeat_words(words) == 1400
    rng = np.random.default_rng(0)
    assert q.repeat_words([f"w{x}" for x in rng.integers(0, 1 << 40, 1_100_000)] + ["a", "b", "c", "d", "a", "b", "c"]) == 6


def prose(rng, odd):
    words = [("".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))) for _ in range(rng.randint(80, 200))]
    return " ".join(w + (rng.choice("###$$$%%") * 3 if odd else "") for w in words)


def test_odd_documents_go_and_clean_ones_stay(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, i % 10 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in q.quality_rules(docs, labels).collect()}
    assert all(got[i].kept for i in range(900) if i % 10)
    assert sum(got[i].kept for i in range(600, 900) if i % 10 == 0) <= 3
    again = {r.doc_id: r.anomaly for r in q.quality_rules(docs.repartition(5), labels).collect()}
    assert all(abs(again[i] - got[i].anomaly) < 1e-12 for i in again)


def plain_length(tree, row):
    """Path length by walking a tree from its root."""
    feature, cut, left, right, depth = tree
    at = steps = 0
    while feature[at] >= 0:
        at = (left if row[feature[at]] < cut[at] else right)[at]
        steps += 1
    return steps, depth[at]


def test_trees_split_the_rows_of_their_nodes():
    rng = np.random.default_rng(6)
    rows = np.concatenate([rng.normal(0, 1, (300, 3)), np.full((4, 3), 9.0)]).astype(np.float32)
    rows[:, 2] = 1.0  # never differs: never cut
    f = q.Forest(rows, rows[:, 0] > 8, trees=20, psi=64, odd=2, seed=1)
    for tree in f.trees:
        feature, cut, left, right, depth = tree
        assert 2 not in feature
        boxes = [(0, [(-np.inf, np.inf)] * 3)]
        while boxes:  # every cut lies inside what its node's rows span
            at, box = boxes.pop()
            if feature[at] >= 0:
                inside = np.all([(rows[:, k] >= lo) & (rows[:, k] < hi) for k, (lo, hi) in enumerate(box)], axis=0)
                k = feature[at]
                assert rows[inside, k].min() <= cut[at] <= rows[inside, k].max()
                for child, side in ((left[at], (box[k][0], cut[at])), (right[at], (cut[at], box[k][1]))):
                    boxes.append((child, [*box[:k], side, *box[k + 1 :]]))
    want = [2.0 ** (-np.mean([plain_length(t, r)[1] for t in f.trees]) / f.expected(f.psi)) for r in rows]
    assert np.allclose(f.score(rows), want, atol=1e-12)
    assert min(want[300:]) > max(want[:300])
    assert all(d >= s for t in f.trees for s, d in [plain_length(t, rows[0])])
    alone = q.Forest(np.array([[0.0], [1.0]]), np.array([False, False]), trees=3)
    assert {plain_length(t, [0.0]) for t in alone.trees} == {(1, 1.0)}


def test_threshold_follows_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(50):
        good = rng.random(40) < 0.7
        scores = np.round(rng.random(40) + 0.3 * ~good, 1)
        if good.all() or not good.any():
            continue
        gains = {c: (scores[~good] >= c).mean() - (scores[good] >= c).mean() for c in set(scores) if (scores[good] >= c).mean() <= 0.1}
        got = q.threshold(scores, good, 0.1)
        if max(gains.values(), default=0) <= 0:
            assert got == np.inf
        else:
            assert abs((scores[~good] >= got).mean() - (scores[good] >= got).mean() - max(gains.values())) < 1e-12


def test_threshold_of_a_table_is_that_of_arrays(spark):
    rng = np.random.default_rng(8)
    for digits in (1, 2, 9):
        good = rng.random(300) < 0.8
        scores = np.round(0.6 * rng.random(300) + 0.4 * ~good, digits)
        rows = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(scores, good, strict=True)], "score double, good boolean")
        for loss in (0.0, 0.05, 1.0):
            assert q.threshold_over(rows, loss) == q.threshold(scores, good, loss)
    assert q.threshold_over(rows.where("good")) is None and q.threshold_over(rows.limit(0)) is None
    assert q.threshold_over(rows.withColumn("good", q.F.col("score") > 0.3)) == np.inf


def test_every_calibration_row_counts_for_the_threshold(spark, monkeypatch):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, i % 10 == 0)) for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(600)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(q, "threshold_over", lambda rows, made=q.threshold_over: seen.append(rows.count()) or made(rows))
    q.quality_rules(docs, labels, max_fit_rows=200)
    q.quality_rules(docs, labels)
    assert seen[0] == seen[1] > 100


def test_held_out_labels_are_not_read(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, prose(rng, i % 10 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(400)], "doc_id long, quality int")
    turned = labels.withColumn("quality", q.F.when(q.held_out(), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    rows = [{r.doc_id: r.anomaly for r in q.quality_rules(docs, x).collect()} for x in (labels, turned)]
    assert rows[0] == rows[1]


def test_features_of_words():
    at = {n: i for i, n in enumerate(q.FEATURES)}
    f = q.statistics("Ab | CD ### e1\x0b\x1c99é ÉA")[1]  # seven words, one of them begun by a separator that is none
    assert [round(f[at[n]] * 7, 5) for n in ("symbol_words", "letterless_words", "capital_words")] == [2, 2, 2]
    assert abs(f[at["letter_share"]] - 8 / 16) < 1e-6 and abs(f[at["digit_share"]] - 3 / 16) < 1e-6


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert q.quality_rules(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect() == []


def test_distinct_share_reads_the_whole_text():
    rng = random.Random(3)
    for n in (1, 5, 199, 200, 201, 650):
        words = [f"w{rng.randrange(150)}" for _ in range(n)]
        w = min(n, 200)
        want = np.mean([len(set(words[i : i + w])) / w for i in range(n - w + 1)])
        assert abs(q.distinct_share(words) - want) < 1e-12
    at = q.FEATURES.index("distinct_share")
    opening, poor = [f"w{i}" for i in range(200)], ["a", "b"] * 1000
    assert q.statistics(" ".join(opening))[1][at] == 1.0
    assert q.statistics(" ".join(opening + poor))[1][at] < 0.2
