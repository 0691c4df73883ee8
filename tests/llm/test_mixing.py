import random
import re
from collections import Counter, defaultdict

import pytest

from cairnlake.llm import mixing as m


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: m.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def rows(seed, n=800):
    rng = random.Random(seed)
    out = [(i, "w " * rng.randint(0, 40), rng.choice(["a"] * 12 + ["b", "c", "d", "é", None]), "x") for i in range(n)]
    return out + [(None, "a b", "a", "x"), (5, out[5][1], out[5][2], "x"), (n, None, "only", "x"), (n + 1, "one", "tiny", "x"), (n + 2, "big " * 3000, "c", "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_words_meet_targets(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, target string")
    got = m.mix(docs).collect()
    assert len(got) == len(data)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s, _ in data:
        sizes[s] += size(t)
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.positions == sorted(r.positions) and r.positions[:1] == [r.position] * bool(r.positions)
        left = r.taken
        for k, at in enumerate(r.positions):  # the demand up to a copy's time reaches the middle of what is taken of it
            part = min(r.size, left, max(0, round(r.target) - r.before - k * r.source_size))
            left -= part
            assert abs((at + r.slope * at * (1 - at)) * r.target - min(r.before + k * r.source_size + part / 2, r.target)) < 1e-6 * max(1, r.target)
        assert left == 0
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want if s != "c"), (taken, want)
    assert abs(taken["c"] - want["c"]) <= 1
    assert sorted(((r.doc_id, r.size, r.taken) for r in got), key=str) == sorted(((r.doc_id, r.size, r.taken) for r in m.mix(docs.repartition(3)).collect()), key=str)


def test_documents_are_repeated_whole(spark):
    data = rows(3)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, _size string")
    out = m.mixed_documents(docs)
    assert out.columns == docs.columns
    got, given = Counter(map(tuple, out.collect())), Counter(map(tuple, data))
    assert all(k in given and v <= 3 * given[k] for k, v in got.items())
    sizes, taken, most = Counter(), Counter(), defaultdict(int)
    for _, t, s, _ in data:
        sizes[s] += len((t or "").split())
        most[s] = max(most[s], len((t or "").split()))
    for (_, t, s, _), n in got.items():
        taken[s] += n * len((t or "").split())
    want = brute_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in want if want[s])


def test_schedule_is_inverted(spark):
    f = m.F
    frame = spark.createDataFrame([(t / 10, s) for t in range(11) for s in (-0.6, 0.0, 0.6)], "t double, s double")
    done = f.col("t") + f.col("s") * f.col("t") * (1 - f.col("t"))
    assert all(abs(r.t - r.u) < 1e-9 for r in frame.select("t", m._time(done, f.col("s")).alias("u")).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mix(docs).collect() == [] and m.mixed_documents(docs).collect() == []
