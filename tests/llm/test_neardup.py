import random

import pytest

import corpus_pipeline
from cairnlake.llm import neardup as nd


def brute_set(t):
    words = (t or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def jaccard(a, b):
    return (1.0, 1) if a == b else (len(a & b) / len(a | b), 5 * len(a & b) >= 4 * len(a | b))


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j])[1]:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return [(rows[i][0], min((x for x in groups[find(i)] if x is not None), default=None)) for i in range(len(rows))]


def planted():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(f"line{i}" for i in range(14))
    texts = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d e", "a b c d e f"]
    for i in range(40):
        base = [word() for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base) + (f" {line}" if i % 2 else ""))
        for _ in range(3):  # from nearly equal to well under 0.8, in runs of swapped words
            copy, at, run = list(base), rng.randrange(len(base)), rng.randint(0, len(base) // 5)
            copy[at : at + run] = [word() for _ in copy[at : at + run]]
            texts.append(" ".join(copy) + (f" {line}" if i % 2 else ""))
    base = [word() for _ in range(100)]  # one large group of near copies
    for _ in range(60):
        copy = list(base)
        copy[rng.randrange(100)] = word()
        texts.append(" ".join(copy))
    rows = list(enumerate(texts, 1))
    rng.shuffle(rows)
    return rows + [(None, "a b c d e"), (None, "nobody else has this text at all"), (4, rows[3][1])]


@pytest.mark.parametrize("group", [nd.GROUP, 8])
def test_components_as_brute_force(spark, group):
    rows = planted()
    sets = [brute_set(t) for _, t in rows]
    scores = [jaccard(a, b)[0] for i, a in enumerate(sets) for b in sets[:i] if a and b]
    assert sum(0.8 <= x < 0.9 for x in scores) > 20 and sum(0.7 < x < 0.8 for x in scores) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = nd.near_components(docs, group=group).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_components(rows), key=str)


def test_stage_drops_near_copies_at_four_fifths(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(9000)}" for _ in range(104)]  # 100 shingles; 10 changed: 90 / 110 = 0.82; 12: 88 / 112 = 0.79
    near, far = [*base[:-10], *(f"x{i}" for i in range(10))], [*base[:-12], *(f"y{i}" for i in range(12))]
    docs = spark.createDataFrame([(i, " ".join(t), i) for i, t in enumerate((base, near, far))], "doc_id long, text string, node int")
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {0, 2}


def test_bitmaps_never_tell_more_than_the_sets():
    rng = random.Random(11)
    for _ in range(300):
        base = [rng.getrandbits(63) for _ in range(rng.choice([0, 3, 90, 700, 3000]))]
        a = {x for x in base if rng.random() < 0.9} | {rng.getrandbits(63) for _ in range(rng.randint(0, 40))}
        b = {x for x in base if rng.random() < 0.7} | {rng.getrandbits(63) for _ in range(rng.randint(0, 400))}
        x, y = (nd.np.array(sorted(s), nd.np.int64) for s in (a, b))
        assert nd.parities_apart(nd.wide_bitmap(x), nd.wide_bitmap(y)) <= len(a ^ b)
        assert nd.parities_apart(nd.wide_bitmap(x), nd.wide_bitmap(x)) == 0


def test_empty_table(spark):
    assert nd.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
