import random

from cairnlake.operators import selection as se

SCHEMA = "query_id long, chunk_id long, doc_id long, score double, measured double, tokens long, terms array<string>"


def brute(rows, budget):
    rows = sorted(rows, key=lambda r: (-r[3], r[1]))
    sets, rest, spent, of_doc, out = [set(r[6]) for r in rows], list(range(len(rows))), 0, {}, []
    overlap = [0.0] * len(rows)
    top = max(r[3] for r in rows) or 1.0
    while rest:
        i = max(rest, key=lambda k: (se.LAMBDA * rows[k][3] / top - (1 - se.LAMBDA) * overlap[k], -k))
        rest.remove(i)
        r = rows[i]
        if spent + r[5] > budget or (out and of_doc.get(r[2], 0) + r[5] > se.DOC_SHARE * budget):
            continue
        spent += r[5]
        of_doc[r[2]] = of_doc.get(r[2], 0) + r[5]
        out.append((r[0], r[1], len(out) + 1))
        for k in rest:
            either = len(sets[i] | sets[k])
            overlap[k] = max(overlap[k], len(sets[i] & sets[k]) / either if either else 0.0)
    return out


def test_rows_beyond_any_pool_are_weighed(spark):
    rng = random.Random(1)
    rows = [(1, i, i, 1.0, None, 100, ["same", "words"]) for i in range(600)]
    rows += [(1, 1000, 1000, 0.9, None, 100, ["other"]), (1, 1001, 1001, 0.1, None, 50, ["short"])]
    for q, sign in ((2, 1), (3, -1), (4, 0)):
        rows += [(q, i, rng.randrange(40), sign * round(rng.random(), 2), None, rng.randint(5, 300), rng.sample("abcdefghijklmnop", rng.randint(0, 5))) for i in range(700)]
    rng.shuffle(rows)
    got = sorted(map(tuple, se.select_evidence(spark.createDataFrame(rows, SCHEMA), 1050).collect()))
    want = sorted(x for q in (1, 2, 3, 4) for x in brute([r for r in rows if r[0] == q], 1050))
    assert got == want
    assert (1, 1000, 2) in got and any(x[:2] == (1, 1001) for x in got)
