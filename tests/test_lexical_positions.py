"""Positional postings and cover density (LX10) against reading covers off the text."""

import random
import re

from pyspark.sql import functions as F

from cairnlake.operators import lexical as lx


def covers(words, terms):
    """Stretches that hold all terms and no shorter stretch that does: 1 / (1 + other words inside), summed."""
    n, total = len(words), 0.0
    whole = lambda a, b: set(terms) <= set(words[a : b + 1])
    for a in range(n):
        for b in range(a, n):
            if whole(a, b) and not (b > a and (whole(a + 1, b) or whole(a, b - 1))):
                total += 1 / (1 + sum(w not in terms for w in words[a : b + 1]))
    return 0.1 * total


def test_covers_equal_brute_force(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "x"]) for _ in range(rng.randint(0, 30))) for i in range(60)}
    texts[60] = None
    asked = {1: ["aa"], 2: ["aa", "bb"], 3: ["aa", "bb", "cc"], 4: ["ee", "dd", "cc", "aa"], 5: ["aa", "nowhere"]}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    terms = spark.createDataFrame([(q, t) for q, ts in asked.items() for t in [*ts, ts[0]]], "query_id long, term string")
    posts = lx.positional_postings(chunks, ["chunk_id"]).cache()
    kept = lx.positional_postings(chunks, ["chunk_id"], terms=terms)
    assert {r.term for r in kept.collect()} == {"aa", "bb", "cc", "dd", "ee"}
    split = {i: re.findall(r"\w{2,}", t or "") for i, t in texts.items()}
    for r in posts.collect():
        assert r.positions == [i + 1 for i, w in enumerate(split[r.chunk_id]) if w == r.term]
    got = {(r.query_id, r.chunk_id): round(r.density, 9) for r in lx.cover_density(posts, terms, ["chunk_id"]).collect()}
    want = {(q, i): round(covers(ws, ts), 9) for q, ts in asked.items() for i, ws in split.items() if set(ts) <= set(ws)}
    assert got == want and len(want) > 60
    found = {(r.query_id, r.chunk_id): round(r.density, 9) for r in lx.cover_density(posts, terms, ["chunk_id"], all_terms=False).collect()}
    assert found == {(q, i): round(0.1 * sum(w in ts for w in ws), 9) for q, ts in asked.items() for i, ws in split.items() if set(ts) & set(ws)}
    top = lx.density_window(lx.cover_density(posts, terms, ["chunk_id"]), 3, ["chunk_id"]).where("query_id = 2").orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in top] == [(i, n) for n, (_, i) in enumerate(sorted((-v, i) for (q, i), v in want.items() if q == 2)[:3], 1)]


def test_positions_of_scripts_without_spaces(spark):
    text = "我们 计算AB token"
    row = lx.positional_postings(spark.createDataFrame([(1, text)], "chunk_id long, text string"), ["chunk_id"])
    at = {r.term: r.positions for r in row.collect()}
    assert at["token"] == [max(p for ps in at.values() for p in ps)] and at["我们"] and at["计算"]


def test_rarest_terms(spark):
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (1, "zz"), (2, "zz")], "query_id long, term string")
    stats = spark.createDataFrame([("a", 5), ("b", 2), ("c", 2)], "term string, df long")
    assert sorted(map(tuple, lx.rarest_terms(asked, stats, 2).select("query_id", "term").collect())) == [(1, "b"), (1, "c")]
