"""Operator 12 against brute force."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from cairnlake.llm import codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code int, key string"


def brute(rows):
    kept = [(i, lab, [math.floor(4096 * float(x)) for x in v]) for i, v, lab, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return []
    w = len(kept[0][2]) // 8
    parts = [[r[2][p * w : p * w + w] for r in kept] for p in range(8)]
    books = [[list(x) for x in own[:16]] for own in parts]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(book)), key=lambda e: (dist(x, book[e]), e)) for x in own] for own, book in zip(parts, books, strict=True)]
    for _ in range(6):
        for own, book, at in zip(parts, books, assign(), strict=True):
            for e in range(len(book)):
                mine = [x for x, a in zip(own, at, strict=True) if a == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = assign()
    out = [(r[0], "".join(f"{at[p][i]:02x}" for p in range(8)), sum(dist(parts[p][i], books[p][at[p][i]]) for p in range(8)), r[1]) for i, r in enumerate(kept)]
    total = {}
    for *_, e, lab in out:
        total[lab] = total.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, c, e, total[lab], digest) for i, c, e, lab in out), key=repr)


def result(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/embeddings.parquet")
    return sorted(map(tuple, vc.op12_vector_codes(spark, str(at)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


@pytest.mark.parametrize("grain", [0.5, 0.001])
def test_equals_brute_force(spark, tmp_path, grain):
    """Coarse components give ties, equal entries and unused ones; some rows can't take part."""
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.5, 24) / grain) * grain], None if i % 5 == 0 else int(i % 3), 0, "x") for i in rng.permutation(400)]
    rows += [(500 + i, [0.25] * 24, 7, 0, None) for i in range(200)]
    rows += [(-1, None, 1, 0, None), (-2, [None] * 24, 1, 0, None), (-3, [float("nan")] + [0.0] * 23, 1, 0, None), (-4, [float("-inf")] * 24, 1, 0, None), (None, [0.1] * 24, 1, 0, None)]
    assert result(spark, rows, tmp_path) == brute(rows)


def test_few_rows_great_components_and_empty_tables(spark, tmp_path):
    rows = [(1, [1.5 * i for i in range(8)], 1, 0, ""), (2, [-1.5] * 8, 1, 0, "")]
    assert result(spark, rows, tmp_path / "a") == brute(rows)
    rows += [(i, [float(2.0**17 + i)] * 4 + [0.3] * 4, None, 0, "") for i in range(3, 30)]
    assert result(spark, rows, tmp_path / "b") == brute(rows)
    assert result(spark, [], tmp_path / "c") == []


def test_masks_hold_the_nearest_entry():
    rng = np.random.default_rng(5)
    for n, d in ((1, 3), (16, 8), (70, 2), (130, 5)):
        entries, x = rng.integers(-50, 50, (n, d)), rng.integers(-60, 60, (500, d))
        s = vc.Slices(entries)
        every = ((x[:, None] - entries[None]) ** 2).sum(2)
        found, best = s.nearest(x)
        assert (found == every.argmin(1)).all() and (best == every.min(1)).all()
        r = rng.integers(0, 40, 500)
        masks = s.candidates(x, r)
        held = np.array([[bool(masks[i, e // 64] >> np.uint64(e % 64) & np.uint64(1)) for e in range(n)] for i in range(500)])
        assert (held == (np.abs(x[:, None] - entries[None]).max(2) <= r[:, None])).all()


def test_codes_as_vectors_again(spark):
    rng = np.random.default_rng(6)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)]) for i in range(100)], "vec_id long, embedding array<float>")
    books = vc.train(vectors, parts=4)
    for r in vc.decode(vc.encode(vectors, books), books).collect():
        assert r.approx == [float(x) / 4096 for p, e in enumerate(r.code) for x in books[p][e]]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not there")
def test_equals_its_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet')")
    rel = con.sql(vc.SQL)
    assert sorted(map(tuple, vc.op12_vector_codes(spark, at).select(*rel.columns).collect())) == sorted(rel.fetchall())
