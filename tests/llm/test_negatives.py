"""Operator 11 against brute force."""

import math
import os

import duckdb
import numpy as np
import pytest

from cairnlake.llm import negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows):
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in [r for r in kept if r[0] % 100 == 0]:
        scored = sorted(((sum(x * y for x, y in zip(a[2], r[2], strict=True)), r[0], r[1]) for r in kept if r[0] != a[0]), key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in scored if s[2] == a[1]][:5]:
            inside = [s for s in scored if s[2] != a[1] and 30 * ps <= 100 * s[0] <= 90 * ps][:10]
            out += [(a[0], pid, n, nid, ps, ns) for n, (ns, nid, _) in enumerate(inside, 1)]
    return sorted(out)


def result(spark, rows, at):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/embeddings.parquet")
    got = hn.op11_hard_negatives(spark, str(at))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("grain", [0.5, 0.01])
def test_equals_brute_force(spark, tmp_path, grain):
    """Coarse components give many ties and equal rows; some ids and labels repeat, and some rows can't take part."""
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(0.1, 0.2, 8) / grain) * grain], int(rng.choice(10, p=[0.37, *[0.07] * 9])), 1, "x") for i in range(900)]
    rows += [(1000 + i, [0.25] * 8, i % 10, 1, None) for i in range(80)]
    rows += [(2000, None, 1, 0, None), (2001, [0.5] * 7 + [None], 1, 0, None), (2002, [float("nan")] * 8, 1, 0, None), (2003, [float("inf")] * 8, 2, 0, None), (2100, [0.5] * 8, None, 0, None), (None, [0.5] * 8, 1, 0, None), (2200, [0.0] * 8, 3, 0, None)]
    got = result(spark, rows, tmp_path)
    assert got == brute(rows) and len(got) > 100


def test_blocks_and_stripes_change_nothing(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(0.1, 0.2, 4)], int(rng.integers(3)), 1, "x") for i in range(0, 3000, 4)]
    want = brute(rows)
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "STRIPE", 3)
    assert result(spark, rows, tmp_path) == want


def test_great_components_empty_tables_and_single_labels(spark, tmp_path):
    rows = [(0, [2.0**21, -3.0], 1, 0, ""), (1, [2.0**20, 1.0], 1, 0, ""), (2, [2.0**19, 5.0], 2, 0, ""), (100, [1.0, 1.0], 4, 0, "")]
    assert result(spark, rows, tmp_path / "a") == brute(rows)
    assert result(spark, [], tmp_path / "b") == []
    assert result(spark, [(100, [1.0], 1, 0, ""), (101, [1.0], 1, 0, "")], tmp_path / "c") == []


def test_best_keeps_the_first_k():
    rng, best, all_ = np.random.default_rng(1), hn.Best(5, 3), []
    for _ in range(20):
        rows, scores, ids = rng.integers(0, 5, 30), rng.integers(-3, 4, 30), rng.integers(0, 10_000, 30)
        all_ += list(zip(rows.tolist(), (-scores).tolist(), ids.tolist(), strict=True))
        best.offer(rows, scores, ids)
    want = [x for r in range(5) for x in sorted(x for x in all_ if x[0] == r)[:3]]
    assert list(zip(best.rows.tolist(), (-best.scores).tolist(), best.ids.tolist(), strict=True)) == want
    assert best.least.tolist() == [-want[3 * r + 2][1] for r in range(5)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are not there")
def test_equals_its_sql(spark):
    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{at}/embeddings.parquet')")
    assert sorted(map(tuple, hn.op11_hard_negatives(spark, at).collect())) == sorted(con.sql(hn.SQL).fetchall())
