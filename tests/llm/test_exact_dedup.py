import hashlib
import re
from collections import defaultdict

import pytest

from cairnlake.llm import exact_dedup as x

ROWS = [(5, "a  b"), (2, "a\tb"), (9, " a b"), (1, None), (3, ""), (4, " "), (8, "c" * 300000), (7, "c" * 300000), (6, "c" * 299999), (None, "a b"), (None, "only"), (2, "a\tb"), (11, "a b")]


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("table_bytes, hot_rows", [(x.TABLE_BYTES, 10_000), (4000, 7)])
def test_as_brute_force(spark, table_bytes, hot_rows):
    rows = ROWS + [(100 + i, f"text {i % 150} " + "z" * (i % 7)) for i in range(900)] + [(5000 + i, "hot  text") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", x.F.lit(0)).withColumn("digest", x.F.lit("d")).withColumn("_keep", x.F.lit(1)).withColumn("row", x.F.lit(2))
    got = sorted((tuple(r) for r in x.exact_dedup(docs, hot_rows=hot_rows, table_bytes=table_bytes, fanout=3).collect()), key=str)
    assert got == brute(rows)
    kept = x.drop_duplicates(docs, table_bytes=table_bytes)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted({r[0] for r in brute(rows) if r[3] and r[0] is not None} | {None}, key=str)


def test_grace_recurses_until_tables_fit(tmp_path):
    rows = [(hashlib.sha256(str(i % 400).encode()).hexdigest(), f"t{i % 400}", i, 1) for i in range(2000)]
    got = sorted(map(tuple, x.grace(iter(rows), str(tmp_path), 3000, 2)))
    want = sorted((hashlib.sha256(str(i).encode()).hexdigest(), f"t{i}", i, 5) for i in range(400))
    assert got == want
    assert not any(p.is_file() for p in tmp_path.rglob("*"))


def test_empty_table(spark):
    assert x.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
