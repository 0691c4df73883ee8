"""The graph index (VX2) against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import graph_index as gi
from cairnlake.operators import vector as vx

SCHEMA = "vec_id long, embedding array<float>, scope long"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def search(spark, vectors, queries, k=10, **kw):
    index = gi.build(vectors, "scope", **kw).cache()
    found = gi.walked(index, queries, k).cache()
    return gi.hits(found, k), gi.effort(found, index), index


@pytest.fixture(scope="module")
def isotropic(spark):
    """The hardest vectors: no direction is denser than another one."""
    rng = np.random.default_rng(2)
    return table(spark, [(i, [float(x) for x in v], i % 20) for i, v in enumerate(rng.normal(size=(12_000, 48)))]).repartition(4).cache()


@pytest.mark.parametrize("n", [None, 5, 1])
def test_few_distances_find_nearly_all(spark, isotropic, n):
    scopes = F.array(*(F.lit(str(x)) for x in range(n))) if n else F.lit(None).cast("array<string>")
    queries = isotropic.where("vec_id % 60 = 7").select(F.col("vec_id").alias("query_id"), "embedding", scopes.alias("scopes"))
    hits, effort, _ = search(spark, isotropic, queries)
    recall = vx.recall_at_k(vx.knn(isotropic, queries, 10, scope="scope"), hits, 10).agg(F.avg("recall"), F.count_if("short")).first()
    assert recall[0] >= 0.95 and recall[1] == 0
    spent = effort.agg(F.avg("distance_share"), F.count(F.lit(1))).first()
    assert spent[0] <= 0.1 and spent[1] == 200


def test_exact_search_keeps_to_scopes(spark, isotropic):
    q = isotropic.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding", F.array(F.lit("3"), F.lit("4")).alias("scopes"))
    rows = isotropic.collect()
    unit = {r.vec_id: np.array(r.embedding) / np.linalg.norm(r.embedding) for r in rows}
    for r in vx.knn(isotropic, q, 3, scope="scope").where("rank = 1").collect():
        best = max((v for v in unit if v % 20 in (3, 4) and v != r.query_id), key=lambda v: unit[v] @ unit[r.query_id])
        assert r.vec_id == best


def test_copies_are_one_node_and_all_come_by_id(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8)], i % 2) for i in range(500)]
    rows += [(1000 + i, [0.5] * 8, i % 2) for i in range(700)] + [(2000 + i, [0.5] * 7 + [0.51 + i / 1e4], 0) for i in range(300)]
    rows += [(3000, None, 0), (3001, [float("nan")] * 8, 0), (3002, [0.0] * 8, 0), (3003, [1.0] * 4, 0), (3004, [0.5] * 8, None)]
    vectors = table(spark, rows)
    queries = spark.createDataFrame([(1000, [0.5] * 8, None), (5, rows[5][1], ["1"]), (-1, [0.5] * 8, ["0"]), (-2, [1.0] * 4, None), (-3, None, None), (-4, [0.5] * 8, ["none"])], "query_id long, embedding array<float>, scopes array<string>")
    hits, effort, index = search(spark, vectors, queries, shard_rows=800)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[1000] == list(range(1001, 1011)) and got[-1] == list(range(1000, 1020, 2)) and got[-2] == [3003] and -4 not in got
    exact = [r.vec_id for r in vx.knn(vectors.where("scope = 1"), queries.where("query_id = 5"), 10).orderBy("rank").collect()]
    assert len(set(exact) & set(got[5])) >= 9 and len(got[5]) == 10
    nodes = index.agg(F.sum(F.length("starts") / 4 - 1), F.sum(F.length("ids") / 8)).first()
    assert nodes[0] < 900 and nodes[1] == 1502
    assert {r.query_id for r in effort.collect()} == {1000, 5, -1, -2, -4}


def test_a_window_widens_until_enough_is_readable():
    rng = np.random.default_rng(6)
    raw = rng.normal(size=(4000, 16))
    unit = vx._unit(raw)
    links = gi._links(unit.astype(np.float32))
    ids = np.arange(4000)
    far = np.argsort(unit @ unit[0])[:600]  # only what lies far from the query is readable: the share misleads
    scopes = np.where(np.isin(ids, far), "far", "near").tolist()
    shard = gi.Shard({"dim": 16, "vectors": raw.tobytes(), "links": links.tobytes(), "starts": np.arange(4001, dtype=np.int32).tobytes(), "ids": ids.tobytes(), "scopes": scopes})
    walk = gi.Walk(shard, unit[:1], shard.members([["far"]]), 10, 50)
    first = int(walk.width[0])
    walk.run()
    assert walk.width[0] > first
    nodes = walk.nodes[0][walk.scores[0] > -np.inf]
    found = [x for x in nodes.tolist() if scopes[x] == "far"][:10]
    best = far[np.argsort(-(unit[far] @ unit[0]))[:10]].tolist()
    assert len(set(found) & set(best)) >= 9


def test_empty_tables(spark):
    none = table(spark, [])
    queries = spark.createDataFrame([(1, [0.5] * 8, None)], "query_id long, embedding array<float>, scopes array<string>")
    hits, effort, index = search(spark, none, queries)
    assert index.count() == 0 and hits.collect() == [] and effort.collect() == []
    one = table(spark, [(7, [1.0] * 8, 1)])
    assert [r.vec_id for r in search(spark, one, queries)[0].collect()] == [7]
    assert search(spark, one, queries.limit(0))[0].collect() == []
