"""What only larger tables show: numbers that two kinds of nodes share, hot keys, many copies."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnlake.plans import registry
from tests.test_oracle import plain


def against_sql(spark, folder, name):
    """Rows of a query over a folder's tables, which equal those of its SQL."""
    plan = registry.plans()[name]
    con = duckdb.connect()
    for table in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM read_parquet('{table}{'/*.parquet' if table.is_dir() else ''}')")
    df = plan.run(spark, str(folder))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    rel = con.sql(plan.sql)
    at = [rel.columns.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    return got


@pytest.mark.parametrize("name", ["gr7_modularity", "gr9_community_edges", "gr10_community_keys"])
def test_a_supplier_and_a_part_of_one_number_are_one_node(spark, tmp_path, name):
    rows = [(1, 0, 1000, 4.0, "N"), (2, 0, 7, 8.0, "N"), (3, 1, 1001, 12.0, "R"), (4, 2, 1000, 4.0, "N")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert against_sql(spark, tmp_path, name)


def test_chains_of_versions_of_any_length_are_retired(spark):
    """Seventy versions and more than a recursion's depth, a translation between two, and a cycle."""
    from cairnlake.operators import access

    rows = [(i, i - 1, "revision") for i in range(1, 71)] + [(101, 100, "translation"), (201, 200, "revision"), (200, 201, "revision"), (301, None, "revision")]
    links = spark.createDataFrame(rows, "doc_id long, previous_id long, kind string")
    docs = spark.createDataFrame([(i, None) for i in [*range(71), 100, 101, 200, 201, 301]], "doc_id long, effective_to timestamp")
    heads = spark.createDataFrame([(70,), (101,), (201,), (301,)], "doc_id long")
    got = access.retire_chain(links, heads, docs, F.lit("1996-06-01").cast("timestamp")).collect()
    assert sorted(r.doc_id for r in got) == [*range(70), 200, 201]
    assert {r.effective_to for r in got} == {datetime.datetime(1996, 6, 1)} and {r.status for r in got} == {"superseded"}


def test_the_budget_of_an_artifact_is_that_of_a_file(spark, tmp_path):
    from cairnlake.sources import readers

    for i in range(3):
        (tmp_path / f"{i}.json").write_text('{"k": %d}\n' % i * 10)
    got = readers.read_table_artifact(spark, str(tmp_path), "k long", most_bytes=100)
    assert sorted(r.k for r in got.collect()) == [0] * 10 + [1] * 10 + [2] * 10
    with pytest.raises(ValueError, match="over budget"):
        readers.read_table_artifact(spark, str(tmp_path), "k long", most_bytes=80)


def test_names_titles_and_chains_with_many_copies(spark):
    """Copies meet by what they share: each pair comes once, and ties of equal chunks go to the first keys."""
    from cairnlake.operators import evaluate, lexical, selection

    names = spark.createDataFrame([(i, ("Large ring", "large Ring", "large rings", "cold bolt", None)[i % 5]) for i in range(50)], "id long, name string")
    got = lexical.similar_names(names, names, 0.7).collect()
    want = {(a, b) for a in range(50) for b in range(50) if a != b and (a % 5 < 3 and b % 5 < 3 or a % 5 == b % 5 == 3)}
    assert len(got) == len(want) and {(r.id_a, r.id_b) for r in got} == want
    titles = spark.createDataFrame([("COLD BOLT", 1), ("Cold bolt", 1), ("cold bolt", 2)], "title string, doc_id long")
    asked = names.select((names.id % 2).alias("query_id"), "name")
    assert sorted(tuple(r) for r in selection.bridge_titles(asked, titles).collect()) == [(q, "cold bolt", d) for q in (0, 1) for d in (1, 2)]
    posts = spark.createDataFrame([(c, w) for c in range(40) for w in (("a", "b") if c % 4 else ("a",))], "chunk_id long, term string")
    terms = spark.createDataFrame([(q, w) for q in range(30) for w in ("a", "b", "z")], "query_id long, term string")
    found = sorted(tuple(r) for r in lexical.candidate_window(posts, terms, 3, ["chunk_id"]).collect())
    assert found == sorted((q, c, 2) for q in range(30) for c in (1, 2, 3))
    chains = spark.createDataFrame([(1, 10, 5), (1, 10, 5), (1, 10, 6), (1, 11, 7), (1, 11, 8), (1, 11, 9), (2, 12, 1)], "qid long, chain_id long, docid long")
    hits = spark.createDataFrame([(1, 6), (1, 6), (1, 7), (1, 8), (2, 5)], "qid long, docid long")
    assert sorted((r.qid, round(r.chain_recall, 6), r.complete) for r in evaluate.chain_recall(hits, chains).collect()) == [(1, 0.666667, False), (2, 0.0, False)]


def within(spark, seconds, df):
    """Rows of a table, or a failure where it takes longer than pairs of all copies may."""
    import threading

    timer = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        return df.collect()
    finally:
        timer.cancel()


def test_window_of_queries_with_the_same_terms(spark):
    from cairnlake.operators import lexical

    posts = spark.range(40_000).select(F.col("id").alias("chunk_id"), F.explode(F.array(F.lit("a"), F.when(F.col("id") % 4 > 0, "b").otherwise("c"))).alias("term"))
    asked = spark.range(20_000).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("z"))).alias("term"))
    got = within(spark, 60, lexical.candidate_window(posts, asked, 3, ["chunk_id"]).groupBy("chunk_id", "matched").count())
    assert sorted(tuple(r) for r in got) == [(1, 2, 20_000), (2, 2, 20_000), (3, 2, 20_000)]


def test_distinct_names_are_compared_and_copies_joined(spark):
    from cairnlake.operators import lexical

    names = spark.range(30_000).select("id", F.concat(F.lit("Large ring number "), (F.col("id") % 3).cast("string")).alias("name"))
    got = within(spark, 60, lexical.similar_names(names.where("id < 600"), names, 0.99).groupBy((F.col("id_a") % 3).alias("a"), (F.col("id_b") % 3).alias("b"), "similarity").count())
    assert sorted(tuple(r) for r in got) == [(k, k, 1.0, 200 * 9_999) for k in range(3)]


def test_siblings_of_many_copies_and_of_anchors_with_two_texts(spark):
    from cairnlake.operators import selection

    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("Rules v1.pdf").alias("title"))
    text = F.concat(F.lit("text of number "), (F.col("id") % 2).cast("string"), F.lit(" of all of these"))
    chunks = spark.range(4_000).select(F.col("id").alias("doc_id"), F.col("id").alias("chunk_id"), text.alias("text")).unionByName(spark.createDataFrame([(1, -1, "text of number 1 of all of these"), (3, -3, None)], "doc_id long, chunk_id long, text string"))
    anchors = spark.range(2_000).select(F.lit(7).alias("query_id"), F.col("id").alias("doc_id"), text.alias("text")).unionByName(spark.createDataFrame([(7, 1, "text of number 0 of all of these"), (8, 2, None)], "query_id int, doc_id long, text string"))
    found = selection.sibling_chunks(anchors, docs, chunks, F.lit("number"), 0.99)
    got = within(spark, 90, found.groupBy("query_id", (F.col("anchor_doc") == 1).alias("twice")).agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("least")))
    assert sorted(tuple(r) for r in got) == [(7, False, 1_999 * 1_999, -1), (7, True, 3_999, 0)]


def test_aliases_of_many_copies_of_a_name(spark):
    from cairnlake.operators import graph

    names = spark.range(20_000).select("id", F.lit("Acme Data").alias("name"), F.lit("org").alias("type")).unionByName(spark.createDataFrame([(-1, "Blue", "org"), (-2, None, "org"), (-3, "Green", None)], "id long, name string, type string"))
    known = spark.range(20_000).select((F.col("id") + 5).alias("entity_id"), F.lit("Acme Data x").alias("name"), F.lit("org").alias("type"))
    ledger = spark.createDataFrame([("blue", 1), ("BLUE", 2), ("acme data", None), ("green", None)], "alias string, entity_id long")
    got = within(spark, 60, graph.resolve_aliases(names, known, ledger).groupBy("name", "how", "entity_id").count())
    assert sorted((tuple(r) for r in got), key=repr) == sorted([("Acme Data", "similar", 5, 20_000), ("Blue", "ledger", 1, 1), ("Blue", "ledger", 2, 1), (None, "new", None, 1), ("Green", "new", None, 1)], key=repr)


def _rights(spark):
    """Many users of one role and organisation, many repeated grants; single rights beside and within those of groups."""
    users = spark.range(20_000).select(F.col("id").cast("string").alias("user_id"), F.lit("r").alias("role_id"), (F.col("id") == 0).alias("is_admin"))
    kbs = spark.createDataFrame([(1, "org", "1", "top"), (2, "industry", "1", None), (3, "personal", "7", None), (4, "org", "1", "else")], "kb_id long, kind string, owner_id string, org_id string")
    orgs = users.select("user_id", F.lit("low").alias("org_id"))
    tree = spark.createDataFrame([("low", "low", 0), ("low", "top", 1)], "id string, ancestor_id string, depth int")
    grants = spark.range(20_000).select(F.lit(2).cast("long").alias("kb_id"), F.lit("role").alias("subject_kind"), F.lit("r").alias("subject_id"), F.lit(None).cast("timestamp").alias("expires_at"))
    managers = spark.createDataFrame([("5", 1), ("5", 4), ("0", 4), ("guest", 1), ("guest", 1), ("7", 3)], "user_id string, kb_id long")
    return users, kbs, orgs, tree, grants, managers, F.lit("2024-01-01").cast("timestamp")


def test_groups_of_users_see_scopes(spark):
    from cairnlake.operators import access

    got = within(spark, 60, access.visible_kbs(*_rights(spark)).groupBy("kb_id").agg(F.count(F.lit(1)), F.count_distinct("user_id")))
    assert sorted(tuple(r) for r in got) == [(1, 20_001, 20_001), (2, 20_000, 20_000), (3, 1, 1), (4, 2, 2)]


def test_users_of_scopes_are_counted_by_groups(spark):
    from cairnlake.operators import access

    got = within(spark, 60, access.kb_users(*_rights(spark)))
    assert sorted(tuple(r) for r in got) == [(1, 20_001), (2, 20_000), (3, 1), (4, 2)]


def test_totals_of_readable_documents_are_those_of_the_pairs(spark):
    from cairnlake.operators import access

    at = F.lit("2024-01-01").cast("timestamp")
    k = F.col("id")
    docs = spark.range(300).select(k.alias("doc_id"), (k % 5).alias("kb_id"), F.when(k % 4 == 0, (k % 9).cast("string")).alias("owner_id"), F.when(k % 3 == 0, "restricted").otherwise("inherit").alias("acl_mode"), F.lit(None).cast("timestamp").alias("effective_from"), F.lit(None).cast("timestamp").alias("effective_to"), F.lit("current").alias("status"))
    acl = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "user").otherwise("role").alias("subject_kind"), F.when(F.col("doc_id") % 6 == 0, (F.col("doc_id") % 7).cast("string")).otherwise("r").alias("subject_id"))
    acl = acl.unionByName(docs.where("doc_id % 10 = 0").select("doc_id", F.lit("role").alias("subject_kind"), F.lit("r").alias("subject_id")))
    subjects = spark.range(8).select(k.cast("string").alias("user_id"), F.lit("user").alias("subject_kind"), k.cast("string").alias("subject_id")).unionByName(spark.range(0, 8, 2).select(k.cast("string").alias("user_id"), F.lit("role").alias("subject_kind"), F.lit("r").alias("subject_id")))
    visible = spark.range(40).where("id % 7 > 0").select((k % 8).cast("string").alias("user_id"), F.floor(k / 8).alias("kb_id"))
    pairs = access.readable_documents(docs, visible, acl, subjects, at).groupBy("user_id").agg(F.count(F.lit(1)), F.min("doc_id"), F.sum("doc_id"))
    got = access.readable_totals(docs, visible, acl, subjects, at).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in pairs.collect()) and len(got) == 9


def test_probes_of_communities_of_many_members(spark):
    from cairnlake.operators import selection

    members = spark.range(40_000).select((F.col("id") % 2).alias("community_id"), F.col("id").alias("node"))
    names = spark.range(40_000).select(F.col("id").alias("node"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("a"), (F.col("id") / 2 % 3).cast("int").cast("string"))).otherwise(F.concat(F.lit("a"), ((F.col("id") - 1) / 2 % 9).cast("int").cast("string"))).alias("name"))
    hits = spark.range(20_000).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("community_id")).withColumn("rank", (F.col("community_id") + 1).cast("int"))
    got = within(spark, 60, selection.drift_probes(hits, members, names).groupBy("name", "nth").count())
    assert sorted(tuple(r) for r in got) == [("a0", 1, 20_000), ("a1", 2, 20_000), ("a2", 3, 20_000), ("a3", 4, 20_000)]


def test_self_retrieval_asks_for_every_twentieth_among_all(spark):
    docs = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{docs}/documents.parquet").where("doc_id % 20 = 0").count()
    assert registry.plans()["ev12_self_retrieval"].run(spark, docs).first().queries == want


@pytest.mark.parametrize("name", ["ch4_chunks", "ch19_passages", "ch21_rebuild", "dd2_simhash", "src1_decoded", "src2_html_text", "src11_archives"])
def test_python_workers_get_texts_in_small_batches(spark, name):
    """However many rows a partition holds, a worker has so many of them at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(rows)
    registry.plans()[name].run(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(rows)) <= 1024
    sizes = spark.range(5000, numPartitions=1).mapInArrow(lambda batches: batches, "id long").mapInPandas(lambda frames: (f.assign(id=len(f)) for f in frames), "id long")
    assert max(r.id for r in sizes.distinct().collect()) <= 1024


def test_pairs_of_one_difference_draw_their_weights_together(spark):
    """As many rows are drawn as there are differences, and the interval is that of all pairs."""
    from cairnlake.operators import evaluate

    pairs = spark.range(200_000).selectExpr("'g' AS g", "id AS pair_id", "0.5D AS a", "0.5D + (id % 2) * 0.5D AS b")
    found = evaluate.paired_bootstrap(pairs, ["g"], 400)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("MapInArrow", 1)[1].split("Join", 1)[0]
    r = found.first()
    # The mean of 200,000 differences of 0 and 0.5 has a deviation of 0.00056.
    assert r.difference == 0.25 and 0.24 < r.low < 0.25 < r.high < 0.26 and 1.5 < (r.high - r.low) / 0.00056 / 1.96 < 2.6
    assert r == evaluate.paired_bootstrap(pairs.repartition(7), ["g"], 400).first()


def test_tasks_of_co_mentions_follow_their_pairs(spark, monkeypatch):
    from cairnlake.operators import graph

    monkeypatch.setattr(graph, "TASK_ROWS", 100)
    rows = spark.range(600).select((F.col("id") % 60).alias("doc"), F.floor(F.col("id") / 20).alias("term"))
    pairs = graph.co_mentions(rows, "doc", "term")
    assert "(doc_a" in (plan := pairs._jdf.queryExecution().toString()) and ", 58), REPARTITION_BY_NUM" in plan
    got = {(r.doc_a, r.doc_b): r.shared for r in pairs.collect()}
    assert got == {(a, b): 10 for a in range(60) for b in range(a + 1, 60) if a // 20 == b // 20}


def broadcasts(df, path):
    """How often the plan that ran to write a table broadcasts."""
    df.write.mode("overwrite").parquet(str(path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("BroadcastExchange")


def test_what_questions_found_is_not_broadcast(spark, tmp_path):
    """Few rows explode into many: Spark's estimate is that of the few."""
    from cairnlake.operators import evaluate

    found = spark.range(200).select((F.col("id") % 10).alias("qid"), F.explode(F.sequence(F.col("id"), F.col("id") + 500)).alias("docid"))
    chains = spark.range(3000).select((F.col("id") % 10).alias("qid"), (F.col("id") % 300).alias("chain_id"), F.col("id").alias("docid"))
    df = evaluate.chain_recall(found, chains)
    assert broadcasts(df, tmp_path / "out") == 0
    need, got = {}, {(i % 10, i + k) for i in range(200) for k in range(501)}
    for i in range(3000):
        need.setdefault((i % 10, i % 300), set()).add(i)
    best = {}
    for (q, _), docs in need.items():
        best[q] = max(best.get(q, 0.0), sum((q, x) in got for x in docs) / len(docs))
    assert {r.qid: r.chain_recall for r in df.collect()} == pytest.approx(best)


def test_titles_and_questions_meet_without_a_broadcast_or_join(spark, tmp_path, monkeypatch):
    """Copies of names and texts over several blocks of names, and more rows than are given at once."""
    from cairnlake.operators import tables

    monkeypatch.setattr(tables, "BLOCK_NAMES", 7, raising=False)
    monkeypatch.setattr(tables, "OUT_ROWS", 16, raising=False)
    names = [f"Quarter {i % 23} report.PDF" for i in range(120)] + ["abc.pdf", ".pdf", "x" * 200, None]
    texts = [f"where is the quarter {i % 5} report?" for i in range(30)] + ["", None, "quarter"]
    titles = spark.createDataFrame(list(enumerate(names)), "title_id long, name string")
    questions = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(None, "quarter 1 report")], "query_id long, text string")
    df = tables.matched_titles(titles, questions)
    assert broadcasts(df, tmp_path / "out") == 0 and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    stem = lambda n: n.lower().rsplit(".", 1)[0] if "." in n else n.lower()
    want = {(q, i): tables.title_match(stem(n), (x or "").lower()) for i, n in enumerate(names) if n and 4 <= len(stem(n)) <= 160 for q, x in enumerate(texts)}
    rows = df.collect()
    assert len(rows) == len({(r.query_id, r.title_id) for r in rows})
    assert {(r.query_id, r.title_id): r.common for r in rows} == {k: n for k, n in want.items() if n}


def test_self_retrieval_asks_for_every_document(spark):
    docs = "/root/testdata/sf0.001"
    rows = {r.asked: r for r in registry.plans()["ev12_self_retrieval"].run(spark, docs).collect()}
    assert rows["all"].queries == spark.read.parquet(f"{docs}/documents.parquet").count()
    assert rows["all"].found >= rows["every twentieth"].found > 0


@pytest.mark.parametrize("by", ["long", "string"])
def test_search_by_blocks_finds_what_search_finds(spark, monkeypatch, by):
    """Copies of texts tie, blocks are many, and ids are numbers or words."""
    import random

    from cairnlake.operators import lexical

    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 40, raising=False)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(1, 30))) for _ in range(120)]
    chunks = spark.createDataFrame([(i, texts[i % 90]) for i in range(120)] + [(500, None), (501, "")], "id long, text string").select(F.col("id").cast(by).alias("chunk_id"), "text")
    queries = chunks.select(F.col("chunk_id").alias("query_id"), F.substring("text", 1, 24).alias("text"))
    rows = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in df.collect())
    want = rows(lexical.bm25_search(chunks, queries, 4, budget=60))
    assert rows(lexical.bm25_blocks(chunks, queries, 4, budget=60)) == want and len(want) > 300


def test_self_retrieval_makes_no_row_for_a_query_and_a_chunk(spark):
    """Documents that share their words: pairs of a query and a chunk are far more than what any shuffle writes."""
    plan = registry.plans()["ev12_self_retrieval"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Aggregate [query_id" in line and "chunk_id" in line]
