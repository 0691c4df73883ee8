"""Operators on small literal inputs."""

import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnlake.operators import access, dedupe, evaluate, graph, lexical, rank, structure, tables, text_quality, vector
from cairnlake.sources import readers


def test_simhash_bands_keep_three_bits_and_drop_four(spark):
    rows = [(1, "s", 300, 0), (2, "s", 300, 0b111), (3, "s", 300, 0b1111), (4, "s", 100, 1), (5, "s", 300, 0), (6, "t", 300, 0)]
    got = dedupe.near_pairs(spark.createDataFrame(rows, "id long, s string, n_tokens int, simhash long"), "id", ["s"])
    assert sorted((r.id_a, r.id_b, r.distance) for r in got.collect()) == [(1, 2, 3), (2, 3, 1)]
    assert dedupe.simhash64([]) == 0 and dedupe.simhash64(["ab"]) == 97 * 131 + 98


def test_checksums_and_masks(spark):
    t = "mail a@b.co, id 11010519491231002X, no 110105194912310021, card 4111111111111111, no 4111111111111112, call 13812345678."
    df = spark.createDataFrame([(1, t), (2, None), (3, "")], "i long, text string")
    r = text_quality.redact_pii(df).orderBy("i").collect()
    assert r[0].redacted == "mail [REDACTED:email], id [REDACTED:id_cn], no 110105194912310021, card [REDACTED:bank_card], no 4111111111111112, call [REDACTED:phone_cn]."
    assert [x.redacted for x in r[1:]] == ["", ""]


def test_quality_of_odd_texts(spark):
    df = spark.createDataFrame([(1, None), (2, "<!-- x -->"), (3, "a�" * 10), (4, "word <!-- image: 1 -->")], "i int, text string")
    got = {r.i: r for r in text_quality.assess_quality(df).collect()}
    assert [got[i].quality_status for i in (1, 2, 3, 4)] == ["rejected", "rejected", "passed", "passed"]
    assert got[3].quality_score == 0.55 and got[4].placeholders == 1


def test_bm25_without_budget_is_brute_force(spark):
    docs = [(1, "alpha beta"), (2, "alpha gamma gamma"), (3, "delta"), (4, "beta beta alpha delta epsilon")]
    chunks = spark.createDataFrame(docs, "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "alpha epsilon"), (2, "zeta"), (3, "alpha")], "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25_search(chunks, queries, 10, 1.0, None, 1, 1.0).collect()}
    sets = {i: set(t.split()) for i, t in docs}
    length = {i: sum(c.isalnum() for c in t) for i, t in docs}
    avg = sum(length.values()) / 4
    for q, words in ((1, ("alpha", "epsilon")), (3, ("alpha",))):
        for i, s in sets.items():
            want = sum(np.log(1 + (4 - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length[i] / avg)) for w in words if w in s for df in [sum(w in x for x in sets.values())])
            assert abs(got.get((q, i), 0) - want) < 1e-9
    assert not any(q == 2 for q, _ in got)
    # alpha is in over half of all chunks: kept only where a query has no other term
    found = {(r.query_id, r.chunk_id) for r in lexical.bm25_search(chunks, queries, 10, 0.5, 8000, 1, 0.9).collect()}
    assert found == {(1, 4), (3, 1), (3, 2), (3, 4)}


def test_pool_bm25_counts_inner_matches_as_present(spark):
    pool = spark.createDataFrame([(1, "art and start"), (2, "start"), (3, "none")], "id long, text string")
    got = {r.id: r.score for r in lexical.pool_bm25(pool, ["art"]).collect()}
    assert set(got) == {1} and abs(got[1] - np.log(1 + 1.5 / 2.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 13 / (22 / 3)))) < 1e-9


def test_fusion_orders_and_quotas(spark):
    rows = [(1, c, ch, s) for ch, xs in {"lexical": "abc", "vector": "bca", "graph": "d"}.items() for c, s in zip(xs, (3.0, 2.0, 1.0), strict=False)]
    fused = {r.chunk_id: r.rrf for r in rank.fuse(rank.channel_ranks(spark.createDataFrame(rows, "query_id long, chunk_id string, channel string, score double"))).collect()}
    assert abs(fused["b"] - (1 / 62 + 1 / 61)) < 1e-12 and abs(fused["d"] - 0.8 / 61) < 1e-12
    placed = spark.createDataFrame([(1, i, i, i) for i in range(1, 8)], "query_id long, chunk_id long, position int, x int")
    order = [r.chunk_id for r in rank.lost_in_the_middle(placed).orderBy("place").collect()]
    assert order == [1, 2, 3, 5, 7, 6, 4]


def test_knn_and_maxsim(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([[1, 0], [0, 1], [1, 1], [0, 0], [-1, 0]])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.where("vec_id < 2").withColumnRenamed("vec_id", "query_id")
    got = [(r.query_id, r.vec_id, round(r.score, 4)) for r in vector.knn(v, q, 2, 0.3, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(0, 2, 0.7071), (1, 2, 0.7071)]
    m = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[0.0, 2.0], [3.0, 0.0]]), ([[1.0, 0.0]], [[0.0, 1.0]])], "a array<array<double>>, b array<array<double>>")
    assert [r.m for r in m.select(vector.maxsim("a", "b").alias("m")).collect()] == [1.0, 0.0]
    assert vector.knn(v, q.limit(0), 2).collect() == []
    assert [len(x) for x in vector.soft_clusters(np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]]), 2)] == [1, 1, 1, 1]


def test_metrics_on_duplicates_and_missing_queries(spark):
    run = spark.createDataFrame([(1, ["x", "a", "a", "b"])], "qid long, docids array<string>")
    qrels = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (1, "z", 0), (2, "q", 1)], "qid long, docid string, gain int")
    m = {r.qid: r for r in evaluate.query_metrics(evaluate.ranked_run(run), qrels, 10).collect()}
    assert abs(m[1].ndcg - (2 / np.log2(3) + 1 / 2) / (2 + 1 / np.log2(3))) < 1e-9
    assert (m[1].recall, m[1].mrr, m[1].map) == (1.0, 0.5, pytest.approx((1 / 2 + 2 / 3) / 2))
    assert (m[2].ndcg, m[2].evaluated) == (0.0, False)


def test_histogram_quantiles_interpolate_and_fall_back_to_the_mean(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 7.0, 8.0, 9.0)] + [("b", 20000.0), ("b", 40000.0)], "k string, v double")
    h = evaluate.histogram(df, ["k"], "v")
    got = {r.k: r.quantile for r in evaluate.histogram_quantile(h, ["k"], 0.5).collect()}
    assert got["a"] == pytest.approx(5 + (2 - 1) / 3 * 5) and got["b"] == 30000


def test_bootstrap_and_platt(spark):
    pairs = spark.createDataFrame([("g", i, 0.5, 0.5 + (i % 3 - 1) * 0.001) for i in range(300)], "g string, pair_id long, a double, b double")
    r = evaluate.paired_bootstrap(pairs, ["g"], 400).first()
    assert r.low < r.difference < r.high and r.not_worse
    rng = np.random.default_rng(0)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(2 * x + 0.5)))).astype(int)
    f = evaluate.platt_fit(spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y, strict=True)], "g string, score double, label int"), ["g"]).first()
    assert abs(f.a - 2) < 0.3 and abs(f.b - 0.5) < 0.2


def test_components_and_modularity(spark):
    chain = [(i, i + 1) for i in range(9)] + [(20, 21), (21, 20), (30, 30)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {got[i] for i in range(10)} == {0} and got[21] == 20
    cliques = [(a + k, b + k, 1.0) for k in (0, 4) for a in range(4) for b in range(a)] + [(0, 4, 1.0)]
    e = spark.createDataFrame(cliques, "src long, dst long, weight double")
    labels = spark.createDataFrame([(i, i // 4) for i in range(8)], "node long, component int")
    assert graph.modularity(e, labels).first().modularity == pytest.approx(2 * (12 / 26 - (13 / 26) ** 2))
    weak = e.where("not (src = 0 and dst = 4)").union(spark.createDataFrame([(0, 4, 0.1)], e.schema))
    for given in (weak, weak.selectExpr("dst as src", "src as dst", "weight").orderBy(F.rand(3)).repartition(3)):
        found = {r.node: r.component for r in graph.communities(given, spark.createDataFrame([(i,) for i in (3, 99)], "node long")).collect()}
        assert found == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(4, 8), 4), 99: 99}  # two cliques part, an isolated node stays
    assert graph.louvain(e.limit(0)).collect() == []


def test_louvain_ends_where_no_move_raises_modularity(spark):
    rng = np.random.default_rng(5)
    block = np.arange(60) // 12
    pairs = [(i, j) for i in range(60) for j in range(i) if rng.random() < (0.6 if block[i] == block[j] else 0.03)] + [(7, 7)]
    pairs += [(100, 101 + k) for k in range(15)]  # a star: many nodes want one community at once
    rows = [(i, j, float(rng.integers(1, 4))) for i, j in pairs]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    levels = graph.louvain(e).collect()
    top = max(r.level for r in levels)
    label = {r.node: r.component for r in levels if r.level == top}
    assert set(label) == {x for p in pairs for x in p} and all(c <= n for n, c in label.items())
    inside = {}
    for r in levels:  # levels only join communities of the level before
        inside.setdefault((r.level, r.component), set()).add(label[r.node])
    assert all(len(x) == 1 for x in inside.values())

    def modularity(label):
        m2 = 2 * sum(w for *_, w in rows)
        degree, within = {}, 0.0
        for i, j, w in rows:
            for x in (i, j):
                degree[label[x]] = degree.get(label[x], 0.0) + w
            within += 2 * w * (label[i] == label[j] and i != j)
        return within / m2 - sum((d / m2) ** 2 for d in degree.values())

    best = modularity(label)
    assert best > 0.5
    for a, b in {(label[i], label[j]) for i, j, _ in rows if label[i] != label[j]}:
        assert modularity({n: a if c == b else c for n, c in label.items()}) <= best + 1e-9
    first = {r.node: r.component for r in levels if r.level == 0}
    at_first = modularity(first)
    for i, j, _ in rows:
        if first[i] != first[j]:
            assert modularity({**first, i: first[j]}) <= at_first + 1e-8


def test_louvain_needs_few_rounds_where_all_nodes_want_the_same(spark, monkeypatch):
    """Eighty nodes that are all alike linked to four hubs: nearly all want one hub at once, which takes few of them."""
    rows = [(i, 1000 + j, 9 + (i * 7 + j * 13) % 11 / 10) for i in range(80) for j in range(4)]
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, name, made=graph.written: rounds.append(name) or made(df, name))
    levels = graph.louvain(spark.createDataFrame(rows, "src long, dst long, weight double")).collect()
    assert {r.node for r in levels if r.level == 0} == {x for i, j, _ in rows for x in (i, j)}
    assert rounds.count("moves") <= 16


def crowd(nodes, hubs):
    """Nodes linked to all hubs by weights that are nearly alike: communities come to balance."""
    rng = np.random.default_rng(3)
    return [(i, 10_000 + j, float(rng.integers(30, 41)) / 4) for i in range(nodes) for j in range(hubs)]


def settled(rows, label):
    """Whether no move of one node to a neighbour's community raises modularity."""
    m2, degree, pull, total = 2 * sum(w for *_, w in rows), {}, {}, {}
    for i, j, w in rows:
        for a, b in ((i, j), (j, i)):
            degree[a] = degree.get(a, 0.0) + w
            pull[a, label[b]] = pull.get((a, label[b]), 0.0) + w
    for n, d in degree.items():
        total[label[n]] = total.get(label[n], 0.0) + d
    price = lambda n, c: degree[n] * (total[c] - degree[n] * (label[n] == c)) / m2
    return all(w - price(n, c) <= pull.get((n, label[n]), 0.0) - price(n, label[n]) + 1e-6 for (n, c), w in pull.items())


@pytest.mark.parametrize("heavy", [1_000_000, 150])
def test_louvain_settles_in_few_rounds_over_many_blocks(spark, monkeypatch, heavy):
    """Blocks that sweep at once, one block of those that are left over, and nodes of too many edges for any block."""
    rows, rounds = crowd(200, 8), []
    monkeypatch.setattr(graph, "BLOCK_ROWS", 400, raising=False)
    monkeypatch.setattr(graph, "HEAVY", heavy, raising=False)
    monkeypatch.setattr(graph, "written", lambda df, name, made=graph.written: rounds.append(name) or made(df, name))
    found = {r.node: r.component for r in graph.louvain(spark.createDataFrame(rows, "src long, dst long, weight double")).where("level = 0").collect()}
    assert len(set(found.values())) >= 8 and settled(rows, found)
    assert rounds.count("labels") <= 20


def test_hierarchy_runs_again_on_what_lies_between_communities(spark):
    """Four cliques, two and two of them linked, and a pair apart: its own links no longer hold a clique from its neighbour."""
    cliques = [(10 * k + a, 10 * k + b, 5.0) for k in range(4) for a in range(5) for b in range(a)]
    e = spark.createDataFrame([*cliques, (0, 10, 1.0), (20, 30, 1.0), (50, 51, 1.0)], "src long, dst long, weight double")
    got = {(r.level, r.node): (r.component, r.parent) for r in graph.hierarchy(e).collect()}
    want = {(0, 10 * k + a): (10 * k, 20 * (k // 2)) for k in range(4) for a in range(5)} | {(1, 10 * k + a): (20 * (k // 2), None) for k in range(4) for a in range(5)}
    assert got == want | {(0, 50): (50, None), (0, 51): (50, None)}


def test_weights_that_are_none_count_as_one_in_communities(spark):
    odd = [(0, 1, None), (1, 2, float("nan")), (0, 2, -3.0), (3, 4, 0.0), (4, 5, float("inf")), (3, 5, 1.0)]
    found = {r.node: r.component for r in graph.communities(spark.createDataFrame(odd, "src long, dst long, weight double")).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_exact_tables(spark):
    cells = spark.createDataFrame([("a", "1,000.50 kg"), ("a", "-.25kg"), ("b", "1 kg"), ("b", "1 m"), ("c", "x"), ("d", "123456789012345678901234567890.000000000000000001")], "t string, cell string")
    got = {r.t: r for r in tables.exact_aggregate(cells.where("t <> 'd'"), ["t"], "cell").collect()}
    assert (float(got["a"]["sum"]), got["a"].avg.denominator, got["a"].unit, got["a"].error) == (1000.25, 2, "kg", None)
    assert (got["b"].error, got["c"].error) == ("mixed units", "non-numeric cell")
    wide = tables.exact_sum_wide(cells.where("t = 'd'").union(cells.where("t = 'd'")), ["t"], "cell").first()
    assert wide["sum"] == "246913578024691357802469135780.000000000000000002"
    with pytest.raises(ValueError):
        tables.count_rows(cells, ["t"], [], "over 5", ["6"])
    assert tables.split_row(r"| a \| b | `x|y` | c |") == ["a | b", "`x|y`", "c"]
    md = "```\n|a|\n|-|\n|x|\n```\n\n| h | k |\n|---|:-:|\n| 1 | 2 |\n| 3 |\n"
    assert [c[:5] for c in tables.markdown_tables(md)] == [(0, 0, 0, "h", "1"), (0, 0, 1, "k", "2")]
    assert tables.title_match("annual report", "show the annual report please") == 13 and tables.title_match("abc", "abc") == 0


def test_access_defaults_to_deny(spark):
    docs = spark.createDataFrame([(1, 1, None, "inherit"), (2, 1, None, "restricted"), (3, 1, "u", "restricted"), (4, 2, None, "inherit"), (5, 1, None, "inherit")], "doc_id long, kb_id long, owner_id string, acl_mode string")
    docs = docs.withColumns({"effective_from": F.lit(None).cast("timestamp"), "effective_to": F.lit(None).cast("timestamp"), "status": F.lit("current")})
    visible = spark.createDataFrame([("u", 1), ("v", 1)], "user_id string, kb_id long")
    acl = spark.createDataFrame([(5, "user", "v"), (2, "role", "r")], "doc_id long, subject_kind string, subject_id string")
    subjects = spark.createDataFrame([("u", "user", "u"), ("v", "user", "v"), ("v", "role", "r")], "user_id string, subject_kind string, subject_id string")
    got = {(r.user_id, r.doc_id) for r in access.readable_documents(docs, visible, acl, subjects, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {("u", 1), ("v", 1), ("u", 3), ("v", 5), ("v", 2)}


def test_repealed_documents_stay_until_their_end(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    one = spark.range(1)
    ok = lambda start, end, status: one.select(access.effective(t(start), t(end), F.lit(status), t("2024-06-01")).alias("x")).first().x
    assert ok(None, None, "current") and ok("2024-06-01", None, "current") and not ok(None, "2024-06-01", "current")
    assert ok(None, "2025-01-01", "repealed") and not ok(None, None, "repealed") and not ok(None, None, "superseded")


def test_chunks_cover_the_text_and_rebuild_it(spark):
    text = "# One\n\n" + "Sentence one is here. " * 200 + "\n\n## Two\n\n```\n" + "code\n" * 300 + "```\n\n| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 50 + "\nend"
    found = structure.chunk_markdown(text)
    assert found[0][2] == 0 and all(text[a:b] == c for _, c, a, b, _ in found)
    assert all(n[2] <= p[3] for p, n in zip(found, found[1:], strict=False)) and found[-1][4] == "One > Two"
    assert structure.chunk_markdown("  ") == []
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in structure.rebuild(structure.chunks(df)).collect()}
    assert got == {1: text, 2: "plain"}
    assert [structure.chinese_number(x) for x in ("十", "二十一", "一百零五", "三万二千", "42")] == [10, 21, 105, 32000, 42]
    assert structure.join_overlap("abc the quick brown fox", "the quick brown fox jumps") == "abc the quick brown fox jumps"


def test_sources(spark, tmp_path):
    assert readers.decode_bytes("é".encode("utf-16")) == "é" and readers.decode_bytes("中文".encode("gb18030")) == "中文" and readers.decode_bytes(None) == ""
    page = "<html><head><title>t</title></head><body><h2>Head</h2><p>a <b>b</b></p><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table><script>no</script><pre>k  v</pre></body>"
    assert readers.html_to_text(page) == "## Head\n\na b\n\n- x\n\n1 | 2\n\n```\nk  v\n```"
    assert readers.html_to_text("<ul><li>a<li>b <i>c</i><ul><li>d</ul></ul><p>x<p>y") == "- a\n\n- b c\n\n- d\n\nx\n\ny"
    assert readers.html_to_text("<p>unclosed <b>bold<table><tr><th>h<th><tr><td>1<td>2</table>end</b>") == "unclosed bold\n\nh |\n\n1 | 2\n\nend"
    assert readers.html_to_text("<pre>a\n\n\n  b &lt; c</pre>") == "```\na\n\n\n  b < c\n```"
    assert readers.html_to_text("<style>x</style><script>all of it</script>") == "" == readers.html_to_text(None)
    assert readers.html_to_text("<svg><p>told in a drawing") == ""
    assert readers.html_to_text("a < b <!-- c --> & d") == "a < b & d" and readers.html_to_text("<iframe>x</iframe>") == ""
    data = BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("top/a.md", "top/sub/b.txt", "top/.hid.md", "top/x.exe", "top/../e.md"):
            z.writestr(name, name)
    assert [(t, s) for t, s, _, _ in readers.archive_entries(data.getvalue())] == [("a.md", "ok"), ("sub - b.txt", "ok"), ("top/.hid.md", "hidden"), ("top/x.exe", "unsupported"), ("top/../e.md", "unsafe")]
    (tmp_path / "q.csv").write_text('id,question,answer,aliases,scope,language,effectiveFrom,effectiveTo,sourceDocumentId,sourceVersionId\n1,"two\nlines","say ""hi""",,,,,,,\n')
    r = readers.validate_qa(readers.read_qa_csv(spark, str(tmp_path / "q.csv"))).first()
    assert (r.question, r.answer, r.errors) == ("two\nlines", 'say "hi"', [])
