"""The summary tree over windowed clusters (RP1) against building it by hand."""

import re

import numpy as np

from cairnlake.operators import structure as st
from cairnlake.operators.vector import soft_clusters


def summary(text, n):
    parts = [p for p in re.findall(r"[^.!?。！？\n]+[.!?。！？]?", text) if len(p.strip()) >= 10]
    return " ".join(p.strip() for p in parts[:n])[:1800]


def shortened(texts, n, group):
    while True:
        texts = [summary("\n".join(texts[i : i + group]), n) for i in range(0, len(texts), group)]
        if len(texts) == 1:
            return texts[0]


def test_tree_and_membership_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, centres = [], rng.normal(size=(3, 6))
    for doc, n in ((1, 23), (2, 2), (3, 9), (4, 40)):
        for i in range(n):
            v = [float(x) for x in centres[i % 3] + rng.normal(scale=1.0, size=6)] if not (doc == 3 and i > 1) and i % 11 != 7 else None
            rows.append(("k", doc, f"s{i // 5}", i, f"Chunk {i} of document {doc} begins here. It ends with number {i * doc}.", v))
    parts = spark.createDataFrame(rows, "kb_id string, doc_id long, section string, ord long, content string, embedding array<double>").repartition(3)
    tree, members = st.cluster_tree(parts, window=10, sentences=3, group=4)
    want = set()
    for doc in (1, 2, 3, 4):
        own = [r for r in rows if r[1] == doc]
        for w in range(0, len(own), 10):
            part = own[w : w + 10]
            good = [r for r in part if r[5] is not None]
            if len(good) >= 3:
                found = soft_clusters(np.array([r[5] for r in good]), min(6, min(8, max(2, int(np.ceil(np.sqrt(len(good))))))))
                want |= {(doc, r[3], f"w{w // 10}-c{c}") for r, cs in zip(good, found, strict=True) for c in cs}
            else:
                good = []
            want |= {(doc, r[3], f"s-{r[2]}") for r in part if r not in good}
    got = {(r.doc_id, r.ord, r.node) for r in members.collect()}
    assert got == want
    assert {(d, o) for d, o, _ in got} == {(r[1], r[3]) for r in rows} and len(got) > len(rows)  # all chunks, some of them twice
    texts = {(r[1], r[3]): r[4] for r in rows}
    nodes = {}
    for d, o, n in want:
        nodes.setdefault((d, n), []).append(o)
    zero = {k: shortened([texts[k[0], o] for o in sorted(os)], 3, 4) for k, os in nodes.items()}
    found = {(r.doc_id, r.level, r.node): r.content for r in tree.collect()}
    assert {(d, n): c for (d, level, n), c in found.items() if level == 0} == zero
    for doc in (1, 2, 3, 4):
        order = sorted((min(os), n) for (d, n), os in nodes.items() if d == doc)
        assert found[doc, 1, "document"] == shortened([zero[doc, n] for _, n in order], 3, 4)
    assert len([k for k in found if k[1] == 2]) == 1


def test_empty(spark):
    tree, members = st.cluster_tree(spark.createDataFrame([], "kb_id string, doc_id long, section string, ord long, content string, embedding array<double>"))
    assert tree.collect() == [] and members.collect() == []
