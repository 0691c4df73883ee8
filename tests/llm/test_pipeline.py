import hashlib
import random
from collections import Counter

import numpy as np
import tiktoken

import corpus_pipeline
from cairnlake.llm import bpe, langid, mixing


def corpus():
    rng = random.Random(8)
    words = {"en": "the of and river stone house with from under light small bird".split(), "de": "der die und fluss stein haus mit von unter licht klein vogel".split()}
    rows = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(30, 90))), lang, f"src{i % 4}", 0))
    rows += [(1000 + i, rows[i][1].replace(" ", "  "), rows[i][2], rows[i][3], 0) for i in range(30)]  # copies
    for i in range(20):  # near copies: a word changed in the middle of a long text, in chains of three
        first = rng.choices([f"{w}{k}" for w in words["en"] for k in "abcdefgh"], k=120)
        for k in range(3):
            rows.append((1100 + 3 * i + k, " ".join(first), "en", f"src{i % 4}", 0))
            first = [*first[: 40 + 20 * k], "stone", *first[41 + 20 * k :]]
    rows.append((1999, " ".join(rng.choices(words["de"], k=30_000)), "de", "src3", 0))
    rows += [(2000, "Ωμέγα και άλφα ψυχή λόγος θάλασσα ουρανός " * 8, None, "src0", 0), (2001, None, "en", "src1", 0), (2002, "12 34 !!", "en", None, 0)]
    return rows


def test_stages(spark):
    rows = corpus()
    at = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(f"{at}/documents.parquet")
    kept = spark.read.parquet(f"{at}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.written(stage(spark, kept, at), f"test-{name}")
        seen.append(kept)
    lang, exact, near, mixed, encoded = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    gone = {r[0] for r in rows} - {r.doc_id for r in lang.collect()}
    assert gone == {2000, 2001, 2002}
    texts = {r[0]: r[1] for r in rows}
    left = {i for i in texts if not 1000 <= i < 1100} - gone
    assert {r.doc_id for r in exact.collect()} == left
    assert {r.doc_id for r in near.collect()} == near_by_hand({i: texts[i] for i in left})
    assert len(left) - near.count() >= 40
    times = Counter(r.doc_id for r in mixed.collect())
    kept_ids = {r.doc_id for r in near.collect()}
    assert set(times) <= kept_ids and max(times.values()) <= 3
    source, size = {r[0]: r[3] for r in rows}, {i: len(t.split()) for i, t in texts.items() if t}
    sizes, taken = Counter(), Counter()
    for i in kept_ids:
        sizes[source[i]] += size[i]
        taken[source[i]] += times[i] * size[i]
    weights = dict(zip(sorted(sizes), (5, 2, 1, 5), strict=True))
    want = {x: min(3 * sizes[x], 0) for x in sizes}
    full = set()
    while True:  # shares by weight, none above three times its source's size
        rest, total = sum(sizes.values()) - sum(3 * sizes[x] for x in full), sum(weights[x] for x in sizes if x not in full)
        want = {x: 3 * sizes[x] if x in full else rest * weights[x] / total for x in sizes}
        over = {x for x in sizes if x not in full and want[x] > 3 * sizes[x]}
        if not over:
            break
        full |= over
    assert all(abs(taken[x] - want[x]) <= max(size[i] for i in kept_ids if source[i] == x) for x in sizes), (taken, want)
    got = encoded.collect()
    assert Counter(r.doc_id for r in got) == times
    path, pattern = bpe.default_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = {i: np.array(library.encode_ordinary(texts[i]), "<u4") for i in times}
    assert all(r.n_tokens == len(ids[r.doc_id]) and r.ids_sha256 == hashlib.sha256(ids[r.doc_id].tobytes()).hexdigest() for r in got)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, got))


def near_by_hand(texts):
    """Of texts linked at a Jaccard similarity of 0.8 or more of their five-word shingles, the least ids."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [t.lower().split()]}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(texts)
    for n, i in enumerate(order):
        for j in order[:n]:
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in texts if find(i) == i}


def test_empty_table_and_clashing_columns(spark):
    names = ["row", "ids", "node", "key", "label", "_position", "_id", "_keep", "block", "bucket", "n", "score", "body", "size", "h", "a"]
    docs = spark.createDataFrame([(i, t, "en", s, *["x"] * len(names)) for i, (t, s) in enumerate([("a b c d e f g", "s"), ("a b c d e f g", None), (None, "s"), ("h i j k l m n o p", None)])], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for given in (docs, docs.limit(0)):
        kept = corpus_pipeline.written(given, "test-clash")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = corpus_pipeline.written(stage(spark, kept, ""), f"test-{name}")
            assert kept.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, "")
        assert out.count() == kept.count() and (given is docs or not kept.count())


def test_model_without_rows(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(docs, langid.fit(docs)).collect()] == [(1, "und", 0.0, True)]
    assert langid.drop_rejected(docs).count() == 1
