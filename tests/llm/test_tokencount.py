import random

import public_tokenizers
import pytest

from cairnlake.llm import tokencount as t

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "b", "the", " ", "  ", "\n", "é", "中", "文", "\U0001f600", "1", "22", "-", "ing", "tion", "▁", "①", "<s>", "e\u0301", " \u0301", "'s", "<|endoftext|>", "\u00a0", "\x1d", "Σ"]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_spliced_counts_equal_whole_ones(name):
    e, rng = t.encoder(public_tokenizers.path(name)), random.Random(1)
    assert e.splices
    for _ in range(150):
        s = "".join(rng.choices(ALPHABET, k=rng.randint(1, 400)))
        for chunk, overlap in ((20, 4), (7, 2), (50, 8)):
            assert t.spliced(e, s, chunk, overlap) == e.counts([s])[0], s


def test_proven_points_are_boundaries_of_every_encoding():
    rng = random.Random(3)
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"):
        e = t.encoder(public_tokenizers.path(name))
        for _ in range(100):
            s = "".join(rng.choices(ALPHABET, k=60))
            points = t.stable_points(e, s, 0, len(s))
            whole = t.Encoding(e, s, 0)
            assert (whole.boundaries(points) == points).all()
            for p in points.tolist():
                right = t.Encoding(e, s[p - 1 :], p - 1)  # begun elsewhere: the same tokens after the point
                assert len(right.begin) - right.before([p])[0] == len(whole.begin) - whole.before([p])[0], (s, p)


def test_overlaps_widen_until_they_align():
    e = t.encoder(PATH)
    for s in ("a" * 1000 + " b" * 200, "a" * 1000, "x " * 40 + "a" * 1000 + " x" * 300, "a" * 99 + " 中" + "a" * 500):
        assert t.spliced(e, s, 50, 8) == e.counts([s])[0]
    assert len(t.stable_points(e, "a" * 1000, 0, 1000)) == 0


def test_other_steps_are_not_spliced():
    file = {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel"}}
    assert t.proven(file) and not t.proven(file | {"pre_tokenizer": None}) and not t.proven(file | {"normalizer": {"type": "NFKC"}})
    token = {"lstrip": False, "rstrip": False, "single_word": False, "content": "a b"}
    assert not t.proven(file | {"added_tokens": [token]}) and t.proven(file | {"added_tokens": [token | {"content": "ab"}]})


def test_query(spark):
    e, rng = t.encoder(PATH), random.Random(2)
    texts = [None, "", " ", "\x00", "a b", "😀".encode("utf-16", "surrogatepass").decode("utf-16")] + ["".join(rng.choices(ALPHABET, k=k)) for k in (10, 500, 3000, 9000)] + ["word " * 5000, "a" * 4000, "x " * 900 + "a" * 2000 + " x" * 900]
    rows = [(i, x, 0, "r") for i, x in enumerate(texts)] + [(None, "a b", 0, ""), (4, "a b", 0, ""), (9, texts[9], 0, ""), (None, texts[10], 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, row string")
    for path in (PATH, public_tokenizers.path("word_bpe_49k.json")):
        e = t.encoder(path)
        got = sorted(map(tuple, t.token_counts(docs, path, chunk=700, overlap=8).collect()), key=str)
        want = sorted(((i, len((x or "").encode()), n := e.counts([x or ""])[0], n > 4096) for i, x, *_ in rows), key=str)
        assert got == want
        assert t.token_counts(docs.limit(0), path).collect() == []


def test_long_texts_at_production_size(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices(ALPHABET, k=150_000)), "a" * 140_000, "word " * 60_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in t.token_counts(docs, PATH).collect()}
    assert got == dict(enumerate(t.encoder(PATH).counts(texts)))
