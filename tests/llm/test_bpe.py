import hashlib
import random

import numpy as np
import pytest
import tiktoken

from cairnlake.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts(rng, n):
    bits = ["the", " and", "ing", "é", "中文", "\U0001f600", " ", "  ", "\n", "\t", "'s", "123", "aaaa", "ñ", "ß", "\x00", "<|endoftext|>", "-", "...", "Ā", "ab" * 20]
    return ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(n)] + ["", "a" * 5000, "\U0001f600" * 300, "z" * 3 + "é" * 700]


def test_a_table_of_words_is_replayed_as_the_library_encodes(library):
    replay, tokens = bpe.replayer(PATH)
    rng = random.Random(3)
    words = list({w for t in texts(rng, 400) for w in bpe.regex.findall(PATTERN, t)}) + ["aba" * 9, "ababab", "aaa", "".join(rng.choices("ab", k=300))]
    got = replay.encode([w.encode() for w in words])
    for w, ids in zip(words, got, strict=True):
        ids = np.frombuffer(ids, "<u4")
        if w.encode() not in replay.ranks:  # the library takes a whole token as it is; these come to the table never
            assert ids.tolist() == library._encode_single_piece(w.encode()), w
        assert tokens.decode(ids)[0].tobytes() == w.encode()
    assert replay.encode([]) == [] and replay.encode([b""]) == [b""]


def test_pairs_that_join_to_one_token_overlap():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"ba": 257, b"aba": 258}
    replay, library = bpe.Replay(ranks), tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2000)]
    for w, ids in zip(words, replay.encode([w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library._encode_single_piece(w.encode()) or w.encode() in ranks, w


def test_packing():
    for parts in ([], [b""], [b"a", b"", b"bc" * 1000]):
        assert bpe.unpacked(bpe.packed(parts)) == parts


@pytest.mark.parametrize("block_chars, known", [(bpe.BLOCK_CHARS, bpe.KNOWN_WORDS), (300, 5), (1, 0)])
def test_query(spark, library, monkeypatch, block_chars, known):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", known)
    monkeypatch.setattr(bpe, "SLICE", 7 if known == 5 else bpe.SLICE)
    ts = [None, *texts(random.Random(5), 60)]
    rows = [(i, t, "x", 1) for i, t in enumerate(ts)] + [(None, "a b", "x", 1), (3, ts[3], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, block int").repartition(3, "doc_id")
    got = sorted(map(tuple, bpe.round_trip(docs, PATH, PATTERN, block_chars=block_chars).collect()), key=str)
    want, plain = [], []
    for i, t, *_ in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        plain.append((i, ids.tobytes()))
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    if known == 5:
        assert sorted(((r.doc_id, bytes(r.ids)) for r in bpe.with_ids(docs, PATH, PATTERN, block_chars=block_chars).collect()), key=str) == sorted(plain, key=str)
        assert bpe.round_trip(docs.limit(0), PATH, PATTERN).collect() == []


def test_very_long_texts(spark, library):
    rng = random.Random(9)
    ts = ["".join(rng.choices(["the ", "ing", " and", "é", "中", "zq"], k=120_000)), "q" * 200_000, " " * 50_000, "".join(rng.choices("abcdefgh", k=100_000))]
    docs = spark.createDataFrame(list(enumerate(ts)), "doc_id long, text string")
    got = {r.doc_id: r.ids_sha256 for r in bpe.round_trip(docs, PATH, PATTERN, block_chars=1 << 17).collect()}
    assert got == {i: hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest() for i, t in enumerate(ts)}
