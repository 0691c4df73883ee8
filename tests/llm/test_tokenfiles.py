import random
import zlib

import numpy as np
import public_tokenizers

from cairnlake.llm import tokenfiles as t
from cairnlake.llm.common import fresh_path

PATH = public_tokenizers.path("word_bpe_49k.json")
BITS = ["The", " and", "ing", "É", "é", "中文", "\U0001f600", " ", "  ", "\n", "\t", "\r\n", "'s", "123", "İ", "ß", "\x1c", " ", " ", " ́x", "<|endoftext|>", "<|startoftext|>", "-", "...", "Σ"]


def test_words_are_encoded_as_whole_texts(monkeypatch):
    monkeypatch.setattr(t, "KNOWN_WORDS", 30)
    e, rng = t.WordEncoder(PATH, "<u4"), random.Random(6)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 50))) for _ in range(600)] + [""]
    for _ in range(2):
        tokens, sizes = e.encode(t.pa.array([*texts, "cut"]).slice(0, len(texts)), 2)
        for x, ids in zip(texts, np.split(tokens, np.cumsum(sizes)[:-1]), strict=True):
            assert ids.tolist() == [*e.library.encode(x, add_special_tokens=False).ids, 2], x
    for k in range(0, 600, 40):  # the bounded table is cleared again and again
        tokens, _ = e.encode(t.pa.array(texts[k : k + 40]))
        assert tokens.tolist() == [i for x in texts[k : k + 40] for i in e.library.encode(x, add_special_tokens=False).ids]
    tokens, sizes = e.encode(t.pa.array(["gap", *texts]).slice(1))
    assert tokens.tolist() == [i for x in texts for i in e.library.encode(x, add_special_tokens=False).ids]
    assert len(e.encode(t.pa.array([], t.pa.string()), 2)[0]) == 0


def test_files_round_trip(spark):
    rng = random.Random(7)
    rows = [(rng.randint(-500, 500), "".join(rng.choices(BITS, k=rng.randint(0, 30))), 1) for _ in range(700)] + [(None, "a b", 1), (3, None, 1), (4, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = fresh_path(spark, "tokens")
    got = sorted(map(tuple, t.read_tokens(spark, folder, t.write_tokens(docs, PATH, 2, folder)).collect()), key=lambda r: r[1])
    library = t.WordEncoder(PATH, "<u4").library
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert [r[1] for r in got] == np.concatenate(([0], np.cumsum([r[2] for r in got])[:-1])).tolist()
    want = sorted(((i, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, x, _ in rows for ids in [library.encode(x or "", add_special_tokens=False).ids]), key=str)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == want


def test_a_very_long_text_is_encoded_whole(spark):
    long = "Some words, then more of them: ÉÉ 中文 🙂\n" * 12_000
    docs = spark.createDataFrame([(2, long, "x"), (1, "short", "y")], "doc_id long, text string, n_tokens string")
    folder = fresh_path(spark, "tokens")
    got = {r[0]: r[1:] for r in map(tuple, t.read_tokens(spark, folder, t.write_tokens(docs, PATH, 2, folder)).collect())}
    library = t.WordEncoder(PATH, "<u4").library
    ids = [*library.encode(long, add_special_tokens=False).ids, 2]
    assert got[2] == (got[1][1], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = fresh_path(spark, "tokens")
    assert t.read_tokens(spark, folder, t.write_tokens(docs, PATH, 2, folder)).collect() == []


def test_width_of_ids(monkeypatch):
    assert t.id_type(PATH, 2) == "<u2" and t.id_type(PATH, 1 << 17) == "<u4"
