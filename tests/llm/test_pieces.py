"""Operator 13 against the model's own library."""

import hashlib
import random

import numpy as np
import pytest

from cairnlake.llm import pieces as pc

PATH = pc.default_model()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(5)
    words = "the of naïve Übergröße façade año mañana tokenization internationalization 世界 你好 мир привет こんにちは 한국어 ▁ ▁▁x x▁y 🙂 👩‍👩‍👧 ́ \x00 <s> </s> <unk> <0x41> aaaa aaaaaaa 1234567 --- ..... http://a.b/c?d=e".split(" ")
    spaces = [" ", " ", " ", "  ", "   ", " " * 7, " " * 16, " " * 33, "\n", "\t", "\r\n", " ", "　", ""]
    out = ["", " ", "  ", "▁", "a", "\n", " a", "a ", "  a  b ", "a" * 3000, "▁" * 100 + "the", "ab " * 2000, "的" * 500]
    for _ in range(1500):
        out.append("".join(rng.choice(words) + rng.choice(spaces) for _ in range(rng.randint(1, 25))))
    for _ in range(500):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 1500), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randint(1, 60))))
        out.append("".join(rng.choice("ab the in▁") for _ in range(rng.randint(1, 80))))
    return out


def test_ids_and_texts_are_the_librarys(library):
    cuts = pc.Cuts(pc.pieces_of(PATH))
    for t in texts():
        ids = pc.encode_text(cuts, t)
        want = library.encode(t)
        assert ids.tolist() == want, t
        assert cuts.pieces.decode(ids.astype(np.int64)) == library.decode(want), t


def test_a_prefix_table_holds_the_last_piece_of_each_prefix(library):
    pieces = pc.pieces_of(PATH)
    text = "▁internationalization▁of▁tokens▁▁▁▁▁aaaa"
    table = pieces.table(text)
    for end in range(1, len(text) + 1):
        assert table[end - 1] == pieces.plain(text[:end])[-1]


def test_pairs_are_compatible_where_merging_keeps_both():
    pieces, rng = pc.pieces_of(PATH), random.Random(3)
    usual = [i for t, i in pieces.id_of.items() if pieces.plain(t) == [i]]
    short = [i for i in usual if pieces.length[i] <= 3]
    for n in range(6000):
        a, b = (rng.choice(usual), rng.choice(usual)) if n % 2 else (rng.choice(short), rng.choice(short))
        assert pieces.compatible(a, b) == (pieces.plain(pieces.text[a] + pieces.text[b]) == [a, b])
    marks = [i for i in usual if set(pieces.text[i]) == {"▁"}]
    assert all(pieces.compatible(a, b) == (pieces.plain(pieces.text[a] + pieces.text[b]) == [a, b]) for a in marks for b in marks)


def test_any_ids_decode_as_in_the_library(library):
    pieces, rng = pc.pieces_of(PATH), random.Random(4)
    for _ in range(400):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(1, 32000)]) for _ in range(rng.randint(1, 12))]
        assert pieces.decode(np.array(ids, np.int64)) == library.decode(ids), ids


def test_other_models_are_refused(monkeypatch):
    model = pc.read_model(PATH)
    assert pc.is_plain_bpe(model)
    model.normalizer_spec.remove_extra_whitespaces = True
    assert not pc.is_plain_bpe(model)
    model = pc.read_model(PATH)
    model.trainer_spec.model_type = 1
    assert not pc.is_plain_bpe(model)


def test_rows_and_query(spark, library, tmp_path):
    rows = [(1, "one two", "x", 0), (1, "one two", "x", 0), (None, "ghost", None, 1), (2, None, "y", 2), (3, "", "y", 2), (4, "long " * 60_000, "y", 2), (5, "w" * 150_000, "y", 2), (6, "a\n\nb  c 世界", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pc.op13_sentencepiece(spark, str(tmp_path)).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pc.op13_sentencepiece(spark, f"{tmp_path}/none").collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert pc.decode(none, PATH).first().decoded is None
