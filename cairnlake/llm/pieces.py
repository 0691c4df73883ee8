"""SentencePiece encoding and decoding (operator 13): a merge-type prefix table.

A sentencepiece model of the BPE type joins the adjacent pair of the best score, leftmost first, until no pair is a piece. A
row of pieces is what that gives if and only if each piece alone is what its own characters give and each two neighbours are
compatible: joined alone, no merge crosses the point between them. Since the whole encoding is one, so is each prefix's, and
so is the last piece of each prefix:

1. An automaton over all pieces gives the pieces that end at each place of a text; of these the one that is compatible with
   the last piece of the prefix before it is the last piece of this prefix. The table holds it and nothing else.
2. The ids are recovered backwards: the last piece of the whole, then that of the prefix before it, and so on.

Two pieces are compatible if the symbols that stand at their common point, as each of them grows by its own merges, never
form a pair that would be joined sooner than the next merge of either (``Pieces.compatible``). A character in no piece is its
own symbol and is written as its bytes.

Texts are cut before the table is made where no piece can lie across: between a space and what stands before it (if no piece
has a space after another character), and around characters that are in no piece of two or more. Distinct cuts are encoded
once in a task and remembered.

Cases: a null text counts as empty, which has no ids; repeated rows give repeated results, a null id is kept; texts and words of
any length are taken whole, and a table has one number for each character of a cut; the merge order has no ties but between places,
where the left one goes first; an empty table gives an empty result; only the named columns are read, so others may have any
name. A model that is not BPE, has no byte pieces or changes texts by more than the marks of spaces is an error.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.bpe import ragged
from cairnlake.llm.common import blocks, bounded_batches, column, text_or_empty

SPACE_MARK = "▁"
#: Cuts that a task remembers, and characters of the longest; pairs of pieces that it remembers.
KNOWN_CUTS, KNOWN_CHARS, KNOWN_PAIRS = 400_000, 48, 1_500_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
BPE, INF = 2, float("inf")

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def read_model(path: str):
    """A model file's message."""
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        return sentencepiece_model_pb2.ModelProto.FromString(f.read())


def is_plain_bpe(model) -> bool:
    """Whether a model is BPE, has a piece for each byte, and does nothing to a text but to mark its spaces and put one before it."""
    how = model.normalizer_spec
    kinds = [p.type for p in model.pieces]
    return (
        model.trainer_spec.model_type == BPE
        and kinds.count(BYTE) == 256
        and not kinds.count(USER_DEFINED)
        and not how.precompiled_charsmap
        and how.add_dummy_prefix
        and how.escape_whitespaces
        and not how.remove_extra_whitespaces
        and not model.trainer_spec.treat_whitespace_as_suffix
    )


class Pieces:
    """Prefix tables over the pieces of a model."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        model = read_model(path)
        if not is_plain_bpe(model):
            raise ValueError(f"{path}: not a BPE model with byte pieces that leaves texts as they are")
        self.size = len(model.pieces)
        self.text = [p.piece for p in model.pieces]
        self.when = [-p.score for p in model.pieces]  # pieces of a lesser value are joined first
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        normal = []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                value = int(p.piece[3:-1], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif p.type == NORMAL:
                normal.append(i)
                self.surface.append(p.piece.replace(SPACE_MARK, " ").encode())
            else:
                self.surface.append(model.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else b"")
        self.id_of = {self.text[i]: i for i in normal}
        # Characters that stand in pieces only are symbols too: they have numbers after all ids.
        for c in sorted({c for i in normal for c in self.text[i]} - set(self.id_of)):
            self.id_of[c] = len(self.text)
            self.text.append(c)
            self.when.append(INF)
        self.length = list(map(len, self.text))
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.uneven: set[int] = set()
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            if self._grow(i):
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.known_pairs: dict[int, bool] = {}
        joined = {c for i in normal if self.length[i] > 1 for c in self.text[i]} - {SPACE_MARK}
        wide = any(c == SPACE_MARK and p != SPACE_MARK for i in normal for p, c in zip(self.text[i], self.text[i][1:], strict=False))
        some = "".join(re.escape(c) for c in sorted(joined | ({SPACE_MARK} if wide else set())))
        self.cut = re.compile(f"{SPACE_MARK}*[{some}]+|{SPACE_MARK}+|." if some else ".", re.DOTALL)
        self.data = np.frombuffer(b"".join(self.surface), np.uint8)
        self.sizes = np.fromiter(map(len, self.surface), np.int64, self.size)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.marked = np.array([p.type == NORMAL and p.piece.startswith(SPACE_MARK) for p in model.pieces])

    def joint(self, a: int, b: int) -> int:
        """The piece that two symbols form, -1 if there is none."""
        found = self.id_of.get(self.text[a] + self.text[b], -1)
        return found if found < self.size else -1

    def merges(self, symbols: list[int]) -> Iterator[tuple[int, float]]:
        """Joins pairs in place, the best first; gives the place and the value of each merge before it is made."""
        pairs = [self.joint(a, b) for a, b in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            at = min(range(len(pairs)), key=lambda i: self.when[pairs[i]] if pairs[i] >= 0 else INF)
            if pairs[at] < 0:
                return
            yield at, self.when[pairs[at]]
            symbols[at : at + 2] = [pairs.pop(at)]
            if at:
                pairs[at - 1] = self.joint(symbols[at - 1], symbols[at])
            if at < len(pairs):
                pairs[at] = self.joint(symbols[at], symbols[at + 1])

    def plain(self, text: str) -> list[int]:
        """Symbols of a text of known characters, by merging alone."""
        symbols = [self.id_of[c] for c in text]
        for _ in self.merges(symbols):
            pass
        return symbols

    def _grow(self, piece: int) -> bool:
        """Whether a piece's characters give the piece. Keeps the symbols at both of its ends, each with the value of the merge that takes it up."""
        symbols = [self.id_of[c] for c in self.text[piece]]
        left, right, last = [], [], -INF
        for at, value in self.merges(symbols):
            if value < last:
                self.uneven.add(piece)
            last = value
            if at == 0:
                left.append((symbols[0], value))
            if at == len(symbols) - 2:
                right.append((symbols[-1], value))
        self.left[piece], self.right[piece] = [*left, (piece, INF)], [*right, (piece, INF)]
        return symbols == [piece]

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the point between two pieces that stand side by side."""
        if a in self.uneven or b in self.uneven:
            return self.plain(self.text[a] + self.text[b]) == [a, b]
        xs, ys, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_goes), (y, y_goes) = xs[i], ys[j]
            both = self.joint(x, y)
            # Of merges of one value the left one goes first: those inside a, then the crossing one, then those inside b.
            if both >= 0 and self.when[both] < x_goes and self.when[both] <= y_goes:
                return False
            if x_goes == y_goes == INF:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def table(self, text: str) -> list[int]:
        """The last symbol of each prefix, -1 where it is a character of no piece."""
        last, length, known = [-1] * len(text), self.length, self.known_pairs
        for end, piece in self.automaton.iter(text):
            if last[end] >= 0:
                continue
            before = end - length[piece]
            if before < 0 or (p := last[before]) < 0:
                last[end] = piece
                continue
            ok = known.get(p << 24 | piece)
            if ok is None:
                if len(known) >= KNOWN_PAIRS:
                    known.clear()
                ok = known[p << 24 | piece] = self.compatible(p, piece)
            if ok:
                last[end] = piece
        return last

    def ids(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marked."""
        last, at, out = self.table(text), len(text) - 1, []
        while at >= 0:
            piece = last[at]
            if 0 <= piece < self.size:
                out.append(piece)
                at -= self.length[piece]
            else:
                out += [self.byte_ids[x] for x in reversed(text[at].encode())]
                at -= 1
        return out[::-1]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: a first mark is no space, bytes that form no character become U+FFFD one by one."""
        said = self.data[ragged(self.starts[ids], self.sizes[ids])].tobytes()
        first = next((i for i in ids.tolist() if self.sizes[i]), None)
        return said.decode("utf-8", "each_byte")[int(first is not None and self.marked[first]) :]


class Cuts(dict):
    """cut -> its ids as unsigned 32-bit integers; long ones and those past ``KNOWN_CUTS`` are not kept for later texts."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.long = pieces, []

    def __missing__(self, cut: str) -> bytes:
        found = self[cut] = np.array(self.pieces.ids(cut), np.uint32).tobytes()
        if len(cut) > KNOWN_CHARS:
            self.long.append(cut)
        return found

    def trim(self) -> None:
        if len(self) > KNOWN_CUTS:
            self.clear()
        for cut in self.long:
            self.pop(cut, None)
        self.long.clear()


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode_text(cuts: Cuts, text: str) -> np.ndarray:
    marked = SPACE_MARK + text.replace(" ", SPACE_MARK) if text else ""
    return np.frombuffer(b"".join(map(cuts.__getitem__, cuts.pieces.cut.findall(marked))), np.uint32)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id and ids (array of int)."""
    bounded_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(pieces_of(path))
        for batch in batches:
            texts, own = column(batch, "text"), batch.column(0)
            for a, b in blocks(texts):
                found = [encode_text(cuts, t) for t in texts[a:b]]
                at = np.concatenate(([0], np.cumsum(list(map(len, found))))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(found).view(np.int32)))
                yield pa.RecordBatch.from_arrays([own.slice(a, b - a), ids], schema=out)
                cuts.trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """Rows (doc_id, ids) with their texts: doc_id, ids, decoded. Null ids have a null text."""
    bounded_batches(rows.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            ids = batch.column(1)
            texts = [pieces.decode(x.values.to_numpy().astype(np.int64)) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids.cast(out.field(1).type), pa.array(texts, pa.string())], schema=out)

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``, there and back."""
    path = default_model()
    rows = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
