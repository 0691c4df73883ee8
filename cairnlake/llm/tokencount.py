"""Token counts (operator 3): overlap resynchronisation for huge documents.

A document over ``CHUNK_CHARS`` is cut into chunks; each is encoded together with the first ``OVERLAP`` characters of
the next one, by whatever task it is dealt to, and the encoder's offsets place its tokens. In the overlap of two
chunks the two encodings are compared: a point where both have a token boundary, and which is proven stable, is where
they are spliced. A chunk's tokens count from its splice on the left to its splice on the right. If an overlap has no
such point, alignment fails; the document is then spliced anew chunk by chunk, each overlap doubled until it aligns, at
worst up to the text's end (``spliced``).

A point is proven stable if no encoding of any text around it can have a token across it, so what lies on either side
changes nothing on the other:
* sentencepiece BPE models with identity normalisation: the two characters at the point stand side by side in no
  piece of the vocabulary, so merges never join them;
* JSON files of tokenizers whose steps are among ``PROVEN`` and whose added tokens hold no white space: a space
  follows a character that is none; words begin there whatever stands around them.
Other models and JSON files with other steps are encoded whole.

Cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results (rows are numbered
before chunks are dealt); of several points the first is taken; an empty table gives an empty result; only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, column, written
from cairnlake.llm.pieces import is_plain_bpe, read_model

#: Characters of a chunk and of the first overlap; tokens that make a text too long.
CHUNK_CHARS, OVERLAP, LIMIT = 65_536, 256, 4096
SPACE_MARK = "▁"
#: Steps of JSON files after which the proof holds: normalisers that join nothing across a space, and splitters whose words begin at it.
PROVEN = {"NFC", "Lowercase", "ByteLevel"}
#: Fixed patterns of such steps: white space made one space; words without white space.
SPACE_PATTERN, WORD_PATTERN = r"\s+", r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Joints:
    """Pairs of characters that are inside some piece of a vocabulary; between any other pair no token crosses."""

    def __init__(self, pieces: list[str]) -> None:
        pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.keys = np.array(sorted((ord(a) << 21) | ord(b) for a, b in pairs), np.int64)

    def free(self, text: str) -> np.ndarray:
        """For each i from 1, whether no token crosses the point before character i of the text."""
        cp = np.frombuffer(text.replace(" ", SPACE_MARK).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        keys = (cp[:-1] << 21) | cp[1:]
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return self.keys[at] != keys


class PieceEncoder:
    """A sentencepiece model: token numbers, tokens' offsets, proven points."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.splices = is_plain_bpe(read_model(path))
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (self.model.is_control, self.model.is_byte, self.model.is_unknown)
        self.joints = Joints([self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not any(k(i) for k in kinds)])

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) character of each token."""
        pieces = self.model.encode(text, return_type="proto").pieces
        data = np.frombuffer(text.encode(), np.uint8)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # the encoder's offsets are of bytes
        return tuple(np.searchsorted(starts, np.array([at(p) for p in pieces], np.int64)) for at in (lambda p: p.begin, lambda p: p.end))

    def stable(self, text: str) -> np.ndarray:
        """For each i from 1, whether the point before character i is proven."""
        return self.joints.free(text)


class WordEncoder:
    """A JSON file of tokenizers."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.splices = proven(json.load(f))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(self.model.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def stable(self, text: str) -> np.ndarray:
        space = np.array([c == " " for c in text])
        white = np.array([c.isspace() or "\x1c" <= c <= "\x1f" for c in text])
        return space[1:] & ~white[:-1]


def proven(file: dict) -> bool:
    """Whether the steps of a JSON file are among those after which a space that follows no white space begins a word."""

    def ok(step: dict | None) -> bool:
        if step is None or step["type"] in PROVEN:
            return True
        pattern = step.get("pattern", {}).get("Regex")
        return (
            (step["type"] == "Sequence" and all(map(ok, step.get("normalizers", []) + step.get("pretokenizers", []))))
            or (step["type"] == "Replace" and pattern == SPACE_PATTERN and step["content"] == " ")
            or (step["type"] == "Split" and pattern == WORD_PATTERN and step["behavior"] == "Removed" and step["invert"])
        )

    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])) for t in file["added_tokens"])
    return plain and file["pre_tokenizer"] is not None and ok(file["normalizer"]) and ok(file["pre_tokenizer"])


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder | WordEncoder:
    return PieceEncoder(path) if path.endswith(".model") else WordEncoder(path)


class Encoding:
    """A stretch of text from character ``start`` on, encoded with offsets."""

    def __init__(self, e: PieceEncoder | WordEncoder, text: str, start: int) -> None:
        self.begin, self.end = (x + start for x in e.offsets(text))
        self.reach = np.concatenate(([start], np.maximum.accumulate(self.end)))

    def before(self, points: np.ndarray) -> np.ndarray:
        """Tokens that begin before each point."""
        return np.searchsorted(self.begin, points)

    def boundaries(self, points: np.ndarray) -> np.ndarray:
        """Those of the points that no token crosses."""
        return points[self.reach[self.before(points)] <= points]


def stable_points(e: PieceEncoder | WordEncoder, text: str, lo: int, hi: int) -> np.ndarray:
    """Proven points of a text after character ``lo`` and before ``hi``."""
    return lo + 1 + np.flatnonzero(e.stable(text[lo:hi])) if hi - lo > 1 else np.zeros(0, np.int64)


def spliced(e: PieceEncoder | WordEncoder, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text from overlapping chunks, one after the other; an overlap doubles until it aligns."""
    total, start, skip = 0, 0, 0  # skip: tokens of this chunk that the one before has
    while True:
        width = overlap
        while True:
            left = Encoding(e, text[start : start + chunk + width], start)
            end = start + chunk + width
            if end >= len(text):
                return total + len(left.begin) - skip
            right = Encoding(e, text[start + chunk : end + chunk], start + chunk)
            points = stable_points(e, text, start + chunk, end)
            both = np.intersect1d(left.boundaries(points), right.boundaries(points))
            if len(both):
                break
            width *= 2
        total += int(left.before(both[:1])[0]) - skip
        # After a wide overlap the next chunk is the last one that begins before the splice.
        following = start + chunk + (int(both[0]) - 1 - start - chunk) // chunk * chunk
        if following != start + chunk:
            right = Encoding(e, text[following : following + chunk + overlap], following)
        skip, start = int(right.before(both[:1])[0]), following


def _deal(chunk: int, overlap: int):
    """Chunks of each text with the overlap after them: row, nth, last, body."""
    out = pa.schema([("row", pa.int64()), ("nth", pa.int32()), ("last", pa.bool_()), ("body", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(column(batch, "row"), column(batch, "body"), strict=True):
                for nth, lo in enumerate(range(0, len(text), chunk)):
                    last = lo + chunk + overlap >= len(text)
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((row, nth, last, text[lo : lo + chunk + overlap]), out, strict=True)], schema=out)
                    if last:
                        break

    return run


_MARKS = "row long, nth int, last boolean, n long, head array<int>, head_n array<int>, tail array<int>, tail_n array<int>"


def _marks(path: str, chunk: int, overlap: int):
    """Of each chunk its tokens, and in the overlaps at either end the proven boundaries and the tokens before each. Places count from the overlap's begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for batch in batches:
            found = []
            for text in column(batch, "body"):
                own, row = Encoding(e, text, 0), []
                row.append(len(own.begin))
                for lo in (0, chunk):
                    points = own.boundaries(stable_points(e, text, lo, min(len(text), lo + overlap)))
                    row += [(points - lo).tolist(), own.before(points).tolist()]
                found.append(row)
            kinds = (pa.int64(), *[pa.list_(pa.int32())] * 4)
            cols = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], names=["row", "nth", "last", "n", "head", "head_n", "tail", "tail_n"])

    return run


def _counter(path: str):
    """Tokens of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = encoder(path).counts(column(batch, "body"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64())], names=["row", "doc_id", "n_bytes", "n_tokens"])

    return run


def _widening(path: str, chunk: int, overlap: int):
    """Tokens of texts with a failed alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [spliced(encoder(path), t, chunk, overlap) for t in column(batch, "body")]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("row")), pa.array(n, pa.int64())], names=["row", "wide"])

    return run


def _of_huge(huge: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """row, doc_id, n_bytes, n_tokens of texts of more than one chunk."""
    chunks = huge.select("row", "body").mapInArrow(_deal(chunk, overlap), "row long, nth int, last boolean, body string").repartition("row", "nth")
    marks = written(chunks.mapInArrow(_marks(path, chunk, overlap), _MARKS), "token-marks")
    left = marks.where("not last").select("row", (F.col("nth") + 1).alias("nth"), "tail", "tail_n")
    pairs = left.join(marks.select("row", "nth", "head", "head_n"), ["row", "nth"])
    pairs = pairs.withColumn("at", F.array_min(F.array_intersect("tail", "head")))
    n_at = lambda places, n: F.element_at(n, F.array_position(places, F.col("at")).cast("int"))
    own = F.when(F.col("at").isNotNull(), n_at(F.col("tail"), F.col("tail_n")) - n_at(F.col("head"), F.col("head_n"))).cast("long")
    totals = pairs.groupBy("row").agg(F.sum(own).alias("own"), F.count_if(F.col("at").isNull()).alias("failed"))
    ends = marks.where("last").select("row", "n").join(totals, "row", "left")
    wide = huge.select("row", "body").join(totals.where("failed > 0"), "row", "left_semi").mapInArrow(_widening(path, chunk, overlap), "row long, wide long")
    n_tokens = F.when(F.coalesce("failed", F.lit(0)) > 0, F.col("wide")).otherwise(F.col("n") + F.coalesce("own", F.lit(0)))
    return huge.select("row", "doc_id", "n_bytes").join(ends, "row").join(wide, "row", "left").select("row", "doc_id", "n_bytes", n_tokens.alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """A row for each row: doc_id, n_bytes, n_tokens, over_limit. Texts of one chunk are counted where they are read;
    longer ones are written apart, and their chunks dealt out."""
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("body"))
    counted = "row long, doc_id long, n_bytes long, n_tokens long"
    if encoder(vocabulary).splices:
        small = rows.where(F.length("body") <= chunk).mapInArrow(_counter(vocabulary), counted)
        out = small.unionByName(_of_huge(written(rows.where(F.length("body") > chunk), "huge-texts"), vocabulary, chunk, overlap))
    else:
        out = rows.mapInArrow(_counter(vocabulary), counted)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
