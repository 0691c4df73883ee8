"""Byte-level BPE encoding and decoding (operator 6): corpus-level merge replay.

1. Texts are cut into words (matches of the splitting pattern), by blocks of documents. A word that is a token is
   written as its id, any other as its place among the block's other distinct words; these codes go to a file of the
   block in the shared folder, and the block's other words are dealt to buckets by their hash.
2. The buckets together hold the corpus's table of words, each word in one of them. There an inverted index from
   token pair to word positions applies every merge in rank order over all words that a task has gathered, and each
   merge updates the index for its two neighbours only. Ranks are taken lowest first from a heap, positions of a rank
   from left to right, so each word's merges come in the order in which an encoder of single words makes them. A
   word is replayed once; a task that has replayed ``KNOWN_WORDS`` of them forgets these and may meet one again.
3. Each block's words come back to it with their ids; its codes become ids, which are decoded by the table of tokens.
A block sends each of its distinct words once, as one row for each bucket, so no word is a hot key however frequent it is.

Files are named by their block's place and content: a task that runs again writes the same file, and rows of an
earlier attempt find it. Documents must therefore come from a scan, in the same order each time, not from a sample.

Cases: a null text counts as empty (no ids); lone surrogates can't occur in Spark strings; repeated rows give
repeated results, a null id is kept; bytes without a rank of their own are an error of the vocabulary file; very long
texts and words are taken whole, a text longer than a block is a block; an empty table gives an empty result; only the
named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, column, fresh_path, written
from cairnlake.llm.tokenfiles import Store

#: Words that a task remembers, and bytes of the longest; characters of a block; bytes of words replayed at once; words decoded at once.
KNOWN_WORDS, KNOWN_BYTES, BLOCK_CHARS, REPLAY_BYTES, SLICE = 300_000, 64, 4 << 20, 2 << 20, 1 << 18
#: Buckets for each shuffle partition.
BUCKETS = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Replay:
    """Merges of a rank file, replayed over tables of words."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair_ranks: dict[int, int] = {}

    def rank_of(self, pair: int) -> int:
        """Rank of a pair's joint token, -1 if there is none. A pair is its first token's id << 20 | the second's."""
        found = self.pair_ranks.get(pair)
        if found is None:
            if len(self.pair_ranks) > 500_000:
                self.pair_ranks.clear()
            found = self.pair_ranks[pair] = self.ranks.get(self.tokens[pair >> 20] + self.tokens[pair & 0xFFFFF], -1)
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        if not any(words):
            return [b""] * len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size)
        n = len(data)
        symbols = self.byte_ids[data]
        ids = symbols.tolist()
        last, first = np.zeros(n, bool), np.zeros(n, bool)
        last[ends[size > 0] - 1] = first[(ends - size)[size > 0]] = True
        after = np.where(last, -1, np.arange(1, n + 1)).tolist()
        before = np.where(first, -1, np.arange(-1, n - 1)).tolist()
        # The index: pair -> positions of its first symbols. Of each rank, the pairs that join to it.
        pairs = np.full(n, -1, np.int64)
        if n > 1:
            pairs[:-1] = np.where(last[:-1], -1, symbols[:-1] << 20 | symbols[1:])
        order = np.argsort(pairs, kind="stable")
        kinds, starts = np.unique(pairs[order], return_index=True)
        index: dict[int, list[int]] = {}
        of_rank: dict[int, list[int]] = {}
        for pair, places in zip(kinds.tolist(), np.split(order, starts[1:]), strict=True):
            if pair >= 0 and (r := self.rank_of(pair)) >= 0:
                index[pair] = places.tolist()
                of_rank.setdefault(r, []).append(pair)
        heap = list(of_rank)
        heapify(heap)
        now, rank_of = pairs.tolist(), self.rank_of

        def enter(pair: int, at: int) -> None:
            now[at] = pair
            if pair in index:
                index[pair].append(at)
            elif (r := rank_of(pair)) >= 0:
                index[pair] = [at]
                if r in of_rank:
                    of_rank[r].append(pair)
                else:
                    of_rank[r] = [pair]
                    heappush(heap, r)

        while heap:
            r = heappop(heap)
            places = sorted((i, pair) for pair in of_rank.pop(r) for i in index.pop(pair))
            for i, pair in places:
                if now[i] != pair:
                    continue  # a merge further left, or of a lower rank, took one of the two symbols
                j = after[i]
                ids[i] = r
                now[j] = ids[j] = -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                    enter(r << 20 | ids[k], i)
                else:
                    now[i] = -1
                h = before[i]
                if h >= 0:
                    enter(ids[h] << 20 | r, h)
        out = np.array(ids, np.int64)
        left = out >= 0
        per = np.zeros(len(words), np.int64)
        per[size > 0] = np.add.reduceat(left, (ends - size)[size > 0]) if n else []
        found, stop = out[left].astype("<u4").tobytes(), (4 * np.cumsum(per)).tolist()
        return [found[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs one after another: starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next run."""
    stop = np.cumsum(sizes)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts - (stop - sizes), sizes)


class Tokens:
    """Bytes of ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids one after another, and the number of each one's."""
        return self.data[ragged(self.starts[ids], self.sizes[ids])], self.sizes[ids]


@lru_cache(maxsize=2)
def replayer(path: str) -> tuple[Replay, Tokens]:
    replay = Replay(read_ranks(path))
    return replay, Tokens(replay.tokens)


def packed(parts: list[bytes]) -> bytes:
    import zstandard

    sizes = np.fromiter(map(len, parts), "<u4", len(parts))
    return zstandard.compress(np.uint32(len(parts)).tobytes() + sizes.tobytes() + b"".join(parts), 3)


def unpacked(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = (4 + 4 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64)))).tolist()
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def planes(ids: np.ndarray) -> list[bytes]:
    """First bytes of all numbers, second bytes, ...: each kind packs better by itself."""
    return [np.ascontiguousarray(x).tobytes() for x in ids.astype("<u4").view(np.uint8).reshape(-1, 4).T]


def joined(parts: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(p, np.uint8) for p in parts], 1).reshape(-1).view("<u4")


class Codes(dict):
    """word -> its id if it is a token, else the number of tokens and its place among the block's other words."""

    def __init__(self, replay: Replay) -> None:
        self.ranks, self.base = replay.ranks, len(replay.tokens)
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self.ranks.get(word.encode())
        if code is None:
            code = self.base + len(self.new)
            self.new.append(word)
        self[word] = code
        return code

    def next_block(self) -> list[bytes]:
        """The block's other words; the next block begins without them."""
        out = [w.encode() for w in self.new]
        for w in self.new:
            del self[w]
        self.new.clear()
        return out


def _write_block(store: Store, place: str, ids: list[int | None], codes: list[np.ndarray], sent: int) -> str:
    """Writes a block's file; returns its name."""
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(list(map(len, codes)), pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    content = packed([sink.getvalue().to_pybytes(), str(sent).encode(), *planes(np.concatenate(codes))])
    name = f"{place}-{hashlib.sha256(content).hexdigest()[:16]}"
    store.write(name, iter([content]))
    return name


def _read_block(store: Store, name: str) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Ids of documents, the number of codes of each, all codes, words that were sent to buckets."""
    head, sent, *codes = unpacked(bytes(store.read(name)))
    table = pa.ipc.open_stream(head).read_all()
    return table.column(0).to_pylist(), table.column(1).to_numpy(), joined(codes).astype(np.int64), int(sent)


def _coder(path: str, pattern: str, folder: str, buckets: int, block_chars: int):
    out = pa.schema([("bucket", pa.int32()), ("block", pa.string()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, store, split = Codes(replayer(path)[0]), Store(folder), regex.compile(pattern)
        ids: list[int | None] = []
        codes: list[np.ndarray] = []
        chars = nth = 0

        def block() -> pa.RecordBatch:
            words = table.next_block()
            at = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
            order = np.argsort(at, kind="stable")
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            for i, c in enumerate(codes):
                new = c >= table.base
                c[new] = table.base + place[c[new] - table.base]
            name = _write_block(store, f"{TaskContext.get().partitionId():06d}-{nth:06d}", ids, codes, len(words))
            used = np.unique(np.append(at, 0))  # a block without other words sends an empty row
            bounds = np.searchsorted(at[order], np.append(used, buckets)).tolist()
            rows = [packed([words[k] for k in order[a:b].tolist()]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([name] * len(rows)), pa.array(rows, pa.binary())], schema=out)

        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "body"), strict=True):
                words = split.findall(text) if len(text) < block_chars else (m.group() for m in split.finditer(text))
                ids.append(doc_id)
                codes.append(np.fromiter(map(table.__getitem__, words), np.int64))
                chars += len(text) + 64
                if chars >= block_chars:
                    yield block()
                    ids, codes, chars, nth = [], [], 0, nth + 1
        if ids:
            yield block()

    return run


def _replayer(path: str):
    out = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, known = replayer(path)[0], {}
        for batch in batches:
            rows = [unpacked(x) for x in column(batch, "words")]
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = list({w for ws in rows for w in ws if w not in known})
            lo = size = 0
            for hi, w in enumerate(new, 1):
                size += len(w)
                if size >= REPLAY_BYTES or hi == len(new):
                    known.update(zip(new[lo:hi], replay.encode(new[lo:hi]), strict=True))
                    lo, size = hi, 0
            found = []
            for ws in rows:
                ids = [known[w] for w in ws]
                sizes = np.fromiter(map(len, ids), "<u4", len(ids))
                found.append(packed([*planes(sizes // 4), *planes(np.frombuffer(b"".join(ids), "<u4"))]))
            for w in new:
                if len(w) > KNOWN_BYTES:
                    del known[w]
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "block")), pa.array(column(batch, "bucket"), pa.int32()), pa.array(found, pa.binary())], schema=out)

    return run


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[np.ndarray]]]:
    """Rows in order of block and bucket: each block with the numbers of ids of its words, and the ids, by bucket in turn."""
    name, held = None, []
    for batch in batches:
        for block, ids in zip(column(batch, "block"), column(batch, "ids"), strict=True):
            if block != name:
                if name is not None:
                    yield name, held
                name, held = block, []
            parts = unpacked(ids)
            held += [joined(parts[:4]), joined(parts[4:])]
    if name is not None:
        yield name, held


def _assembler(path: str, folder: str, digests: bool):
    kinds = [("doc_id", pa.int64()), *([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.binary())])]
    out = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, (replay, tokens) = Store(folder), replayer(path)
        base = np.arange(len(replay.tokens), dtype="<u4")
        for name, words in _whole_blocks(batches):
            ids, n, codes, sent = _read_block(store, name)
            sizes = np.concatenate((np.ones(len(base), np.int64), *words[::2]))
            if len(sizes) != len(base) + sent:
                raise ValueError(f"block {name}: {len(sizes) - len(base)} of {sent} words came back")
            table = np.concatenate((base, *words[1::2]))
            starts = np.cumsum(sizes) - sizes
            rows = [[hashlib.sha256(), hashlib.sha256(), 0] if digests else [] for _ in ids]
            stops = np.cumsum(n)
            for lo in range(0, len(codes), SLICE):
                part = codes[lo : lo + SLICE]
                found = table[ragged(starts[part], sizes[part])]
                cuts = np.concatenate(([0], np.cumsum(sizes[part])))
                first = int(np.searchsorted(stops, lo, "right"))
                ends = stops[first : int(np.searchsorted(stops, lo + len(part), "left")) + 1]
                at = cuts[np.minimum(ends - lo, len(part))].tolist()
                if digests:
                    text, each = tokens.decode(found)
                    places = np.concatenate(([0], np.cumsum(each)))
                for row, a, b in zip(rows[first:], [0, *at[:-1]], at, strict=False):
                    if digests:
                        row[0].update(found[a:b])
                        row[1].update(text[places[a] : places[b]])
                        row[2] += b - a
                    else:
                        row.append(found[a:b].tobytes())
            cols = [[r[2] for r in rows], [r[0].hexdigest() for r in rows], [r[1].hexdigest() for r in rows]] if digests else [[b"".join(r) for r in rows]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, (_, k) in zip(cols, kinds[1:], strict=True))], schema=out)

    return run


def _encoded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, digests: bool, folder: str, block_chars: int) -> DataFrame:
    spark = docs.sparkSession
    bounded_batches(spark)
    store = Store(folder)
    store.fs.create_dir(store.path, recursive=True)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    dealt = rows.mapInArrow(_coder(path, pattern, folder, buckets, block_chars), "bucket int, block string, words binary").repartition("bucket")
    back = dealt.mapInArrow(_replayer(path), "block string, bucket int, ids binary").repartition("block").sortWithinPartitions("block", "bucket")
    return back.mapInArrow(_assembler(path, folder, digests), "doc_id long, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary"))


def with_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each row: doc_id and ids (binary: little-endian unsigned 32-bit integers). The blocks' files stay in the shared folder."""
    return _encoded(docs, path, pattern, id_col, text_col, False, fresh_path(docs.sparkSession, "codes"), block_chars)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each row: doc_id, n_tokens, ids_sha256, decoded_sha256, the last from decoding the ids. The result is
    written, and the blocks' files go."""
    folder = fresh_path(docs.sparkSession, "codes")
    out = written(_encoded(docs, path, pattern, id_col, text_col, True, folder, block_chars), "token-digests")
    store = Store(folder)
    store.fs.delete_dir(store.path)
    return out


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``, there and back."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_vocabulary())
