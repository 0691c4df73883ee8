"""Token-ID output (operator 1): flat files of unsigned integers plus 64-bit document offsets, memory-mapped.

Format: a folder with ``shard-00000.bin`` (unsigned little-endian ids of 16 bits where the vocabulary has fewer than
65,536 ids, else of 32; documents one after another, each ended by the end id), ``shard-00000.idx`` (64-bit little-endian: the document ids, -2**63 for null, then where each
document starts in the whole corpus, then where the last one ends) and ``manifest.json`` (shards in order with
their bases). Documents stand in ascending id order across shards, null first, equal ids by text.

1. Rows are range-partitioned by id and sorted; each task writes its shard's ids and returns its counts.
2. Shard bases are the prefix sums of those counts (a row for each shard, not for each document).
3. Each task writes its shard's offsets from its base; a reader maps the files and needs no other state.

A task writes under a name of its own attempt and renames at the end, so a lost executor leaves no half shard.
Whole words are encoded once and remembered (the pre-tokenizer of word_bpe_49k.json cuts at white space and drops
it, and neither normalisation nor added tokens reach across it), so the library sees each distinct word only.

Cases: a null text counts as empty and yields the end id alone; repeated rows and ids yield a document each; very long
texts are encoded whole; only the named columns are read, so others may have any name; an empty table yields a manifest
without shards.
"""

from __future__ import annotations

import json
import mmap
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, column, fresh_path

#: Words that a worker remembers; bytes of text that are encoded together.
KNOWN_WORDS, ENCODE_BYTES = 900_000, 8 << 20
NULL_ID = -(1 << 63)
SHARD = "shard int, n_docs long, n_tokens long"


class WordEncoder:
    """The tokenizers library, one call for many distinct words."""

    def __init__(self, path: str, dtype: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.dtype = Tokenizer.from_file(path), dtype
        self.known: dict[str, bytes] = {"": b""}

    @staticmethod
    def stem(word: str) -> str:
        """The word whose ids those of this one begin with; the rest is one mark. Marks and letters never share a token,
        and ASCII letters lose their case before anything is looked up."""
        if len(word) > 1 and word[-1] in ".," and word[-2].isalpha():
            word = word[:-1]
        return word.lower() if word.isascii() and "<" not in word else word

    def learn(self, words: list[str]) -> None:
        """Encode words by the library; those of letters alone together, as each of them is one unit of its output."""
        plain, rest = [w for w in words if w.isalpha()], [w for w in words if not w.isalpha()]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            found = self.library.encode(" ".join(part), add_special_tokens=False)
            data, unit = np.array(found.ids, self.dtype).tobytes(), np.array(found.word_ids)
            starts = (np.flatnonzero(np.diff(unit, prepend=-1)) * int(self.dtype[2])).tolist()
            if len(starts) != len(part):
                rest += part  # a letter that becomes a letter and a mark
                continue
            self.known.update((w, data[i:j]) for w, i, j in zip(part, starts, [*starts[1:], len(data)], strict=True))
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for w, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, self.dtype).tobytes()

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known = self.known
        out = list(map(known.get, words))
        new = [i for i, ids in enumerate(out) if ids is None]
        stems = [self.stem(words[i]) for i in new]
        self.learn([s for s in {*stems, ".", ","} if s not in known])
        for i, s in zip(new, stems, strict=True):
            w = words[i]
            out[i] = known[s] if w == s else known[s] + known[w[len(s) :]]
        if len(known) > KNOWN_WORDS:
            known = self.known = {"": b"", **dict(zip(words, out, strict=True))}
        known.update((words[i], out[i]) for i in new)
        for w in [w for w in {*stems, *(words[i] for i in new)} if len(w) > 64]:
            known.pop(w, None)
        return out

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text's followed by ``end``, and how many each text has.

        Arrow numbers the words, so Python sees each distinct word of the array once."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        ids, which = self.words(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // int(self.dtype[2])
        starts = np.cumsum(n) - n
        size = n[which]
        stop = np.cumsum(size)
        take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(starts[which] - (stop - size), size)
        tokens = np.frombuffer(b"".join(ids), self.dtype)[take]
        at = np.concatenate(([0], stop))[first - first[0]]
        if end is not None:
            tokens = np.insert(tokens, at[1:], end)
        return tokens, np.diff(at) + (end is not None)


@lru_cache(maxsize=2)
def _encoder(path: str, dtype: str) -> WordEncoder:
    return WordEncoder(path, dtype)


def id_type(vocabulary: str, end_id: int) -> str:
    """The narrowest type that holds every id."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(vocabulary).get_vocab_size(), end_id + 1) < 1 << 16 else "<u4"


class Store:
    """Files of the output folder, in any store that pyarrow reaches."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)

    def write(self, name: str, chunks: Iterator[bytes]) -> None:
        part = f"{self.path}/.{name}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(part) as out:
            for c in chunks:
                out.write(c)
        self.fs.move(part, f"{self.path}/{name}")

    def read(self, name: str):
        """A buffer of a file: memory-mapped where the store is a local or mounted folder."""
        if isinstance(self.fs, pafs.LocalFileSystem):
            with open(f"{self.path}/{name}", "rb") as f:
                f.seek(0, 2)
                return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
        with self.fs.open_input_file(f"{self.path}/{name}") as f:
            return f.read_buffer()


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into ``folder``; returns the table of shards: shard, n_docs, n_tokens, base."""
    spark = docs.sparkSession
    bounded_batches(spark)
    store = Store(folder)
    store.fs.create_dir(store.path, recursive=True)
    dtype = id_type(vocabulary, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, own, ids, sizes = TaskContext.get().partitionId(), Store(folder), [], []

        def pieces() -> Iterator[bytes]:
            encoder, held = _encoder(vocabulary, dtype), []
            for batch in chain(batches, [None]):
                if batch is not None:
                    ids.extend(column(batch, "doc_id"))
                    held.append(batch.column(1))
                if held and (batch is None or sum(x.nbytes for x in held) >= ENCODE_BYTES):
                    tokens, size = encoder.encode(pa.concat_arrays(held), end_id)
                    held = []
                    sizes.extend(size.tolist())
                    yield tokens.tobytes()

        own.write(f"shard-{shard:05d}.bin", pieces())
        starts = np.concatenate(([0], np.cumsum(np.array(sizes, "<i8"))))
        # Offsets within the shard, until the bases are known.
        own.write(f"shard-{shard:05d}.local", iter([np.array([NULL_ID if i is None else i for i in ids], "<i8").tobytes(), starts.astype("<i8").tobytes()]))
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([x], pa.int64()) for x in (len(sizes), int(starts[-1])))], names=["shard", "n_docs", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    # Equal ids are ordered by text, so that every attempt of a task writes the same file.
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "body")
    shards = sorted(ordered.mapInArrow(run, SHARD).collect())  # a row for each shard
    base, listed = 0, []
    for s in shards:
        listed.append((s.shard, s.n_docs, s.n_tokens, base))
        base += s.n_tokens
    store.write("manifest.json", iter([json.dumps({"dtype": {"<u2": "uint16", "<u4": "uint32"}[dtype], "end_id": end_id, "shards": [dict(zip(("shard", "n_docs", "n_tokens", "base"), x, strict=True)) for x in listed]}).encode()]))
    table = spark.createDataFrame(listed, "shard int, n_docs long, n_tokens long, base long")
    if not listed:
        return table

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Store(folder)
        for batch in batches:
            for shard, n, base in zip(column(batch, "shard"), column(batch, "n_docs"), column(batch, "base"), strict=True):
                local = np.frombuffer(own.read(f"shard-{shard:05d}.local"), "<i8")
                own.write(f"shard-{shard:05d}.idx", iter([local[:n].tobytes(), (local[n:] + base).astype("<i8").tobytes()]))
            yield batch

    # Every task's file is complete before the manifest's readers see the result.
    by_shard = table.repartitionByRange(len(listed), "shard")
    done = spark.createDataFrame(by_shard.mapInArrow(offsets, table.schema).collect(), table.schema)
    for s in listed:
        store.fs.delete_file(f"{store.path}/shard-{s[0]:05d}.local")
    return done


def read_tokens(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """A row for each document, from the files alone: doc_id, start, n_tokens, ids_crc32 (unsigned crc32 of its ids as
    little-endian unsigned 32-bit integers, whatever the width in the files)."""
    width = {"uint16": 2, "uint32": 4}[json.loads(bytes(Store(folder).read("manifest.json")))["dtype"]]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Store(folder)
        for batch in batches:
            for shard, n, base in zip(column(batch, "shard"), column(batch, "n_docs"), column(batch, "base"), strict=True):
                index = np.frombuffer(own.read(f"shard-{shard:05d}.idx"), "<i8")
                data = np.frombuffer(own.read(f"shard-{shard:05d}.bin"), f"<u{width}")
                ids, starts = index[:n], index[n:]
                for lo in range(0, n, 4096):
                    at = starts[lo : lo + 4097]
                    crc = [zlib.crc32(data[a:b].astype("<u4")) for a, b in zip((at[:-1] - base).tolist(), (at[1:] - base).tolist(), strict=True)]
                    own_ids = ids[lo : lo + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array(own_ids, pa.int64(), mask=own_ids == NULL_ID), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=schema)

    return shards.repartition("shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Query: encode every whole text of ``documents``, write the files, read them back."""
    import public_tokenizers

    folder = fresh_path(spark, "tokens")
    shards = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 2, folder)
    return read_tokens(spark, folder, shards)
