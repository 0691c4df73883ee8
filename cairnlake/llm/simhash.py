"""SimHash near-dedup (operator 4): Golay-code fuzzy hashing.

Fingerprints link at ``BITS`` = 3 or fewer differing bits. The 64 bits fall into segments A, B (23 bits) and C (18
bits, padded with zeros to 23). Two 23-bit words at distance 2 or less share a key if each takes as keys the
indices of the codewords within 3 of it, and of those at 4 where the nearest is at 3: the perfect binary Golay
code has one codeword within 3 of any word, and five more at 4 when the nearest is at 3; so a word has 1 or 6 keys.

Three differing bits over three segments leave a segment without errors, or one error in each:
* a segment without errors, with the Golay keys of the segment after it (A-B, B-C, C-A). Should that one hold all
  three errors, the third segment has none either and the pair that it leads covers the case;
* one error in each segment: then one half of every segment has none: eight keys of one half of each.
Rows of equal keys meet, differing bits are counted, and what links is kept. A group of fingerprints is never
turned into all pairs: a search from one unvisited fingerprint to the next leaves the edges of a spanning forest,
which has the same components. A key of more than about ``GROUP`` fingerprints is hot: before anything is shuffled it
is split into keys of parts of the bits that it leaves open, of which one holds no difference. A key that still has
more than ``GROUP`` is dealt as pairs of blocks of that size, which hold every pair of fingerprints between them.

Components come from alternating large and small stars over the distinct fingerprints, each round written to the
shared folder. Equal fingerprints are one node throughout, whatever the number of documents.

Cases: a null text counts as empty; no words: fingerprint zero, linked like any other; a null id never names a
component unless all its ids are null; repeated rows give repeated results; a bit set in just half of all hashes is 0; an empty table gives an empty result; very long texts
are read whole; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, column, forget, joined_by_weight, written

#: Words of a shingle, seed of its hash, differing bits of a link, fingerprints of a key that one task compares.
WORDS, SEED, BITS, GROUP = 3, 42, 3, 4096
#: Fingerprints of which one is sampled for hot keys; hot keys sent to tasks at most (0.5 MB).
SAMPLE, HOT = 16, 1 << 16
#: First bit and width of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
_GENERATOR = 0b101011100011


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of XXH64 of word shingles; a bit is set if over half the shingles set it."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    last = min(words, len(parts)) - 1
    a, b, digest = starts[:n].tolist(), ends[last : last + n].tolist(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the 64-bit hashes set."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 16384):
        bits = np.unpackbits(hashes[lo : lo + 16384].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """A row for each row: doc_id, fp (the fingerprint's 64 bits as a signed long)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in column(batch, "body")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _remainder(x: int) -> int:
    for k in range(22, 10, -1):
        if x >> k & 1:
            x ^= _GENERATOR << (k - 11)
    return x


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of bytes at their three places; for each remainder the error patterns of its 1 or 6 codewords (-1: none)."""
    bytes_ = np.array([[_remainder(b << s) if b << s < 1 << 23 else 0 for b in range(256)] for s in (0, 8, 16)], np.int64)
    patterns = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    for weight in (0, 1, 2, 3, 4):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            r = _remainder(e)
            patterns[r, used[r]] = e
            used[r] += 1
    return bytes_, patterns


def golay_keys(x: np.ndarray) -> np.ndarray:
    """Codeword indices (12 bits) of 23-bit words: a row of 6, -1 where there is none."""
    by_byte, patterns = golay_tables()
    r = by_byte[0][x & 255] ^ by_byte[1][x >> 8 & 255] ^ by_byte[2][x >> 16]
    e = patterns[r]
    return np.where(e >= 0, (x[:, None] ^ e) >> 11, -1)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of fingerprints (signed longs): which one, and its key, over all its keys."""
    u = fps.view(np.uint64)
    seg = [((u >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    who, keys, every = [], [], np.arange(len(fps))
    for i, j in ((0, 1), (1, 2), (2, 0)):
        golay = golay_keys(seg[j])
        rows, cols = np.nonzero(golay >= 0)
        who.append(rows)
        keys.append((i << 40) | (seg[i][rows] << 12) | golay[rows, cols])
    halves = [(s & ((1 << (w // 2)) - 1), s >> (w // 2)) for s, (_, w) in zip(seg, SEGMENTS, strict=True)]
    for n, (a, b, c) in enumerate(product((0, 1), repeat=3)):
        who.append(every)
        keys.append(((8 + n) << 40) | (halves[0][a] << 24) | (halves[1][b] << 12) | halves[2][c])
    return np.concatenate(who), np.concatenate(keys)


@lru_cache(maxsize=1)
def free_bits() -> np.ndarray:
    """Of each kind of key (its bits from 40 on), masks of four parts of the bits that it leaves open."""
    whole = [sum(1 << (s + b) for b in range(w)) for s, w in SEGMENTS]
    low = [sum(1 << (s + b) for b in range(w // 2)) for s, w in SEGMENTS]
    out = np.zeros((16, 4), np.uint64)
    for kind in [0, 1, 2, *range(8, 16)]:
        if kind < 8:
            held = whole[kind]  # of the segment under Golay keys any bit may differ
        else:
            choice = tuple(product((0, 1), repeat=3))[kind - 8]
            held = sum(low[k] if not c else whole[k] & ~low[k] for k, c in enumerate(choice))
        bits = [b for b in range(64) if not held >> b & 1]
        for part in range(4):
            out[kind, part] = sum(1 << b for b in bits[part::4])
    return out


def _with_keys(hot: np.ndarray):
    """(key, fp) of each fingerprint. Under a hot key, four keys of a part of its open bits each take its place: of two
    fingerprints that differ in three bits at most, one of the four parts has no difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            who, keys = keys_of(fps)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
                h = hot[at] == keys
                parts = fps[who[h]].view(np.uint64)[:, None] & free_bits()[keys[h] >> 40]
                x = keys[h].view(np.uint64)[:, None] * np.uint64(8) + np.arange(4, dtype=np.uint64)
                for y in (parts, parts >> np.uint64(31)):
                    x = (x ^ (x >> np.uint64(29)) ^ y) * np.uint64(0x9E3779B97F4A7C15)
                who, keys = np.concatenate((who[~h], np.repeat(who[h], 4))), np.concatenate((keys[~h], (x ^ (x >> np.uint64(32))).view(np.int64).ravel()))
            for lo in range(0, len(who), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 65536]), pa.array(fps[who[lo : lo + 65536]])], names=["key", "fp"])

    return run


def hot_keys(fps: DataFrame, group: int, sample: int = SAMPLE) -> np.ndarray:
    """Keys of more than about ``group`` fingerprints, the ``HOT`` most frequent of them, by one fingerprint in ``sample``; ascending.
    Which keys are among them changes how the work is dealt, never a link."""
    some = fps.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(sample)) == 0)
    counts = some.mapInArrow(_with_keys(np.zeros(0, np.int64)), "key long, fp long").groupBy("key").count().where(F.col("count") * sample > group)
    return np.sort(counts.orderBy(F.desc("count"), "key").limit(HOT).select("key").toArrow().column(0).to_numpy())


def forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among fingerprints (signed longs)."""
    rest, out = np.unique(fps), []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count((rest ^ node).view(np.uint64)) <= BITS
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), node), found))
                queue.extend(found)
                rest = rest[~near]
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in order of key, cut where a key ends (or after at least 64 k rows of keys that do not end)."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        held_k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        held_f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(held_k) < 65536:
            continue
        at = int(np.searchsorted(held_k, held_k[-1]))
        if at:
            yield held_k[:at], held_f[:at]
            held_k, held_f = held_k[at:], held_f[at:]
    if len(held_k):
        yield held_k, held_f


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("nth", pa.int64())])


def _linker(group: int):
    """Links within each key. Rows of a key beyond ``group`` come out as they are: a, key, nth."""

    def flush(links: list, more: list) -> Iterator[pa.RecordBatch]:
        none = lambda n: pa.nulls(n, pa.int64())
        if links:
            a, b = (np.concatenate(x) for x in zip(*links, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none(len(a)), none(len(a))], schema=LINKS)
        if more:
            a, k, n = (np.concatenate(x) for x in zip(*more, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), none(len(a)), pa.array(k), pa.array(n)], schema=LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _groups(batches):
            starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
            sizes = np.diff(np.append(starts, len(keys)))
            links, more = [], []
            two = starts[sizes == 2]
            a, b = fps[two], fps[two + 1]
            near = (np.bitwise_count((a ^ b).view(np.uint64)) <= BITS) & (a != b)
            if near.any():
                links.append((a[near], b[near]))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if n <= group:
                    links += forest(fps[s : s + n])
                else:
                    more.append((fps[s : s + n], keys[s : s + n], np.arange(n)))
            yield from flush(links, more)

    return run


def links(fps: DataFrame, group: int = GROUP, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp, distinct) whose components are those of all links."""
    keyed = fps.select("fp").mapInArrow(_with_keys(hot_keys(fps, group, sample)), "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = written(keyed.mapInArrow(_linker(group), "a long, b long, key long, nth long"), "links")
    edges = found.where("key is null").select("a", "b")
    # Keys of very many fingerprints: each row goes to every pair of blocks that its block is in.
    wide = found.where("key is not null").select("key", F.col("a").alias("fp"), F.floor(F.col("nth") / group).alias("block"))
    blocks = wide.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
    dealt = wide.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.where((F.col("block") != F.col("other")) | (F.col("blocks") == 1)).withColumn("pair", F.concat_ws("-", "key", F.least("block", "other"), F.greatest("block", "other")))
    parts = dealt.select(F.xxhash64("pair").alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return edges.unionByName(parts.mapInArrow(_linker(1 << 62), "a long, b long, key long, nth long").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, by large and small stars in turn; nodes without edges are absent."""
    edges = written(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not now.n or (now.n, now.x) == before:
            return edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        before = (now.n, now.x)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        following = written(small.where("a <> b").distinct(), "edges")
        forget(edges)
        edges = following


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, group: int = GROUP) -> DataFrame:
    """A row for each row: doc_id, fingerprint (16 hex digits), component_id (least id of its component)."""
    rows = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("_rows"))
    roots = components(links(nodes, group))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id", "_rows"), "components")
    return joined_by_weight(rows, named, "fp", "_rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
