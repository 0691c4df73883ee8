"""SimHash near-dedup of the pipeline (operator 4 with its own setting): sets of ``WORDS``-word shingles with a Jaccard
similarity of ``SAME`` (4/5) or more are linked.

Golay keys (``simhash.links``) propose pairs of sets whose fingerprints differ in at most three bits. Sets at 4/5
often differ in more, ten in the mean, and no keys of a 64-bit fingerprint hold all of these; so what the fingerprints
miss is proposed by an exact join, and every proposal is held against the whole texts.

The exact join (shingles are their 64-bit hashes): two sets that similar share one of the first hashes of each in any
one order, of which a set of n has n - ceil(4 n / 5) + 1 (prefix filter), so keys are those; the order is by hash, but
what is common in a sample comes last, which saves work and changes no result. Sets of equal keys meet at a place, once
for however many keys the same sets share, and a pair stays a candidate if sizes allow 4/5, and parity bitmaps too, a
narrow one at the place and then one as wide as the set asks: differing bits never outnumber differing shingles.

A group of near copies is never turned into all pairs: first the candidates of a spanning forest of each place are
verified; then, where one of those failed, all other candidates whose ends these links have not joined yet. A key of
more than ``GROUP`` sets is dealt as pairs of blocks of that size. Equal sets are one node throughout, named by a 64-bit
digest; hashes and digests are taken for what they stand for (an error needs a collision of 64 bits).

Tables of the way are deleted once the components are written.

Cases: a null text counts as empty; fewer than ``WORDS`` words: one shingle of all of them; no words: equal to each other only;
a null id names a component only if all its ids are null; rows that share the kept id are all kept; an empty table gives an
empty result; very long texts are read whole; columns of any other name are kept and not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import bounded_batches, column, forget, written
from cairnlake.llm.simhash import components, majority
from cairnlake.llm.simhash import links as golay_links

#: Words of a shingle, seed of hashes, similarity of a link as a fraction, sets of a key that meet at once, bits of a bitmap.
WORDS, SEED, SAME, GROUP, BITMAP = 5, 42, (4, 5), 1024, 1024
#: One document of so many is sampled for common shingles, of which at most so many are sent to tasks; bits of the filter of wanted nodes.
SAMPLE, COMMON, FILTER = 64, 1 << 16, 1 << 26
_PRIME = np.uint64(0x9E3779B185EBCA87)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of word shingles (signed, ascending): XXH64 of words, mixed in order."""
    import xxhash

    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts))
    n = max(1, len(h) - words + 1)
    x = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        x = (x ^ (x >> np.uint64(29))) * _PRIME + h[k : k + n]
    x = (x ^ (x >> np.uint64(32))) * _PRIME
    return np.unique((x ^ (x >> np.uint64(29))).view(np.int64))


def bitmap(hashes: np.ndarray, bits: int = BITMAP) -> bytes:
    """Bit b: whether the number of hashes that fall on b is odd."""
    at = (hashes.view(np.uint64) >> np.uint64(7)) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).tobytes()


def wide_bitmap(hashes: np.ndarray) -> bytes:
    """A bitmap of two bits or more for each hash, a power of two of them."""
    return bitmap(hashes, max(BITMAP, 1 << (2 * len(hashes)).bit_length()))


def parities_apart(x: bytes, y: bytes) -> int:
    """Differing bits of two bitmaps; the wider one is folded onto itself until both are alike."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Of a sample of rows (body), the shingles of three documents or more, at most COMMON; ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in column(batch, "body"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text))], names=["hash"])

    sample = rows.where(F.pmod(F.xxhash64("body"), F.lit(SAMPLE)) == 0).select("body")
    counts = sample.mapInArrow(run, "hash long").groupBy("hash").count().where("count > 2")
    return np.sort(counts.orderBy(F.desc("count"), "hash").limit(COMMON).select("hash").toArrow().column(0).to_numpy())


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(4 n / 5) + 1 hashes, common ones last."""
    n = len(hashes)
    if not n:
        return hashes
    late = np.isin(hashes, common, assume_unique=True)
    return np.concatenate((hashes[~late], hashes[late]))[: n - -(-n * SAME[0] // SAME[1]) + 1]


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, body, and place of the body: its hash."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.withColumn("text_at", F.xxhash64("body"))


def shingle_sets(rows: DataFrame) -> DataFrame:
    """A row for each of (doc_id, body, text_at): doc_id, text_at, node (digest of the set), n (its size), fp (its SimHash), bits and wide (its bitmaps), keys (its prefix)."""
    bounded_batches(rows.sparkSession)
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows))  # at most 0.5 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            texts = column(batch, "body")
            for lo in range(0, len(texts), 128):
                sets = [shingles(t) for t in texts[lo : lo + 128]]
                nodes, fps = (np.array(x, np.uint64).view(np.int64) for x in ([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], [majority(s.view(np.uint64)) for s in sets]))
                cols = [pa.array(nodes), pa.array(list(map(len, sets)), pa.int64()), pa.array(fps), pa.array(map(bitmap, sets), pa.binary()), pa.array(map(wide_bitmap, sets), pa.binary()), _lists([prefix(s, common.value) for s in sets])]
                own = (batch.column(batch.schema.get_field_index(c)).slice(lo, 128) for c in ("doc_id", "text_at"))
                yield pa.RecordBatch.from_arrays([*own, *cols], names=["doc_id", "text_at", "node", "n", "fp", "bits", "wide", "keys"])

    return rows.mapInArrow(run, "doc_id long, text_at long, node long, n long, fp long, bits binary, wide binary, keys array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def _wanted_texts(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """(text_at, body) of some texts. A filter of FILTER bits (8 MB) drops nearly all others before texts are shuffled."""
    at = F.pmod(F.xxhash64("text_at"), F.lit(FILTER))
    words = ends.select(at.alias("at")).groupBy(F.expr("at >> 6").alias("word")).agg(F.expr("bit_or(1L << cast(at & 63 as int))").alias("bits")).toArrow()
    field = np.zeros(FILTER // 64, np.int64)
    field[words.column(0).to_numpy()] = words.column(1).to_numpy()
    handle = rows.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("boolean")
    def wanted(place):
        import pandas as pd

        x = place.to_numpy()
        return pd.Series((handle.value[x >> 6] >> (x & 63)) & 1 == 1)

    found = rows.select("text_at", "body").where(wanted(at)).join(ends, "text_at", "left_semi")
    return found.groupBy("text_at").agg(F.first("body").alias("body"))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b, a_at, b_at) of sets of n shingles together whose bitmaps x and y allow 4/5."""
    for batch in batches:
        apart = np.array([parities_apart(x, y) for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True)], np.int64)
        n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        kept = batch.filter(pa.array(sum(SAME) * apart <= (SAME[1] - SAME[0]) * n))
        yield pa.RecordBatch.from_arrays([kept.column(kept.schema.get_field_index(c)) for c in ("a", "b", "a_at", "b_at")], names=["a", "b", "a_at", "b_at"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts x and y have sets at 4/5 or more."""
    for batch in batches:
        keep = []
        for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
            x, y = shingles(x), shingles(y)
            keep.append(sum(SAME) * len(np.intersect1d(x, y, assume_unique=True)) >= SAME[0] * (len(x) + len(y)))
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])


def _whole_keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows in order of their first column, cut where a key ends, ``least`` or more at once."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(0).to_numpy()
        if at := int(np.searchsorted(keys, keys[-1])):
            yield table.slice(0, at)
            held = table.slice(at).to_batches()
            n -= at
    if n:
        yield pa.Table.from_batches(held)


def _bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1))
    return starts, np.diff(np.append(starts, len(keys)))


def _meeting(group: int) -> Callable:
    """(key, node), sorted, to (place, node) of keys of two nodes or more. A place is named by its nodes; those of a large key are pairs of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def named(nodes: np.ndarray) -> int:
            return np.uint64(xxhash.xxh64_intdigest(nodes.tobytes(), SEED)).view(np.int64)

        for table in _whole_keys(batches, 65536):
            keys, nodes = (table.column(c).to_numpy() for c in (0, 1))
            first = np.append(True, (np.diff(keys) != 0) | (np.diff(nodes) != 0))  # equal sets meet once
            keys, nodes = keys[first], nodes[first]
            starts, sizes = _bounds(keys)
            some = (sizes > 1) & (sizes <= group)
            places = [named(nodes[s : s + n]) for s, n in zip(starts[some].tolist(), sizes[some].tolist(), strict=True)]
            rows = np.unique(np.stack((np.repeat(np.array(places, np.int64), sizes[some]), nodes[np.repeat(some, sizes)]), 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].copy()), pa.array(rows[:, 1].copy())], names=["place", "node"])
            for s, n in zip(starts[sizes > group].tolist(), sizes[sizes > group].tolist(), strict=True):
                parts = [nodes[i : min(i + group, s + n)] for i in range(s, s + n, group)]
                for i in range(len(parts)):
                    for j in range(i):
                        both = np.concatenate((parts[i], parts[j]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), named(both))), pa.array(both)], names=["place", "node"])

    return run


def _candidates(every: bool) -> Callable:
    """(place, node, n, bits, label, text_at), sorted, to candidates (a, b, their texts' places) of different labels: all, or a spanning forest of each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_keys(batches, 16384):
            places, nodes, sizes, labels, texts = (table.column(c).to_numpy() for c in (0, 1, 2, 4, 5))
            bits = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint64).reshape(len(nodes), -1)
            found = []

            def near(i, j, nodes=nodes, sizes=sizes, labels=labels, bits=bits):
                a, b = sizes[i], sizes[j]
                ok = (labels[i] != labels[j]) & (SAME[1] * np.minimum(a, b) >= SAME[0] * np.maximum(a, b))
                # Sets at 4/5 differ in at most (a + b) / 9 shingles.
                return ok & (sum(SAME) * np.bitwise_count(bits[i] ^ bits[j]).sum(-1, dtype=np.int64) <= (SAME[1] - SAME[0]) * (a + b))

            starts, lengths = _bounds(places)
            two = starts[lengths == 2]
            two = two[near(two, two + 1)]
            found.append((two, two + 1))
            for s, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                rest = np.arange(s, s + n)
                if (labels[rest] == labels[s]).all():
                    continue
                queue = []
                while len(rest):
                    if every or not queue:
                        queue, rest = [rest[0]], rest[1:]
                    node = queue.pop()
                    ok = near(node, rest)
                    found.append((np.full(int(ok.sum()), node), rest[ok]))
                    if not every:
                        queue.extend(rest[ok].tolist())
                        rest = rest[~ok]
            i, j = (np.concatenate(x) for x in zip(*found, strict=True))
            i, j = np.where(nodes[i] < nodes[j], i, j), np.where(nodes[i] < nodes[j], j, i)
            pairs = np.unique(np.stack((nodes[i], nodes[j], texts[i], texts[j]), 1), axis=0)
            for lo in range(0, len(pairs), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + 65536, c].copy()) for c in range(4)], names=["a", "b", "a_at", "b_at"])

    return run


def _golay_pairs(marks: DataFrame) -> DataFrame:
    """Candidates (a, b, a_at, b_at) from fingerprints: a forest of those within three bits, and the nodes of equal ones."""
    first = marks.groupBy("fp").agg(F.min(F.struct("node", "n", "text_at")).alias("first")).select("fp", "first.*")
    at = lambda end: first.select(F.col("fp").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in ("node", "n", "text_at")))
    near = golay_links(first.select("fp")).join(at("a"), "a").join(at("b"), "b").drop("a", "b")
    equal = marks.select("fp", *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "text_at"))).join(at("a"), F.col("fp") == F.col("a")).where("a_node <> b_node")
    both = near.unionByName(equal.select(near.columns)).where(SAME[1] * F.least("a_n", "b_n") >= SAME[0] * F.greatest("a_n", "b_n"))
    ends = [F.struct(F.col(f"{e}_node").alias("node"), F.col(f"{e}_text_at").alias("at")) for e in "ab"]
    return both.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.at").alias("a_at"), F.col("y.at").alias("b_at"))


def links(sets: DataFrame, rows: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (a, b) between nodes of ``sets`` (as of ``shingle_sets``, of ``rows``) whose components are those of all pairs at 4/5 or more."""
    marks = written(sets.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "bits", "wide")), F.min("text_at").alias("text_at")), "marks")
    keyed = sets.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    meeting = written(keyed.mapInArrow(_meeting(group), "place long, node long").distinct(), "meeting")

    def candidates(meeting: DataFrame, labelled: DataFrame, every: bool) -> DataFrame:
        placed = meeting.join(labelled.drop("wide"), "node").select("place", "node", "n", "bits", "label", "text_at").repartition("place").sortWithinPartitions("place")
        return placed.mapInArrow(_candidates(every), "a long, b long, a_at long, b_at long")

    def close(pairs: DataFrame) -> DataFrame:
        left, right = (marks.select(F.col("node").alias(e), F.col("n").alias(f"n{e}"), F.col("wide").alias(w)) for e, w in (("a", "x"), ("b", "y")))
        both = pairs.join(left, "a").join(right, "b").withColumn("n", F.col("na") + F.col("nb"))
        return both.select("a", "b", "a_at", "b_at", "n", "x", "y").mapInArrow(_close, "a long, b long, a_at long, b_at long")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a_at").alias("text_at")).unionByName(pairs.select(F.col("b_at").alias("text_at"))).distinct()
        texts = _wanted_texts(rows, ends)
        left, right = texts.select(F.col("text_at").alias("a_at"), F.col("body").alias("x")), texts.select(F.col("text_at").alias("b_at"), F.col("body").alias("y"))
        both = pairs.join(left, "a_at").join(right, "b_at").select("a", "b", "x", "y")
        return written(both.mapInArrow(_similar, "a long, b long"), "near-links")

    forest = candidates(meeting, marks.withColumn("label", F.col("node")), False)
    pairs = written(forest.unionByName(_golay_pairs(marks)).distinct(), "candidates")
    near = written(close(pairs), "near")
    first = verified(near)
    roots = components(first).withColumnRenamed("root", "label")
    labelled = written(marks.join(roots, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    # Only where a candidate of a forest failed can others be left: every such place holds the end a of the failed pair.
    failed = pairs.join(first, ["a", "b"], "left_anti")
    ends = failed.select(F.col("a").alias("node")).distinct()
    places = meeting.join(ends, "node", "left_semi").select("place").distinct()
    others = candidates(meeting.join(places, "place", "left_semi"), labelled, True).distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    others = written(close(others.select("a", "b", "a_at", "b_at")), "near")
    second = verified(others)
    forget(marks, meeting, pairs, near, labelled, others)
    return first.unionByName(second)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """A row for each row: doc_id, component_id (least id of its component)."""
    rows = _bodies(docs, id_col, text_col)
    sets = written(shingle_sets(rows), "shingles")
    found = links(sets, rows, group)
    roots = components(found)
    rooted = sets.groupBy("node").agg(F.min("doc_id").alias("least_id")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = written(sets.select("doc_id", "node").join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id"), "near-components")
    forget(sets, found, roots)
    return out


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The rows of ``docs`` that carry their component's least id, with all their columns."""
    kept = near_components(docs, id_col, text_col, group).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = kept.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_id")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_id"))
    return rows.join(ids, "_id", "left_semi").select("row.*")
