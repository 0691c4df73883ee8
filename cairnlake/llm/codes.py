"""Vector code compression (operator 12): slice-and-intersect bitmasks.

Vectors become integers, are cut into equal parts, and each part is written as the index of the nearest entry of its
position's codebook. The nearest entry is found exactly, by masks (``Slices``):

1. Of each dimension the entries' coordinates are sorted; before the first, after the first, after the second, ... stands the
   mask of the entries up to there.
2. A first entry, near in the widest dimensions, gives a radius: its distance. No entry outside the box of that radius around
   the part can be nearer, or as near.
3. In each dimension two binary searches give the range of the box; the masks at its ends differ in the entries between them.
   The masks of all dimensions, ANDed, are the candidates, whose distances alone are computed.

Codebooks are fitted by rounds over all rows: a task assigns its rows and sums them for each entry, so that a round shuffles and
brings to the driver a row for each entry and dimension from each task, and no vector.

Cases: rows whose vector is null, empty, of another length than the first one's or holds null or non-finite components take no
part; null ids come last; rows that repeat an id are rows of their own, ordered by their vectors; equal distances go to the
lower index; fewer rows than entries give fewer entries; an empty table gives an empty result; a length that the parts do not
divide, and errors beyond 64 bits, are errors; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import joined_by_weight, written
from cairnlake.llm.vectors import int64, integers, kept_vectors, narrowed

#: Components are floor(SCALE * x); parts of a vector, entries of a codebook, rounds of fitting.
SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Dimensions whose nearest coordinates give first entries.
GUESSES = 2


class Slices:
    """Entries of a codebook (a row each), for exact search of the nearest one."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = [entries[order[:, j], j] for j in range(d)]
        bits = np.zeros((n, -(-n // 64)), np.uint64)
        bits[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
        none = np.zeros((1, bits.shape[1]), np.uint64)
        self.upto = [np.concatenate((none, np.bitwise_or.accumulate(bits[order[:, j]], axis=0))) for j in range(d)]
        spread = [int(s[-1]) - int(s[0]) for s in self.sorted]
        self.widest = sorted(range(d), key=lambda j: -spread[j])[:GUESSES]
        self.order = order

    def distance(self, x: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        d = x - self.entries[at]
        return (d * d).sum(1)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row the mask of entries that are within the radius in every dimension: a row of 64-bit words."""
        out = None
        for j, (s, upto) in enumerate(zip(self.sorted, self.upto, strict=True)):
            lo, hi = np.searchsorted(s, x[:, j] - radius, "left"), np.searchsorted(s, x[:, j] + radius, "right")
            between = upto[hi] ^ upto[lo]
            out = between if out is None else out & between
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry, and its squared distance."""
        found = best = None
        if self.entries.dtype == object:
            x = x.astype(object)
        for j in self.widest:
            place = np.minimum(np.searchsorted(self.sorted[j], x[:, j]), len(self.entries) - 1)
            guess = self.order[place, j]
            d = self.distance(x, guess)
            nearer = None if best is None else d < best
            found, best = (guess, d) if best is None else (np.where(nearer, guess, found), np.where(nearer, d, best))
        # One more than the root's floor: the root of a large square is not exact.
        root = np.sqrt(best.astype(np.float64))
        radius = root.astype(np.int64) + 1 if best.dtype == np.int64 else np.array([int(r * (1 + 1e-12)) + 1 for r in root], object)
        masks = self.candidates(x, radius)
        for k in range(len(self.entries)):
            rows = np.flatnonzero(masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1))
            if len(rows):
                d = self.distance(x[rows], k)
                take = (d < best[rows]) | ((d == best[rows]) & (k < found[rows]))
                rows, d = rows[take], d[take]
                best[rows], found[rows] = d, k
        return found, best


def _parts(x: np.ndarray, parts: int) -> list[np.ndarray]:
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} components are no {parts} equal parts")
    return np.split(x, parts, axis=1)


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], scale: int) -> Iterator[pa.RecordBatch]:
    """A task's sums: part, entry, place, total and the number of parts."""
    slices = [Slices(b) for b in books]
    totals = [np.zeros(b.shape, object) for b in books]
    counts = [np.zeros(len(b), np.int64) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        for p, x in enumerate(_parts(integers(batch.column(0), scale), len(books))):
            own, _ = slices[p].nearest(x)
            order = np.argsort(own, kind="stable")
            used, first = np.unique(own[order], return_index=True)
            totals[p][used] += np.add.reduceat(x[order], first, axis=0).astype(object)
            counts[p][used] += np.diff(np.append(first, len(own)))
    rows = [(p, e, j, int(totals[p][e, j]), int(counts[p][e])) for p, b in enumerate(books) for e in range(len(b)) if counts[p][e] for j in range(b.shape[1])]
    if rows:
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.decimal128(38, 0)), pa.array(columns[4], pa.int64())], names=["part", "entry", "place", "total", "n"])


def train(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks of rows (vec_id, embedding), which ``kept_vectors`` gave: one for each part, a row for each entry. They begin as the parts of
    the rows of the least ids."""
    first = vectors.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    if not len(first):
        return []
    books = [b.copy() for b in _parts(integers(first.column(1).combine_chunks(), scale), parts)]
    for _ in range(rounds):
        sums = vectors.select("embedding").mapInArrow(lambda batches, books=books: _sums(batches, books, scale), "part int, entry int, place int, total decimal(38,0), n long")
        books = [b.astype(object) for b in books]
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            books[r.part][r.entry, r.place] = int(r.total) // r.n
        books = [narrowed(b) for b in books]
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """Rows with their codes: adds code (binary, one byte for each part) and error (squared distances of all parts)."""
    if any(len(b) > 256 for b in books):
        raise ValueError("a code's byte holds 256 entries at most")
    schema = vectors.schema
    rest = [c for c in vectors.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [s.nearest(x) for s, x in zip(slices, _parts(integers(batch.column(len(rest)), scale), len(books)), strict=True)]
            codes = np.stack([own for own, _ in found], 1).astype(np.uint8)
            error = int64(sum(d for _, d in found))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=[*rest, "code", "error"])

    out = "".join(f"`{c}` {schema[c].dataType.simpleString()}, " for c in rest) + "code binary, error long"
    return vectors.select(*rest, "embedding").mapInArrow(run, out)


def decode(codes: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """Codes as vectors again: adds approx (array of double): the entries' components over ``scale``."""
    tables = F.array(*(F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry.tolist())) for entry in book)) for book in books))
    places = F.sequence(F.lit(1), F.lit(len(books)))
    at = lambda p: F.conv(F.hex(F.substring("code", p, F.lit(1))), 16, 10).cast("int")
    return codes.withColumn("approx", F.flatten(F.transform(places, lambda p: F.element_at(F.element_at(tables, p), at(p) + 1))))


def digest(books: list[np.ndarray]) -> str:
    """Hexadecimal sha256 of all components by part, entry and place, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Query: codes of all ``embeddings``, their errors, and the errors of all rows of a label."""
    rows = kept_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label", "embedding")
    books = train(rows)
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0)).alias("label"))
    codes = written(encode(rows, books).withColumn("key", key).drop("label"), "codes")
    labels = written(codes.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    return joined_by_weight(codes, labels, "key", "n").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    nearest = "SELECT * EXCLUDE (nth) FROM (SELECT p.vec_id, p.label, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d, row_number() OVER (PARTITION BY p.vec_id, p.part ORDER BY list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry) AS nth FROM p JOIN {0} c USING (part)) WHERE nth = 1"
    steps = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] AS x FROM k, range({PARTS}) AS r(part))",
        f"c0 AS MATERIALIZED (SELECT part, nth - 1 AS entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) AS nth FROM p) WHERE nth <= {ENTRIES})",
    ]
    for r in range(ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest.format(f'c{r}')})",
            f"m{r} AS (SELECT part, entry, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY place) AS x FROM (SELECT part, entry, place, CAST(sum(v) AS HUGEINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS place FROM a{r}) GROUP BY ALL) GROUP BY ALL)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m USING (part, entry))",
        ]
    steps += [
        f"a{ROUNDS} AS MATERIALIZED ({nearest.format(f'c{ROUNDS}')})",
        f"o AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(format('{{:x}}', entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)",
        f"h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"


SQL = _sql()
