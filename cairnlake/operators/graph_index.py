"""VX2: a navigable small-world graph over vectors, and filtered search in it.

The index is a table of shards, each of about ``SHARD_ROWS`` vectors by hash of their ids and packed into one row, so a search
reads it without a shuffle. In a shard equal vectors are one node. A node's links are its nearest nodes but for those that a
nearer link is closer to, filled up by the nearest of the rest, all of them in both directions, and a few far ones.

A search walks the graph best first, for a block of queries at once, within a window of the ``width`` best nodes seen. Each
node has a sketch, the signs of ``BITS`` random projections; a node met is compared by its sketch first, and only if that is
not farther than the window's last node by its full vector. A filter does not stop the walk: nodes that a query may not read
lead on, but are no result. The window begins so wide that it should hold enough readable nodes, and doubles as long as it
does not, up to ``MOST_SCANNED`` nodes; where few nodes are readable at all they are compared one by one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.operators.vector import QUERY_BLOCK, _rounded, _unit, is_finite

#: Vectors of a shard, in the mean; nearest nodes among which links are chosen, links chosen, far links, links kept in both directions.
SHARD_ROWS, NEAREST, CHOSEN, FAR, LINKS = 16_384, 96, 32, 4, 64
#: Bits of a sketch; nodes where every walk begins; the window; nodes opened at once; queries walked together.
BITS, ENTRIES, WIDTH, OPENED, TOGETHER = 256, 64, 160, 4, 128
#: Nodes that a widening window may hold (the fixed value of the settings); share of readable nodes up to which all are compared; readable nodes asked for, as a multiple of k.
MOST_SCANNED, FLAT, SPARE = 20_000, 0.1, 2.0
SEED = 11

INDEX = "shard int, dim int, vectors binary, links binary, starts binary, ids binary, scopes array<string>"
FOUND = "query_id long, vec_id long, score double, distances long, sketches long"


def _sketches(unit: np.ndarray) -> np.ndarray:
    planes = np.random.default_rng(SEED).normal(size=(unit.shape[1], BITS)).astype(np.float32)
    return np.packbits(unit @ planes > 0, axis=1).view(np.uint64)


def _nearest(unit: np.ndarray, most: int) -> np.ndarray:
    """Each node's ``most`` nearest others, nearest first."""
    out = np.empty((len(unit), most), np.int32)
    for lo in range(0, len(unit), 1024):
        s = unit[lo : lo + 1024] @ unit.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        part = np.argpartition(-s, most - 1, axis=1)[:, :most]
        out[lo : lo + 1024] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
    return out


def _chosen(unit: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each node's nearest ``most``: first those to which no chosen one is as near as the node, then the nearest of the rest."""
    out = []
    for lo in range(0, len(near), 256):
        own = near[lo : lo + 256]
        v = unit[own]
        to_node, among = np.einsum("bcd,bd->bc", v, unit[lo : lo + 256]), v @ v.transpose(0, 2, 1)
        kept = np.zeros(own.shape, bool)
        for j in range(own.shape[1]):
            kept[:, j] = ~((among[:, j] >= to_node[:, j, None]) & kept).any(1) & (kept.sum(1) < most)
        spare = most - kept.sum(1, keepdims=True)
        kept |= ~kept & (np.cumsum(~kept, axis=1) <= spare)
        out.append(np.take_along_axis(own, np.argsort(~kept, axis=1, kind="stable")[:, :most], 1))
    return np.concatenate(out)


def _links(unit: np.ndarray) -> np.ndarray:
    """A row of ``LINKS`` nodes for each node; the number of nodes stands where there are fewer."""
    n = len(unit)
    out = np.full((n, LINKS), n, np.int32)
    if n < 2:
        return out
    near = _nearest(unit, min(NEAREST, n - 1))
    chosen = _chosen(unit, near, min(CHOSEN, near.shape[1]))
    a, b = np.repeat(np.arange(n), chosen.shape[1]), chosen.ravel().astype(np.int64)
    pairs = np.unique(np.concatenate((a * n + b, b * n + a)))
    a, b = pairs // n, pairs % n
    close = np.concatenate([np.einsum("ij,ij->i", unit[a[i : i + 65536]], unit[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
    order = np.lexsort((-close, a))
    a, b = a[order], b[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    keep = nth < LINKS - FAR
    out[a[keep], nth[keep]] = b[keep]
    out[:, LINKS - FAR :] = np.random.default_rng(SEED).integers(0, n, (n, FAR))
    return out


def build(vectors: DataFrame, scope: str | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of vectors (vec_id, embedding and ``scope``, which filters may name): a row for each shard. Rows without a finite vector
    or with a zero one are left out. To be written: searches read it."""
    rows = vectors.select("vec_id", "embedding", (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope")).where(is_finite("embedding") & F.exists("embedding", lambda x: x != 0))
    shards = max(1, -(-rows.count() // shard_rows))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        column = table.column("embedding").combine_chunks()
        raw = column.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        nodes, own = np.unique(raw, axis=0, return_inverse=True)
        own = own.ravel()
        order = np.argsort(own, kind="stable")  # members of a node stay in order of their ids
        starts = np.searchsorted(own[order], np.arange(len(nodes) + 1)).astype(np.int32)
        links = _links(_unit(nodes.astype(np.float64)).astype(np.float32))
        ids = table.column("vec_id").to_numpy()[order]
        scopes = table.column("scope").combine_chunks().take(pa.array(order))
        data = [[int(table.column("shard")[0].as_py())], [raw.shape[1]], [nodes.astype(np.float64).tobytes()], [links.tobytes()], [starts.tobytes()], [ids.tobytes()]]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        return pa.table([*(pa.array(x, k) for x, k in zip(data, kinds, strict=True)), pa.ListArray.from_arrays([0, len(scopes)], scopes)], names=["shard", "dim", "vectors", "links", "starts", "ids", "scopes"])

    # The length of the vectors is a key too, as a graph holds vectors of one length.
    keyed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("dim", F.size("embedding"))
    return keyed.groupBy("shard", "dim").applyInArrow(one, INDEX)


class Shard:
    def __init__(self, row: dict) -> None:
        self.raw = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.n = len(self.raw)
        self.unit = _unit(self.raw)
        self.flat = self.unit.astype(np.float32)
        self.links = np.frombuffer(row["links"], np.int32).reshape(self.n, -1)
        self.starts = np.frombuffer(row["starts"], np.int32)
        self.ids = np.frombuffer(row["ids"], np.int64)
        names, self.scope = np.unique(np.array(["" if s is None else "s" + s for s in row["scopes"]]), return_inverse=True)
        self.scopes = {s[1:]: i for i, s in enumerate(names.tolist()) if s}
        self.sketches = _sketches(self.flat)
        self.entries = np.linspace(0, self.n - 1, min(ENTRIES, self.n)).astype(np.int64)

    def members(self, allowed: list[list[str] | None]) -> np.ndarray:
        """For each query, whether it may read each member; without a filter all."""
        if all(a is None for a in allowed):
            return np.ones((len(allowed), len(self.ids)), bool)
        table = np.zeros((len(allowed), int(self.scope.max()) + 1), bool)
        for i, a in enumerate(allowed):
            table[i, slice(None) if a is None else [self.scopes[s] for s in a if s in self.scopes]] = True
        return table[:, self.scope]


class Walk:
    """A block of queries on their way through a shard."""

    def __init__(self, shard: Shard, q: np.ndarray, readable: np.ndarray, k: int, width: int) -> None:
        self.shard, self.q, self.readable = shard, q.astype(np.float32), readable
        self.sketch = _sketches(self.q)
        n, m = shard.n, len(q)
        self.met = np.zeros((m, n + 1), bool)
        self.met[:, n] = True  # the place of missing links
        self.seen = self.met.copy()  # of the nodes met, those compared by their vectors
        self.need = np.minimum(readable.sum(1), int(np.ceil(SPARE * k)))
        share = readable.mean(1)
        self.width = np.minimum(np.maximum(width, np.ceil(self.need / np.maximum(share, 1e-9))), MOST_SCANNED).astype(np.int64)
        self.scores, self.nodes, self.open = np.full((m, 1), -np.inf, np.float32), np.full((m, 1), n, np.int64), np.zeros((m, 1), bool)
        self.distances, self.sketched = np.zeros(m, np.int64), np.zeros(m, np.int64)

    def enter(self, rows: np.ndarray, nodes: np.ndarray) -> None:
        """Compares nodes by their vectors; they join the queries' lists. ``rows`` ascend."""
        s = np.einsum("ij,ij->i", self.q[rows], self.shard.flat[nodes])
        count = np.bincount(rows, minlength=len(self.q))
        self.distances += count
        self.seen[rows, nodes] = self.met[rows, nodes] = True
        own = np.flatnonzero(count)
        place = np.cumsum(count > 0)[rows] - 1
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        scores = np.full((len(own), int(count.max())), -np.inf, np.float32)
        fresh = np.full(scores.shape, self.shard.n, np.int64)
        scores[place, at], fresh[place, at] = s, nodes
        joint = [np.concatenate(x, 1) for x in ((self.scores[own], scores), (self.nodes[own], fresh), (self.open[own], fresh < self.shard.n))]
        order = np.argsort(-joint[0], axis=1, kind="stable")[:, : MOST_SCANNED]
        used = int((joint[0] > -np.inf).sum(1).max())
        wide = max(self.scores.shape[1], min(used, MOST_SCANNED))
        for name, x, empty in (("scores", joint[0], -np.inf), ("nodes", joint[1], self.shard.n), ("open", joint[2], False)):
            old = getattr(self, name)
            new = np.full((len(old), wide), empty, old.dtype)
            new[:, : old.shape[1]] = old
            x = np.take_along_axis(x, order, 1)[:, :wide]
            new[own, : x.shape[1]] = x
            setattr(self, name, new)

    def inside(self) -> np.ndarray:
        return np.arange(self.scores.shape[1]) < self.width[:, None]

    def run(self) -> None:
        n, links = self.shard.n, self.shard.links
        few = self.readable.sum(1) <= max(1, FLAT * n)
        rows, nodes = np.nonzero(self.readable & few[:, None])
        if len(rows):
            self.enter(rows, nodes)
            self.open[few] = False
        rows = np.repeat(np.flatnonzero(~few), len(self.shard.entries))
        if not len(rows):
            return
        nodes = np.tile(self.shard.entries, int((~few).sum()))
        self.enter(rows, nodes)
        while True:
            open_ = self.open & self.inside()
            rows, cols = np.nonzero(open_ & (np.cumsum(open_, axis=1) <= OPENED))
            if not len(rows):
                if not self.widen(few):
                    return
                continue
            self.open[rows, cols] = False
            met = links[self.nodes[rows, cols]]
            pairs = np.unique(np.repeat(rows, met.shape[1]) * (n + 1) + met.ravel())
            rows, nodes = pairs // (n + 1), pairs % (n + 1)
            new = ~self.met[rows, nodes]
            rows, nodes = rows[new], nodes[new]
            self.met[rows, nodes] = True
            np.add.at(self.sketched, rows, 1)
            last = np.minimum(self.width - 1, self.scores.shape[1] - 1)
            worst = np.where(self.width <= self.scores.shape[1], self.scores[np.arange(len(last)), last], -1)
            farthest = BITS / np.pi * np.arccos(np.clip(np.where(np.isfinite(worst), worst, -1), -1, 1))
            near = np.bitwise_count(self.sketch[rows] ^ self.shard.sketches[nodes]).sum(1) <= farthest[rows]
            if near.any():
                self.enter(rows[near], nodes[near])

    def widen(self, few: np.ndarray) -> bool:
        """Doubles the windows that hold too few readable nodes, if anything is left to open; false if none is. What a narrower
        window's sketches held back may be met again."""
        own = np.take_along_axis(np.concatenate((self.readable, np.zeros((len(self.q), 1), bool)), 1), self.nodes, 1) & self.inside()
        short = ~few & (own.sum(1) < self.need) & (self.width < MOST_SCANNED) & self.open.any(1)
        self.width[short] = np.minimum(self.width[short] * 2, MOST_SCANNED)
        self.met[short] = self.seen[short]
        return bool(short.any())


def _walked(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int, width: int, exclude_self: bool) -> Iterator[pa.RecordBatch]:
    all_ids = queries.column("query_id").to_numpy()
    vectors, allowed = queries.column("embedding").to_pylist(), queries.column("scopes").to_pylist()
    for batch in batches:
        for nth in range(batch.num_rows):
            row = batch.slice(nth, 1).to_pylist()[0]
            shard = Shard(row)
            fit = [i for i, v in enumerate(vectors) if v is not None and len(v) == row["dim"]]
            for lo in range(0, len(fit), TOGETHER):
                at = fit[lo : lo + TOGETHER]
                ids, q = all_ids[at], _unit(np.array([vectors[i] for i in at], np.float64))
                member = shard.members([allowed[i] for i in at])
                if exclude_self:
                    member = member & (shard.ids[None, :] != ids[:, None])
                walk = Walk(shard, q, np.logical_or.reduceat(member, shard.starts[:-1], axis=1), k, width)
                walk.run()
                out: list[tuple] = []
                for i in range(len(at)):
                    nodes = walk.nodes[i][walk.scores[i] > -np.inf]
                    nodes = nodes[walk.readable[i][nodes]][: k + 8]
                    exact = _rounded(shard.unit[nodes] @ q[i])
                    hits = []
                    for s, node in zip(exact.tolist(), nodes.tolist(), strict=True):
                        a, b = shard.starts[node], shard.starts[node + 1]
                        hits += [(-s, v) for v in shard.ids[a:b][member[i, a:b]][:k].tolist()]
                    out += [(int(ids[i]), v, -s, 0, 0) for s, v in sorted(hits)[:k]]
                    out.append((int(ids[i]), None, None, int(walk.distances[i]), int(walk.sketched[i])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["query_id", "vec_id", "score", "distances", "sketches"])


def walked(index: DataFrame, queries: DataFrame, k: int, width: int = WIDTH, exclude_self: bool = True, block: int = QUERY_BLOCK) -> DataFrame:
    """What each shard gives each query (query_id, embedding, scopes: array of string, null without a filter): its k best
    (vec_id, score), and a row without them that counts the vectors and the sketches compared. Queries go to the tasks in blocks."""
    spark = index.sparkSession
    own = queries.where(is_finite("embedding"))
    blocks = max(1, -(-own.count() // block))
    parts = None
    for b in range(blocks):
        table = own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", "embedding", F.col("scopes").cast("array<string>").alias("scopes")).toArrow()
        handle = spark.sparkContext.broadcast(table)
        part = index.mapInArrow(lambda batches, handle=handle: _walked(batches, handle.value, k, width, exclude_self), FOUND)
        parts = part if parts is None else parts.unionByName(part)
    return parts


def hits(found: DataFrame, k: int) -> DataFrame:
    """The k best of all shards: query_id, vec_id, score, rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.where("vec_id IS NOT NULL").select("query_id", "vec_id", "score", F.row_number().over(best).alias("rank")).where(F.col("rank") <= k)


def effort(found: DataFrame, index: DataFrame) -> DataFrame:
    """Vectors and sketches that each query was compared with, as shares of all indexed vectors."""
    n = index.agg(F.sum(F.length("ids") / 8).alias("n"))
    spent = found.where("vec_id IS NULL").groupBy("query_id").agg(F.sum("distances").alias("d"), F.sum("sketches").alias("s"))
    return spent.crossJoin(F.broadcast(n)).select("query_id", (F.col("d") / F.col("n")).alias("distance_share"), (F.col("s") / F.col("n")).alias("sketch_share"))
