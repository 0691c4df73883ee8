"""Knowledge graph (GR1-GR17): vertices and edges as rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlake.session import forget, written

MAX_WEIGHT = 10.0
#: GR1: fixed values: how a relation is written, its kind and weight.
MENTION = r"\b(?:\p{Lu}[\p{L}\p{N}&-]*\s+){1,4}(?:Inc|Ltd|Corp|GmbH|Company|Ministry|System|Platform)\b|[\p{L}\p{N}]{2,32}(?:公司|部门|委员会|系统|平台|数据库)"
PATTERNS = {"heading": (r"(?m)^#{1,6}\s+(.{2,80})$", "contains", 1.5), "reference": (r"《([^》]{2,60})》", "references", 2.0), "wiki": (r"\[\[([^\]|]{2,60})(?:\|[^\]]*)?\]\]", "links", 1.8), "supersedes": (r"(?i)supersedes\s+\"([^\"]{2,60})\"", "supersedes", 3.0), "amends": (r"(?i)amends\s+\"([^\"]{2,60})\"", "amends", 2.5), "mention": (f"({MENTION})", "mentions", 1.0)}
#: GR2: endings that tell an entity's type.
TYPES = {"regulation": r"(?i)(act|law|regulation|rules?|条例|办法|规定)$", "organisation": r"(?i)(inc|ltd|gmbh|corp|company|ministry|部|局|公司)\.?$", "system": r"(?i)(system|platform|系统|平台)$"}


def extract_relations(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """GR1: (id, kind, target, weight, place) for every written relation of a document, each target and kind once."""
    t = F.coalesce(F.col(text), F.lit(""))

    def of(pattern: str, kind: str, weight: float) -> Column:
        return F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), lambda m: F.struct(F.lit(kind).alias("kind"), F.trim(m).alias("target"), F.lit(weight).alias("weight")))

    found = F.flatten(F.array(*(of(*p) for p in PATTERNS.values())))
    return docs.select(id_col, F.explode(F.array_distinct(found)).alias("r")).select(id_col, "r.*")


def entity_type(name: Column | str) -> Column:
    """GR2."""
    n = F.col(name) if isinstance(name, str) else name
    out = F.when(F.lit(False), "")
    for kind, ending in TYPES.items():
        out = out.when(n.rlike(ending), kind)
    return out.otherwise("concept")


def entity_key(name: Column | str, kind: Column | str) -> Column:
    """GR3: lower case, trimmed, single spaces, and the type."""
    return F.concat_ws("|", F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), kind)


def merge_relations(edges: DataFrame) -> DataFrame:
    """GR4: one edge for (src, dst, kind): greatest weight, at most 10, the documents it comes from; self-edges go."""
    return edges.where("src <> dst").groupBy("src", "dst", "kind").agg(F.least(F.max("weight"), F.lit(MAX_WEIGHT)).alias("weight"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def remove_document(edges: DataFrame, vertices: DataFrame, doc_id: Column) -> tuple[DataFrame, DataFrame]:
    """GR6: edges without a document's evidence, and vertices that still have an edge."""
    left = edges.withColumn("doc_ids", F.filter("doc_ids", lambda d: d != doc_id)).where(F.size("doc_ids") > 0)
    used = left.select(F.col("src").alias("id")).union(left.select(F.col("dst").alias("id"))).distinct()
    return left, vertices.join(used, "id", "left_semi")


def _pieces(name: Column | str) -> Column:
    """Runs of three characters of a name in lower case."""
    n = F.lower(name)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(n) - 2, F.lit(1))), lambda i: F.substring(n, i, F.lit(3)))


def resolve_aliases(names: DataFrame, known: DataFrame, ledger: DataFrame, at_least: float = 0.86) -> DataFrame:
    """GR5: entity for each (id, name, type): by the ledger of aliases, else the most similar name of its type, by trigrams of at
    least ``at_least``, else a name of four and more characters that holds it or that it holds to at least 60 %."""
    from cairnlake.functions.text import jaccard
    from cairnlake.operators.lexical import trigram_prefix, trigrams

    # Copies of a name and type resolve alike, so each is compared once, and of equal known names the first one stands. Names that the
    # ledger resolves go by an anti-join, before the ledger's own copies multiply them.
    settled = ledger.groupBy(F.lower("alias").alias("_k")).agg(F.bool_and(F.col("entity_id").isNotNull()).alias("_all")).where("_all").select("_k")
    a = names.select("name", "type").distinct().join(settled, F.lower("name") == F.col("_k"), "left_anti")
    b = known.groupBy(F.col("name").alias("other"), "type").agg(F.min("entity_id").alias("entity_id"))
    # Names at this similarity share one of the first trigrams of both, in any one order: here by hash.
    first = lambda name: trigram_prefix(trigrams(name), at_least)
    near = a.withColumn("t", F.explode(first("name"))).join(b.withColumn("t", F.explode(first("other"))), ["type", "t"])
    # A name that holds another holds each of its pieces, so also the one that the fewest names hold.
    own, others = (x.withColumn("p", F.explode(F.array_distinct(_pieces(n)))) for x, n in ((a, "name"), (b, "other")))
    counts = own.select("type", "p").unionByName(others.select("type", "p")).groupBy("type", "p").count()
    rare = lambda x, keys: x.join(counts, ["type", "p"]).groupBy(*keys).agg(F.min(F.struct("count", "p"))["p"].alias("p"))
    holds = own.join(rare(others, b.columns), ["type", "p"])
    held = rare(own, a.columns).join(others, ["type", "p"])
    columns = ["name", "type", "entity_id", "other"]
    pairs = near.select(columns).unionByName(holds.select(columns)).unionByName(held.select(columns)).distinct()
    low, high = F.lower("name"), F.lower("other")
    inside = (F.least(F.length("name"), F.length("other")) >= 4) & (F.contains(low, high) | F.contains(high, low)) & (F.least(F.length("name"), F.length("other")) >= 0.6 * F.greatest(F.length("name"), F.length("other")))
    pairs = pairs.withColumn("similarity", jaccard(trigrams("name"), trigrams("other"))).where((F.col("similarity") >= at_least) | inside)
    best = pairs.groupBy("name", "type").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "entity_id"))["entity_id"].alias("similar_id"))
    # The ledger comes last: where it names an alias several times, each name has as many rows, which nothing shuffles any more.
    entries = ledger.select(F.lower("alias").alias("_k"), F.col("entity_id").alias("ledger_id"))
    found = names.join(best, ["name", "type"], "left").join(entries, F.lower("name") == F.col("_k"), "left")
    return found.select("id", "name", "type", F.coalesce("ledger_id", "similar_id").alias("entity_id"), F.when(F.col("ledger_id").isNotNull(), "ledger").when(F.col("similar_id").isNotNull(), "similar").otherwise("new").alias("how"))


def connected_components(edges: DataFrame) -> DataFrame:
    """GR8: (node, component): the least node of each node's component.

    Large and small stars in turn: every node's greater neighbours, then all its neighbours, are joined to its least
    one. Edges between nodes that already share their least neighbour vanish, so tables shrink; a node's neighbours
    are only ever folded to their least, never gathered."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = written(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not mark.n or mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        following = written(small.distinct(), "edges")
        forget(now)
        now = following
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """GR7: modularity of a labelling (node, component) of weighted edges; a self-loop counts twice in degrees and not inside."""
    total = edges.agg((2 * F.sum("weight")).alias("m2"))
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    degrees = ends.join(labels, "node").groupBy("component").agg(F.sum("weight").alias("degree"))
    a, b = labels.select(F.col("node").alias("src"), F.col("component").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    inside = edges.where("src <> dst").join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("component")).agg((2 * F.sum("weight")).alias("inside"))
    parts = degrees.join(inside, "component", "left").crossJoin(total)
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m2") - resolution * F.pow(F.col("degree") / F.col("m2"), 2)).alias("modularity"))


#: Gains of modularity below this, times the weight of all edges, count as none.
LEAST_GAIN = 1e-9


def _moves(both: DataFrame, labels: DataFrame, m2: float, resolution: float) -> DataFrame:
    """(node, degree, own, to, gain): every move of a node to a neighbour's community that raises modularity."""
    totals = labels.groupBy("component").agg(F.round(F.sum("degree"), 9).alias("total"))
    pull = both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("pull"))
    mine = labels.join(totals, "component").withColumnsRenamed({"component": "own", "total": "own_total"})
    options = pull.join(mine, "node")
    inner = options.where("to = own").select("node", F.col("pull").alias("inner"))
    others = options.where("to <> own").join(inner, "node", "left").join(totals.withColumnRenamed("component", "to"), "to")
    price = F.lit(resolution / m2) * F.col("degree") * (F.col("total") - F.col("own_total") + F.col("degree"))
    gain = F.round(F.col("pull") - F.coalesce("inner", F.lit(0.0)) - price, 9)
    return others.select("node", "degree", "own", "to", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN)


#: A round ranks moves by their gains less a share of up to this, by hash, so that moves of like gains spread.
SPREAD = 0.7
#: Moves of a community are admitted by cells: slots, by hash, of classes of the mass that their gains can bear, so many a doubling.
SLOTS, CLASSES = 64, 4


def _together(moves: DataFrame, m2: float, resolution: float) -> DataFrame:
    """Moves that raise modularity also if all of them are made: a community only sends or only takes nodes, as the best move
    from or to it says, a node makes its best move among these, and a move's gain must outweigh what moves of its own and of
    earlier cells from and to its communities can cost it. Then each of them still raises modularity, made in that order."""
    lot = lambda n, *of: F.pmod(F.xxhash64(*of, "gain"), F.lit(n))  # noqa: E731  # gains change from round to round
    worth = F.round(-F.col("gain") * (1 - SPREAD * lot(1 << 20, "node", "to") / (1 << 20)), 9)
    ranked = moves.withColumn("low", worth)
    ends = ranked.select("low", "node", "to", F.explode(F.array(F.struct(F.col("own").alias("c"), F.lit(True).alias("sends")), F.struct(F.col("to").alias("c"), F.lit(False).alias("sends")))).alias("e"))
    roles = ends.groupBy("e.c").agg(F.min(F.struct("low", "node", "to", "e.sends"))["sends"].alias("sends"))
    senders, takers = roles.where("sends").select(F.col("c").alias("own")), roles.where("not sends").select(F.col("c").alias("to"))
    some = ranked.join(senders, "own", "left_semi").join(takers, "to", "left_semi")
    picked = some.groupBy("node").agg(F.min(F.struct("low", "to", "own", "degree", "gain")).alias("m")).select("node", "m.to", "m.own", "m.degree", "m.gain")
    bears = F.floor(CLASSES * F.log2(F.col("gain") * F.lit(m2 / resolution) / F.col("degree")))
    picked = picked.withColumn("cell", (lot(SLOTS, "node") - bears * SLOTS).cast("long"))
    mass = picked.select(F.explode(F.array("own", "to")).alias("c"), "cell", "degree").groupBy("c", "cell").agg(F.sum("degree").alias("mass"))
    mass = mass.select("c", "cell", F.round(F.sum("mass").over(Window.partitionBy("c").orderBy("cell")), 9).alias("mass"))
    left, came = mass.select(F.col("c").alias("own"), "cell", F.col("mass").alias("left")), mass.select(F.col("c").alias("to"), "cell", F.col("mass").alias("came"))
    cost = F.lit(resolution / m2) * F.col("degree") * (F.col("left") + F.col("came") - 2 * F.col("degree"))
    return picked.join(left, ["own", "cell"]).join(came, ["to", "cell"]).where(F.col("gain") - cost > LEAST_GAIN).select("node", "to")


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two share a community: those that are the best of both of theirs."""
    rank = F.struct((-F.col("gain")).alias("low"), "node", "to")
    best = moves.select(F.explode(F.array("own", "to")).alias("c"), rank.alias("r")).groupBy("c").agg(F.min("r").alias("r"))
    return best.groupBy("r").count().where("count = 2").select("r.node", "r.to")


#: Edge ends that a block of nodes gathers, sweeps that go over it, as the reference's, and edges from which on a node is in no block.
BLOCK_ROWS, SWEEPS, HEAVY = 65_536, 50, 1_000_000


def _sweeps(rows: pd.DataFrame, price: float, blocks: int) -> pd.DataFrame:
    """Sequential local moving over the sorted nodes of a block: (node, to, n, open) of nodes that moved, or still would if they were alone.

    rows: (node, degree, own, own_total, dst, to, total, weight). Other blocks sweep at once and are taken to do alike: what moves
    change counts ``blocks`` times, so that not all of them go for the same gain."""
    rows = rows.sort_values(["node", "dst"], ignore_index=True)
    at = [*np.flatnonzero((rows["node"] != rows["node"].shift()).to_numpy()).tolist(), len(rows)]
    dst, to, weight = (rows[c].tolist() for c in ("dst", "to", "weight"))
    nodes, degrees, owns = (rows[c].iloc[at[:-1]].tolist() for c in ("node", "degree", "own"))
    total, label, change = dict(zip(to, rows["total"], strict=True)) | dict(zip(rows["own"], rows["own_total"], strict=True)), dict(zip(nodes, owns, strict=True)), {}

    def best(i: int, times: int) -> tuple[float, object]:
        own, degree, pull = label[nodes[i]], degrees[i], {}
        for j in range(at[i], at[i + 1]):
            c = label.get(dst[j], to[j])
            pull[c] = pull.get(c, 0.0) + weight[j]
        alike = (times - 1) * degree
        left = max(total[own] + times * change.get(own, 0.0) - alike, degree) - degree
        inner, most, found = pull.get(own, 0.0), LEAST_GAIN, own
        for c, w in pull.items():
            if c != own:
                gain = round(w - inner - price * degree * (total[c] + times * change.get(c, 0.0) + alike - left), 9)
                if gain > most or (gain == most and found != own and c < found):
                    most, found = gain, c
        return most, found

    for _ in range(SWEEPS):
        moved = False
        for i, node in enumerate(nodes):
            old, new = label[node], best(i, blocks)[1]
            if new != old:
                moved, label[node] = True, new
                change[old], change[new] = round(change.get(old, 0.0) - degrees[i], 9), round(change.get(new, 0.0) + degrees[i], 9)
        if not moved:
            break
    out = [(node, None if label[node] == owns[i] else label[node], at[i + 1] - at[i], best(i, 1)[1] != label[node]) for i, node in enumerate(nodes)]
    return pd.DataFrame([x for x in out if x[1] is not None or x[3]], columns=["node", "to", "n", "open"]).astype({"node": object, "to": object})


def _settled(both: DataFrame, labels: DataFrame, m2: float, resolution: float) -> DataFrame:
    """Labels (node, degree, n, component) after a level's local moving, which ends where no move raises modularity.

    All nodes move at once, in blocks by hash that are swept one by one each, as long as that raises modularity; where it does not,
    moves that surely raise it together. Where blocks leave only moves that they can't make at once, some of the nodes that
    would move are swept as one block. Nodes of more than ``HEAVY`` edges are in no block: they move by joins alone."""
    kinds = dict(labels.dtypes)
    blocks = 1 + both.count() // BLOCK_ROWS

    def swept(labels: DataFrame, block: Column, times: int, some: DataFrame | None = None) -> DataFrame:
        totals = labels.groupBy("component").agg(F.round(F.sum("degree"), 9).alias("total"))
        ends = labels.join(totals, "component")
        light = ends.where(F.col("n") <= HEAVY).select("node", "degree", F.col("component").alias("own"), F.col("total").alias("own_total"))
        others = ends.select(F.col("node").alias("dst"), F.col("component").alias("to"), "total")
        mine = light if some is None else light.join(some, "node", "left_semi")
        rows = both.withColumnRenamed("src", "node").join(mine, "node").join(others, "dst").withColumn("block", block)
        run = lambda x: _sweeps(x, resolution / m2, times)
        return written(rows.groupBy("block").applyInPandas(run, f"node {kinds['node']}, to {kinds['component']}, n long, open boolean"), "moves")

    def after(labels: DataFrame, made: DataFrame) -> DataFrame:
        return written(labels.join(made.where("to is not null").select("node", "to"), "node", "left").select("node", "degree", "n", F.coalesce("to", "component").alias("component")), "labels")

    def worth(labels: DataFrame) -> float:
        a, b = (labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in ("src", "dst"))
        inside = both.join(a, "src").join(b, "dst").where("csrc = cdst").agg(F.sum("weight").alias("w")).first().w or 0.0
        totals = labels.groupBy("component").agg(F.sum("degree").alias("total"))
        return round(inside - resolution / m2 * totals.agg(F.sum(F.col("total") * F.col("total")).alias("t")).first().t, 6)

    heavy = not labels.where(F.col("n") > HEAVY).isEmpty()
    now, turn = worth(labels) if blocks > 1 else 0.0, 0
    while True:
        turn += 1
        found = swept(labels, F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(blocks)), blocks)
        seen = found.agg(F.count("to").alias("moved"), F.count_if("open").alias("open"), F.sum(F.when(F.col("open"), F.col("n"))).alias("rows")).first()
        if seen.moved:
            following = after(labels, found)
            then = worth(following) if blocks > 1 else 0.0
            if blocks == 1 or then > now:
                forget(found, labels)
                labels, now = following, then
                continue
            forget(following)
        elif not seen.open and not heavy:
            forget(found)
            return labels
        if seen.open and not seen.moved:
            share = max(1, seen.open * BLOCK_ROWS // seen.rows)
            some = found.where("open").orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(share).select("node")
            made = swept(labels, F.lit(0), 1, some)
        else:
            moves = written(_moves(both, labels, m2, resolution), "moves")
            made = written(_together(moves, m2, resolution), "moves")
            if made.isEmpty():
                forget(made)
                made = written(_apart(moves), "moves")
            forget(moves)
            if made.isEmpty():
                forget(made, found)
                return labels
        following = after(labels, made)
        forget(found, made, labels)
        labels, now = following, worth(following) if blocks > 1 else 0.0


def louvain(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0, levels: int = 10) -> DataFrame:
    """GR7: communities by modularity, level on level: (node, level, component), a community named by its least node.

    edges: (src, dst, weight), undirected, repeated ones add up; nodes: (node), those without edges too. A level moves
    nodes to neighbours' communities as long as that raises modularity, then makes each community a node. Blocks of nodes are
    swept one by one, all at once; every round raises modularity and the last one finds no move. No more than a block's edges
    gather in one task. Order and partitioning of rows change nothing. An empty graph gives an empty result."""
    weight = F.col("weight").cast("double")  # one that is not finite or not above 0 counts as 1, as in the reference
    flat = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.when((weight > 0) & (weight < float("inf")), weight).otherwise(1.0).alias("weight"))
    graph = written(flat.groupBy("a", "b").agg(F.round(F.sum("weight"), 9).alias("weight")), "graph")
    every = graph.select(F.col("a").alias("node")).unionByName(graph.select(F.col("b").alias("node")))
    place = written((every.unionByName(nodes.select("node")) if nodes is not None else every).distinct().withColumn("component", F.col("node")), "places")
    m2 = round(2 * (graph.agg(F.sum("weight").alias("w")).first().w or 0.0), 6)
    found = []
    for level in range(levels if m2 else 0):
        both = written(graph.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(graph.where("a <> b").select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")), "both")
        loops = graph.where("a = b").select(F.col("a").alias("node"), (2 * F.col("weight")).alias("weight"), F.lit(0).alias("n"))
        degrees = both.select(F.col("src").alias("node"), "weight", F.lit(1).alias("n")).unionByName(loops).groupBy("node").agg(F.round(F.sum("weight"), 9).alias("degree"), F.sum("n").alias("n"))
        labels = _settled(both, written(degrees.withColumn("component", F.col("node")), "labels"), m2, resolution)
        least = labels.groupBy("component").agg(F.min("node").alias("least"))
        named = written(labels.join(least, "component").select("node", F.col("least").alias("component")), "named")
        step = named.select(F.col("node").alias("component"), F.col("component").alias("joined"))
        place = written(place.join(step, "component", "left").select("node", F.coalesce("joined", "component").alias("component")), "places")
        found.append(place.select("node", F.lit(level).alias("level"), "component"))
        a, b = (named.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
        joined = graph.join(a, "a").join(b, "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.round(F.sum("weight"), 9).alias("weight"))
        following = written(joined, "graph")
        moved = not named.where("node <> component").isEmpty()
        forget(graph, both, labels, named)
        graph = following
        if not moved:
            break
    if not found:
        return place.select("node", F.lit(0).alias("level"), "component")
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def communities(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0) -> DataFrame:
    """GR7: (node, component) of the last level of ``louvain``."""
    every = louvain(edges, nodes, resolution)
    top = every.agg(F.max("level").alias("level"))
    return every.join(F.broadcast(top), "level").select("node", "component")


def community_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """GR9: weights between communities, each pair once."""
    a, b = labels.select(F.col("node").alias("src"), F.col("component").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    found = edges.join(a, "src").join(b, "dst").where("ca <> cb")
    return found.groupBy(F.least("ca", "cb").alias("src"), F.greatest("ca", "cb").alias("dst")).agg(F.sum("weight").alias("weight"))


def hierarchy(edges: DataFrame, nodes: DataFrame | None = None, resolution: float = 1.0) -> DataFrame:
    """GR9: (node, level, component, parent): GR7's communities at level 0, and at level 1 those that Louvain finds again on the graph
    of the weights between them, where what lies inside one counts no more. Two and more of level 0 make one of level 1, their parent;
    one that stays alone has none. A community is named by its least node."""
    edges = written(edges.select("src", "dst", "weight"), "edges")
    low = written(communities(edges, nodes, resolution), "communities")
    up = communities(community_edges(edges, low), low.select(F.col("component").alias("node")).distinct(), resolution)
    joined = up.join(up.groupBy("component").count().where("count > 1"), "component", "left_semi").select(F.col("node").alias("component"), F.col("component").alias("parent"))
    first = low.join(joined, "component", "left").select("node", F.lit(0).alias("level"), "component", "parent")
    return first.unionByName(first.where("parent is not null").select("node", F.lit(1).alias("level"), F.col("parent").alias("component"), F.lit(None).cast(first.schema["parent"].dataType).alias("parent")))


def community_keys(labels: DataFrame) -> DataFrame:
    """GR10: a key of each community's members, so that an unchanged one is used again."""
    return labels.groupBy("component").agg(F.md5(F.concat_ws(",", F.array_sort(F.collect_set(F.col("node").cast("string")))).cast("binary")).alias("member_key"), F.count(F.lit(1)).alias("size"))


def local_search(seeds: DataFrame, edges: DataFrame, per_node: int = 5, hops: int = 2) -> DataFrame:
    """GR12: (query_id, node, hop, score) of what seeds (query_id, node) reach over their ``per_node`` heaviest edges either way;
    edges of kind supersedes count 0.3 of their weight."""
    w = F.when(F.col("kind") == "supersedes", F.col("weight") * 0.3).otherwise(F.col("weight"))
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), w.alias("w")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("next"), w.alias("w")))
    heaviest = Window.partitionBy("node").orderBy(F.desc("w"), "next")
    both = both.groupBy("node", "next").agg(F.max("w").alias("w")).withColumn("_n", F.row_number().over(heaviest)).where(F.col("_n") <= per_node).drop("_n")
    front = seeds.select("query_id", "node", F.lit(1.0).alias("score")).withColumn("hop", F.lit(0))
    reached = front
    for h in range(1, hops + 1):
        front = front.join(both, "node").groupBy("query_id", F.col("next").alias("node")).agg(F.max(F.col("score") * F.col("w") / MAX_WEIGHT).alias("score")).withColumn("hop", F.lit(h))
        reached = reached.unionByName(front)
    best = F.min(F.struct("hop", (-F.col("score")).alias("s")))
    return reached.groupBy("query_id", "node").agg(best.alias("b")).select("query_id", "node", F.col("b.hop").alias("hop"), (-F.col("b.s")).alias("score"))


def chunk_arm(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """GR13: chunks that prove the edges around seeds: sum of distinct edges' weights, least hop, by score, hop, id."""
    touched = edges.join(seeds, F.col("src") == F.col("node")).unionByName(edges.join(seeds, F.col("dst") == F.col("node")))
    once = touched.groupBy("query_id", "src", "dst", "kind").agg(F.max("weight").alias("weight"), F.first("doc_ids").alias("doc_ids"), F.min("hop").alias("hop"))
    scored = once.select("query_id", F.explode("doc_ids").alias("chunk_id"), "weight", "hop").groupBy("query_id", "chunk_id").agg(F.sum("weight").alias("score"), F.min("hop").alias("hops"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "hops", "chunk_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k)


def project_shards(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """GR16: documents whose shard (key, fingerprint) is new, changed or gone; all others keep their projection."""
    both = old.select(key, F.col("fingerprint").alias("before")).join(new.select(key, F.col("fingerprint").alias("after")), key, "full_outer")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "gone").when(F.col("before") != F.col("after"), "changed")
    return both.withColumn("change", kind).where("change is not null").select(key, "change")


#: Rows that a task of ``co_mentions`` gets.
TASK_ROWS = 250_000


def co_mentions(mentions: DataFrame, doc: str, term: str, most_docs: int = 20, at_least: int = 2) -> DataFrame:
    """GR17, JN11: pairs of documents that share ``at_least`` terms; a term of more than ``most_docs`` documents links none, which
    also bounds the pairs of a term."""
    tasks = lambda n: 1 + int(n or 0) // TASK_ROWS
    rows = mentions.select(doc, term).repartition(tasks(mentions.count()), doc, term).distinct()
    rare = rows.groupBy(term).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most_docs))
    # Few bytes of terms give many pairs: tasks are as many as pairs need, before and after pairs are made.
    n = tasks(rare.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first().pairs)
    kept = rows.join(rare.select(term), term).repartition(n, term)
    pairs = kept.join(kept.select(term, F.col(doc).alias("other")), term).where(F.col(doc) < F.col("other")).select(F.col(doc).alias("doc_a"), F.col("other").alias("doc_b"))
    return pairs.repartition(n, "doc_a", "doc_b").groupBy("doc_a", "doc_b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= at_least)
