"""Near-duplicate vectors by NN-descent.

Vectors are compared inside one label and one length only. Equal vectors are one
vertex with a count. The neighbour graph starts from random-projection leaves
(a leaf with too many vectors is cut by hash; labels with more vectors have more
trees) and is refined, until lists and links hardly change, by rounds of
neighbours-of-neighbours joins: every vertex compares the members of its list and
of the lists it is in with each other, a member takes what is nearer than its
farthest neighbour, and only pairs with a new member are compared again. A list
whose entries all reach the threshold is saturated and is enlarged.

Links are the pairs at or above the threshold. Every compared pair that is one
counts, whether a list keeps it or not: each comparison hangs its members on the
least vertex their links lead to. Vertices with saturated lists are then searched
again, with a list of the nearest outside their component, until no more components
are joined. Inside each component all pairs are counted in blocks, so the number of
links does not depend on how long lists have grown. An audit compares a sample of
about AUDIT query vectors with all vectors of their label, in blocks, and takes more
until it holds AUDIT_LINKS true links or all vectors; while its recall is below
`least_recall`, or a true link has its ends in two components, the search is repeated
with longer lists and more leaves. If that does not help, all pairs are compared.

A vertex with a list of very many others is cut by hash as well, so no task gets
an unbounded group. Nothing is dropped: what a list cannot hold is counted inside
its component.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite
component, and vectors without a label, link with nothing; a repeated row is a row
of its own, linked with its copies; a null identifier counts as a link of others,
and a component's identifier is its smallest non-null one; columns other than
identifier, vector and label are neither read nor returned.
"""

from __future__ import annotations

import logging
import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstat.llm.common import written
from fleetstat.llm.components import components

THRESHOLD = 0.93
LIST, LEAVES, LEAF_ROWS, LEAF_MOST = 10, 4, 128, 1024
#: Refining ends when at most this share of all list entries, and of all links in lists, is new.
CHANGED, NEW_LINKS = 0.01, 0.001
#: A pair at the threshold is apart in all start trees of its label with at most this probability.
MISS = 0.01
#: Searches with doubled effort before all pairs of a label are compared.
TRIES = 4
#: Saturated lists grow up to so many times LIST; beyond that, the search outside the component and counting inside it take over.
GROWTH = 4
BLOCK = 1024
#: Query vectors of the audit, and true links its sample must hold, or else it is enlarged up to all vectors.
AUDIT, AUDIT_LINKS = 1000, 500
LEAST_RECALL = 0.95
_LOG = logging.getLogger(__name__)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    array = column.combine_chunks()
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(array), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def vertices(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and the distinct comparable vectors: v, space (label and length), vec, count."""
    vec, label = F.col("vec"), F.col("label")
    good = label.isNotNull() & vec.isNotNull() & (F.size("vec") > 0) & F.forall(
        "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = written(df.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label")
    ).withColumn("good", F.coalesce(good, F.lit(False))), "vectors")
    space = F.xxhash64("label", F.size("vec"))
    distinct = rows.where("good").groupBy("label", "vec").agg(F.min("row").alias("v"), F.count("*").alias("count"))
    return rows, written(distinct.select("v", space.alias("space"), "vec", "count", "label"), "vertices")


def _trees(leaves: int, bits, threshold: float):
    """Start trees of a label: `leaves`, or as many more as bound the probability that a pair at the threshold shares no leaf."""
    together = F.pow(F.lit(1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi), bits)
    needed = F.when((together < 1) & (together > 0), F.ceil(F.lit(leaves / LEAVES * math.log(MISS)) / F.log1p(-together)))
    return F.greatest(F.lit(leaves), needed).cast("int")


def _leaves(points: DataFrame, leaves: int, seed: int, threshold: float) -> DataFrame:
    """(tree, leaf, v, vec, own): every vector in one leaf of each tree, leaves of bounded size."""
    sizes = points.groupBy("space").agg(F.count("*").alias("n"))
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LEAF_ROWS))).cast("int")
    sized = points.join(sizes.select("space", bits.alias("bits"), _trees(leaves, bits, threshold).alias("trees")), "space").select("v", "space", "vec", "bits", "own", "trees")
    kind = sized.schema["vec"].dataType.simpleString()

    def run(batches):
        planes: dict = {}
        for batch in batches:
            lengths = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                unit = _matrix(pa.chunked_array([part.column(2)]))
                trees = part.column(5).to_numpy()
                for tree in range(int(trees.max())):
                    if (dim, tree) not in planes:
                        planes[dim, tree] = np.random.default_rng([seed, tree, int(dim)]).standard_normal((int(dim), 40))
                    has = trees > tree
                    dealt, bits = part.filter(pa.array(has)), part.column(3).to_numpy()[has]
                    signs = (unit[has] @ planes[dim, tree] > 0).astype(np.int64)
                    code = (signs << np.arange(40)).sum(axis=1) & ((np.int64(1) << np.minimum(bits, 40)) - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(dealt), tree)), dealt.column(1), pa.array(code), dealt.column(0), dealt.column(2), dealt.column(4)],
                        ["tree", "space", "code", "v", "vec", "own"])

    coded = sized.mapInArrow(run, f"tree long, space long, code long, v long, vec {kind}, own long")
    stored = written(coded, "leaves")
    counts = stored.groupBy("tree", "space", "code").agg(F.ceil(F.count("*") / LEAF_MOST).alias("parts"))
    return stored.join(counts, ["tree", "space", "code"]).select(
        "tree", "space", "code", F.pmod(F.xxhash64("v", "tree"), F.col("parts")).alias("part"), "v", "vec", "own")


def _roots(near: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and column of a table of links, the least identifier that a chain of them leads to."""
    own, other = ids.copy(), others.copy()
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if len(rows):
        near, most = near[np.ix_(rows, columns)], np.iinfo(np.int64).max
        while True:
            least = np.minimum(own[rows], np.where(near, other[columns][None, :], most).min(axis=1))
            back = np.minimum(other[columns], np.where(near, least[:, None], most).min(axis=0))
            if (least == own[rows]).all() and (back == other[columns]).all():
                break
            own[rows], other[columns] = least, back
    return own, other


def _entries(ids, own, sims, i, j, near) -> pa.Table:
    """The pairs (i, j) as candidates, and for `near`, the links among those compared, each vertex with the root of its links here (sim null)."""
    root, _ = _roots(near, ids, ids)
    hung = root != ids
    n, m = len(i), int(hung.sum())
    return pa.table({
        "v": np.concatenate((ids[i], ids[hung])), "u": np.concatenate((ids[j], root[hung])),
        "sim": pa.array(np.concatenate((sims[i, j], np.zeros(m))), mask=np.arange(n + m) >= n),
        "fresh": np.ones(n + m, dtype=bool), "inside": np.concatenate((own[i] == own[j], np.zeros(m, dtype=bool)))})


_ENTRY = "v long, u long, sim double, fresh boolean, inside boolean"


def _start(points: DataFrame, k: int, leaves: int, seed: int, threshold: float) -> DataFrame:
    """The k nearest of each vertex in its leaves, inside its own component and outside, and the links of leaves."""
    def run(leaf: pa.Table) -> pa.Table:
        ids, own = leaf.column("v").to_numpy(), leaf.column("own").to_numpy()
        unit = _matrix(leaf.column("vec"))
        sims = unit @ unit.T
        same, diagonal = own[:, None] == own[None, :], np.eye(len(ids), dtype=bool)
        pairs = []
        for allowed in (~same, same & ~diagonal):
            if allowed.any():
                best = np.argpartition(np.where(allowed, -sims, np.inf), min(k, len(ids) - 1) - 1, axis=1)[:, :k]
                i, j = np.repeat(np.arange(len(ids)), best.shape[1]), best.ravel()
                pairs.append((i[allowed[i, j]], j[allowed[i, j]]))
        i, j = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, dtype=int),) * 2
        return _entries(ids, own, sims, i, j, (sims >= threshold) & ~same)

    return _leaves(points, leaves, seed, threshold).groupBy("tree", "space", "code", "part").applyInArrow(run, _ENTRY)


def _kept(candidates: DataFrame, before: DataFrame | None, k: int, threshold: float = THRESHOLD) -> DataFrame:
    """The best of a vertex's old and new neighbours, inside and outside its component: k, or as many as its enlarged list holds."""
    if before is not None:
        candidates = candidates.unionByName(before.select("v", "inside", "size", F.explode("near").alias("e")).select("v", "inside", "e.*", "size"), allowMissingColumns=True)
    else:
        candidates = candidates.withColumn("size", F.lit(None).cast("int"))
    # One entry for each neighbour; an old entry wins, as it has been compared already.
    once = candidates.groupBy("v", "u", "inside").agg(
        F.max("sim").alias("sim"), F.min(F.when(F.col("sim").isNotNull(), F.col("fresh"))).alias("fresh"), F.max("size").alias("size"), F.max(F.col("sim").isNull()).alias("root"))
    entry = F.when(F.col("sim").isNotNull(), F.struct("sim", "u", "fresh"))
    lists = once.groupBy("v", "inside").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("near"), F.coalesce(F.max("size"), F.lit(k)).alias("size"), F.collect_list(F.when(F.col("root"), F.col("u"))).alias("roots"))
    cut = lists.withColumn("near", F.slice("near", F.lit(1), F.col("size")))
    full = ~F.col("inside") & (F.size("near") >= F.col("size")) & (_last("near") >= threshold)
    return written(cut.select(
        "v", "inside", "near", F.when(full, F.least(F.col("size") * 2, F.lit(GROWTH * k))).otherwise(F.col("size")).cast("int").alias("size"), "roots"), "graph")


def _last(near: str):
    """The similarity of a list's farthest entry."""
    return F.get(near, F.size(near) - 1)["sim"]


def _round(graph: DataFrame, points: DataFrame, k: int, threshold: float) -> DataFrame:
    """Compare the members around each vertex with each other: candidates, and the links among those compared."""
    edges = graph.select("v", F.explode("near").alias("e")).select("v", "e.u", "e.fresh")
    around = edges.select(F.col("v").alias("at"), F.col("u").alias("v"), "fresh").unionByName(edges.select(F.col("u").alias("at"), "v", "fresh"))
    around = around.groupBy("at", "v").agg(F.max("fresh").alias("fresh"))
    parts = around.groupBy("at").agg(F.ceil(F.count("*") / (GROWTH * 2 * k)).alias("parts"), F.max("fresh").alias("any")).where("any")
    last = F.when(F.size("near") >= F.col("size"), _last("near"))
    farthest = graph.groupBy("v").agg(F.max(F.when(F.col("inside"), last)).alias("far_in"), F.max(F.when(~F.col("inside"), last)).alias("far_out"))
    members = (around.join(parts, "at").select("at", F.pmod(F.xxhash64("v", "at"), F.col("parts")).alias("part"), "v", "fresh")
               .join(points.select("v", "vec", "own"), "v").join(farthest, "v", "left")
               .select("at", "part", "v", "fresh", "vec", "own", F.coalesce("far_in", F.lit(-2.0)).alias("far_in"), F.coalesce("far_out", F.lit(-2.0)).alias("far_out")))

    def run(group: pa.Table) -> pa.Table:
        ids, own = group.column("v").to_numpy(), group.column("own").to_numpy()
        unit = _matrix(group.column("vec"))
        sims, same = unit @ unit.T, own[:, None] == own[None, :]
        fresh = group.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
        far = np.where(same, group.column("far_in").to_numpy()[:, None], group.column("far_out").to_numpy()[:, None])
        new = fresh[:, None] | fresh[None, :]
        np.fill_diagonal(new, False)
        i, j = np.nonzero(new & (sims > far))
        return _entries(ids, own, sims, i, j, new & ~same & (sims >= threshold))

    return members.groupBy("at", "part").applyInArrow(run, _ENTRY)


def _descended(points: DataFrame, start: DataFrame, k: int, rounds: int | None, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The graph refined from its first candidates, and the links (a, b) of all compared pairs, each group's as a star."""
    rooted = lambda graph: graph.select(F.col("v").alias("a"), F.explode("roots").alias("b"))
    graph = _kept(start, None, k, threshold)
    links = rooted(graph)
    old = F.transform("near", lambda e: F.struct(e["sim"], e["u"], F.lit(False).alias("fresh")))
    for _ in count() if rounds is None else range(rounds):
        graph = _kept(_round(graph, points, k, threshold), graph.withColumn("near", old), k, threshold)
        links = links.unionByName(rooted(graph))
        number = lambda test: F.coalesce(F.sum(F.size(F.filter("near", test))), F.lit(0))
        changed, entries, news, linked_ = graph.where("not inside").select(
            number(lambda e: e["fresh"]), number(lambda e: F.lit(True)),
            number(lambda e: e["fresh"] & (e["sim"] >= threshold)), number(lambda e: e["sim"] >= threshold)).first()
        if changed <= CHANGED * entries and news <= NEW_LINKS * linked_:
            break
    return graph, links


def search(points: DataFrame, k: int = LIST, leaves: int = LEAVES, rounds: int | None = None, threshold: float = THRESHOLD, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The refined graph, and links (a, b) that connect what is linked.

    A list that is full of links says nothing about links beyond it. The vertices
    with such lists are searched again, each with a list of the nearest inside its
    component and one of the nearest outside, until no link joins two components.
    """
    single = points.withColumn("own", F.col("v"))
    graph, links = _descended(single, _start(single, k, leaves, seed, threshold), k, rounds, threshold)
    full = graph.where((F.size("near") >= k) & (_last("near") >= threshold)).select("v")
    if full.isEmpty():
        return graph, links
    dense = written(points.join(full, "v", "left_semi").select("v", "space", "vec"), "dense")
    edges = graph.join(full, "v", "left_semi").select("v", F.explode("near").alias("e")).select("v", "e.u", "e.sim")
    while True:
        seed += 1
        found = components(links)
        placed = dense.join(found, dense["v"] == found["vertex"], "left").select("v", "space", "vec", F.coalesce("component", "v").alias("own"))
        several = placed.groupBy("space").agg(F.min("own").alias("least"), F.max("own").alias("most")).where("least <> most").select("space")
        placed = written(placed.join(several, "space", "left_semi"), "placed")
        if placed.isEmpty():
            return graph, links
        own = placed.select("v", "own")
        known = edges.join(own, "v").join(own.select(F.col("v").alias("u"), F.col("own").alias("other")), "u").select(
            "v", "u", "sim", F.lit(True).alias("fresh"), (F.col("own") == F.col("other")).alias("inside"))
        _, more = _descended(placed, _start(placed, k, leaves, seed, threshold).unionByName(known), k, rounds, threshold)
        if more.isEmpty():
            return graph, links
        links = links.unionByName(more)


def descend(points: DataFrame, k: int = LIST, leaves: int = LEAVES, rounds: int | None = None, threshold: float = THRESHOLD, seed: int = 0) -> DataFrame:
    """The refined graph: v, near (sim, u, fresh)."""
    return search(points, k, leaves, rounds, threshold, seed)[0]


def _joined(points: DataFrame, graph: DataFrame, threshold: float, more: DataFrame | None = None) -> DataFrame:
    """Every vertex with its component, by the links of the lists and `more`."""
    links = graph.select(F.col("v").alias("a"), F.explode("near").alias("e")).where(F.col("e.sim") >= threshold).select("a", F.col("e.u").alias("b"))
    found = components(links if more is None else links.unionByName(more))
    return points.join(found, points["v"] == found["vertex"], "left").select("v", "space", "vec", "count", F.coalesce("component", "v").alias("component"))


def _blocked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides dealt to pairs of blocks of one key: key, i, j, side and the columns v, vec, count, component."""
    def counted(df, name):
        blocks = df.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias(name))
        return blocks
    li, rj = counted(left, "rows_i"), counted(right, "rows_j")
    sides = []
    for df, own, other, side in ((left, "rows_i", "rows_j", 0), (right, "rows_j", "rows_i", 1)):
        block = F.pmod(F.xxhash64("v"), F.col(own))
        dealt = df.join(li, key).join(rj, key).withColumn("mine", block).withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        i, j = ("mine", "theirs") if side == 0 else ("theirs", "mine")
        group = F.col("component") if "component" in df.columns else F.lit(0).cast("long")
        sides.append(dealt.select(F.col(key).alias("key"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "v", "vec", "count", group.alias("component")))
    return sides[0].unionByName(sides[1])


def _counted(blocks: DataFrame, threshold: float) -> DataFrame:
    """Links of each vertex of side 0 to rows of side 1 over all blocks, and how many of them lead to another component."""
    def run(group: pa.Table) -> pa.Table:
        unit, side = _matrix(group.column("vec")), group.column("side").to_numpy()
        ids, count = group.column("v").to_numpy(), group.column("count").to_numpy()
        a, b = side == 0, side == 1
        near = unit[a] @ unit[b].T >= threshold
        near[ids[a][:, None] == ids[b][None, :]] = False
        component = group.column("component").to_numpy()
        apart = near & (component[a][:, None] != component[b][None, :])
        return pa.table({"v": ids[a], "links": near @ count[b], "apart": apart @ count[b]})

    found = blocks.groupBy("key", "i", "j").applyInArrow(run, "v long, links long, apart long")
    return found.groupBy("v").agg(F.sum("links").alias("links"), F.sum("apart").alias("apart"))


def _degrees(placed: DataFrame, threshold: float) -> DataFrame:
    """Links of each vertex that is not alone in its component."""
    shared = placed.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    inside = written(placed.join(shared, "component"), "inside")
    return _counted(_blocked(inside, inside, "component"), threshold).select("v", "links")


def audited(points: DataFrame, degrees: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT, least_links: int = AUDIT_LINKS) -> tuple[float, int]:
    """Share of the true links of sampled query vectors that were found, and how many of them join different components.

    The sample grows until it holds `least_links` links or every vector, so that an
    audit never passes on links it has not seen.
    """
    n = points.count()
    while True:
        share = min(1.0, queries / max(n, 1))
        chosen = points.where(F.pmod(F.xxhash64("v", F.lit("audit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
        true = _counted(_blocked(chosen, points, "space"), threshold)
        links, found, apart = true.join(degrees.withColumnRenamed("links", "found"), "v", "left").agg(
            F.coalesce(F.sum("links"), F.lit(0)), F.sum(F.coalesce("found", F.lit(0))), F.coalesce(F.sum("apart"), F.lit(0))).first()
        if links >= least_links or share == 1.0:
            return (found / links if links else 1.0), apart
        queries *= max(2, min(16, math.ceil(1.5 * least_links / max(links, 1))))


def audit(points: DataFrame, degrees: DataFrame, threshold: float = THRESHOLD, queries: int = AUDIT) -> float:
    """Share of the true links of sampled query vectors that were found."""
    return audited(points, degrees, threshold, queries)[0]


def _exactly(points: DataFrame, threshold: float) -> DataFrame:
    """Every vertex with its component by all pairs of its label, in blocks."""
    def run(group: pa.Table) -> pa.Table:
        unit, side, ids = _matrix(group.column("vec")), group.column("side").to_numpy(), group.column("v").to_numpy()
        a, b = side == 0, side == 1
        roots = np.concatenate(_roots(unit[a] @ unit[b].T >= threshold, ids[a], ids[b]))
        both = np.concatenate((ids[a], ids[b]))
        return pa.table({"a": both[roots != both], "b": roots[roots != both]})

    links = _blocked(points, points, "space").where("i <= j").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")
    found = components(links)
    return points.join(found, points["v"] == found["vertex"], "left").select("v", "space", "vec", "count", F.coalesce("component", "v").alias("component"))


def linked(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", k: int = LIST, least_recall: float = LEAST_RECALL) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    rows, points = vertices(df, id_col, vector_col, label_col)
    leaves = LEAVES
    for _ in range(TRIES):
        graph, links = search(points, k, leaves, threshold=threshold)
        placed = written(_joined(points, graph, threshold, links), "placed")
        degrees = written(_degrees(placed, threshold), "degrees")
        recall, apart = audited(placed, degrees, threshold, AUDIT, AUDIT_LINKS)
        _LOG.info("NN-descent with lists of %d and %d trees: recall %.4f, %d links between components", k, leaves, recall, apart)
        if recall >= least_recall and not apart:
            break
        k, leaves = 2 * k, 2 * leaves
    else:
        _LOG.warning("NN-descent stays below recall %.4f or leaves links between components: all pairs are compared", least_recall)
        placed = written(_exactly(points, threshold), "placed")
        degrees = written(_degrees(placed, threshold), "degrees")
    of_vertex = placed.join(degrees, "v", "left").select("v", "component", "count", (F.coalesce("links", F.lit(0)) + F.col("count") - 1).alias("n_links"))
    classes = points.select("v", F.col("label").alias("l"), F.col("vec").alias("x")).join(of_vertex, "v").select("l", "x", "component", "n_links")
    good = rows.where("good").join(classes, (F.col("label") == F.col("l")) & (F.col("vec") == F.col("x"))).select("vec_id", "component", "n_links")
    least = good.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    found = good.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
