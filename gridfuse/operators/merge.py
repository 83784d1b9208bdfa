"""Agglomeration on graphs, in rounds that each merge as much as they can at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, spatial

#: Price of merging the neighbours a and b, which have `n` voxels and mean features `ts`; `w` is the least price of an edge between them.
COSTS = {
    "edge": lambda a, b: F.col("w"),
    "squared": lambda a, b: V.sq_distance(a["ts"], b["ts"]),
    "ward": lambda a, b: a["n"] * b["n"] / (a["n"] + b["n"]) * V.sq_distance(a["ts"], b["ts"]),
    "cosine": lambda a, b: 1 - V.dot(a["ts"], b["ts"]) / F.greatest(V.norm(a["ts"]) * V.norm(b["ts"]), F.lit(1e-12)),
}


def allowed(scale: float | None) -> Column:
    """Whether an edge is no dearer than what either side holds already plus `scale` over its size."""
    if scale is None:
        return F.lit(True)
    return F.least(*[F.col(f"{s}.inner") + scale / F.col(f"{s}.n") for s in "ab"]) >= F.col("d")


def priced(nodes: DataFrame, edges: DataFrame, cost: str, scale: float | None = None) -> DataFrame:
    """(src, dst, d): what each allowed merge costs."""
    a = nodes.select(F.col("vid").alias("src"), F.struct("n", "ts", "inner").alias("a"))
    rows = edges.join(a, "src").join(a.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    return rows.withColumn("d", COSTS[cost](F.col("a"), F.col("b"))).filter(allowed(scale)).select("src", "dst", "d")


def united(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The nodes after dst of each pair (src, dst, d) went into src: sizes add up, means are weighted by size."""
    gone = pairs.join(nodes.select(F.col("vid").alias("dst"), F.struct("n", "ts", "inner").alias("b")), "dst").select(F.col("src").alias("vid"), "b", "d")
    kept = nodes.join(pairs.select(F.col("dst").alias("vid")), "vid", "left_anti").join(gone, "vid", "left")
    # The sum of sizes has another name than its parts: inside a lambda, a name would mean the new column.
    kept = kept.withColumns({"own": F.col("n"), "added": F.coalesce("b.n", F.lit(0))}).drop("n")
    both = F.zip_with("ts", "b.ts", lambda x, y: (x * F.col("own") + y * F.col("added")) / (F.col("own") + F.col("added")))
    return kept.select("vid", (F.col("own") + F.col("added")).alias("n"), F.coalesce(both, "ts").alias("ts"), F.greatest("inner", "b.inner", "d").alias("inner"))


def rewired(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (src, dst, w) between renamed nodes (old, new), the lightest of each pair; nodes without a new name keep theirs."""
    for side in ("src", "dst"):
        edges = edges.join(names.withColumnRenamed("old", side), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
    rows = edges.filter("src <> dst").groupBy(F.least("src", "dst").alias("s"), F.greatest("src", "dst").alias("t")).agg(F.min("w").alias("w"))
    return rows.select(F.col("s").alias("src"), F.col("t").alias("dst"), "w")


def followed(labels: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """Labels (vid, cid) after each table of new names (old, new) in turn."""
    for i, names in enumerate(steps):
        labels = labels.join(names.withColumnRenamed("old", "cid"), "cid", "left").select("vid", F.coalesce("new", "cid").alias("cid"))
        labels = graph.saved(labels) if i % 8 == 7 else labels
    return labels


def agglomerate(nodes: DataFrame, edges: DataFrame, k: int, cost: str, scale: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges pairs of nodes that are each other's cheapest neighbour, down to `k` nodes or until no pair is left or allowed.

    nodes: (vid, n, ts, inner), edges: (src, dst, w). Returns (vid, cid), the nodes left and their edges. Means are weighted by size.
    A round writes the pairs, the nodes and the edges; labels follow at the end.
    """
    labels, steps = nodes.select("vid", F.col("vid").alias("cid")), []
    nodes, edges = graph.saved(nodes), graph.saved(edges)
    labels = graph.saved(labels)
    left = nodes.count()
    while left > k:
        near = graph.nearest_edge(priced(nodes, edges, cost, scale), hashed=True)
        back = near.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        pairs = graph.saved(near.join(back, ["src", "dst"], "left_semi").filter("src < dst"))
        found = pairs.count()
        if not found:
            break
        if found > left - k:
            pairs = graph.saved(pairs.orderBy("d", "src", "dst").limit(left - k))
            found = left - k
        names = pairs.select(F.col("dst").alias("old"), F.col("src").alias("new"))
        steps.append(names)
        left -= found
        new_nodes, new_edges = graph.saved(united(nodes, pairs)), graph.saved(rewired(edges, names))
        graph.discard(nodes, edges)
        nodes, edges = new_nodes, new_edges
    return graph.saved(followed(labels, steps)), nodes, edges


def pooled(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """(vid, n, ts, inner) of the parts (vid, cid) of nodes; means are weighted by size."""
    rows = nodes.join(parts, "vid").select("cid", "n", F.posexplode("ts").alias("t", "v"))
    sums = rows.groupBy("cid", "t").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("t", "v")))
    return sums.groupBy("cid").agg(F.first("n").alias("n"), F.transform(ordered, lambda s: s.v).alias("ts")).select(F.col("cid").alias("vid"), "n", "ts", F.lit(0.0).alias("inner"))


def coarsen(nodes: DataFrame, edges: DataFrame, stop_at: int, image: DataFrame | None = None, weight: float = 0.0, exact: bool = False, weighted: bool = True, most: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nearest neighbours unite, round after round, until at most `stop_at` nodes are left.

    With an `image` (vid, g), prices grow by `weight` times its difference. With `exact`, a round that would go below `stop_at` unites only
    the closest pairs. Means are weighted by size, or plain means of the nodes of the round. Returns labels, nodes and edges.
    """
    labels, steps = graph.saved(nodes.select("vid", F.col("vid").alias("cid"))), []
    nodes, edges = graph.saved(nodes), graph.saved(edges)
    left = nodes.count()
    for _ in range(most):
        if left <= stop_at:
            break
        prices = priced(nodes, edges, "squared")
        near = graph.saved(graph.nearest_edge(prices if image is None else graph.penalised(prices, image, weight)))
        parts = graph.pointed(near, nodes)
        after = parts.filter("vid = cid").count()
        if exact and after < stop_at:
            pairs = near.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "d").distinct().orderBy("d", "src", "dst").limit(left - stop_at)
            both = spatial.both_ways(graph.saved(pairs).select("src", "dst"))
            parts = graph.pointed(near.join(both, ["src", "dst"], "left_semi"), nodes)
            after = parts.filter("vid = cid").count()
        graph.discard(near)
        if after == left:
            break
        names = parts.select(F.col("vid").alias("old"), F.col("cid").alias("new"))
        steps.append(names)
        if image is not None:
            image = graph.saved(image.join(parts, "vid").join(nodes.select("vid", "n"), "vid").groupBy("cid").agg((F.sum(F.col("g") * F.col("n")) / F.sum("n")).alias("g")).withColumnRenamed("cid", "vid"))
        pool = pooled(nodes if weighted else nodes.withColumn("n", F.lit(1).cast("long")), parts)
        new_nodes, new_edges = graph.saved(pool), graph.saved(rewired(edges, names))
        graph.discard(nodes, edges)
        nodes, edges, left = new_nodes, new_edges, after
    return graph.saved(followed(labels, steps)), nodes, edges


def leaves(voxels: DataFrame) -> DataFrame:
    return voxels.select("vid", F.lit(1).cast("long").alias("n"), "ts", F.lit(0.0).alias("inner"))


def dendrogram(nodes: DataFrame, edges: DataFrame, cost: str = "ward", enough: int | None = None) -> DataFrame:
    """(child, parent, height, round): all merges of `agglomerate`, down to the parts that no edge joins; `child` lives on in `parent`.

    A height is the price, or that of a merge inside either part if it is greater: with edges between some parts only, a price may fall when parts unite.
    Where all parts are neighbours Ward's prices never fall, and the merges are those of a sequential run.
    Ends as soon as `enough` merges are no dearer than every pair still open: a sequential run makes these first.
    """
    nodes, edges, found = graph.saved(nodes), graph.saved(edges), []
    while True:
        near = graph.nearest_edge(priced(nodes, edges, cost), hashed=True)
        back = near.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
        pairs = graph.saved(near.join(back, ["src", "dst"], "left_semi").filter("src < dst"))
        least = pairs.agg(F.min("d")).first()[0]
        if least is None or (enough is not None and sum(one.filter(F.col("height") <= least).count() for one in found) >= enough):
            break
        held = [nodes.select(F.col("vid").alias(c), F.col("inner").alias(f"in_{c}")) for c in ("src", "dst")]
        high = pairs.join(held[0], "src").join(held[1], "dst")
        found.append(graph.saved(high.select(F.col("dst").alias("child"), F.col("src").alias("parent"), F.greatest("d", "in_src", "in_dst").alias("height"), F.lit(len(found) + 1).alias("round"))))
        new_nodes, new_edges = graph.saved(united(nodes, pairs)), graph.saved(rewired(edges, pairs.select(F.col("dst").alias("old"), F.col("src").alias("new"))))
        graph.discard(nodes, edges)
        nodes, edges = new_nodes, new_edges
    rows = pairs.limit(0).select(F.col("dst").alias("child"), F.col("src").alias("parent"), F.col("d").alias("height"), F.lit(0).alias("round"))
    for one in found:
        rows = rows.union(one)
    return graph.saved(rows)


def cut_at(nodes: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(vid, cid): parts after the merges of least height that leave k of them (more if the merges end before); one dendrogram serves any k."""
    spare = max(0, k - (nodes.count() - merges.count()))
    order = [F.col("height").desc(), F.col("round").desc(), F.col("child").desc()]
    kept = merges.join(graph.saved(merges.orderBy(*order).limit(spare)).select("child"), "child", "left_anti")
    return graph.pointed(kept.select(F.col("child").alias("src"), F.col("parent").alias("dst")), nodes)


def to_k(nodes: DataFrame, edges: DataFrame, k: int, cost: str) -> DataFrame:
    """(vid, cid): k parts by the merges of least height over the whole graph; `agglomerate` stops after rounds, whose dear pairs may come before cheap ones of a later round."""
    nodes = graph.saved(nodes)
    return cut_at(nodes, dendrogram(nodes, edges, cost, max(0, nodes.count() - k)), k)
