"""Communities of a weighted graph by modularity with a resolution, for many resolutions in the same jobs.

A round finds each node's best community from sums by neighbouring community and community totals. Half of the willing nodes, picked by a hash of node and round, move
together if that raises the modularity of the whole; else moves that share no community do, whose gains add up exactly. So every round raises it. When
none is left, communities become the nodes of the next level.

Before the rounds tasks sweep over slabs, nodes of near ids, one node after the other, as long as the outcome of all slabs raises modularity; where one slab holds all nodes no round is needed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.operators import graph

#: Least gain of a move, and rounds of a level and levels at most.
LEAST, ROUNDS, LEVELS = 1e-9, 24, 12
#: Nodes of near ids that one task sweeps over.
SLAB = 8192


def both(edges: DataFrame) -> DataFrame:
    """(g, src, dst, w) from both ends; loops stand once with twice their weight."""
    loops = edges.filter("src = dst").select("g", "src", "dst", (2 * F.col("w")).alias("w"))
    rest = edges.filter("src <> dst")
    return rest.select("g", "src", "dst", "w").union(rest.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).union(loops)


def modularity(labels: DataFrame, edges: DataFrame, gamma: Column | float = 1.0, by: tuple[str, ...] = ()) -> DataFrame:
    """(q, communities) of labels (vid, cid) and edges (src, dst, w), src <= dst, for each value of the columns `by`, which both tables have.

    q is the sum over communities of inner weight / m - gamma * (degrees / 2m)**2.
    """
    by = list(by)
    a = labels.select(*by, F.col("vid").alias("src"), F.col("cid").alias("a"))
    rows = edges.join(a, [*by, "src"]).join(a.withColumnsRenamed({"src": "dst", "a": "b"}), [*by, "dst"])
    ends = rows.select(*by, F.explode(F.array(F.struct(F.col("a").alias("c"), F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0).alias("i"), F.col("w").alias("d")), F.struct(F.col("b").alias("c"), F.lit(0.0).alias("i"), F.col("w").alias("d")))).alias("e"))
    sums = ends.groupBy(*by, "e.c").agg(F.sum("e.i").alias("inner"), F.sum("e.d").alias("degree"))
    # Communities without an edge count too.
    alone = labels.select(*by, F.col("cid").alias("c")).distinct().join(sums, [*by, "c"], "left").fillna(0.0, ["inner", "degree"])
    total = alone.groupBy(*by).agg(F.sum("inner").alias("inner"), F.sum(F.col("degree") * F.col("degree")).alias("squares"), (F.sum("degree") / 2).alias("m"), F.count("*").alias("communities"))
    gamma = gamma if isinstance(gamma, Column) else F.lit(gamma)
    q = F.when(F.col("m") > 0, F.col("inner") / F.col("m") - gamma * F.col("squares") / (4 * F.col("m") * F.col("m"))).otherwise(0.0)
    return total.select(*by, q.alias("q"), "communities")


def moves(labels: DataFrame, edges: DataFrame, gamma: Column, m: Column) -> DataFrame:
    """(g, vid, a, c, gain): the community that raises modularity most for each node that any other would; ties go to the smaller one.

    labels: (g, vid, cid, k), k the node's degree. gain = (w to c - w to its own) / m - gamma * k * (total of c - total of its own without it) / (2 m**2).
    """
    near = both(edges).filter("src <> dst").join(labels.select("g", F.col("vid").alias("dst"), F.col("cid").alias("c")), ["g", "dst"]).groupBy("g", "src", "c").agg(F.sum("w").alias("w"))
    totals = labels.groupBy("g", F.col("cid").alias("c")).agg(F.sum("k").alias("total"))
    own = labels.select("g", F.col("vid").alias("src"), F.col("cid").alias("a"), "k").join(totals.withColumnsRenamed({"c": "a", "total": "of_a"}), ["g", "a"])
    inner = near.select("g", "src", F.col("c").alias("a"), F.col("w").alias("to_a"))
    own = own.join(inner, ["g", "src", "a"], "left").fillna(0.0, ["to_a"])
    rows = near.join(own, ["g", "src"]).filter("c <> a").join(totals, ["g", "c"])
    gain = (F.col("w") - F.col("to_a")) / m - gamma * F.col("k") * (F.col("total") - F.col("of_a") + F.col("k")) / (2 * m * m)
    best = rows.withColumn("gain", gain).filter(F.col("gain") > LEAST).groupBy("g", "src", "a").agg(F.min(F.struct((-F.col("gain")).alias("n"), F.col("c"))).alias("b"))
    return best.select("g", F.col("src").alias("vid"), "a", F.col("b.c").alias("c"), (-F.col("b.n")).alias("gain"))


def apart(found: DataFrame) -> DataFrame:
    """Of the moves those that are the best of both communities that they touch, so that no two touch the same."""
    rank = F.struct((-F.col("gain")).alias("n"), F.col("vid"))
    touched = found.select("g", F.explode(F.array("a", "c")).alias("x"), rank.alias("r"))
    best = touched.groupBy("g", "x").agg(F.min("r").alias("r")).select("g", "x", F.col("r.vid").alias("vid"))
    return found.join(best.groupBy("g", "vid").agg(F.count("*").alias("n")).filter("n = 2").select("g", "vid"), ["g", "vid"], "left_semi")


def literal(values: dict[int, float]) -> Column:
    """A value for each g: a map of as many entries as there are resolutions."""
    return F.element_at(F.create_map(*[F.lit(x) for g, v in sorted(values.items()) for x in (g, float(v))]), F.col("g"))


def sweep(at: pd.DataFrame, near: pd.DataFrame, gamma: float, m: float) -> pd.DataFrame:
    """Labels of a slab's nodes (vid, cid, k, total) after moves of one node at a time until none helps; near: (src, dst, w, c, held) its edges with the labels beyond."""
    mine = dict(zip(at["vid"].tolist(), at["cid"].tolist(), strict=True))
    other = dict(zip(near["dst"].tolist(), near["c"].tolist(), strict=True)) | mine
    total = dict(zip(near["c"].tolist(), near["held"].tolist(), strict=True)) | dict(zip(at["cid"].tolist(), at["total"].tolist(), strict=True))
    ways: dict = {}
    for src, dst, w in zip(near["src"].tolist(), near["dst"].tolist(), near["w"].tolist(), strict=True):
        ways.setdefault(src, []).append((dst, w))
    degree = sorted(zip(at["vid"].tolist(), at["k"].tolist(), strict=True))
    moved = True
    while moved:
        moved = False
        for vid, k in degree:
            sums: dict = {}
            for dst, w in ways.get(vid, ()):
                sums[other[dst]] = sums.get(other[dst], 0.0) + w
            a = other[vid]
            base = sums.get(a, 0.0) / m - gamma * k * (total[a] - k) / (2 * m * m)
            gain, c = max(((w / m - gamma * k * total[c] / (2 * m * m) - base, -c) for c, w in sums.items() if c != a), default=(0.0, 0))
            if gain > LEAST:
                total[a], total[-c], other[vid], moved = total[a] - k, total[-c] + k, -c, True
    return at.assign(cid=[other[v] for v in at["vid"].tolist()])


def swept(labels: DataFrame, edges: DataFrame, gammas: dict[int, float], weight: dict[int, float], slab: Column) -> DataFrame:
    """(g, vid, cid, k) after `sweep` of every slab by itself."""
    totals = labels.groupBy("g", "cid").agg(F.sum("k").alias("total"))
    at = labels.join(totals, ["g", "cid"]).select("g", "vid", "cid", "k", "total", slab.alias("slab"))
    # Other names, as both sides come from one table.
    ends = at.select(F.col("g").alias("h"), F.col("vid").alias("dst"), F.col("cid").alias("c"), F.col("total").alias("held"))
    begins = at.select(F.col("g").alias("h"), F.col("vid").alias("src"), F.col("slab").alias("part"))
    near = both(edges).filter("src <> dst").withColumnRenamed("g", "h").join(ends, ["h", "dst"]).join(begins, ["h", "src"]).select("h", "src", "dst", "w", "c", "held", "part")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        g = int(a["g"].iloc[0])
        return sweep(a, b, gammas[g], weight.get(g) or 1.0)[["g", "vid", "cid", "k"]]

    return at.groupBy("g", "slab").cogroup(near.groupBy("h", "part")).applyInPandas(run, "g int, vid long, cid long, k double")


def settle(labels: DataFrame, edges: DataFrame, gammas: dict[int, float], history: list | None = None) -> tuple[DataFrame, set[int]]:
    """Labels after moves until none helps, and which g have moved at all."""
    weight = {r.g: r.w for r in edges.groupBy("g").agg(F.sum("w").alias("w")).collect()}  # one row a resolution
    gamma, m = literal(gammas), literal({g: weight.get(g) or 1.0 for g in gammas})
    quality = {r.g: r.q for r in modularity(labels, edges, gamma, ("g",)).collect()}
    moved: set[int] = set()
    live = set(gammas)
    size = labels.groupBy("g").agg(F.count("*").alias("n"), F.max("vid").alias("last")).agg(F.max("n").alias("n"), F.max("last").alias("last")).first()
    width = ((size.last or 0) + 1) / max(1, -(-(size.n or 0) // SLAB))
    for step in range(ROUNDS):
        # Every other time slabs begin half a slab later.
        slab = F.floor(F.col("vid") / width + step % 2 / 2) if (size.n or 0) > SLAB else F.lit(0)
        at, near = (t.filter(F.col("g").isin(sorted(live))) for t in (labels, edges))
        tried = graph.saved(swept(at, near, gammas, weight, slab))
        better = {r.g: r.q for r in modularity(tried, near, gamma, ("g",)).collect() if r.q > quality[r.g] + LEAST}  # a row a resolution
        if history is not None:
            history.append({g: (quality[g], q) for g, q in better.items()})
        if not better:
            break
        labels = graph.saved(tried.filter(F.col("g").isin(sorted(better))).union(labels.filter(~F.col("g").isin(sorted(better))).select("g", "vid", "cid", "k")))
        graph.discard(tried)
        quality |= better
        moved, live = moved | set(better), set(better)
        if (size.n or 0) <= SLAB:
            return labels, moved
    live = set(gammas)
    for step in range(ROUNDS):
        at = labels.filter(F.col("g").isin(sorted(live)))
        found = graph.saved(moves(at, edges.filter(F.col("g").isin(sorted(live))), gamma, m))
        many = found.filter(F.pmod(F.xxhash64("vid", F.lit(step)), F.lit(2)) == 0)
        chosen = many.select(F.lit(0).alias("mode"), "g", "vid", "c").union(apart(found).select(F.lit(1).alias("mode"), "g", "vid", "c"))
        modes = at.withColumn("mode", F.explode(F.array(F.lit(0), F.lit(1))))
        tried = graph.saved(modes.join(chosen, ["mode", "g", "vid"], "left").select("mode", "g", "vid", F.coalesce("c", "cid").alias("cid"), "k"))
        tried_edges = edges.filter(F.col("g").isin(sorted(live))).withColumn("mode", F.explode(F.array(F.lit(0), F.lit(1))))
        best = {}
        for r in modularity(tried, tried_edges, gamma, ("g", "mode")).collect():  # two rows a resolution
            if r.q > quality[r.g] + LEAST and r.q > best.get(r.g, (quality[r.g], 0))[0]:
                best[r.g] = (r.q, r.mode)
        if history is not None:
            history.append({g: (quality[g], q) for g, (q, _) in best.items()})
        if not best:
            break
        taken = F.lit(False)
        for g, (q, mode) in best.items():
            taken = taken | ((F.col("g") == g) & (F.col("mode") == mode))
            quality[g] = q
        rest = labels.filter(~F.col("g").isin(sorted(best)))
        labels = graph.saved(tried.filter(taken).select("g", "vid", "cid", "k").union(rest.select("g", "vid", "cid", "k")))
        graph.discard(found, tried)
        moved, live = moved | set(best), set(best)
    return labels, moved


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, vid, cid, k) with each node a community of its own."""
    k = both(edges).groupBy("g", F.col("src").alias("vid")).agg(F.sum("w").alias("k"))
    return nodes.join(k, ["g", "vid"], "left").fillna(0.0, ["k"]).select("g", "vid", F.col("vid").alias("cid"), "k")


def communities(nodes: DataFrame, edges: DataFrame, gammas: list[float], history: list | None = None) -> DataFrame:
    """(g, vid, cid) for each resolution gammas[g]: levels of moves and contraction until no node moves. edges: (src, dst, w)."""
    numbers = F.explode(F.array(*[F.lit(g) for g in range(len(gammas))]))
    low, high = F.least("src", "dst").cast("long"), F.greatest("src", "dst").cast("long")
    graphs = graph.saved(edges.select(low.alias("src"), high.alias("dst"), F.col("w").cast("double")).groupBy("src", "dst").agg(F.sum("w").alias("w")).withColumn("g", numbers).select("g", "src", "dst", "w"))
    labels = graph.saved(nodes.select(F.col("vid").cast("long").alias("vid")).withColumn("g", numbers).select("g", "vid", F.col("vid").alias("cid")))
    if graphs.isEmpty():
        return labels
    level, live = labels.select("g", "vid"), set(range(len(gammas)))
    for _ in range(LEVELS):
        start = graph.saved(degrees(level, graphs))
        settled, moved = settle(start, graphs, {g: gammas[g] for g in live}, history)
        if not moved:
            break
        live = moved
        names = settled.select("g", F.col("vid").alias("cid"), F.col("cid").alias("new"))
        labels = graph.saved(labels.join(names, ["g", "cid"], "left").select("g", "vid", F.coalesce("new", "cid").alias("cid")))
        a = settled.filter(F.col("g").isin(sorted(live))).select("g", F.col("vid").alias("src"), F.col("cid").alias("a"))
        rows = graphs.join(a, ["g", "src"]).join(a.withColumnsRenamed({"src": "dst", "a": "b"}), ["g", "dst"])
        graphs = graph.saved(rows.groupBy("g", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")))
        level = settled.filter(F.col("g").isin(sorted(live))).select("g", F.col("cid").alias("vid")).distinct()
    return labels


def louvain(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(vid, cid): communities at one resolution."""
    return communities(nodes, edges, [gamma]).select("vid", "cid")


def to_k(nodes: DataFrame, edges: DataFrame, k: int, tolerance: float = 0.05, low: float = 1e-3, high: float = 128.0, width: int = 8, passes: int = 2) -> tuple[DataFrame, float, int]:
    """Labels, resolution and number of communities nearest to k: `width` resolutions between two bounds at once, then between the two that stand around k."""
    best = None
    for _ in range(passes):
        gammas = [low * (high / low) ** (i / (width - 1)) for i in range(width)]
        found = graph.saved(communities(nodes, edges, gammas))
        counts = {r.g: r.n for r in found.groupBy("g").agg(F.countDistinct("cid").alias("n")).collect()}
        for g, n in sorted(counts.items()):
            if best is None or abs(n - k) < abs(best[2] - k):
                best = (graph.saved(found.filter(F.col("g") == g).select("vid", "cid")), gammas[g], n)
        if best is None or abs(best[2] - k) <= tolerance * k:
            break
        below = [g for g in counts if counts[g] < k]
        above = [g for g in counts if counts[g] > k]
        low, high = gammas[max(below, default=0)], gammas[min(above, default=width - 1)]
        if not low < high:
            break
    if best is None:
        raise ValueError("no nodes")
    return best
