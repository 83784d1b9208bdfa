"""Minimum spanning forests and segmentations that follow Kruskal's order, in rounds over tables of edges.

All edges stand in one total order: price, then a hash of the pair, then the pair. So the forest is unique, equal prices don't make rounds
wait for each other, and what a sequential pass over sorted edges would do can be told from the cheapest edges of each part.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.operators import graph, merge

#: Fixed values of the hash of a pair: a prime and two factors below it.
PRIME, LEFT, RIGHT = 2_147_483_647, 1_103_515_245, 1_540_483_477
#: Parts that one task of `segments` settles among themselves.
GROUP = 1 << 15


def pair_hash(src, dst) -> Column:
    """((src * LEFT + dst * RIGHT) mod PRIME) squared, mod PRIME; plain arithmetic, so other engines agree."""
    part = lambda c, f: F.pmod(F.col(c) if isinstance(c, str) else c, F.lit(PRIME)) * f
    x = F.pmod(part(src, LEFT) + F.pmod(part(dst, RIGHT), F.lit(PRIME)), F.lit(PRIME))
    return F.pmod(x * x, F.lit(PRIME))


def ordered(edges: DataFrame, price: str = "w") -> DataFrame:
    """(a, b, e): the cheapest edge of each pair, e = (w, h, src, dst) being its place in the order; loops go."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    rows = edges.filter("src <> dst").groupBy(low.cast("long").alias("a"), high.cast("long").alias("b")).agg(F.min(F.col(price).cast("double")).alias("w"))
    return rows.select("a", "b", F.struct("w", pair_hash("a", "b").alias("h"), F.col("a").alias("src"), F.col("b").alias("dst")).alias("e"))


def cheapest(live: DataFrame) -> DataFrame:
    """(src, dst, e): for each part the first of its edges in the order, and the part beyond it."""
    both = live.select(F.col("a").alias("src"), F.col("b").alias("dst"), "e").union(live.select(F.col("b").alias("src"), F.col("a").alias("dst"), "e"))
    return both.groupBy("src").agg(F.min(F.struct("e", "dst")).alias("m")).select("src", F.col("m.dst").alias("dst"), F.col("m.e").alias("e"))


def contracted(live: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between renamed parts (old, new), the first of each pair; parts without a new name keep theirs."""
    for side in "ab":
        live = live.join(names.withColumnRenamed("old", side), side, "left").withColumn(side, F.coalesce("new", side)).drop("new")
    return live.filter("a <> b").groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min("e").alias("e")).select(F.col("x").alias("a"), F.col("y").alias("b"), "e")


def spanning(nodes: DataFrame, edges: DataFrame, price: str = "w") -> tuple[DataFrame, DataFrame]:
    """Labels (vid, cid) of the connected parts and the minimum spanning forest (src, dst, w, h, round).

    Boruvka's rounds: each part takes the first of its outgoing edges, whole chains of parts contract at once, and the parts that have edges at least halve.
    """
    live, rounds, steps = graph.saved(ordered(edges, price)), [], []
    while not live.isEmpty():
        near = graph.saved(cheapest(live))
        parts = graph.pointed(near.select("src", "dst"), near.select(F.col("src").alias("vid")))
        names = parts.select(F.col("vid").alias("old"), F.col("cid").alias("new"))
        rounds.append(near.select("e.src", "e.dst", "e.w", "e.h", F.lit(len(rounds) + 1).alias("round")))
        steps.append(names)
        new = graph.saved(contracted(live, names))
        graph.discard(live)
        live = new
    none = live.select("e.src", "e.dst", "e.w", "e.h", F.lit(0).alias("round"))
    for one in rounds:
        none = none.union(one)
    # The two parts of an edge may both have taken it.
    forest = graph.saved(none.groupBy("src", "dst").agg(*[F.first(c).alias(c) for c in ("w", "h", "round")]))
    labels = merge.followed(nodes.select(F.col("vid").cast("long").alias("vid"), F.col("vid").cast("long").alias("cid")), steps)
    return graph.saved(labels), forest


def dearest(forest: DataFrame, n: int) -> DataFrame:
    return forest.orderBy(*[F.col(c).desc() for c in ("w", "h", "src", "dst")]).limit(n)


def cut(nodes: DataFrame, forest: DataFrame, k: int) -> DataFrame:
    """(vid, cid): the forest without its dearest edges, so that k parts are left (more if the graph has more to begin with)."""
    parts = nodes.count() - forest.count()
    kept = forest if k <= parts else forest.join(graph.saved(dearest(forest, k - parts)).select("src", "dst"), ["src", "dst"], "left_anti")
    return spanning(nodes, kept)[0]


def first_members(labels: DataFrame) -> DataFrame:
    """Labels by the smallest member of each part."""
    return labels.join(labels.groupBy("cid").agg(F.min("vid").alias("first")), "cid").select("vid", F.col("first").alias("cid"))


def settled(part: pd.DataFrame, group: int, scale: float) -> pd.DataFrame:
    """(vid, cid, n, inner, final) of the parts of one group after all decisions of `segments` that need no edge beyond the group.

    part: live edges (w, h, src, dst) and of both ends the part, its size, its dearest inner edge and its group (a, n_a, in_a, g_a, b, ...). A part whose first edge
    leaves the group waits, and so do those whose first edges lead to it.
    """
    part = part.sort_values(["w", "h", "src", "dst"])
    w = part.w.to_list()
    ends = list(zip(part.a.to_list(), part.b.to_list(), strict=True))
    up, size, inner, own, firsts, final = {}, {}, {}, set(), {}, set()
    for s in "ab":
        for v, n, dear, g in zip(part[s].to_list(), part[f"n_{s}"].to_list(), part[f"in_{s}"].to_list(), part[f"g_{s}"].to_list(), strict=True):
            up[v], size[v], inner[v] = v, n, dear
            if g == group:
                own.add(v)
    for i, pair in enumerate(ends):
        for v in pair:
            firsts.setdefault(v, []).append(i)  # rising, so a heap as it is

    def top(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    def first(v: int) -> tuple[int, int] | None:
        heap = firsts[v]
        while heap:
            a, b = map(top, ends[heap[0]])
            other = b if a == v else a
            if other != v and other not in final:
                return heap[0], other
            heapq.heappop(heap)
        return None

    todo = list(own)
    while todo:
        v = top(todo.pop())
        if v in final or (found := first(v)) is None:
            continue
        i, other = found
        if w[i] > inner[v] + scale / size[v]:
            final.add(v)
            todo += {u for e in firsts[v] for u in map(top, ends[e]) if u in own and u != v}
        elif other in own and first(other)[0] == i and w[i] <= inner[other] + scale / size[other]:
            low, high = min(v, other), max(v, other)
            less, more = sorted((firsts[low], firsts.pop(high)), key=len)
            for e in less:
                heapq.heappush(more, e)
            up[high], firsts[low] = low, more
            size[low], inner[low] = size[low] + size[high], w[i]
            todo.append(low)
    rows = [(v, r, size[r], inner[r], r in final) for v in own for r in (top(v),)]
    return pd.DataFrame(rows, columns=["vid", "cid", "n", "inner", "final"])


def grouped(live: DataFrame, state: DataFrame, scale: float, bounds: list[int]) -> DataFrame:
    """`settled` of each group of parts, which are cut at the bounds of their ids; an edge between two groups is known to both."""
    at = F.lit(0) if not bounds else F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in bounds]), lambda x: x <= F.col("vid")))
    known = state.select("vid", F.col("n").alias("n_"), F.col("inner").alias("in_"), at.alias("g_"))
    rows = live.select("a", "b", "e.*")
    for s in "ab":
        rows = rows.join(known.select(F.col("vid").alias(s), *[F.col(c).alias(c + s) for c in ("n_", "in_", "g_")]), s)
    rows = rows.withColumn("g", F.explode(F.array_distinct(F.array("g_a", "g_b"))))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return settled(part, int(key[0]), scale)

    return rows.groupBy("g").applyInPandas(run, "vid long, cid long, n long, inner double, final boolean")


def segments(nodes: DataFrame, edges: DataFrame, scale: float, min_size: int = 1, price: str = "w", most: int = 32, size: int = GROUP) -> DataFrame:
    """(vid, cid): what a pass over the edges in their order makes that unites two parts where the edge is, for either of them, no
    dearer than its dearest inner edge plus `scale` over its size; then parts under `min_size` join their cheapest neighbour, `most` times at most.

    The first outgoing edge of a part meets it as the pass would: all of its inner edges came before. If it is too dear for the part, all later ones are, and
    the part is final; if it is the first for both sides and dear to neither, they unite. Groups of about `size` parts of near ids settle that among themselves,
    all they can; each round cuts the parts that are left at other places, and every third settles one step for all parts at once, wherever their ids are.
    """
    start = nodes.select(F.col("vid").cast("long").alias("vid"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("inner"))
    every = graph.saved(ordered(edges, price))
    live, state, steps, turn = every, graph.saved(start), [], 0
    while not live.isEmpty():
        ends = live.select(F.explode(F.array("a", "b")).alias("vid")).distinct()
        near = graph.saved(state.join(ends, "vid", "left_semi"))
        groups = -(-near.count() // size)
        if groups > 1 and turn % 3 == 2:
            found = graph.saved(one_step(live, near, scale))
        else:
            shares = [(i + (0.5 if turn % 3 else 0.0)) / groups for i in range(groups)]
            bounds = near.approxQuantile("vid", [s for s in shares if s > 0], 0.1 / groups) if groups > 1 else []
            found = graph.saved(grouped(live, near, scale, sorted({int(x) for x in bounds})))
        names = found.filter("vid <> cid").select(F.col("vid").alias("old"), F.col("cid").alias("new"))
        final = found.filter("final").select(F.col("cid").alias("vid")).distinct()
        steps.append(names)
        # Edges of a final part go first, by the names that its members had.
        gone = found.filter("final").select("vid")
        beyond = live.join(gone.withColumnRenamed("vid", "a"), "a", "left_anti").join(gone.withColumnRenamed("vid", "b"), "b", "left_anti")
        new_live, new_state = graph.saved(contracted(beyond, names)), graph.saved(found.filter("vid = cid").join(final, "vid", "left_anti").select("vid", "n", "inner"))
        graph.discard(state, near, *([live] if live is not every else []))
        live, state, turn = new_live, new_state, turn + 1
    labels = graph.saved(merge.followed(start.select("vid", F.col("vid").alias("cid")), steps))
    return swallowed(labels, every, min_size, most) if min_size > 1 else labels


def one_step(live: DataFrame, state: DataFrame, scale: float) -> DataFrame:
    """(vid, cid, n, inner, final) after one decision for each part: the first edge is too dear, or first for both sides, or neither."""
    own = state.select(F.col("vid").alias("src"), (F.col("inner") + scale / F.col("n")).alias("bound"))
    near = graph.saved(cheapest(live).join(own, "src").withColumn("open", F.col("e.w") <= F.col("bound")))
    back = near.filter("open").select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    pairs = graph.saved(near.filter("open").join(back, ["src", "dst"], "left_semi").filter("src < dst").select("src", "dst", "e.w"))
    final = near.filter("NOT open").select(F.col("src").alias("vid"), F.lit(True).alias("final"))
    names = pairs.select(F.col("dst").alias("vid"), F.col("src").alias("cid"))
    named = state.select("vid").join(names, "vid", "left").select("vid", F.coalesce("cid", "vid").alias("cid"))
    kept = absorbed(state, pairs).join(final, "vid", "left").select(F.col("vid").alias("cid"), "n", "inner", F.coalesce("final", F.lit(False)).alias("final"))
    return named.join(kept, "cid").select("vid", "cid", "n", "inner", "final")


def absorbed(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parts (vid, n, inner) after dst of each pair (src, dst, w) went into src."""
    gone = pairs.join(state.select(F.col("vid").alias("dst"), F.col("n").alias("more")), "dst").select(F.col("src").alias("vid"), "more", "w")
    kept = state.join(pairs.select(F.col("dst").alias("vid")), "vid", "left_anti").join(gone, "vid", "left")
    return kept.select("vid", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("w", "inner").alias("inner"))


def swallowed(labels: DataFrame, every: DataFrame, min_size: int, most: int = 32) -> DataFrame:
    """Parts under `min_size` unite with the part beyond their first outgoing edge, all at once, again until none is left or none has a neighbour."""
    sizes = graph.saved(labels.groupBy(F.col("cid").alias("vid")).agg(F.count("*").alias("n")))
    live, steps = graph.saved(contracted(every, labels.select(F.col("vid").alias("old"), F.col("cid").alias("new")))), []
    for _ in range(most):
        small = sizes.filter(F.col("n") < min_size).select(F.col("vid").alias("src"))
        near = graph.saved(cheapest(live).join(small, "src", "left_semi").select("src", "dst"))
        if near.isEmpty():
            break
        parts = graph.pointed(near, sizes.select("vid"))
        names = parts.select(F.col("vid").alias("old"), F.col("cid").alias("new"))
        steps.append(names)
        new_sizes = graph.saved(sizes.join(parts, "vid").groupBy("cid").agg(F.sum("n").alias("n")).withColumnRenamed("cid", "vid"))
        new_live = graph.saved(contracted(live, names))
        graph.discard(sizes, live, near)
        sizes, live = new_sizes, new_live
    return graph.saved(merge.followed(labels, steps))
