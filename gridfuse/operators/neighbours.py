"""Nearest neighbours by features, exactly and without a row for each pair: cells of pivots, bounds by the triangle inequality, tiles of vectors inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, groups

#: Pivots, and the most vectors of either side of a tile. A vector is sent once for each tile that it meets, so small tiles multiply what is shuffled.
PIVOTS, TILE = 32, 32768
#: Rows of a tile that are compared at once.
STRIP = 64


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with the nearest pivot as their cell, the distance to it (gap), and those to all pivots (far)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                far = np.sqrt(distances(np.stack(part["ts"].to_numpy()), pivots))
                cell = far.argmin(1)
                yield pd.DataFrame({"vid": part["vid"], "ts": part["ts"], "cell": cell, "gap": far[np.arange(len(far)), cell], "far": list(far)})

    return rows.mapInPandas(run, "vid long, ts array<double>, cell int, gap double, far array<double>")


def first_k(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of a, ids of b, distances) of the k rows of b nearest to each row of a, itself left out; ties go to the smaller id.

    With `bound`, a distance for each row of a (not a number: none), rows of b that are farther are left out.
    """
    out = []
    within = np.full(len(a), np.inf) if bound is None else np.where(np.isnan(bound), np.inf, bound * bound)
    # Products lose digits, so what is close to a limit is measured again.
    slack = 1e-9 * np.maximum(1, (a * a).sum(1) + (b * b).sum(1).max())
    for begin in range(0, len(a), STRIP):
        mine = slice(begin, begin + STRIP)
        rough, limit = distances(a[mine], b), within[mine].copy()
        rough[a_ids[mine, None] == b_ids[None]] = np.inf
        many = np.flatnonzero((rough <= (limit + slack[mine])[:, None]).sum(1) > k)
        if len(many) and len(b) > k:
            limit[many] = np.minimum(limit[many], np.partition(rough[many], k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((rough <= (limit + slack[mine])[:, None]) & np.isfinite(rough))
        exact = np.sqrt(((b[j] - a[begin + i]) ** 2).sum(1))
        order = np.lexsort((b_ids[j], exact, i))
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
        out.append((a_ids[begin + i[order]], b_ids[j[order]], exact[order]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def searched(asked: DataFrame, rows: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(src, dst, d): for each asked (vid, ts, cell, bound) its k nearest of the rows of that cell, from each tile of it, none farther than the bound (null: none).

    Either side of a cell is dealt into parts of about `tile` rows, and each pair of parts is a group of its own, so a crowded cell spreads.
    """
    dealt = {}
    for name, side in (("q", asked), ("r", rows)):
        dealt[name] = side.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias(f"n{name}"))
    sizes = dealt["q"].join(dealt["r"], "cell")  # a row for each pivot
    part = lambda n: F.pmod(F.xxhash64("vid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = asked.join(sizes, "cell").select("cell", part("nq").alias("p"), every("nr").alias("q"), "vid", "ts", "bound")
    # Other names, as both sides may come from one table.
    right = rows.join(sizes, "cell").select(F.col("cell").alias("of"), every("nq").alias("op"), part("nr").alias("oq"), F.col("vid").alias("id"), F.col("ts").alias("f"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"src": [], "dst": [], "d": []})
        found = first_k(np.stack(a["ts"].to_numpy()), a["vid"].to_numpy(), np.stack(b["f"].to_numpy()), b["id"].to_numpy(), k, a["bound"].to_numpy(float))
        return pd.DataFrame(dict(zip(("src", "dst", "d"), found, strict=True)))

    return left.groupBy("cell", "p", "q").cogroup(right.groupBy("of", "op", "oq")).applyInPandas(run, "src long, dst long, d double")


def feature_knn(rows: DataFrame, k: int, pivots: int = PIVOTS, tile: int = TILE, unit: bool = True) -> DataFrame:
    """(src, dst, rank, d): the k nearest rows (vid, ts) of each by the distance of features, of length one if `unit`; ties go to the smaller vid.

    Each row first asks its own cell; the k-th distance found there bounds what it must ask of others: cells all of whose rows are farther, by their least and
    greatest distance from the pivot, are left out, and so are rows beyond it, so a tile of another cell gives few rows. Exact whatever the pivots.
    """
    picked = rows.select(F.col("vid").cast("long").alias("vid"), (V.unit("ts") if unit else F.col("ts")).alias("ts"))
    picked = graph.saved(picked)
    sample = picked.orderBy(F.xxhash64("vid"), "vid").limit(pivots).collect()
    if not sample:
        return picked.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0).alias("rank"), F.lit(0.0).alias("d"))
    placed = graph.saved(in_cells(picked, np.array([r.ts for r in sample], float)))
    cells = placed.groupBy("cell").agg(F.min("gap").alias("least"), F.max("gap").alias("most")).collect()  # a row for each pivot
    near = graph.saved(searched(placed.select("vid", "ts", "cell", F.lit(None).cast("double").alias("bound")), placed.select("vid", "ts", "cell"), k, tile))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst")))
    bound = ranked.filter(F.col("n") == k).select(F.col("src").alias("vid"), F.col("d").alias("bound"))
    limits = F.array(*[F.struct(F.lit(c.cell).alias("cell"), F.lit(float(c.least)).alias("least"), F.lit(float(c.most)).alias("most")) for c in sorted(cells)])
    gap = lambda c: F.greatest(F.get("far", c.cell) - c.most, c.least - F.get("far", c.cell))
    more = placed.join(bound, "vid", "left").withColumn("ask", F.filter(limits, lambda c: (c.cell != F.col("cell")) & (F.col("bound").isNull() | (gap(c) <= F.col("bound") + 1e-9))))
    asked = more.select("vid", "ts", F.explode(F.transform("ask", lambda c: c.cell)).alias("cell"), "bound")
    found = near.union(searched(asked, placed.select("vid", "ts", "cell"), k, tile))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d", "dst")))
    return ranked.filter(F.col("rank") <= k).select("src", "dst", F.col("rank").cast("int").alias("rank"), "d")


def knn_graph(near: DataFrame, places: DataFrame, alpha: float, side: float, weighting: str = "gaussian") -> DataFrame:
    """(src, dst, w), src < dst: alpha * max(0, 1 - distance of unit features) + (1 - alpha) * closeness of places (vid, cx, cy, cz).

    Closeness is exp(-gap**2 / (2 side**2)), or with "binary" 1 within `side`. Where both are among each other's nearest the weights add up.
    """
    if weighting not in ("gaussian", "binary"):
        raise ValueError("weighting must be gaussian or binary")
    at = places.select(F.col("vid").alias("src"), F.struct("cx", "cy", "cz").alias("a"))
    rows = near.select("src", "dst", "d").join(at, "src").join(at.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    gap = sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in ("cx", "cy", "cz"))
    close = V.heat(gap, side) if weighting == "gaussian" else (gap <= side * side).cast("double")
    w = alpha * F.greatest(1 - F.col("d"), F.lit(0.0)) + (1 - alpha) * close
    return rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def block_nodes(voxels: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Means of blocks (vid, n, ts, cx, cy, cz), vid counting them from 1, and the block (vid, cid) of each voxel."""
    key = groups.block_labels(voxels, side)
    spans = key.agg(*[(F.max(c) + 1).alias(c) for c in ("bx", "by")]).first()
    number = (F.col("bx") + (spans.bx or 1) * (F.col("by") + (spans.by or 1) * F.col("bz").cast("long")) + 1).cast("long")
    own = graph.saved(key.select("vid", number.alias("cid")))
    nodes = groups.centers(voxels, own).select(F.col("cid").alias("vid"), "n", F.col("feat").alias("ts"), "cx", "cy", "cz")
    return graph.saved(nodes), own


def block_graph(voxels: DataFrame, side: int, k: int, alpha: float = 0.5, weighting: str = "gaussian", projection: str | None = None, components: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges between blocks whose mean features are among each other's k nearest, the blocks, and each voxel's block. Features may be projected first ("dct" or "rp")."""
    from gridfuse.operators import embed

    nodes, own = block_nodes(voxels, side)
    rows = nodes.select("vid", "ts")
    if projection:
        n_time = rows.select(F.size("ts").alias("n")).first().n
        if 0 < components < n_time:
            rows = embed.block_projection(rows, n_time, components, projection)
    return graph.saved(knn_graph(feature_knn(rows, k), nodes, alpha, side, weighting)), nodes, own
