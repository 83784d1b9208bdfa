"""Leading eigenvectors of a graph by Chebyshev-filtered subspace iteration, and the commute-time embedding.

A block of vectors is a table (vid, one column each). A step multiplies it by the graph: edges join the block on one end and sums go to the
other, one aggregation for all columns. Some steps in a row are a Chebyshev filter, which damps what lies below the wanted part of the spectrum; a
Rayleigh-Ritz step on matrices of the number of columns squared then rotates the block, and residuals decide when to stop.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.operators import graph, spatial

#: Steps of a filter, filters at most, the residual at which a pair is settled, and columns beyond those wanted.
DEGREE, FILTERS, TOLERANCE, EXTRA = 8, 40, 1e-6, 4
#: Nodes of near ids that one task multiplies at a time.
SLAB = 8192


@dataclass
class Spectrum:
    """Eigenvalues of D**-1/2 W D**-1/2, falling, their vectors (vid, g, v0, v1, ...), of length one each, g the degree, residuals and filters made."""

    values: np.ndarray
    vectors: DataFrame
    residuals: np.ndarray
    filters: int


def columns(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{j}" for j in range(n)]


def normalised(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vid, g) degrees, and (src, dst, s) with s = w / sqrt(g of src * g of dst) from both ends; a node without edges has a loop of weight one."""
    both = spatial.both_ways(edges.select("src", "dst", F.col("w").cast("double").alias("w")).filter("src <> dst AND w > 0"))
    g = nodes.select("vid").join(both.groupBy("src").agg(F.sum("w").alias("g")).withColumnRenamed("src", "vid"), "vid", "left")
    g = graph.saved(g)
    known = g.filter("g IS NOT NULL")
    s = both.join(known.select(F.col("vid").alias("src"), F.col("g").alias("a")), "src").join(known.select(F.col("vid").alias("dst"), F.col("g").alias("b")), "dst")
    loops = g.filter("g IS NULL").select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(1.0).alias("s"))
    return g.fillna(1.0, ["g"]), graph.saved(s.select("src", "dst", (F.col("w") / F.sqrt(F.col("a") * F.col("b"))).alias("s")).union(loops))


def slabs(nodes: DataFrame, size: int = SLAB) -> Callable[[str], Column]:
    """Which run of about `size` nodes of near ids a column of ids belongs to."""
    parts = -(-nodes.count() // size)
    bounds = nodes.approxQuantile("vid", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    cuts = [F.lit(int(x)).cast("long") for x in sorted(set(bounds))]
    return lambda c: F.size(F.filter(F.array(*cuts), lambda x: x <= F.col(c))) if cuts else F.lit(0)


def stepped(block: DataFrame, steps: DataFrame, n: int, scale: float, shift: float, before: float, slab: Callable[[str], Column] | None = None) -> DataFrame:
    """The block (vid, p*, c*) after p <- c and c <- scale * S c + shift * c + before * p.

    The table of steps holds each node's row to itself too (own = 1), so one join and one sum make both. With `slab` the join is one of whole slabs, by the column
    `slab` of the steps (that of dst): a task sums up what all nodes of a slab give to each node, so what is shuffled is about the block, not a row of the block for each edge.
    """
    old, new = columns("p", n), columns("c", n)
    if slab is None:
        rows = steps.join(block.withColumnRenamed("vid", "dst"), "dst")
        own = F.col("own")
        sums = [F.sum(own * F.col(c)).alias(p) for p, c in zip(old, new, strict=True)]
        sums += [F.sum((F.col("s") * scale + own * shift) * F.col(c) + own * before * F.col(p)).alias(f"n{c}") for p, c in zip(old, new, strict=True)]
        return rows.groupBy(F.col("src").alias("vid")).agg(*sums).withColumnsRenamed({f"n{c}": c for c in new})

    def run(x: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        at = pd.Index(x["vid"]).get_indexer(edges["dst"])
        code, ids = pd.factorize(edges["src"])
        s, own = edges["s"].to_numpy() * scale + edges["own"].to_numpy() * shift, edges["own"].to_numpy()
        self, out = np.flatnonzero(own), {"vid": np.asarray(ids, np.int64)}
        for p, c in zip(old, new, strict=True):
            value = x[c].to_numpy()
            out[p] = np.bincount(code[self], value[at[self]], len(ids))
            out[c] = np.bincount(code, s * value[at], len(ids)) + before * np.bincount(code[self], x[p].to_numpy()[at[self]], len(ids))
        return pd.DataFrame(out)[["vid", *old, *new]]

    schema = "vid long, " + ", ".join(f"{c} double" for c in [*old, *new])
    given = block.withColumn("slab", slab("vid")).groupBy("slab").cogroup(steps.groupBy("slab")).applyInPandas(run, schema)
    return given.groupBy("vid").agg(*[F.sum(c).alias(c) for c in [*old, *new]])


def products(block: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """pᵀp, pᵀc and cᵀc over all rows; each task sends one matrix of 2n * 2n."""
    names = columns("p", n) + columns("c", n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2 * n, 2 * n))
        for part in batches:
            x = part[names].to_numpy()
            total += x.T @ x
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pd.DataFrame({"i": i, "j": j, "v": total.reshape(-1)})

    found = block.select(*names).mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    whole = np.zeros((2 * n, 2 * n))
    whole[found["i"], found["j"]] = found["v"]
    return whole[:n, :n], whole[:n, n:], whole[n:, n:]


def rotated(block: DataFrame, y: np.ndarray, only_p: bool = False) -> DataFrame:
    """p times the columns of y as c, with p of zero; with `only_p` as p alone. A product of matrices inside each task."""
    n, m = y.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = part[columns("p", n)].to_numpy() @ y
            out = pd.DataFrame(x, columns=columns("p" if only_p else "c", m))
            if not only_p:
                out = pd.concat([pd.DataFrame(np.zeros((len(x), m)), columns=columns("p", m)), out], axis=1)
            out.insert(0, "vid", part["vid"].to_numpy())
            yield out

    names = columns("p", m) if only_p else columns("p", m) + columns("c", m)
    return block.select("vid", *columns("p", n)).mapInPandas(run, "vid long, " + ", ".join(f"{c} double" for c in names))


def ritz(block: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values, falling, the rotation, and residuals, of a block with c = S p."""
    gram, middle, outer = products(block, n)
    size = np.sqrt(np.diag(gram))
    values, vectors = np.linalg.eigh(gram / np.outer(size, size))
    keep = values > 1e-12 * values.max()  # columns that have become dependent go
    back = (vectors[:, keep] / np.sqrt(values[keep])) / size[:, None]
    small = back.T @ ((middle + middle.T) / 2) @ back
    theta, z = np.linalg.eigh(small)
    order = np.argsort(-theta)
    theta, y = theta[order], (back @ z)[:, order]
    square = np.einsum("ij,ik,kj->j", y, outer, y) - theta**2
    return theta, y, np.sqrt(np.maximum(square, 0))


def leading(nodes: DataFrame, edges: DataFrame, wanted: int, degree: int = DEGREE, filters: int = FILTERS, tolerance: float = TOLERANCE, extra: int = EXTRA, seed: int = 1) -> Spectrum:
    """The `wanted` greatest eigenvalues of the normalised graph and their vectors; the first is 1, of the roots of the degrees."""
    total = nodes.count()
    n = min(total, wanted + extra)
    wanted = min(wanted, total)
    g, s = normalised(nodes, edges)
    own = nodes.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0.0).alias("s"), F.lit(1.0).alias("own"))
    slab = slabs(nodes)
    steps = graph.saved(s.withColumn("own", F.lit(0.0)).union(own).withColumn("slab", slab("dst")))

    def noise(j: int) -> Column:
        return F.xxhash64(F.col("vid"), F.lit(seed), F.lit(j)) / 2.0**63

    zero = [F.lit(0.0).alias(c) for c in columns("p", n)]
    block = g.select("vid", *zero, F.sqrt("g").alias("c0"), *[noise(j).alias(f"c{j}") for j in range(1, n)])
    block = graph.saved(stepped(block, steps, n, 1.0, 0.0, 0.0, slab))
    theta, y, residuals = ritz(block, n)
    made = 0
    for made in range(1, filters + 1):
        low = min(max(theta[-1], -0.9), theta[min(wanted, len(theta)) - 1] - 1e-9)
        middle, half = (low - 1) / 2, (low + 1) / 2
        n = y.shape[1]
        x = stepped(rotated(block, y), steps, n, 1 / half, -middle / half, 0.0, slab)
        for _ in range(degree - 1):
            x = stepped(x, steps, n, 2 / half, -2 * middle / half, -1.0, slab)
        new = graph.saved(stepped(x, steps, n, 1.0, 0.0, 0.0, slab))
        graph.discard(block)
        block = new
        theta, y, residuals = ritz(block, n)
        if len(theta) >= wanted and (residuals[:wanted] <= tolerance).all():
            break
    found = rotated(block, y[:, :wanted], only_p=True).withColumnsRenamed({f"p{j}": f"v{j}" for j in range(wanted)}).join(g, "vid")
    vectors = graph.saved(found)
    graph.discard(block, steps, s)
    return Spectrum(theta[:wanted], vectors, residuals[:wanted], made)


def commute_times(nodes: DataFrame, edges: DataFrame, components: int, **options) -> tuple[DataFrame, Spectrum]:
    """(vid, ts): coordinates whose squared distances are commute times: vector / sqrt(degree) * sqrt(volume / (1 - eigenvalue)), without those of eigenvalue one."""
    found = leading(nodes, edges, components + 1, **options)
    volume = found.vectors.agg(F.sum("g")).first()[0] or 1.0
    used = [(j, float(np.sqrt(volume / (1 - v)))) for j, v in enumerate(found.values) if v < 1 - 1e-9]
    at = [F.col(f"v{j}") / F.sqrt("g") * f for j, f in used] or [F.lit(0.0)]
    return graph.saved(found.vectors.select("vid", F.array(*at).alias("ts"))), found
