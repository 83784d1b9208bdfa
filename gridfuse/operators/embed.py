"""Shorter features of series: polynomial residuals, cosine sketches, hash bits, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import series


def gathered(long: DataFrame, key: str, at: str, value: str, name: str = "ts") -> DataFrame:
    """Rows (key, at, value) as one array a key, in the order of `at`."""
    return long.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda s: s[value]).alias(name))


def sketch(voxels: DataFrame, n_time: int, r: int) -> DataFrame:
    """(vid, ts): unit vectors of cosine coefficients 1..r of detrended z-scores."""
    z = voxels.select("vid", series.scaled(series.detrended("ts")).alias("ts"))
    return z.select("vid", series.coefficients("ts", series.cosines(n_time, r + 1)[1:]).alias("ts")).select("vid", V.unit("ts").alias("ts"))


def cosine_embedding(voxels: DataFrame, n_time: int, d: int) -> DataFrame:
    """(vid, ts): unit vectors of cosine coefficients 1..d of the series as they are."""
    return voxels.select("vid", series.coefficients("ts", series.cosines(n_time, d + 1)[1:]).alias("ts")).select("vid", V.unit("ts").alias("ts"))


def splitmix(x: int) -> int:
    """The published splitmix64 finaliser."""
    m = 2**64 - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def hash_projection(n_time: int, bins: int, seed: int = 1) -> np.ndarray:
    """(bins, n_time) with one sign a time, in the bin that a hash of the time picks; each row's mean times its sum of signs is taken off by the caller's demeaning."""
    out = np.zeros((bins, n_time))
    for t in range(n_time):
        z = splitmix((seed + t * 0x9E3779B97F4A7C15) & (2**64 - 1))
        out[z % bins, t] = 1.0 if z >> 32 & 1 else -1.0
    return out


def count_sketch(voxels: DataFrame, n_time: int, bins: int, seed: int = 1, repeats: int = 1, whiten: bool = False) -> DataFrame:
    """(vid, ts): unit vectors of signed sums of the demeaned series over hashed times, summed over `repeats` hashes and scaled by their root.

    With `whiten` each component has its mean over voxels taken off and is divided by its spread first.
    """
    basis = sum(hash_projection(n_time, bins, splitmix(seed + r)) for r in range(repeats)) / np.sqrt(repeats)
    rows = voxels.select("vid", series.coefficients(series.demeaned("ts"), basis).alias("ts"))
    if whiten:
        rows = rows.crossJoin(F.broadcast(series.over_voxels(rows)))  # one row
        rows = rows.select("vid", F.zip_with(F.zip_with("ts", "m", lambda x, m: x - m), "s", lambda x, s: x / (F.coalesce(s, F.lit(0.0)) + 1e-8)).alias("ts"))
    return rows.select("vid", V.unit("ts").alias("ts"))


def embedding_size(n_voxels: int, n_time: int, least: int = 16, most: int = 128) -> int:
    """Components for this many voxels: eight times their binary logarithm, in steps of 8, within bounds and never over the length of the series."""
    wanted = 8 * round(max(least, min(most, 8 * np.log2(max(2, n_voxels)))) / 8)
    return int(max(1, min(wanted, n_time - 1 if n_time > 1 else 1)))


def embedding_sizes(n_voxels: Column, n_time: Column, least: int = 16, most: int = 128) -> Column:
    """`embedding_size` of each row."""
    wanted = 8 * F.bround(F.greatest(F.lit(least), F.least(F.lit(most), 8 * F.log2(F.greatest(n_voxels, F.lit(2))))) / 8)
    return F.greatest(F.lit(1), F.least(wanted, F.when(n_time > 1, n_time - 1).otherwise(1))).cast("int")


def bit_pairs(coefficients: int, bits: int) -> list[tuple[int, int]]:
    """Which two coefficients each bit compares, by a multiplicative rule."""
    return [((7 * b + 1) % coefficients, (7 * b + 2 + b % (coefficients - 1)) % coefficients) for b in range(bits)]


def hash_bits(voxels: DataFrame, n_time: int, coefficients: int = 12, bits: int = 64) -> DataFrame:
    """(vid, h): bit b tells whether one cosine coefficient of the z-scored series is over another. With 128 bits there is a second long, h2."""
    coefs = voxels.select("vid", series.coefficients(series.scaled("ts"), series.cosines(n_time, coefficients)).alias("c"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")

    def word(pairs: list) -> Column:
        asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(b).alias("b")) for b, (i, j) in enumerate(pairs)])
        return F.aggregate(asked, none, lambda h, p: h.bitwiseOR(F.when(F.get("c", p.i) > F.get("c", p.j), F.call_function("shiftleft", one, p.b)).otherwise(none)))

    pairs = bit_pairs(coefficients, bits)
    return coefs.select("vid", *[word(pairs[i : i + 64]).alias("h" if i == 0 else f"h{i // 64 + 1}") for i in range(0, bits, 64)])


def gram(voxels: DataFrame) -> DataFrame:
    """(s, t, g): sums over voxels of the products of two times; each task sends one matrix of T * T at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            if len(rows):
                x = np.stack(rows.ts.to_numpy()).astype(float)
                held = x.T @ x if held is None else held + x.T @ x
        if held is not None:
            s, t = np.indices(held.shape).reshape(2, -1)
            yield pd.DataFrame({"s": s, "t": t, "g": held.reshape(-1)})

    return voxels.select("ts").mapInPandas(run, "s int, t int, g double").groupBy("s", "t").agg(F.sum("g").alias("g"))


class Components:
    """Leading directions of z-scored (or plain) columns, fitted once and applied to any voxels of the same length.

    Fitting needs the Gram matrix, one row a pair of times, which doesn't grow with the voxels.
    """

    def __init__(self, voxels: DataFrame, most: int, share: float = 0.95, scale: bool = True):
        moments = series.over_voxels(voxels).first()
        n_time = len(moments.m or [])
        self.mean = np.array(moments.m or [], float) if scale else np.zeros(n_time)
        spread = np.array([x or 0.0 for x in moments.s or []], float)
        self.spread = np.where(spread < 1e-8, 1.0, spread) if scale else np.ones(n_time)
        cells = gram(self.prepared(voxels)).toPandas()
        dense = np.zeros((n_time, n_time))
        if len(cells):
            dense[cells.s, cells.t] = cells.g
        values, vectors = np.linalg.eigh(dense)
        self.values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        self.count = min(most, cumulative_count(self.values, share), n_time)
        vectors = vectors[:, : self.count]
        # A direction's greatest entry is positive, so that runs agree.
        self.basis = (vectors * np.where(vectors[np.abs(vectors).argmax(0), range(self.count)] < 0, -1, 1)).T if self.count else np.zeros((0, n_time))

    def prepared(self, voxels: DataFrame) -> DataFrame:
        m, s = (F.lit([float(x) for x in v]) for v in (self.mean, self.spread))
        return voxels.withColumn("ts", F.zip_with(F.zip_with("ts", m, lambda x, y: x - y), s, lambda x, y: x / y))

    def transform(self, voxels: DataFrame) -> DataFrame:
        """(vid, ts): unit rows of the components."""
        rows = self.prepared(voxels).select("vid", series.coefficients("ts", self.basis).alias("ts"))
        return rows.select("vid", V.unit("ts").alias("ts"))


def cumulative_count(values: np.ndarray, share: float) -> int:
    """The fewest leading values that hold `share` of the sum."""
    return int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12)) + 1


def elbow_count(values: np.ndarray) -> int:
    """Where the values bend most: the greatest second difference."""
    return int(np.argmax(np.diff(values, 2))) + 2 if len(values) > 2 else len(values)


def component_count(voxels: DataFrame, most: int = 50, method: str = "variance", share: float = 0.95) -> int:
    values = Components(voxels, most, share).values[:most]
    if method not in ("variance", "elbow"):
        raise ValueError("method must be variance or elbow")
    return elbow_count(values) if method == "elbow" else min(most, cumulative_count(values, share))


def compressed(voxels: DataFrame, most: int = 15, share: float = 0.95) -> DataFrame:
    """(vid, ts): unit rows of the leading components of z-scored times."""
    return Components(voxels, most, share).transform(voxels)


def random_projection(voxels: DataFrame, n_time: int, n: int, seed: int = 123) -> DataFrame:
    """(vid, ts): products with n normal vectors over the root of n."""
    basis = np.random.default_rng(seed).normal(size=(n, n_time)) / np.sqrt(n)
    return voxels.select("vid", series.coefficients("ts", basis).alias("ts"))


def block_projection(blocks: DataFrame, n_time: int, n: int, method: str = "dct", seed: int = 1) -> DataFrame:
    """Shorter features of block means before their neighbours are searched: leading cosines, or a random projection."""
    if method not in ("dct", "rp"):
        raise ValueError("method must be dct or rp")
    if method == "rp":
        return random_projection(blocks, n_time, n, seed)
    return blocks.select("vid", series.coefficients("ts", series.cosines(n_time, n)).alias("ts"))


def knn_mean(voxels: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(vid, ts): mean of a voxel and its first k - 1 neighbours."""
    asked = near.filter(F.col("rank") < k).select("src", "dst").union(voxels.select("vid", "vid"))
    rows = asked.join(voxels.select(F.col("vid").alias("dst"), "ts"), "dst").groupBy(F.col("src").alias("vid")).agg(F.collect_list("ts").alias("all"))
    total = F.aggregate(F.slice("all", 2, 1 << 20), F.col("all")[0], lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    return rows.select("vid", F.transform(total, lambda x: x / F.size("all")).alias("ts"))
