"""Volumes with known labels and series, made by expressions over a range of voxels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """(vid, x, y, z), x running fastest."""
    rows = spark.range(nx * ny * nz).withColumnRenamed("id", "vid")
    return rows.select("vid", *[F.expr(e).cast("int").alias(n) for e, n in ((f"vid % {nx}", "x"), (f"(vid div {nx}) % {ny}", "y"), (f"vid div {nx * ny}", "z"))])


def linear(x, y, z, nx: int, ny: int, base: int = 0) -> Column:
    """The number of a place, x running fastest; places and numbers count from `base`."""
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    return ((x - base) + nx * ((y - base) + ny * (z - base)) + base).cast("long")


def place(lin, nx: int, ny: int, base: int = 0) -> list[Column]:
    """x, y and z of such a number."""
    at = (F.col(lin) if isinstance(lin, str) else lin) - base
    parts = (at % nx, F.floor(at / nx) % ny, F.floor(at / (nx * ny)))
    return [(p + base).cast("int").alias(c) for p, c in zip(parts, "xyz", strict=True)]


def normal(seed: int, *keys) -> Column:
    """A normal value that keys and seed fix, whatever the partitions."""
    u, v = (F.shiftrightunsigned(F.xxhash64(*keys, F.lit(2 * seed + j)), 11) / 2.0**53 for j in (0, 1))
    return F.sqrt(-2 * F.log1p(-u)) * F.cos(2 * F.pi() * v)


def checkerboard(voxels: DataFrame, k: int, block: int) -> DataFrame:
    """(vid, cid): blocks take the labels 1..k in turn along the diagonals."""
    return voxels.select("vid", (F.expr(f"(x div {block} + y div {block} + z div {block}) % {k}") + 1).cast("int").alias("cid"))


def layers(voxels: DataFrame, k: int, jitter: float = 0.0, seed: int = 1) -> DataFrame:
    """(vid, cid): k layers of equal depth along z, whose borders are blurred by `jitter`; null beyond the volume."""
    depth = (voxels.agg(F.max("z")).first()[0] or 0) + 1
    at = (F.col("z") + 1 + normal(seed, "vid") * jitter - 0.5) * k / depth
    return voxels.select("vid", F.when((at >= 0) & (at <= k), F.greatest(F.ceil(at), F.lit(1))).cast("int").alias("cid"))


def bands(voxels: DataFrame, k: int = 3) -> DataFrame:
    """(vid, cid): k bands of equal width along x."""
    width = (voxels.agg(F.max("x")).first()[0] or 0) + 1
    return voxels.select("vid", (F.floor(F.col("x") * k / width) + 1).cast("int").alias("cid"))


def cubes(voxels: DataFrame, side: int, per_axis: int) -> DataFrame:
    """(vid, cid): cubes of `side` voxels, numbered from 1 with x fastest."""
    return voxels.select("vid", F.expr(f"cast(x div {side} + {per_axis} * (y div {side} + {per_axis} * (z div {side})) + 1 as int)").alias("cid"))


def blob_centers(spark: SparkSession, dims: tuple[int, int, int], k: int, spread: tuple[float, float, float], seed: int = 1) -> DataFrame:
    """(cid, cx, cy, cz): random places, counted from 1, at least the spread (and 2) away from the borders."""
    rng = np.random.default_rng(seed)
    pad = [max(2, math.ceil(s)) for s in spread]
    rows = [(c + 1, *[float(rng.uniform(p, max(p, d - p + 1))) for d, p in zip(dims, pad, strict=True)]) for c in range(k)]
    return spark.createDataFrame(rows, "cid int, cx double, cy double, cz double")


def blobs(voxels: DataFrame, centers: DataFrame, spread: tuple[float, float, float], floor: float = 0.2) -> DataFrame:
    """(vid, cid, weight): the center of greatest weight exp(-sum((offset / spread)**2) / 2), and that weight over the greatest of all, at least `floor`.

    Places count from 1; ties go to the smaller label.
    """
    met = voxels.select("vid", *[(F.col(c) + 1).alias(c) for c in "xyz"]).crossJoin(F.broadcast(centers))  # k is a parameter
    far = sum(((F.col(c) - F.col(f"c{c}")) / s) * ((F.col(c) - F.col(f"c{c}")) / s) for c, s in zip("xyz", spread, strict=True))
    best = met.groupBy("vid").agg(F.min(F.struct(far.alias("far"), "cid")).alias("m")).select("vid", F.col("m.cid").alias("cid"), F.exp(-F.col("m.far") / 2).alias("w"))
    top = best.agg(F.max("w").alias("top"))
    return best.crossJoin(F.broadcast(top)).select("vid", "cid", F.greatest(F.col("w") / F.col("top"), F.lit(floor)).alias("weight"))  # one row


def patterns(k: int, n_time: int, kind: str = "orthogonal", seed: int = 1) -> np.ndarray:
    """A series for each of k labels: `orthogonal` (of squared length n_time), `harmonic` sines, or `random` mixtures; the last two peak at 1."""
    rng, t = np.random.default_rng(seed), np.linspace(0, 2 * math.pi, n_time)
    if kind == "orthogonal":
        if k > n_time:
            raise ValueError("there are no more orthogonal series than samples")
        return np.linalg.qr(rng.normal(size=(n_time, k)))[0].T * math.sqrt(n_time)
    if kind == "harmonic":
        out = np.stack([np.sin(rng.uniform(0.6, 1.6) * t + rng.uniform(0, 2 * math.pi)) for _ in range(k)])
    elif kind == "random":
        out = np.stack([a * np.sin(t) + b * np.cos(2 * t) + c for a, b, c in rng.normal(size=(k, 3))])
    else:
        raise ValueError("kind must be orthogonal, harmonic or random")
    return out / np.abs(out).max(1, keepdims=True)


def with_patterns(voxels: DataFrame, labels: DataFrame, series: np.ndarray, noise: float = 0.0, seed: int = 1, weight: str | None = None) -> DataFrame:
    """(vid, x, y, z, ts, cid): each voxel has its label's series, times its `weight` if that column of labels is named, plus normal noise; null labels have noise alone."""
    rows = voxels.join(labels, "vid")
    table = F.array(*[F.lit([float(v) for v in row]) for row in series])
    own = F.coalesce(F.get(table, F.col("cid") - 1), F.array_repeat(F.lit(0.0), series.shape[1]))
    scale = F.col(weight) if weight else F.lit(1.0)
    ts = F.transform(own, lambda v, t: v * scale + (normal(seed, "vid", t) * noise if noise else F.lit(0.0)))
    return rows.select("vid", "x", "y", "z", ts.alias("ts"), "cid")


def with_series(voxels: DataFrame, labels: DataFrame, n_time: int, noise: float = 0.1, seed: int = 1) -> DataFrame:
    """`with_patterns` of cosines of c half periods for label c, orthogonal among labels below n_time."""
    k = labels.agg(F.max("cid")).first()[0] or 1
    return with_patterns(voxels, labels, math.sqrt(2) * np.cos((np.arange(n_time) + 0.5) * np.arange(1, k + 1)[:, None] * math.pi / n_time), noise, seed)


def cube_volume(spark: SparkSession, n_time: int = 100, noise: float = 0.0, k: int = 27, side: int = 3, seed: int = 42) -> DataFrame:
    """k cubes (k a perfect cube) with orthogonal series of squared length n_time."""
    per_axis = round(k ** (1 / 3))
    if per_axis**3 != k:
        raise ValueError("k must be a perfect cube")
    voxels = grid(spark, *[per_axis * side] * 3)
    return with_patterns(voxels, cubes(voxels, side, per_axis), patterns(k, n_time, "orthogonal", seed), noise, seed)


def band_series(n_time: int) -> np.ndarray:
    """The three fixed series of `band_volume`: a sine, a square wave of height 0.8, a shifted sine of height 0.6."""
    t = np.linspace(0, 2 * math.pi, n_time)
    return np.stack([np.sin(t), 0.8 * np.sign(np.sin(3 * t)), 0.6 * np.sin(2 * t + math.pi / 4)])


def thirds(voxels: DataFrame, width: int) -> DataFrame:
    """(vid, cid): the three bands of `band_volume` along x."""
    third = [F.col("x") + 1 <= width * i / 3 for i in (1, 2)]
    return voxels.select("vid", F.when(third[0], 1).when(third[1], 2).otherwise(3).alias("cid"))


def band_volume(spark: SparkSession, dims: tuple[int, int, int] = (12, 12, 1), n_time: int = 80, noise: float = 0.15, seed: int = 1) -> DataFrame:
    voxels = grid(spark, *dims)
    return with_patterns(voxels, thirds(voxels, dims[0]), band_series(n_time), noise, seed)


def volume(spark: SparkSession, scenario: str = "blobs", dims: tuple[int, int, int] = (20, 20, 6), k: int = 4, n_time: int = 40, spread: tuple[float, float, float] = (3.0, 3.0, 2.0), noise: float = 0.1, amplitude: tuple[float, float] = (1.0, 1.0), kind: str = "orthogonal", block: int = 2, jitter: float = 0.1, seed: int = 1) -> DataFrame:
    """A volume of `blobs`, `layers` or `checkerboard` labels; each label's series is scaled by an amplitude from the range, blobs also by their weight."""
    voxels = grid(spark, *dims)
    ways = {"blobs": lambda: blobs(voxels, blob_centers(spark, dims, k, spread, seed), spread), "layers": lambda: layers(voxels, k, jitter, seed), "checkerboard": lambda: checkerboard(voxels, k, block)}
    if scenario not in ways:
        raise ValueError(f"scenario must be one of {sorted(ways)}")
    height = np.random.default_rng(seed + 1).uniform(*amplitude, size=(k, 1))
    return with_patterns(voxels, ways[scenario](), patterns(k, n_time, kind, seed) * height, noise, seed, "weight" if scenario == "blobs" else None)
