"""Transforms of series. What concerns one voxel is an expression on its array and shuffles nothing; only sums over voxels do."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V


def samples(voxels: DataFrame) -> DataFrame:
    """(vid, t, v), t from 0."""
    return voxels.select("vid", F.posexplode("ts").alias("t", "v"))


def promoted(values: DataFrame) -> DataFrame:
    """Voxels with one value `v` as voxels with a series of one sample."""
    return values.withColumn("ts", F.array(F.col("v").cast("double"))).drop("v")


def with_series(voxels: DataFrame, ts: Column) -> DataFrame:
    return voxels.withColumn("ts", ts)


def over_voxels(voxels: DataFrame) -> DataFrame:
    """(m, s): one row with the mean and the spread of each time over all voxels, as arrays; partial sums are combined before the shuffle."""
    stats = samples(voxels).groupBy("t").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("t", "m", "s")))
    return stats.agg(ordered.alias("o")).select(F.transform("o", lambda x: x.m).alias("m"), F.transform("o", lambda x: x.s).alias("s"))


def center_volumes(voxels: DataFrame) -> DataFrame:
    """Takes the spatial mean of each time off."""
    rows = voxels.crossJoin(F.broadcast(over_voxels(voxels)))  # one row
    return rows.withColumn("ts", F.zip_with("ts", "m", lambda x, m: x - m)).drop("m", "s")


def scale_times(voxels: DataFrame) -> DataFrame:
    """z-score of each time across voxels; a spread of 0 or none gives 0."""
    rows = voxels.crossJoin(F.broadcast(over_voxels(voxels)))  # one row
    centered = F.zip_with("ts", "m", lambda x, m: x - m)
    return rows.withColumn("ts", F.zip_with(centered, "s", lambda x, s: F.when(s > 0, x / s).otherwise(0.0))).drop("m", "s")


def scaled(ts, floor: float = 1e-8) -> Column:
    """z-score over time; a spread under `floor`, or none, divides by 1."""

    def parts(a) -> Column:
        return V.let(F.struct(V.mean(a).alias("m"), F.coalesce(V.deviation(a), F.lit(0.0)).alias("s")), lambda p: F.transform(a, lambda x: (x - p.m) / F.when(p.s < floor, 1.0).otherwise(p.s)))

    return V.let(V.col(ts), parts)


def detrended(ts) -> Column:
    """Residual of the least-squares line over t; a single sample leaves 0."""

    def parts(a) -> Column:
        n = F.size(a)
        slope = F.aggregate(F.transform(a, lambda x, i: x * (i - (n - 1) / 2)), F.lit(0.0), lambda s, x: s + x) / F.nullif(n * (n * n - 1) / 12, F.lit(0))
        line = F.struct(V.mean(a).alias("m"), F.coalesce(slope, F.lit(0.0)).alias("b"), ((n - 1) / 2).alias("c"))
        return V.let(line, lambda p: F.transform(a, lambda x, i: x - p.m - p.b * (i - p.c)))

    return V.let(V.col(ts), parts)


def demeaned(ts) -> Column:
    return V.let(V.col(ts), lambda a: V.let(V.mean(a), lambda m: F.transform(a, lambda x: x - m)))


def cosines(n_time: int, n: int) -> np.ndarray:
    """Orthonormal cosines, a row each, the first constant; at most n_time of them."""
    k, t = np.arange(min(n, n_time))[:, None], np.arange(n_time)[None, :]
    return np.where(k == 0, math.sqrt(1 / n_time), math.sqrt(2 / n_time)) * np.cos(math.pi * (t + 0.5) * k / n_time)


def polynomials(n_time: int, degree: int) -> np.ndarray:
    """Orthonormal polynomials on [-1, 1], a row each, the first constant; at most n_time of them."""
    powers = np.vander(np.linspace(-1, 1, n_time) if n_time > 1 else np.zeros(1), min(degree, n_time - 1) + 1, increasing=True)
    q, r = np.linalg.qr(powers)
    return (q * np.where(np.diag(r) < 0, -1, 1)).T


def basis_table(spark: SparkSession, basis: np.ndarray) -> DataFrame:
    """(t, k, b) of a basis with a row for each k."""
    return spark.createDataFrame([(t, k, float(basis[k, t])) for k in range(basis.shape[0]) for t in range(basis.shape[1])], "t int, k int, b double")


def literal(basis: np.ndarray) -> Column:
    """A small matrix as a literal array of its rows."""
    return F.array(*[F.lit([float(x) for x in row]) for row in basis])


def coefficients(ts, basis: np.ndarray) -> Column:
    """Inner products with the rows of a basis."""
    return V.let(V.col(ts), lambda a: F.transform(literal(basis), lambda b: V.dot(a, b)))


def residual(ts, basis: np.ndarray) -> Column:
    """What an orthonormal basis leaves of a series."""

    def parts(a) -> Column:
        fit = F.aggregate(literal(basis), F.transform(a, lambda x: x * 0.0), lambda s, b: V.let(V.dot(a, b), lambda c: F.zip_with(s, b, lambda x, y: x + c * y)))
        return F.zip_with(a, fit, lambda x, f: x - f)

    return V.let(V.col(ts), parts)


def detrend_time(voxels: DataFrame, method: str, n_time: int, degree: int = 2, n_basis: int = 4) -> DataFrame:
    """Voxels without their trend, by `linear`, `poly` of a degree, or `dct` with a number of cosines."""
    ways = {"linear": lambda: detrended("ts"), "poly": lambda: residual("ts", polynomials(n_time, degree)), "dct": lambda: residual("ts", cosines(n_time, n_basis))}
    if method not in ways:
        raise ValueError(f"method must be one of {sorted(ways)}")
    return voxels.withColumn("ts", ways[method]())


def split_half(ts) -> Column:
    """Correlation of even with odd samples; 0 where there is none."""

    def parts(a) -> Column:
        half = lambda odd: F.filter(F.slice(a, 1, F.floor(F.size(a) / 2).cast("int") * 2), lambda x, i: i % 2 == odd)
        return F.when(F.size(a) < 4, 0.0).otherwise(F.coalesce(V.let(F.struct(half(0).alias("e"), half(1).alias("o")), lambda p: V.correlation(p.e, p.o)), F.lit(0.0)))

    return V.let(V.col(ts), parts)


def smooth_z(rows: DataFrame, value: str, share: float = 0.5) -> DataFrame:
    """(1 - share) of a voxel, share / 2 of each neighbour above and below; an edge stands for its missing neighbour. `value` is a number or an array."""
    w = Window.partitionBy("x", "y").orderBy("z")
    near = [F.coalesce(F.when(f("z", 1).over(w) == F.col("z") + d, f(value, 1).over(w)), F.col(value)) for f, d in ((F.lag, -1), (F.lead, 1))]
    if dict(rows.dtypes)[value].startswith("array"):
        both = F.zip_with(near[0], near[1], lambda a, b: a + b)
        return rows.withColumn("smooth", F.zip_with(value, both, lambda v, n: (1 - share) * v + share / 2 * n))
    return rows.withColumn("smooth", (1 - share) * F.col(value) + share / 2 * (near[0] + near[1]))


def masked(voxels: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), origin: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: bool = True) -> DataFrame:
    """(vid, x, y, z, mx, my, mz, ts) of the voxels in the mask (`mask` > 0), places also in millimetres; NaN and null samples count as 0, times are z-scored if asked."""
    inside = voxels.filter("mask > 0") if "mask" in voxels.columns else voxels
    clean = F.transform("ts", lambda x: F.coalesce(F.nanvl(x.cast("double"), F.lit(0.0)), F.lit(0.0)))
    rows = inside.select("vid", "x", "y", "z", *[(F.col(c) * d + o).cast("double").alias(f"m{c}") for c, d, o in zip("xyz", spacing, origin, strict=True)], clean.alias("ts"))
    return scale_times(rows) if scale else rows


def clean_for_blocks(voxels: DataFrame, metric: str = "pearson") -> DataFrame:
    """Spatial means and each voxel's line taken off. With `spearman` the series are then ranks, so that products of unit series are rank correlations;
    with `robust` a series is its one robust location."""
    if metric not in ("pearson", "spearman", "robust"):
        raise ValueError("metric must be pearson, spearman or robust")
    rows = center_volumes(voxels).withColumn("ts", detrended("ts"))
    if metric == "pearson":
        return rows
    return rows.withColumn("ts", demeaned(V.ranks("ts")) if metric == "spearman" else F.array(V.huber_location("ts")))
