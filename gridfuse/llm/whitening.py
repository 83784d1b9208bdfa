"""Operator 13: whitening of embeddings by matrix-free block Lanczos.

The covariance is never formed. A pass over the rows takes a block of b vectors, and every task adds up Xᵀ(X v) of its centred rows; the
sums of d * b numbers are added in groups of tasks and come to the driver, which holds the basis of the Krylov space (d * `most` numbers, a parameter).
A new block is made orthogonal to the whole basis, twice; columns that break down are replaced by random ones. Ritz pairs come from the basis and its
images, so residuals are those of the operator itself; passes go on until the residuals of all wanted pairs are small or the basis spans the whole space. A basis
of `most` vectors is replaced by its leading Ritz vectors. Centring is exact: n * x - S is taken in whole numbers.

Defined results: rows with a null vector, or a null or non-finite entry, are dropped; shorter vectors count as if entries of zero followed; rows with a null or
repeated vec_id stay; entries beyond 2**40 after scaling are held there; components number at most the dimensions; a component without variance has an eigenvalue of zero, a
null `whitened` and no part in `identity_error` (null if there is none); `deviation` is null where it doesn't fit in 64 bits, `deviation_exact` has it as a decimal up to 38 digits; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import common

#: Vectors of a block, of the basis, passes, and the residual, as a share of the largest eigenvalue, below which a pair is settled.
BLOCK, MOST, PASSES, TOLERANCE = 8, 256, 200, 1e-13
#: Tasks whose sums are added in one group.
GROUP = 64
#: Eigenvalues below this share of the trace count as zero.
ZERO = 1e-12
HELD = float(2**40)
#: Rows that a task turns into doubles at a time.
AT_ONCE = 4096


def whole_numbers(embeddings: DataFrame, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, x) of the rows that are left, x = floor(scale * entry) + shift, as a table in the shared folder."""
    value = F.col("embedding")
    fine = ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale).cast("double"), F.lit(-HELD)), F.lit(HELD)).cast("long") + shift
    rows = common.as_table(embeddings, "vec_id", "embedding").filter(value.isNotNull()).filter(fine)
    return common.cut(rows.select("vec_id", F.transform(value, held).alias("x")), "numbers")[0]


def matrices(batches: Iterator[pa.RecordBatch], d: int, shift: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their vectors as rows of a matrix; missing entries are entries of zero, `shift` after scaling."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            x = part.column("x")
            flat, n = x.flatten().to_numpy(zero_copy_only=False), np.diff(x.offsets.to_numpy())
            if (n == d).all():
                yield part, flat.reshape(-1, d).astype(np.int64)
            else:
                out = np.full((len(n), d), shift, np.int64)
                out[np.arange(d) < n[:, None]] = flat
                yield part, out


def summed(rows: DataFrame, one, kind: str) -> np.ndarray:
    """The sum over all rows of what `one` (batches -> array) makes of each task's: added in groups of GROUP tasks, then on the driver in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), one(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([out.astype(kind).tobytes()], pa.binary())], ["task", "sums"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(v, kind) for v in group.sort_values("task")["sums"]]
        return pd.DataFrame({"task": [int(group["task"].min())], "sums": [sum(parts[1:], parts[0]).tobytes()]})

    schema = "task long, sums binary"
    groups = rows.mapInArrow(run, schema).withColumn("g", F.expr(f"task div {GROUP}")).groupBy("g")
    found = groups.applyInPandas(lambda group: add(group[["task", "sums"]]), schema).orderBy("task").toPandas()
    parts = [np.frombuffer(v, kind) for v in found["sums"]]
    return sum(parts[1:], parts[0]) if parts else np.zeros(0, kind)


@dataclass
class Fitted:
    """Exact counts and sums, the exact total of squared deviations (times n**2), and the leading eigenpairs of the covariance."""

    n: int
    sums: list[int]
    squares: int
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    passes: int

    @property
    def trace(self) -> float:
        return self.squares / self.n**3


def exact_sums(rows: DataFrame, d: int, shift: int) -> tuple[int, list[int]]:
    """Rows and sums of each dimension. Numbers are added in two halves of 24 and more bits, so none overflows below 2**39 rows."""

    def one(batches):
        total = np.zeros((2, d), np.int64)
        n = 0
        for _, x in matrices(batches, d, shift):
            total += np.stack([(x >> 24).sum(0), (x & 0xFFFFFF).sum(0)])
            n += len(x)
        return np.concatenate((total.reshape(-1), [n])) if n else None

    found = summed(rows, one, "<i8")
    if not len(found):
        return 0, []
    high, low = found[:-1].reshape(2, d).tolist()
    return int(found[-1]), [(h << 24) + s for h, s in zip(high, low, strict=True)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64-bit integers where they fit, else in Python's."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if bound < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared(dev: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if dev.dtype != object:
        most = int(np.abs(dev).max(initial=0))
        if most * most * dev.shape[1] < 2**63:
            return (dev * dev).sum(1).tolist()
        if most < 2**54:  # in halves of 27 bits: each sum of products stays below 2**63 up to 2**9 dimensions
            high, low = dev >> 27, dev & (2**27 - 1)
            if dev.shape[1] <= 2**8:
                return [(a << 54) + (b << 28) + c for a, b, c in zip((high * high).sum(1).tolist(), (high * low).sum(1).tolist(), (low * low).sum(1).tolist(), strict=True)]
    return [sum(v * v for v in row) for row in dev.tolist()]


def total_squares(rows: DataFrame, d: int, shift: int, n: int, sums: list[int]) -> int:
    """The exact sum of all deviations: each task's total in pieces of 32 bits."""
    pieces = 16

    def one(batches):
        total, any_row = 0, False
        for _, x in matrices(batches, d, shift):
            total, any_row = total + sum(squared(deviations(x, n, sums))), True
        return np.array([(total >> (32 * i)) & 0xFFFFFFFF for i in range(pieces)], np.int64) if any_row else None

    return sum(int(v) << (32 * i) for i, v in enumerate(summed(rows, one, "<i8").tolist()))


def covariance_times(rows: DataFrame, d: int, shift: int, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """The covariance times a block of vectors, in one pass over the rows."""

    def one(batches):
        total, any_row = np.zeros(block.shape), False
        for _, x in matrices(batches, d, shift):
            centred = (deviations(x, n, sums) / n).astype(np.float64)
            total += centred.T @ (centred @ block)
            any_row = True
        return total.reshape(-1) if any_row else None

    return summed(rows, one, "<f8").reshape(block.shape) / n


def orthogonal(block: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns, orthogonal to the basis, and how many broke down: such a column is replaced by a random one, once the space has one left."""
    d, out, broken = len(block), basis, 0
    for column in block.T:
        if out.shape[1] >= d:
            break
        v, size = column, float(np.linalg.norm(column))
        for attempt in range(10):
            before = np.linalg.norm(v)
            for _ in range(3):
                v = v - out @ (out.T @ v)
            after = np.linalg.norm(v)
            if size > 0 and after > 1e-10 * max(before, size if attempt == 0 else before):
                break
            broken += attempt == 0
            v, size = random.standard_normal(d), 1.0
        out = np.column_stack((out, v / np.linalg.norm(v)))
    return out[:, basis.shape[1] :], broken


def lanczos(times, d: int, wanted: int, size: int = BLOCK, most: int = MOST, passes: int = PASSES, tolerance: float = TOLERANCE, seed: int = 13) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Leading eigenvalues, eigenvectors and residuals of a symmetric operator that `times` applies to a block, and the passes made."""
    random = np.random.default_rng(seed)
    wanted, size = min(wanted, d), min(size, d)
    most = min(d, max(most, 3 * max(wanted, size)))
    block, _ = orthogonal(random.standard_normal((d, size)), np.zeros((d, 0)), random)
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    values = vectors = residuals = None
    for made in range(1, passes + 1):
        image = times(block)
        basis, images = np.column_stack((basis, block)), np.column_stack((images, image))
        small = basis.T @ images
        theta, y = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-theta, kind="stable")
        theta, y = theta[order], y[:, order]
        ritz, moved = basis @ y, images @ y
        values, vectors = theta[:wanted], ritz[:, :wanted]
        residuals = np.linalg.norm(moved[:, :wanted] - vectors * values, axis=0)
        if basis.shape[1] >= d or (len(values) == wanted and (residuals <= tolerance * max(values[0], 1e-300)).all()):
            break
        if basis.shape[1] + size > most:  # the leading Ritz vectors stand for the whole basis
            keep = max(wanted, size)
            basis, images = ritz[:, :keep], moved[:, :keep]
            image = moved[:, :size] - ritz[:, :size] * theta[:size]
        block, _ = orthogonal(image, basis, random)
    return values, vectors / np.linalg.norm(vectors, axis=0), residuals, made


def fit(rows: DataFrame, wanted: int = 8, shift: int = 100_000, **options) -> Fitted | None:
    """Eigenpairs of the covariance of `whole_numbers`; None without rows or dimensions."""
    d = rows.agg(F.max(F.size("x")).alias("d")).first().d or 0
    n, sums = exact_sums(rows, d, shift) if d else (0, [])
    if not n:
        return None
    squares = total_squares(rows, d, shift, n, sums)
    values, vectors, residuals, passes = lanczos(lambda block: covariance_times(rows, d, shift, n, sums, block), d, wanted, **options)
    return Fitted(n, sums, squares, values, vectors, residuals, passes)


def whiten(rows: DataFrame, fitted: Fitted, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, deviation_exact, whitened, explained, identity_error, eigenvalue) of every row and component."""
    n, sums, d, trace, k = fitted.n, fitted.sums, len(fitted.sums), fitted.trace, len(fitted.values)
    live = fitted.values > ZERO * max(trace, 1e-300)
    scaled = fitted.vectors / np.sqrt(np.where(live, fitted.values, 1.0))

    def spread(batches):
        total, any_row = np.zeros((k + 1, k)), False
        for _, x in matrices(batches, d, shift):
            w = (deviations(x, n, sums) / n).astype(np.float64) @ scaled
            total += np.vstack((w.T @ w, w.sum(0)))
            any_row = True
        return total.reshape(-1) if any_row else None

    found = summed(rows, spread, "<f8").reshape(k + 1, k) / n
    off = np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k))[np.ix_(live, live)]
    error = float(off.max()) if off.size else None
    explained = np.where(live, fitted.values / (trace or 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches, d, shift):
            dev = deviations(x, n, sums)
            w = (dev / n).astype(np.float64) @ scaled
            squares = squared(dev)
            each = np.repeat(np.arange(len(x)), k)
            arrays = [
                part.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), n, np.int64)),
                pa.array([s if s < 2**63 else None for s in squares], pa.int64()).take(pa.array(each)),
                pa.array([Decimal(s) if s < 10**38 else None for s in squares], pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(w.reshape(-1), mask=np.tile(~live, len(x))),
                pa.array(np.tile(explained, len(x))),
                pa.array([error] * len(each), pa.float64()),
                pa.array(np.tile(fitted.values, len(x))),
            ]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    return rows.mapInArrow(run, SCHEMA)


SCHEMA = "vec_id long, component int, n long, deviation long, deviation_exact decimal(38,0), whitened double, explained double, identity_error double, eigenvalue double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(common.read(spark, sf_dir, "embeddings"))
    fitted = fit(rows)
    return whiten(rows, fitted) if fitted else spark.createDataFrame([], SCHEMA)
