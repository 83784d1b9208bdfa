"""Hard negatives and whitening against brute force, on odd vectors, repeated rows, ties and empty tables."""

import numpy as np
import pytest
from gridfuse.llm import hard_negatives, whitening
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, row string, x int"


def odd_rows(n=260, d=40, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((4, d))
    rows = []
    for i in range(n):
        v = (centers[i % 4] + 0.9 * rng.standard_normal(d)) / 4
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(0, 4)), "x", 1))
    rows[7] = (7, None, 1, "x", 1)
    rows[8] = (8, [float("nan"), *rows[9][1][1:]], 1, "x", 1)
    rows[10] = (10, [float("inf"), *rows[9][1][1:]], 1, "x", 1)
    rows[11] = (11, [None, *rows[9][1][1:]], 1, "x", 1)
    rows[12] = (12, rows[9][1], None, "x", 1)
    rows[13] = (13, rows[9][1][:33], 2, "x", 1)
    rows[14] = (14, [], 2, "x", 1)
    rows += [rows[50], rows[51], (None, rows[9][1], 2, "x", 1), (1000, rows[50][1], rows[50][2], "x", 1), (1001, [0.0] * d, 3, "x", 1)]
    return rows


def whole(values, scale, d):
    return np.array([int(np.floor(scale * np.float64(np.float32(c)))) for c in values] + [0] * (d - len(values)), np.int64)


def good(values):
    return values is not None and all(v is not None and np.isfinite(v) for v in values)


def brute_negatives(rows, every, d=40):
    rows = [(v, whole(e, 256, d), (c + 1) % 10 if v % 7 == 0 else c) for v, e, c, *_ in rows if v is not None and c is not None and good(e)]
    out = []
    for i, (anchor, a, label) in enumerate(rows):
        if anchor % every:
            continue
        scored = sorted((-int(a @ x), v, j) for j, (v, x, _) in enumerate(rows) if j != i)
        for s, p, _ in [t for t in scored if rows[t[2]][2] == label][:5]:
            found = [(v, -t) for t, v, j in scored if rows[j][2] != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(anchor, p, r + 1, v, -s, t) for r, (v, t) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"row_size": 17, "anchor_size": 3, "chunk": 7}])
def test_hard_negatives(spark, sizes):
    rows = odd_rows()
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = hard_negatives.scaled(spark.createDataFrame(rows, SCHEMA), label)
    got = sorted(map(tuple, hard_negatives.mine(scaled, every=10, **sizes).collect()))
    assert got == brute_negatives(rows, 10) and len(got) > 50


def test_hard_negatives_query(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, str(tmp_path)).collect())) == brute_negatives(rows, 50)
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "embeddings.parquet"))
    assert hard_negatives.op12_hard_negatives(spark, str(tmp_path / "none")).count() == 0


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for top in (100, 2**20, 2**28):
        a, b = rng.integers(-top, top, (5, 9)), rng.integers(-top, top, (4, 9))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert hard_negatives.product(a, b).tolist() == want
        kind, data = hard_negatives.packed(a)
        assert (hard_negatives.unpacked(kind, data).reshape(a.shape) == a).all()


def brute_whitening(rows, d=40):
    x = np.array([whole(e, 1024, d) + 100_000 for _, e, *_ in rows if good(e)])
    n, sums = len(x), x.sum(0)
    dev = n * x - sums
    covariance = (dev / n).T @ (dev / n) / n
    values, vectors = np.linalg.eigh(covariance)
    return n, dev, values[::-1], vectors[:, ::-1], np.trace(covariance)


def test_whitening(spark, tmp_path):
    rows = odd_rows()
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op13_whitening(spark, str(tmp_path)).toPandas()
    n, dev, values, vectors, trace = brute_whitening(rows)
    assert len(out) == 8 * n and (out["n"] == n).all() and set(out["component"]) == set(range(1, 9))
    want = {}
    for (v, e, *_), row in zip([r for r in rows if good(r[1])], dev, strict=True):
        want.setdefault(v, []).append((int((row * row).sum()), row / n @ vectors[:, :8] / np.sqrt(values[:8])))
    sign = None
    for v, part in out.groupby("vec_id", dropna=False):
        v = None if v != v else int(v)
        assert sorted(part[part.component == 1].deviation) == sorted(d for d, _ in want[v])
        w = part[part.deviation == part.deviation.iloc[0]].sort_values("component").whitened.to_numpy()[:8] if len(part) == 8 else None
        if w is not None:
            expected = want[v][0][1]
            sign = np.sign(w * expected) if sign is None else sign
            assert np.abs(w * sign - expected).max() < 1e-8
    assert np.abs(out.groupby("component").explained.first() / (values[:8] / trace) - 1).max() < 1e-9
    assert out["identity_error"].max() < 1e-9
    assert (out["deviation_exact"].astype("int64") == out["deviation"]).all()


def test_lanczos_converges_before_the_space_is_spanned():
    rng = np.random.default_rng(8)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.concatenate(([50, 40, 40, 30, 20, 10], rng.random(294)))
    matrix = (q * values) @ q.T
    passes = []
    found, vectors, residuals, made = whitening.lanczos(lambda b: passes.append(1) or matrix @ b, 300, 6, size=4, most=40, tolerance=1e-11)
    assert np.abs(found - [50, 40, 40, 30, 20, 10]).max() < 1e-8 and (residuals < 1e-8).all()
    assert made == len(passes) < 40 and np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-10


def test_lanczos_restarts_on_breakdown():
    # The first block spans a space that the operator never leaves, and two of its columns are equal.
    matrix = np.diag([9.0, 8.0, 7.0, 6.0, 0.0, 0.0, 0.0, 0.0])
    found, vectors, residuals, _ = whitening.lanczos(lambda b: matrix @ b, 8, 8, size=2)
    assert np.abs(found - np.diag(matrix)).max() < 1e-12 and (residuals < 1e-12).all()
    block, broken = whitening.orthogonal(np.eye(8)[:, [0, 0, 1]], np.eye(8)[:, [1]], np.random.default_rng(0))
    whole = np.column_stack((np.eye(8)[:, [1]], block))
    assert broken == 2 and np.abs(whole.T @ whole - np.eye(4)).max() < 1e-12


@pytest.mark.parametrize("rows,live", [([(1, [0.5, 0.25], 0, "x", 1)] * 3, 0), ([(1, [0.5, 0.25], 0, "x", 1), (2, [0.5, 0.75], 0, "x", 1)], 1), ([(1, [], 0, "x", 1)], 0), ([(1, None, 0, "x", 1)], 0), ([(1, [3e38, -3e38], 0, "x", 1), (2, [0.0, 1.0], 0, "x", 1)], 1)])
def test_whitening_without_variance(spark, tmp_path, rows, live):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = whitening.op13_whitening(spark, str(tmp_path)).collect()
    d = max((len(r[1]) for r in rows if r[1]), default=0)
    assert len(out) == len(rows) * d
    assert all((r.whitened is not None) == (r.component <= live) for r in out)
    assert all((r.identity_error is None) == (live == 0) and (not live or r.identity_error < 1e-9) for r in out)


def test_large_deviations_are_exact():
    x = np.array([[2**40, -(2**40), 5], [1, 2, 3]])
    for n in (2, 10**5, 10**9):
        sums = [int(v) for v in x.sum(0)]
        want = [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
        assert whitening.squared(whitening.deviations(x, n, sums)) == want
