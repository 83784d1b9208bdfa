"""Forests, slices, feature neighbours, communities, growth and spectra: against SQL, sequential runs, brute force and closed forms."""

import heapq
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from gridfuse.functions import vectors as V
from gridfuse.operators import ensemble, forest, growth, local, louvain, measures, merge, methods, neighbours, series, slices, spatial, spectral
from gridfuse.plans import rounds as R
from gridfuse.sources import synthetic
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(R.ORACLES) - {"forest_segments"}))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{D}/embeddings.parquet'")
    ours, theirs = R.QUERIES[name](spark, D).toPandas(), con.execute(R.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x.sort_values(columns)[columns].to_numpy(float) for x in (ours, theirs))
    assert a.shape == b.shape
    np.testing.assert_allclose(a, b, atol=2e-6)


def pair_hash(a, b):
    x = ((a % forest.PRIME) * forest.LEFT + (b % forest.PRIME) * forest.RIGHT % forest.PRIME) % forest.PRIME
    return x * x % forest.PRIME


def sequential(n, edges, scale, min_size=1):
    """Kruskal's pass with bounds, one edge at a time."""
    part, inner = [{i} for i in range(n)], [0.0] * n
    at = list(range(n))
    tree = []
    for w, _, a, b in sorted((w, pair_hash(a, b), a, b) for a, b, w in edges):
        i, j = at[a], at[b]
        if i != j and all(w <= inner[p] + scale / len(part[p]) for p in (i, j)):
            part[i] |= part[j]
            inner[i] = w
            for v in part[j]:
                at[v] = i
            tree.append((a, b))
    return {frozenset(part[i]) for i in set(at)}, sorted(tree)


def as_parts(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.cid, set()).add(r.vid)
    return {frozenset(v) for v in out.values()}


@pytest.fixture(scope="module")
def tied(spark):
    """A small grid most of whose edges have equal prices."""
    rng = random.Random(1)
    v = synthetic.grid(spark, 5, 5, 3)
    edges = [(r.src, r.dst, rng.randrange(3) / 3 if rng.random() < 0.7 else rng.random()) for r in spatial.grid_edges(v, 6).collect()]
    return v, edges, spark.createDataFrame(edges, "src long, dst long, w double")


def test_forest_equals_sequential(tied):
    v, edges, table = tied
    labels, tree = forest.spanning(v, table)
    assert sorted((r.src, r.dst) for r in tree.collect()) == sequential(75, edges, 1e9)[1]
    assert labels.select("cid").distinct().count() == 1
    order = sorted((w, pair_hash(a, b), a, b) for a, b, w in edges)
    kept = {(a, b) for _, _, a, b in sorted(e for e in order if (e[2], e[3]) in set(sequential(75, edges, 1e9)[1]))[: 75 - 6]}
    assert as_parts(forest.cut(v, tree, 6)) == sequential(75, [(a, b, w) for a, b, w in edges if (a, b) in kept], 1e9)[0]
    assert tree.agg(F.max("round")).first()[0] <= math.ceil(math.log2(75))


def test_segments_equal_sequential(tied):
    v, edges, table = tied
    labels = forest.segments(v, table, 0.9)
    assert as_parts(labels) == sequential(75, edges, 0.9)[0]
    big = as_parts(forest.swallowed(labels, forest.ordered(table), 5))
    assert min(map(len, big)) >= 5 and all(any(s <= b for b in big) for s in sequential(75, edges, 0.9)[0])


def test_isolated_and_empty(spark):
    nodes, none = spark.range(3).withColumnRenamed("id", "vid"), spark.createDataFrame([], "src long, dst long, w double")
    labels, tree = forest.spanning(nodes, none)
    assert as_parts(labels) == {frozenset([i]) for i in range(3)} and tree.count() == 0
    assert as_parts(forest.segments(nodes, none, 1.0, 2)) == {frozenset([i]) for i in range(3)}
    assert as_parts(louvain.louvain(nodes, none)) == {frozenset([i]) for i in range(3)}


def test_slices(spark, tied):
    v, edges, table = tied
    flat = [(a, b, w) for a, b, w in edges if a // 25 == b // 25]
    labels = slices.segment_slices(v, table.join(spark.createDataFrame(flat, "src long, dst long, w double").select("src", "dst"), ["src", "dst"]), 0.5)
    assert as_parts(labels) == sequential(75, flat, 0.5)[0]
    rows = v.withColumn("ts", F.array(*[(F.pmod(F.xxhash64("vid", F.lit(j)), F.lit(1000)) / 500.0 - 1) for j in range(4)]))
    counts = slices.k_per_slice(rows, labels, 3).join(v, "vid").groupBy("z").agg(F.countDistinct("cid").alias("k")).collect()
    assert {r.k for r in counts} == {3}
    runs = [(labels.withColumn("cid", F.col("cid") + 1), None), (synthetic.checkerboard(v, 4, 2), None), (synthetic.checkerboard(v, 3, 3), v.select("vid", F.lit(0.5).alias("w")))]
    fused = slices.fuse(rows, runs, 0.3, 3, [rows.select("vid", "ts")] * 3, k=4, stitch=True)
    assert fused.select("cid").distinct().count() == 4 and fused.count() == 75
    per_slice = slices.fuse(rows, runs, 0.3, 3, [rows.select("vid", "ts")] * 3, k_slice=2).join(v, "vid").groupBy("z").agg(F.countDistinct("cid").alias("k")).collect()
    assert {r.k for r in per_slice} == {2}
    with pytest.raises(ValueError):
        slices.fuse(rows, runs[:1])
    # All parts alike: each column of slices becomes one.
    same = v.withColumn("ts", F.array(F.lit(1.0), F.lit(2.0)))
    whole = slices.segment_slices(v, slices.slice_edges(v).withColumn("w", F.lit(0.0)).select("src", "dst", "w"), 1.0)
    assert slices.stitched(same, whole).select("cid").distinct().count() == 1
    assert slices.stitched(same, whole, min_contact=26).select("cid").distinct().count() == 3


@pytest.mark.parametrize("pivots, tile", [(1, 1000), (5, 9), (40, 3)])
def test_feature_neighbours_are_exact(spark, pivots, tile):
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(size=(60, 5)), rng.normal(size=(50, 5)) * 0.05 + 3))
    x[70:80] = x[70]  # copies of one row
    rows = spark.createDataFrame([(i, [float(q) for q in r]) for i, r in enumerate(x)], "vid long, ts array<double>")
    got = {}
    for r in neighbours.feature_knn(rows, 4, pivots, tile).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(x)):
        d = np.sqrt(((u - u[i]) ** 2).sum(1))
        assert got[i] == [int(j) for j in np.lexsort((np.arange(len(x)), np.round(d, 12))) if j != i][:4]


def test_communities(spark):
    rng, n = np.random.default_rng(5), 90
    edges = [(i, j, 1.0) for i in range(n) for j in range(i) if rng.random() < (0.6 if i % 6 == j % 6 else 0.03)]
    table, nodes, history = spark.createDataFrame(edges, "src long, dst long, w double"), spark.range(n).withColumnRenamed("id", "vid"), []
    found = louvain.communities(nodes, table, [0.2, 1.0], history)
    assert history and all(after > before for step in history for before, after in step.values())
    truth = nodes.select("vid", (F.col("vid") % 6 + 1).alias("cid"))
    assert measures.accuracy(found.filter("g = 1").select("vid", (F.col("cid") + 1).alias("cid")), truth).first().ari == 1.0
    labels, gamma, k = louvain.to_k(nodes, table, 6)
    assert k == 6 and labels.select("cid").distinct().count() == 6


def test_growth_equals_one_queue(spark):
    rng = np.random.default_rng(3)
    xyz = [(i, j, k) for k in range(2) for j in range(2) for i in range(4)]
    ts, starts = rng.normal(size=(16, 5)), [(2, 1), (13, 2)]
    v = spark.createDataFrame([(i, *x, [float(q) for q in y]) for i, (x, y) in enumerate(zip(xyz, ts, strict=True))], "vid long, x int, y int, z int, ts array<double>")
    edges = spatial.grid_edges(v, 26)
    cost = V.region_distance("ts", "feat", local.space(), 4.0, 5.0)
    got = {r.vid: r.cid for r in growth.grow(v, spark.createDataFrame(starts, "vid long, cid int"), edges, cost, unit=True, share=0.0).collect()}
    near: dict = {}
    for r in edges.collect():
        near.setdefault(r.src, []).append(r.dst)
        near.setdefault(r.dst, []).append(r.src)
    x = np.array(xyz, float)
    sums = {c: [ts[v_].copy(), x[v_].copy(), 1] for v_, c in starts}
    queue, labels, best = [(i / (len(starts) + 1), v_, c) for i, (v_, c) in enumerate(starts)], {}, {}
    heapq.heapify(queue)
    while queue:
        d, at, c = heapq.heappop(queue)
        if at in labels:
            continue
        labels[at] = c
        s = sums[c]
        s[0], s[1], s[2] = s[0] + ts[at], s[1] + x[at], s[2] + 1
        feat, place = s[0] / np.linalg.norm(s[0]), s[1] / s[2]
        for u in near[at]:
            price = ((x[u] - place) ** 2).sum() / 4 + ((ts[u] - feat) ** 2).sum() / 5
            if u not in labels and price < best.get(u, np.inf):
                best[u] = price
                heapq.heappush(queue, (price, u, c))
    assert got == labels


def test_snic_on_noisy_regions(spark):
    """15 x 15 x 15 voxels, 8 samples, 4 regions of near places, oscillations that grow away from the middle of a region, noise of 0.15."""
    rng, d = np.random.default_rng(42), 15
    xyz = np.array([(i, j, k) for k in range(d) for j in range(d) for i in range(d)], float)
    c = xyz[rng.choice(len(xyz), 4, replace=False)]
    for _ in range(50):
        region = ((xyz[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([xyz[region == j].mean(0) for j in range(4)])
    t = np.arange(1, 9)
    wave = np.array([np.sin(2 * np.pi * r * t / 8) + 0.5 * np.cos(2 * np.pi * (r + 1) * t / 16) for r in range(1, 5)])
    far = np.sqrt(((xyz - c[region]) ** 2).sum(1))
    ts = wave[region] * (1 + 0.1 * far / d)[:, None] + rng.normal(0, 0.15, (len(xyz), 8))
    rows = [(i, *map(int, x), [float(q) for q in y], int(r) + 1) for i, (x, y, r) in enumerate(zip(xyz, ts, region, strict=True))]
    v = spark.createDataFrame(rows, "vid long, x int, y int, z int, ts array<double>, cid int")
    found = measures.accuracy(methods.snic(v.drop("cid"), 4, 5.0), v.select("vid", "cid")).first()
    assert found.ari > 0.4 and found.nmi > 0.4


def test_spectrum_of_a_torus(spark):
    edges = [(i, (i % 8 + 1) % 8 + 8 * (i // 8), 1.0) for i in range(48)] + [(i, i % 8 + 8 * ((i // 8 + 1) % 6), 1.0) for i in range(48)]
    nodes = spark.range(48).withColumnRenamed("id", "vid")
    found = spectral.leading(nodes, spark.createDataFrame(edges, "src long, dst long, w double"), 9, tolerance=1e-4)
    want = sorted(((math.cos(2 * math.pi * a / 8) + math.cos(2 * math.pi * b / 6)) / 2 for a in range(8) for b in range(6)), reverse=True)[:9]
    assert np.abs(found.values - want).max() < 1e-6 and (found.residuals <= 1e-4).all()
    x = np.array([[r[f"v{j}"] for j in range(9)] for r in found.vectors.collect()])
    assert np.abs(x.T @ x - np.eye(9)).max() < 1e-6


def test_commute_finds_cubes(spark):
    v = synthetic.cube_volume(spark, 40, 0.0, 8, 3)
    assert measures.accuracy(methods.commute(v.drop("cid"), 8, starts=4), v.select("vid", "cid")).first().ari > 0.9


def test_assignment_and_soft_consensus(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 7):
        gain = rng.integers(0, 9, (n, n))
        best = max(sum(gain[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        found = ensemble.assignment(gain)
        assert sorted(found) == list(range(n)) and sum(gain[i, c] for i, c in enumerate(found)) == best
    # Three partitions of six, the same two halves but for one voxel of the last, under different names.
    parts = [[1, 1, 1, 2, 2, 2], [9, 9, 9, 4, 4, 4], [2, 2, 1, 1, 1, 1]]
    tables = [spark.createDataFrame(list(enumerate(p)), "vid long, cid int") for p in parts]
    soft, hard = ensemble.soft_consensus(tables)
    assert as_parts(hard) == {frozenset((0, 1, 2)), frozenset((3, 4, 5))}
    assert {(r.vid, r.c): round(r.p, 6) for r in soft.collect()}[2, 1] == round(2 / 3, 6)
    assert as_parts(ensemble.temporal_consensus(tables)) == as_parts(hard)
    with pytest.raises(ValueError):
        ensemble.soft_consensus(tables[:1])


def test_one_dendrogram_many_cuts(spark):
    """Ward's merging of values that are all neighbours, one merge at a time; on a line heights never fall and cuts are nested."""
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=12), 3)
    v = spark.createDataFrame([(i, i, 0, 0, [float(q)]) for i, q in enumerate(x)], "vid long, x int, y int, z int, ts array<double>")
    every = spark.createDataFrame(list(itertools.combinations(range(12), 2)), "src long, dst long").withColumn("w", F.lit(0.0))
    merges = merge.dendrogram(merge.leaves(v), every)
    parts, found = [[i] for i in range(12)], {}
    while len(parts) > 1:
        price = {(i, j): len(a) * len(b) / (len(a) + len(b)) * (x[a].mean() - x[b].mean()) ** 2 for (i, a), (j, b) in itertools.combinations(enumerate(parts), 2)}
        i, j = min(price, key=price.get)
        parts = [p for n, p in enumerate(parts) if n not in (i, j)] + [parts[i] + parts[j]]
        found[len(parts)] = parts
    assert merges.count() == 11
    for k in (2, 5):
        assert as_parts(merge.cut_at(v, merges, k)) == {frozenset(p) for p in found[k]}
    line = merge.dendrogram(merge.leaves(v), spatial.grid_edges(v, 6).withColumn("w", F.lit(0.0)))
    few, many = (as_parts(merge.cut_at(v, line, k)) for k in (3, 6))
    assert len(few) == 3 and len(many) == 6 and all(any(m <= f for f in few) for m in many)


def test_cleaning_for_blocks(spark):
    v = spark.createDataFrame([(i, i, 0, 0, [float((i * 7 + t * t) % 11) for t in range(8)]) for i in range(5)], "vid long, x int, y int, z int, ts array<double>")
    assert all(len(r.ts) == 1 for r in series.clean_for_blocks(v, "robust").collect())
    assert all(abs(sum(r.ts)) < 1e-9 and sorted(set(np.diff(np.sort(r.ts)))) for r in series.clean_for_blocks(v, "spearman").collect())
    with pytest.raises(ValueError):
        series.clean_for_blocks(v, "cosine")


@pytest.mark.parametrize("scale", [0.9, 1.9])
def test_segments_do_not_depend_on_the_groups(spark, scale):
    v, rows = R.vox(spark, D).select("vid"), R.edges_d(spark, D).collect()
    table = spark.createDataFrame(rows, "src long, dst long, w double")
    want = sequential(500, [(r.src, r.dst, r.w) for r in rows], scale)[0]
    for size in (70, forest.GROUP):
        assert as_parts(forest.segments(v, table, scale, size=size)) == want


def test_steps_by_slabs_equal_steps_by_edges(spark):
    v = R.vox(spark, D)
    _, s = spectral.normalised(v, R.weights(spark, D))
    own = v.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0.0).alias("s"), F.lit(1.0).alias("own"))
    slab = spectral.slabs(v.select("vid"), 90)
    steps = s.withColumn("own", F.lit(0.0)).union(own).withColumn("slab", slab("dst"))
    block = v.select("vid", F.sin("vid").alias("p0"), F.cos("vid").alias("c0"))
    one, two = (spectral.stepped(block, steps, 1, 1.5, -0.25, -1.0, how).toPandas().sort_values("vid").to_numpy() for how in (None, slab))
    assert v.select(slab("vid")).distinct().count() > 4
    np.testing.assert_allclose(one, two, atol=1e-12)


def test_bounded_neighbours_in_a_tile():
    """Rows of another tile beyond the bound are left out, equal rows and ties included; no bound leaves the first k."""
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(150, 5)), rng.normal(size=(90, 5))
    b[40:60] = b[0]
    a[:3] = b[0]
    a_ids, b_ids = np.arange(150), np.arange(60, 150)[::-1].copy()
    bound = np.where(np.arange(150) % 4 == 0, np.nan, rng.uniform(0, 3, 150))
    found = set(zip(*(x.tolist() for x in neighbours.first_k(a, a_ids, b, b_ids, 4, bound)), strict=True))
    expected = set()
    for i in range(150):
        d = np.sqrt(((b - a[i]) ** 2).sum(1))
        near = sorted((float(d[j]), int(b_ids[j])) for j in range(90) if b_ids[j] != a_ids[i] and not d[j] > bound[i])[:4]
        expected |= {(i, j, x) for x, j in near}
    assert found == expected


def test_cheap_merges_come_before_dear_ones(spark):
    """9 and 11 are each other's cheapest at once, but all merges of the four small values are cheaper, also those of later rounds."""
    values = [0.0, 0.1, 0.25, 0.45, 9.0, 11.0]
    nodes = spark.createDataFrame([(i, 1, [v], 0.0) for i, v in enumerate(values)], "vid long, n long, ts array<double>, inner double")
    edges = spark.createDataFrame([(i, i + 1, 0.0) for i in range(5)], "src long, dst long, w double")
    assert as_parts(merge.to_k(nodes, edges, 3, "ward")) == {frozenset({0, 1, 2, 3}), frozenset({4}), frozenset({5})}


def test_supervoxels_follow_series_of_many_samples(spark):
    """Two noisy patterns of 64 samples meet at x = 4, the first split by places is at x = 5: with a fixed sigma1 of 1 the feature kernel is nil."""
    rng = np.random.default_rng(3)
    patterns = rng.normal(size=(2, 64))
    places = [(x, y, z) for z in range(3) for y in range(3) for x in range(10)]
    rows = [(i, x, y, z, (patterns[int(x >= 4)] + rng.normal(0, 0.5, 64)).tolist()) for i, (x, y, z) in enumerate(places)]
    v = spark.createDataFrame(rows, "vid long, x int, y int, z int, ts array<double>")
    assert as_parts(methods.supervoxels(v, 2)) == {frozenset(i for i, p in enumerate(places) if (p[0] >= 4) == right) for right in (False, True)}
