"""Local, sketch, flow and measure operators with SQL against DuckDB; the other methods, sources and the stream by properties."""

import struct

import duckdb
import numpy as np
import pytest
from gridfuse.functions import vectors as V
from gridfuse.operators import cluster, embed, groups, measures
from gridfuse.plans import more as M
from gridfuse.sources import synthetic, volumes
from gridfuse.streaming import assign
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(M.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{D}/embeddings.parquet'")
    ours, theirs = M.QUERIES[name](spark, D).toPandas(), con.execute(M.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).to_numpy(float) for x in (ours, theirs))
    assert a.shape == b.shape
    np.testing.assert_allclose(a, b, atol=2e-6)


@pytest.fixture(scope="module")
def bands(spark):
    """Three bands of 2 x 4 x 2 voxels with orthogonal series."""
    v = synthetic.grid(spark, 6, 4, 2)
    return synthetic.with_series(v, synthetic.bands(v), 16, 0.05).cache()


@pytest.mark.parametrize("method, options", [("snic", {}), ("flash3d", {"rounds": 1}), ("mcl", {"rounds": 4}), ("acsc", {"refinements": 1}), ("commute", {"starts": 2}), ("rena_plus", {}), ("slice_msf", {}), ("g3s", {}), ("corr_slic", {"dimensions": 8}), ("brs_slic", {"dimensions": 8}), ("supervoxels", {"rounds": 3})])
def test_method_labels_every_voxel(spark, bands, method, options):
    found = cluster.cluster(bands.drop("cid"), 3, method, **options)
    rows = found.toPandas()
    assert rows.vid.is_unique and len(rows) == 48
    assert sorted(rows.cid.unique()) == list(range(1, rows.cid.nunique() + 1))
    if method in ("slice_msf", "rena_plus"):
        assert groups.agreement(groups.contingency(found, bands)).first().ari > 0.99


def test_components_keep_lengths(spark, bands):
    basis = embed.Components(bands, 16, 1.0).basis
    np.testing.assert_allclose(basis @ basis.T, np.eye(len(basis)), atol=1e-9)
    lengths = embed.compressed(bands, 5).select(V.norm("ts").alias("n")).toPandas().n
    np.testing.assert_allclose(lengths, 1)


def test_matching_is_greedy(spark):
    cells = [(1, 1, 5), (1, 2, 9), (2, 1, 4), (2, 2, 9), (3, 1, 7), (3, 3, 1)]
    found = measures.matching(spark.createDataFrame(cells, "a int, b int, n long")).collect()
    assert sorted(map(tuple, found)) == [(1, 2, 9), (3, 1, 7)]


def test_suggestions():
    assert measures.suggest(60_000, 100, "speed") == {"method": "slice_msf", "n_clusters": 168, "memory_mb": 48}
    assert measures.suggest(10_000, 10)["method"] == "slic"
    with pytest.raises(ValueError):
        measures.suggest(1, 1, "other")


def test_reads_volumes(spark, tmp_path):
    values = np.arange(12, dtype="<i2").reshape(3, 2, 1, 2, order="F")
    header = bytearray(352)
    struct.pack_into("<i", header, 0, 348)
    struct.pack_into("<8h", header, 40, 4, 3, 2, 1, 2, 1, 1, 1)
    struct.pack_into("<h", header, 70, 4)
    struct.pack_into("<3f", header, 108, 352, 2, 1)
    (tmp_path / "a.nii").write_bytes(bytes(header) + values.tobytes(order="F"))
    rows = {r.vid: list(r.ts) for r in volumes.read_nifti(spark, f"{tmp_path}/a.nii").collect()}
    assert rows[4] == [9.0, 21.0] and len(rows) == 6


def test_stream_labels_as_batch(spark, bands, tmp_path):
    rows = bands.select("vid", "x", "y", "z", "ts")
    rows.write.parquet(f"{tmp_path}/in")
    centers = groups.centers(rows, bands.select("vid", "cid")).cache()
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assign.label_stream(stream, centers, 3.0, 0.1, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out").select("vid", "cid")
    assert found.join(bands.select("vid", F.col("cid").alias("truth")), "vid").filter("cid = truth").count() == 48


def test_stream_labels_far_voxels(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 0, [0.0]), (2, 90, 0, 0, [5.0]), (3, 0, 90, 90, [0.1])], "vid long, x int, y int, z int, ts array<double>")
    centers = spark.createDataFrame([(1, [0.0], 0.0, 0.0, 0.0), (2, [5.0], 30.0, 0.0, 0.0)], "cid long, feat array<double>, cx double, cy double, cz double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assign.label_stream(stream, centers, 3.0, 0.1, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("vid", "cid").collect()) == [(1, 1), (2, 2), (3, 1)]


def test_running_centers_count_each_batch_once(spark, tmp_path):
    """Means follow the batches in their order, as in a sequential run; a batch that is run again changes nothing."""
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 12)), int(rng.integers(0, 12)), int(rng.integers(0, 12)), [float(v) for v in rng.integers(-8, 9, 3)]) for i in range(90)]
    schema = "vid long, x int, y int, z int, ts array<double>"
    centers = [(1, 2, [4.0, 4.0, 4.0], 3.0, 3.0, 3.0), (2, 1, [-4.0, -4.0, -4.0], 9.0, 9.0, 9.0)]
    start = spark.createDataFrame(centers, "cid long, n long, feat array<double>, cx double, cy double, cz double")
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assign.running_centers(stream, start, 12.0, 0.5, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()

    held = {c: np.array([n, x * n, y * n, z * n, *(v * n for v in f)]) for c, n, f, x, y, z in centers}
    seen = {r.vid: (r.cid, r.batch) for r in spark.read.parquet(f"{tmp_path}/out/labels").collect()}
    assert len(seen) == 90 and {b for _, b in seen.values()} == {0, 1, 2}
    for number in range(3):
        now = {c: h[1:] / h[0] for c, h in held.items()}
        for vid, x, y, z, ts in rows:
            if seen[vid][1] == number:
                cost = {c: ((np.array(ts) - m[3:]) ** 2).sum() + ((np.array([x, y, z]) - m[:3]) ** 2).sum() * 0.25 / 144 for c, m in now.items()}
                assert min(cost, key=cost.get) == seen[vid][0]
                held[seen[vid][0]] += np.array([1.0, x, y, z, *ts])
    sums = lambda n: {(r.cid, r.pos): r.v for r in spark.read.parquet(f"{tmp_path}/out/sums/version={n}").collect()}
    expected = {(c, p): v for c, h in held.items() for p, v in enumerate(h.tolist())}
    assert sums(2) == expected
    last = spark.createDataFrame([r for r in rows if seen[r[0]][1] == 2], schema)
    assign.add_batch(last, 2, start, 12.0, 0.5, f"{tmp_path}/out")
    assert sums(2) == expected
    found = {r.cid: r for r in assign.means(spark.read.parquet(f"{tmp_path}/out/sums/version=2")).collect()}
    assert all(found[c].n == h[0] and np.allclose([found[c].cx, found[c].cy, found[c].cz, *found[c].feat], h[1:] / h[0]) for c, h in held.items())
    assign.add_batch(last.limit(0), 3, start, 12.0, 0.5, f"{tmp_path}/out")
    assert sums(3) == expected
