"""Sources, sketches, graphs, seeds, reports and single steps with SQL against DuckDB; results, defaults and trials by properties."""

import duckdb
import numpy as np
import pytest
from gridfuse.operators import embed, exact, graph, groups, result, seeds, series
from gridfuse.plans import wider as W
from gridfuse.sources import synthetic, volumes
from pyspark.sql import functions as F

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(W.ORACLES) - set(W.RECOVERY)))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{D}/embeddings.parquet'")
    ours, theirs = W.QUERIES[name](spark, D).toPandas(), con.execute(W.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    texts = [c for c in columns if ours[c].dtype == object or str(ours[c].dtype).startswith("str")]
    numbers = [c for c in columns if c not in texts]
    a, b = (x.sort_values(columns)[texts].astype(str).to_numpy().tolist() for x in (ours, theirs))
    assert a == b
    a, b = (x.sort_values(columns)[numbers].to_numpy(float) for x in (ours, theirs))
    assert a.shape == b.shape
    np.testing.assert_allclose(a, b, atol=2e-6)


@pytest.mark.parametrize("method", ["rena", "supervoxels"])
def test_methods_recover_planted_regions(spark, method):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{D}/embeddings.parquet'")
    ours, theirs = W.QUERIES[f"recovery_{method}"](spark, D).toPandas(), con.execute(W.ORACLES[f"recovery_{method}"]).df()
    assert ours.sort_values("vid")[["vid", "cid"]].to_numpy().tolist() == theirs.sort_values("vid")[["vid", "cid"]].to_numpy().tolist()


def test_series_are_not_shuffled(spark):
    v = W.vox(spark, D)
    for column in (series.scaled("ts"), series.detrended("ts"), series.residual("ts", series.cosines(64, 4)), series.split_half("ts")):
        plan = v.select("vid", column.alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_contract_is_checked(spark):
    v = W.vox(spark, D)
    assert result.checked(v, 500)["n_voxels"] == 500
    for rows, k in ((v, 0), (v, 501), (v.filter("vid < 0"), 1), (v.union(v), 3), (v.withColumn("ts", F.when(F.col("vid") == 3, F.slice("ts", 1, 5)).otherwise(F.col("ts"))), 3), (v.withColumn("ts", F.transform("ts", lambda x: F.lit(float("nan")))), 3), (v.drop("x"), 3)):
        with pytest.raises(ValueError):
            result.checked(rows, k)


def test_parameters_have_common_names():
    assert result.renamed("supervoxels", {"K": 5, "alpha": 0.25, "iterations": 3}) == {"k": 5, "spatial_weight": 0.75, "max_iterations": 3}
    assert result.renamed("snic", {"compactness": 20}) == {"spatial_weight": 0.9}
    assert result.renamed("slice_msf", {"target_k_global": 9, "k": 4}) == {"k": 4}


def test_splits_and_merges_lead_to_k(spark):
    v = W.vox(spark, D)
    for k in (1, 7, 60):
        found = exact.exact_k(v, W.labels(spark, D), k).toPandas()
        assert len(found) == 500 and sorted(found.cid.unique()) == list(range(1, k + 1))


def test_linkage_is_wards():
    x = np.array([[0.0], [1.0], [10.0], [12.0], [30.0]])
    merges = exact.linkage(np.abs(x - x.T))
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (0, 2), (0, 4)]
    assert exact.cut(merges, 5, 3).tolist() == [1, 1, 2, 2, 3] and exact.cut(merges, 5, 1).tolist() == [1] * 5


def test_component_counts(spark):
    v = W.vox(spark, D)
    assert embed.elbow_count(np.array([9.0, 8.9, 1.0, 0.9, 0.8])) == 3
    assert 1 <= embed.component_count(v, 20) <= 20 and 1 <= embed.component_count(v, 20, "elbow") <= 20


def test_spaced_is_the_greedy_choice(spark):
    rows = [(i, (i * 7) % 11, (i * 5) % 13, i % 3, (i * 31) % 17) for i in range(60)]
    found = [r.vid for r in seeds.spaced(spark.createDataFrame(rows, "vid long, x int, y int, z int, g int"), F.col("g"), 3.0).orderBy("o", "vid").collect()]
    kept = []
    for v in sorted(rows, key=lambda r: (r[4], r[0])):
        if all(sum((a - b) ** 2 for a, b in zip(v[1:4], k[1:4])) > 9 for k in kept):
            kept.append(v)
    assert found == [k[0] for k in kept]


def test_volumes_and_trial_rows(spark, tmp_path):
    v = synthetic.volume(spark, "layers", (4, 4, 6), 3, 8, jitter=0.0)
    assert v.groupBy("cid").count().count() == 3
    rows = result.trials(spark, ["rena", "none"], [0.0], k=8, side=2, n_time=16)
    result.write_rows(rows, f"{tmp_path}/rows", "csv")
    back = {r.method: r for r in spark.read.option("header", True).csv(f"{tmp_path}/rows").collect()}
    assert back["rena"].error is None and float(back["rena"].ari) == 1 and "ValueError" in back["none"].error
    made = volumes.write_nifti(v, v.select("vid", "cid"), f"{tmp_path}/nii", (4, 4, 6), only=2).first()
    assert volumes.read_nifti(spark, made.path).filter("ts[0] = 1").count() == 32


def test_nifti_keeps_to_the_rows_of_an_unfinished_slice(spark, tmp_path):
    spark.read.parquet(f"{D}/embeddings.parquet").filter("vec_id < 456 AND vec_id <> 37").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = W.QUERIES["nifti_round_trip"](spark, str(tmp_path)).select("vid", "cid").toPandas().sort_values("vid")
    want = W.labels(spark, str(tmp_path)).toPandas().sort_values("vid")
    assert got.to_numpy().tolist() == want.to_numpy().tolist()


def test_nearest_voxels_meet_only_those_around(spark):
    v = W.vox(spark, D).filter("vid % 7 = 0 AND NOT (x BETWEEN 2 AND 7 AND y BETWEEN 2 AND 7)")
    points = seeds.grid_points(v, (3, 4, 3), True)
    found = {r.p: r.vid for r in seeds.nearest_voxels(v, points).collect()}
    rows, asked = v.select("vid", "x", "y", "z").collect(), points.collect()
    assert found == {p.p: min(((r.x - p.px) ** 2 + (r.y - p.py) ** 2 + (r.z - p.pz) ** 2, r.vid) for r in rows)[1] for p in asked}


def test_clusters_that_share_a_region_are_split_and_merged(spark):
    v = graph.saved(W.planted(spark, D))
    wrong = v.select("vid", F.expr("CASE WHEN cid = 2 AND vid % 2 = 0 THEN 4 WHEN cid = 4 THEN 3 ELSE cid END").alias("cid")).transform(graph.saved)
    k = wrong.select("cid").distinct().count()
    assert k == v.select("cid").distinct().count()
    found = exact.resettled(v.drop("cid"), wrong, k)
    table = groups.contingency(v.select("vid", "cid"), found)
    assert table.count() == k and groups.agreement(table).first().ari == 1
