"""Every core query with SQL against DuckDB, and properties of the clustering methods."""

import duckdb
import numpy as np
import pytest
from gridfuse.operators import cluster
from gridfuse.plans import queries as Q

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{D}/embeddings.parquet'")
    ours, theirs = Q.QUERIES[name](spark, D).toPandas(), con.execute(Q.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).to_numpy(float) for x in (ours, theirs))
    assert a.shape == b.shape
    np.testing.assert_allclose(a, b, atol=2e-6)


@pytest.mark.parametrize("method", ["slic", "rena"])
def test_cluster_labels_every_voxel(spark, method):
    found = cluster.cluster(Q.voxels(spark, D), 12, method).toPandas()
    assert found.vid.is_unique and len(found) == 500
    assert sorted(found.cid.unique()) == list(range(1, found.cid.nunique() + 1))
    assert method != "rena" or found.cid.nunique() == 12


def test_cluster_rejects_wrong_arguments(spark):
    with pytest.raises(ValueError):
        cluster.cluster(Q.voxels(spark, D), 0)
    with pytest.raises(ValueError):
        cluster.cluster(Q.voxels(spark, D), 5, "other")
