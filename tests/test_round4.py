"""Round 4's findings; not run on the code before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import exact, graph, growth, local, louvain, measures, methods, neighbours, result, spatial, spectral
from gridfuse.sources import synthetic


class Seen(Exception):
    pass


def test_commute_components_follow_k_alone(spark, monkeypatch):
    def seen(nodes, edges, components, **options):
        raise Seen(components)

    monkeypatch.setattr(spectral, "commute_times", seen)
    v = synthetic.cube_volume(spark, 10, 0.0, 8, 3).drop("cid")
    with pytest.raises(Seen) as found:
        methods.commute(v, 8)
    assert found.value.args == (4,)


def regions(spark, n, patterns, noise, n_time=16):
    """n voxels of a rod of 10 x 10 in cubes of 5 voxels a side; cubes take turns with so many patterns."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, y, z = i % 10, i // 10 % 10, i // 100
        r = x // 5 + 2 * (y // 5 + 2 * (z // 5))
        wave = np.cos(np.pi * (np.arange(n_time) + 0.5) * (r % patterns + 1) / n_time)
        rows.append((i, x, y, z, (wave + noise * rng.normal(size=n_time)).tolist(), r + 1))
    return spark.createDataFrame(rows, "vid long, x int, y int, z int, ts array<double>, cid int")


def test_slices_keep_small_ends_of_regions(spark):
    v = regions(spark, 756, 8, 0.1)
    found = result.fit(v.drop("cid"), 8, "slice_msf")
    assert measures.accuracy(found.labels, v.select("vid", "cid")).first().ari == 1.0


def test_scattered_clusters_give_way_to_connected_ones(spark):
    v = regions(spark, 2000, 10, 0.3)
    # Of two cubes of one pattern each cluster has a part of both, by the first sample, which fits the noise.
    labels = v.select("vid", F.expr("cast(2 * ((cid - 1) % 10) + if((cid - 1) % 10 < 6 and ts[0] > 1, 2, 1) as int)").alias("cid"))
    truth, rows = v.select("vid", "cid"), v.drop("cid")
    assert exact.spread(rows, labels) < exact.spread(rows, truth)
    assert measures.accuracy(exact.resettled(rows, labels, 16), truth).first().ari == 1.0


@pytest.mark.parametrize("slab", [8192, 40])
def test_communities_settle_by_sweeps(spark, monkeypatch, slab):
    monkeypatch.setattr(louvain, "SLAB", slab)
    rng, n = np.random.default_rng(5), 120
    edges = [(i, j, 1.0) for i in range(n) for j in range(i) if rng.random() < (0.6 if i % 6 == j % 6 else 0.03)]
    table, nodes = spark.createDataFrame(edges, "src long, dst long, w double").selectExpr("0 as g", "dst as src", "src as dst", "w"), spark.range(n).selectExpr("0 as g", "id as vid")
    history = []
    labels, moved = louvain.settle(louvain.degrees(nodes, table), table, {0: 1.0}, history)
    assert moved == {0} and all(after > before for step in history for before, after in step.values())
    assert louvain.moves(labels, table, F.lit(1.0), F.lit(float(len(edges)))).isEmpty()
    assert len(history) == 1 or slab == 40


def test_slabs_grow_as_one_queue(spark):
    v = regions(spark, 100, 3, 0.5).drop("cid")
    seeds, edges = spark.createDataFrame([(7, 1), (52, 2), (88, 3)], "vid long, cid int"), graph.saved(spatial.grid_edges(v, 26))
    want = growth.grow(v.filter("vid < 30"), seeds.filter("vid < 30"), edges.filter("dst < 30"), V.region_distance("ts", "feat", local.space(), 4.0, 5.0), unit=True, share=0.0)
    got = growth.grow_in_slabs(v.filter("vid < 30"), seeds.filter("vid < 30"), edges.filter("dst < 30"), growth.offset_price(4.0, 5.0), unit=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    one, many = (growth.grow_in_slabs(v, seeds, edges, growth.cosine_price(0.5, 9.0), ahead=True, slab=slab) for slab in (100, 25))
    assert one.count() == many.count() == 100
    for labels in (one, many):
        assert {(7, 1), (52, 2), (88, 3)} <= set(map(tuple, labels.collect()))
        assert graph.fragments(labels, edges).select("cid").distinct().count() == 3


def test_tables_of_a_row_a_voxel_are_not_broadcast(spark):
    v = regions(spark, 200, 4, 0.1)
    rows, labels = graph.saved(v.drop("cid")), graph.saved(v.select("vid", "cid"))
    edges = graph.saved(spatial.grid_edges(rows, 6))
    for found in (spatial.grid_edges(rows, 6), spatial.boundary(labels, edges), graph.contract(edges, labels), local.kept_or(labels, labels), local.candidates(labels, edges)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_mean_cell_of_615384_vectors_is_one_tile():
    """Copies of a vector in each cell that it asks are as many as the cell's tiles."""
    assert 615384 / neighbours.PIVOTS <= neighbours.TILE
