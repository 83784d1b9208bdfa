"""Queries of the core operators over the test tables, and their SQL.

Embeddings stand for voxels: 10 x 10 in the plane, further vectors stack up in z. Values are rounded to six places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import cluster, graph, groups, series, spatial


def voxels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    place = [F.expr(e).cast("int").alias(n) for e, n in (("vec_id % 10", "x"), ("(vec_id div 10) % 10", "y"), ("vec_id div 100", "z"))]
    return rows.select(F.col("vec_id").alias("vid"), *place, V.doubles("embedding").alias("ts"), (F.col("label") + 1).alias("cid"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


def plain(spark, d):
    return voxels(spark, d).drop("cid")


def changed(voxels: DataFrame, ts) -> DataFrame:
    """(vid, t, v) of an expression on each series, rounded."""
    return rounded(series.samples(voxels.select("vid", ts.alias("ts"))), "v")


def long(voxels: DataFrame) -> DataFrame:
    return rounded(series.samples(voxels), "v")


VOX = "vox AS (SELECT vec_id AS vid, (vec_id % 10)::INT AS x, ((vec_id // 10) % 10)::INT AS y, (vec_id // 100)::INT AS z, embedding::DOUBLE[] AS ts, label + 1 AS cid FROM embeddings)"
LONG = VOX + ", s AS (SELECT vid, unnest(range(len(ts)))::INT AS t, unnest(ts) AS v FROM vox)"
COS = "basis AS (SELECT t::INT AS t, k::INT AS k, CASE WHEN k = 0 THEN sqrt(1 / 64.0) ELSE sqrt(2 / 64.0) END * cos(pi() * (t + 0.5) * k / 64) AS b FROM range(64) a(t), range(4) c(k))"
COEF = LONG + ", " + COS + ", coef AS (SELECT vid, k, sum(v * b) AS c FROM s JOIN basis USING (t) GROUP BY vid, k)"


def _edges_sql(reach: int) -> str:
    return f"e AS (SELECT a.vid AS src, b.vid AS dst FROM vox a JOIN vox b ON a.vid < b.vid AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) <= {reach})"


SQ = "list_sum(list_transform(range(1, 65), lambda i: (a.ts[i] - b.ts[i]) * (a.ts[i] - b.ts[i])))"
DIST = VOX + ", " + _edges_sql(1) + f", d AS (SELECT src, dst, {SQ} AS d FROM e JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst)"
NEAR = DIST + ", w AS (SELECT src, dst, d FROM d UNION ALL SELECT dst, src, d FROM d), n AS (SELECT src, dst, d FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1)"
TABLE = VOX + ", tab AS (SELECT cid AS a, (z % 3) + 1 AS b, count(*) AS n FROM vox GROUP BY ALL)"


def edges(spark, d, connectivity=6):
    return spatial.grid_edges(voxels(spark, d), connectivity)


def edge_d(spark, d):
    v = voxels(spark, d)
    return spatial.edge_distances(spatial.grid_edges(v, 6), v)


def nearest(spark, d):
    return graph.nearest_edge(edge_d(spark, d))


def table(spark, d):
    v = voxels(spark, d)
    return groups.contingency(v, v.select("vid", (F.col("z") % 3 + 1).alias("cid")))


def flagship(spark, d):
    return rounded(nearest(spark, d), "d")


def split_centers(spark, d):
    v = voxels(spark, d)
    return rounded(groups.centers(v.drop("cid"), v.select("vid", "cid")).select("cid", "n", "cx", "cy", "cz", V.total("feat").alias("sum_feat")), "cx", "cy", "cz", "sum_feat")


def nn_components(spark, d):
    return graph.components(voxels(spark, d), nearest(spark, d).select("src", "dst"))


def shares(s, d, basis):
    """(vid, k, b): the share of each voxel's squared length that one function of a basis holds."""
    rows = plain(s, d).select("vid", V.dot("ts", "ts").alias("q"), F.posexplode(series.coefficients("ts", basis)).alias("k", "c"))
    return rounded(rows.select("vid", "k", (F.col("c") * F.col("c") / F.col("q")).alias("b")), "b")


QUERIES = {
    "norm_volumes": lambda s, d: long(series.center_volumes(plain(s, d))),
    "zscore_timepoint": lambda s, d: long(series.scale_times(plain(s, d))),
    "zscore_voxel": lambda s, d: changed(plain(s, d), series.scaled("ts")),
    "detrend_linear": lambda s, d: changed(plain(s, d), series.detrended("ts")),
    "normalize_detrend": lambda s, d: changed(series.center_volumes(plain(s, d)), series.detrended("ts")),
    "dct_basis": lambda s, d: shares(s, d, series.cosines(64, 4)),
    "dct_coeffs": lambda s, d: rounded(plain(s, d).select("vid", F.posexplode(series.coefficients("ts", series.cosines(64, 4))).alias("k", "c")), "c"),
    "dct_residual": lambda s, d: changed(plain(s, d), series.residual("ts", series.cosines(64, 4))),
    "split_half_reliability": lambda s, d: rounded(plain(s, d).select("vid", series.split_half("ts").alias("r")), "r"),
    "unit_rows": lambda s, d: rounded(voxels(s, d).select("vid", V.total(V.unit("ts")).alias("sum_unit"), V.norm("ts").alias("length")), "sum_unit", "length"),
    "quantised_unit": lambda s, d: voxels(s, d).select("vid", F.aggregate(V.quantise_unit("ts"), F.lit(0), lambda a, x: a + x).cast("long").alias("sum_q")),
    "z_smooth": lambda s, d: rounded(series.smooth_z(voxels(s, d).select("vid", "x", "y", "z", F.col("ts")[0].alias("v")), "v").select("vid", "smooth"), "smooth"),
    "grid_adj_6": lambda s, d: edges(s, d, 6),
    "grid_adj_18": lambda s, d: edges(s, d, 18),
    "grid_adj_26": lambda s, d: edges(s, d, 26),
    "edge_sqdist": lambda s, d: rounded(edge_d(s, d), "d"),
    "edge_corr_similarity": lambda s, d: rounded(spatial.edge_similarity(edges(s, d, 6), voxels(s, d)), "w"),
    "edge_nn": flagship,
    "mutual_nn": lambda s, d: graph.mutual(nearest(s, d)),
    "components_1nn": nn_components,
    "contract_graph": lambda s, d: graph.contract(edges(s, d), nn_components(s, d)),
    "knn_6": lambda s, d: rounded(spatial.nearest(voxels(s, d), 6, 2), "d"),
    "boundary_voxels": lambda s, d: spatial.boundary(voxels(s, d).select("vid", "cid"), edges(s, d)),
    "cluster_centers": split_centers,
    "contingency": table,
    "partition_agreement": lambda s, d: rounded(groups.agreement(table(s, d)), "ari", "nmi", "purity"),
    "cluster_sizes": lambda s, d: rounded(groups.sizes(voxels(s, d)), "first", "median", "third", "mean", "sd"),
    "block_means": lambda s, d: rounded(groups.blocks(voxels(s, d), 4).withColumn("sum_feat", V.total("feat")).drop("feat"), "cx", "cy", "cz", "sum_feat"),
    "dense_relabel": lambda s, d: groups.dense(voxels(s, d).select("vid", (F.col("cid") * 7).alias("cid"))),
    "cluster_slic": lambda s, d: cluster.cluster(voxels(s, d), 20, "slic"),
    "cluster_rena": lambda s, d: cluster.cluster(voxels(s, d), 20, "rena"),
}

_R = "round({}, 6) + 0.0 AS {}"


def _r(expression: str, name: str) -> str:
    return _R.format(expression, name)


_DETREND = "SELECT vid, t, " + _r("v - mv - b * (t - mt)", "v") + " FROM (SELECT *, sum((t - mt) * (v - mv)) OVER (PARTITION BY vid) / sum((t - mt) * (t - mt)) OVER (PARTITION BY vid) AS b FROM (SELECT *, avg(t) OVER (PARTITION BY vid) AS mt, avg(v) OVER (PARTITION BY vid) AS mv FROM {}))"
_COMPONENTS = (
    "WITH RECURSIVE " + NEAR + ", g AS (SELECT src AS p, dst AS q FROM n UNION SELECT dst, src FROM n), "
    "r(vid, seen) AS (SELECT vid, vid FROM vox UNION SELECT r.vid, g.q FROM r JOIN g ON g.p = r.seen), comp AS (SELECT vid, min(seen) AS cid FROM r GROUP BY vid) "
)

ORACLES = {
    "norm_volumes": f"WITH {LONG} SELECT vid, t, " + _r("v - avg(v) OVER (PARTITION BY t)", "v") + " FROM s",
    "zscore_timepoint": f"WITH {LONG} SELECT vid, t, " + _r("(v - avg(v) OVER (PARTITION BY t)) / stddev_samp(v) OVER (PARTITION BY t)", "v") + " FROM s",
    "zscore_voxel": f"WITH {LONG} SELECT vid, t, " + _r("(v - avg(v) OVER (PARTITION BY vid)) / stddev_samp(v) OVER (PARTITION BY vid)", "v") + " FROM s",
    "detrend_linear": f"WITH {LONG} " + _DETREND.format("s"),
    "normalize_detrend": f"WITH {LONG}, c AS (SELECT vid, t, v - avg(v) OVER (PARTITION BY t) AS v FROM s) " + _DETREND.format("c"),
    "dct_basis": f"WITH {COEF} SELECT vid, k, " + _r("c * c / list_sum(list_transform(ts, lambda q: q * q))", "b") + " FROM coef JOIN vox USING (vid)",
    "dct_coeffs": f"WITH {COEF} SELECT vid, k, " + _r("c", "c") + " FROM coef",
    "dct_residual": f"WITH {COEF}, f AS (SELECT vid, t, sum(c * b) AS f FROM coef JOIN basis USING (k) GROUP BY vid, t) SELECT vid, t, " + _r("v - f", "v") + " FROM s JOIN f USING (vid, t)",
    "split_half_reliability": f"WITH {LONG} SELECT a.vid, " + _r("corr(a.v, b.v)", "r") + " FROM s a JOIN s b ON a.vid = b.vid AND a.t % 2 = 0 AND b.t = a.t + 1 GROUP BY a.vid",
    "unit_rows": f"WITH {VOX}, l AS (SELECT vid, ts, sqrt(list_sum(list_transform(ts, lambda q: q * q))) AS n FROM vox) SELECT vid, " + _r("list_sum(ts) / n", "sum_unit") + ", " + _r("n", "length") + " FROM l",
    "quantised_unit": f"WITH {VOX} SELECT vid, list_sum(list_transform(ts, lambda q: round(least(greatest(q, -1), 1) * 127)::BIGINT))::BIGINT AS sum_q FROM vox",
    "z_smooth": f"WITH {VOX} SELECT a.vid, " + _r("0.5 * a.ts[1] + 0.25 * (coalesce(b.ts[1], a.ts[1]) + coalesce(c.ts[1], a.ts[1]))", "smooth") + " FROM vox a LEFT JOIN vox b ON b.vid = a.vid - 100 LEFT JOIN vox c ON c.vid = a.vid + 100",
    "grid_adj_6": f"WITH {VOX}, {_edges_sql(1)} SELECT * FROM e",
    "grid_adj_18": f"WITH {VOX}, {_edges_sql(2)} SELECT * FROM e",
    "grid_adj_26": f"WITH {VOX}, {_edges_sql(3)} SELECT * FROM e",
    "edge_sqdist": f"WITH {DIST} SELECT src, dst, " + _r("d", "d") + " FROM d",
    "edge_corr_similarity": f"WITH {LONG}, {_edges_sql(1)} SELECT src, dst, " + _r("(corr(a.v, b.v) + 1) / 2", "w") + " FROM e JOIN s a ON a.vid = src JOIN s b ON b.vid = dst AND a.t = b.t GROUP BY src, dst",
    "edge_nn": f"WITH {NEAR} SELECT src, dst, " + _r("d", "d") + " FROM n",
    "mutual_nn": f"WITH {NEAR} SELECT a.src, a.dst FROM n a JOIN n b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst",
    "components_1nn": _COMPONENTS + "SELECT vid, cid FROM comp",
    "contract_graph": _COMPONENTS + "SELECT DISTINCT least(a.cid, b.cid) AS src, greatest(a.cid, b.cid) AS dst FROM e JOIN comp a ON a.vid = src JOIN comp b ON b.vid = dst WHERE a.cid <> b.cid",
    "knn_6": f"WITH {VOX}, p AS (SELECT a.vid AS src, b.vid AS dst, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM vox a JOIN vox b ON a.vid <> b.vid AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.z - b.z) <= 2), k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst)::INT AS rank, d2 FROM p WHERE d2 <= 4) SELECT src, dst, rank, " + _r("sqrt(d2)", "d") + " FROM k WHERE rank <= 6",
    "boundary_voxels": f"WITH {VOX}, {_edges_sql(1)}, o AS (SELECT src, dst FROM e JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst WHERE a.cid <> b.cid) SELECT src AS vid FROM o UNION SELECT dst FROM o",
    "cluster_centers": f"WITH {VOX} SELECT cid, count(*) AS n, " + ", ".join(_r(f"avg({c})", f"c{c}") for c in "xyz") + ", " + _r("sum(list_sum(ts)) / count(*)", "sum_feat") + " FROM vox GROUP BY cid",
    "contingency": f"WITH {TABLE} SELECT * FROM tab",
    "partition_agreement": f"WITH {TABLE}, t AS (SELECT sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2.0) AS p FROM tab), ra AS (SELECT a, sum(n)::DOUBLE AS m FROM tab GROUP BY a), rb AS (SELECT b, sum(n)::DOUBLE AS m, max(n) AS top FROM tab GROUP BY b), "
    "z AS (SELECT t.n, t.p, (SELECT sum(m * (m - 1) / 2) FROM ra) AS pa, (SELECT sum(m * (m - 1) / 2) FROM rb) AS pb, (SELECT sum(-m / t.n * ln(m / t.n)) FROM ra) AS ha, (SELECT sum(-m / t.n * ln(m / t.n)) FROM rb) AS hb, (SELECT sum(-tab.n / t.n * ln(tab.n / t.n)) FROM tab) AS h, (SELECT sum(top) FROM rb) AS top FROM t) "
    "SELECT n::BIGINT AS n, " + _r("(p - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2))", "ari") + ", " + _r("2 * (ha + hb - h) / (ha + hb)", "nmi") + ", " + _r("top / n", "purity") + " FROM z",
    "cluster_sizes": f"WITH {VOX}, c AS (SELECT cid, count(*) AS n FROM vox GROUP BY cid) SELECT count(*) AS k, min(n) AS smallest, " + _r("quantile_cont(n, 0.25)", "first") + ", " + _r("quantile_cont(n, 0.75)", "third") + ", " + _r("median(n)", "median") + ", max(n) AS largest, " + _r("avg(n)", "mean") + ", " + _r("stddev_samp(n)", "sd") + " FROM c",
    "block_means": f"WITH {VOX} SELECT x // 4 AS bx, y // 4 AS by, z // 4 AS bz, count(*) AS n, " + ", ".join(_r(f"avg({c})", f"c{c}") for c in "xyz") + ", " + _r("avg(list_sum(ts))", "sum_feat") + " FROM vox GROUP BY ALL",
    "dense_relabel": f"WITH {VOX} SELECT vid, dense_rank() OVER (ORDER BY cid)::INT AS cid FROM vox",
}
