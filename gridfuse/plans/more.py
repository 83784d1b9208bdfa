"""Queries of the local, sketch, flow and measure operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import cluster, embed, flow, graph, groups, local, measures, methods, series, spatial
from gridfuse.plans import queries as Q
from gridfuse.sources import synthetic

rounded, _r = Q.rounded, Q._r


def vox(s, d):
    return Q.voxels(s, d).drop("cid")


def labels(s, d):
    return Q.voxels(s, d).select("vid", "cid")


def centers(s, d):
    return groups.centers(vox(s, d), labels(s, d))


def near(s, d):
    return spatial.nearest(vox(s, d), 6, 2)


def heat(s, d):
    return Q.edge_d(s, d).select("src", "dst", V.heat(F.col("d"), 1.0).alias("heat"), V.normalised_heat(F.col("d"), 64, 1.0).alias("normalised"))


def sketch(s, d):
    return embed.sketch(vox(s, d), 64, 4).select("vid", F.posexplode("ts").alias("k", "c")).withColumn("k", F.col("k") + 1)


def candidates(s, d):
    return local.candidates(labels(s, d), near(s, d), 1.3)


def best(s, d):
    return local.best(vox(s, d), candidates(s, d), centers(s, d), local.heat_score(0.5, 1.0, 2.5, True))


def matrix(s, d):
    v = vox(s, d)
    return flow.from_edges(v, spatial.edge_similarity(spatial.grid_edges(v, 6), v))


def refined(s, d):
    return local.refine_step(vox(s, d), labels(s, d), Q.edges(s, d)).select("vid", "cid")


def adjacent(s, d):
    return graph.contract(Q.edges(s, d), labels(s, d))


QUERIES = {
    "heat_kernel": lambda s, d: rounded(heat(s, d), "heat", "normalised"),
    "own_scores": lambda s, d: rounded(local.own_scores(vox(s, d), labels(s, d), centers(s, d), 1.0, 2.5), "score"),
    "poly_basis": lambda s, d: Q.shares(s, d, series.polynomials(64, 2)),
    "detrend_poly": lambda s, d: Q.changed(vox(s, d), series.residual("ts", series.polynomials(64, 2))),
    "dct_sketch": lambda s, d: rounded(sketch(s, d), "c"),
    "gram": lambda s, d: rounded(embed.gram(vox(s, d)), "g"),
    "svd_compress": lambda s, d: embed.compressed(vox(s, d)).select("vid", F.posexplode("ts").alias("k", "c")),
    "count_sketch": lambda s, d: embed.count_sketch(vox(s, d), 64, 16).select("vid", F.posexplode("ts").alias("k", "c")),
    "hash_bits": lambda s, d: embed.hash_bits(vox(s, d), 64),
    "knn_shrink": lambda s, d: Q.long(embed.knn_mean(vox(s, d), near(s, d), 5)),
    "boundary_score": lambda s, d: local.slice_boundary(vox(s, d), labels(s, d)),
    "region_adjacency": adjacent,
    "functional_gradient": lambda s, d: rounded(local.functional_gradient(vox(s, d), near(s, d)), "g"),
    "product_gradient": lambda s, d: rounded(local.product_gradient(vox(s, d)), "g"),
    "difference_gradient": lambda s, d: rounded(local.difference_gradient(vox(s, d).select("vid", "x", "y", "z", F.col("ts")[0].alias("v")), "v"), "g"),
    "candidate_labels": candidates,
    "best_candidate": best,
    "assign_binned": lambda s, d: local.assign_within(vox(s, d), centers(s, d), 4.0, local.heat_score(0.5, 1.0, 2.5)),
    "refine_step": refined,
    "medoids": lambda s, d: measures.medoids(vox(s, d), labels(s, d), centers(s, d)),
    "cluster_quality": lambda s, d: rounded(measures.quality(vox(s, d), labels(s, d), centers(s, d)), "within_corr", "within_dist"),
    "center_correlation": lambda s, d: rounded(measures.between(adjacent(s, d), centers(s, d)), "r"),
    "label_order": lambda s, d: rounded(measures.label_order(centers(s, d)), "cor_x", "cor_y", "cor_z"),
    "label_validity": lambda s, d: measures.validity(labels(s, d).withColumn("cid", F.col("cid") * 2)),
    "partition_overlap": lambda s, d: rounded(measures.overlap(Q.table(s, d)), "overlap"),
    "greedy_matching": lambda s, d: measures.matching(Q.table(s, d)),
    "mcl_matrix": lambda s, d: rounded(matrix(s, d), "x"),
    "mcl_expand": lambda s, d: rounded(flow.product(matrix(s, d), matrix(s, d)), "x"),
    "mcl_inflate": lambda s, d: rounded(flow.inflated(matrix(s, d), 1.6), "x"),
    "checkerboard": lambda s, d: synthetic.checkerboard(vox(s, d), 4, 3),
    "islands": lambda s, d: local.islands(labels(s, d), Q.edges(s, d)),
    "meta_clusters": lambda s, d: methods.meta(centers(s, d)),
} | {f"cluster_{m}": (lambda s, d, m=m: cluster.cluster(vox(s, d), 20, m)) for m in methods.METHODS if m not in ("slic", "rena")}

SQF = "list_sum(list_transform(range(1, 65), lambda i: (ts[i] - feat[i]) * (ts[i] - feat[i])))"
D2 = "((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2)"
CEN = Q.LONG + ", feat AS (SELECT cid, list(v ORDER BY t) AS feat FROM (SELECT cid, t, avg(v) AS v FROM s JOIN vox USING (vid) GROUP BY cid, t) GROUP BY cid), pos AS (SELECT cid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vox GROUP BY cid), cen AS (FROM feat JOIN pos USING (cid))"
OWN = CEN + ", own AS (SELECT vid, cid, ts, feat, " + SQF + " AS sq, " + D2 + " AS d2 FROM vox JOIN cen USING (cid))"
POLY = "pb AS (SELECT t, 0 AS k, sqrt(1 / 64.0) AS b FROM u UNION ALL SELECT t, 1, u / sqrt(sum(u * u) OVER ()) FROM u UNION ALL SELECT t, 2, w / sqrt(sum(w * w) OVER ()) FROM (SELECT t, u * u - avg(u * u) OVER () AS w FROM u))"
POLY = "u AS (SELECT t::INT AS t, 2 * t / 63.0 - 1 AS u FROM range(64) r(t)), " + POLY
KNN = "k AS (SELECT * FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank, sqrt(d2) AS d FROM (SELECT a.vid AS src, b.vid AS dst, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM vox a JOIN vox b ON a.vid <> b.vid AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.z - b.z) <= 2) WHERE d2 <= 4) WHERE rank <= 6)"
CAND = "cand AS (SELECT vid, cid FROM vox UNION SELECT src, cid FROM k JOIN vox ON vid = dst WHERE d < 1.3)"
_N = "sqrt(list_sum(list_transform({0}, lambda q: q * q)))"
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {0}[i] * {1}[i]))"
MAT = Q.LONG + ", " + Q._edges_sql(1) + ", w AS (SELECT src, dst, (corr(a.v, b.v) + 1) / 2 AS w FROM e JOIN s a ON a.vid = src JOIN s b ON b.vid = dst AND a.t = b.t GROUP BY src, dst), raw AS (SELECT src AS row, dst AS col, w AS x FROM w UNION ALL SELECT dst, src, w FROM w UNION ALL SELECT vid, vid, 1 FROM vox), m AS (SELECT row, col, x / sum(x) OVER (PARTITION BY col) AS x FROM raw)"
REFINE = (
    "WITH " + Q.VOX + ", " + Q._edges_sql(1) + ", un AS (SELECT vid, cid, list_transform(ts, lambda q: q / n) AS ts FROM (SELECT *, " + _N.format("ts") + " AS n FROM vox)), "
    "lg AS (SELECT cid, unnest(range(64)) AS t, unnest(ts) AS v FROM un), mean AS (SELECT cid, list(v ORDER BY t) AS f FROM (SELECT cid, t, avg(v) AS v FROM lg GROUP BY cid, t) GROUP BY cid), "
    "b AS (SELECT src AS vid, dst AS n FROM e UNION ALL SELECT dst, src FROM e), edge AS (SELECT DISTINCT b.vid FROM b JOIN vox p ON p.vid = b.vid JOIN vox q ON q.vid = b.n WHERE p.cid <> q.cid), "
    "cand AS (SELECT vid, cid FROM vox UNION SELECT b.vid, q.cid FROM b JOIN vox q ON q.vid = b.n), "
    "win AS (SELECT c.vid, c.cid FROM cand c JOIN edge USING (vid) JOIN un ON un.vid = c.vid JOIN mean ON mean.cid = c.cid QUALIFY row_number() OVER (PARTITION BY c.vid ORDER BY " + _DOT.format("ts", "f") + " / " + _N.format("f") + " DESC, c.cid) = 1) "
    "SELECT vox.vid, coalesce(win.cid, vox.cid) AS cid FROM vox LEFT JOIN win ON win.vid = vox.vid"
)
RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in ("cid", "cx", "cy", "cz"))

ORACLES = {
    "heat_kernel": f"WITH {Q.DIST} SELECT src, dst, " + _r("exp(-d / 2)", "heat") + ", " + _r("exp(-d / 128 / 2)", "normalised") + " FROM d",
    "own_scores": f"WITH {OWN} SELECT vid, " + _r("exp(-sq / 128 / 2) + exp(-d2 / 12.5)", "score") + " FROM own",
    "poly_basis": f"WITH {Q.LONG}, {POLY}, pc AS (SELECT vid, k, sum(v * b) AS c FROM s JOIN pb USING (t) GROUP BY vid, k) SELECT vid, k, " + _r("c * c / list_sum(list_transform(ts, lambda q: q * q))", "b") + " FROM pc JOIN vox USING (vid)",
    "detrend_poly": f"WITH {Q.LONG}, {POLY}, c AS (SELECT vid, k, sum(v * b) AS c FROM s JOIN pb USING (t) GROUP BY vid, k), f AS (SELECT vid, t, sum(c * b) AS f FROM c JOIN pb USING (k) GROUP BY vid, t) SELECT vid, t, " + _r("v - f", "v") + " FROM s JOIN f USING (vid, t)",
    "dct_sketch": f"WITH {Q.LONG}, dm AS (SELECT vid, t, v - mv - b * (t - mt) AS v FROM (SELECT *, sum((t - mt) * (v - mv)) OVER (PARTITION BY vid) / sum((t - mt) * (t - mt)) OVER (PARTITION BY vid) AS b FROM (SELECT *, avg(t) OVER (PARTITION BY vid) AS mt, avg(v) OVER (PARTITION BY vid) AS mv FROM s))), "
    "zz AS (SELECT vid, t, (v - avg(v) OVER (PARTITION BY vid)) / stddev_samp(v) OVER (PARTITION BY vid) AS v FROM dm), c AS (SELECT vid, k, sum(v * sqrt(2 / 64.0) * cos(pi() * (t + 0.5) * k / 64)) AS c FROM zz, range(1, 5) r(k) GROUP BY vid, k) SELECT vid, k::INT AS k, " + _r("c / sqrt(sum(c * c) OVER (PARTITION BY vid))", "c") + " FROM c",
    "gram": f"WITH {Q.LONG} SELECT a.t AS s, b.t AS t, " + _r("sum(a.v * b.v)", "g") + " FROM s a JOIN s b USING (vid) GROUP BY a.t, b.t",
    "knn_shrink": f"WITH {Q.LONG}, {KNN}, n AS (SELECT src, dst FROM k WHERE rank < 5 UNION ALL SELECT vid, vid FROM vox) SELECT src AS vid, t, " + _r("avg(v)", "v") + " FROM n JOIN s ON s.vid = dst GROUP BY src, t",
    "boundary_score": f"WITH {Q.VOX}, c AS (SELECT a.vid, count(*) FILTER (a.cid = b.cid) AS same FROM vox a JOIN vox b ON a.z = b.z AND a.vid <> b.vid AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vid) SELECT vox.vid, (CASE WHEN x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 THEN 8 - coalesce(same, 0) ELSE 0 END)::BIGINT AS score FROM vox LEFT JOIN c ON c.vid = vox.vid",
    "region_adjacency": f"WITH {Q.VOX}, {Q._edges_sql(1)} SELECT DISTINCT least(a.cid, b.cid) AS src, greatest(a.cid, b.cid) AS dst FROM e JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst WHERE a.cid <> b.cid",
    "functional_gradient": f"WITH {Q.VOX}, {KNN} SELECT src AS vid, " + _r("1 - avg(" + _DOT.format("a.ts", "b.ts") + " / " + _N.format("a.ts") + " / " + _N.format("b.ts") + ")", "g") + " FROM k JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst GROUP BY src",
    "product_gradient": f"WITH {Q.VOX}, p AS (SELECT a.vid, sum((({_DOT.format('a.ts', 'b.ts')} - {_DOT.format('a.ts', 'a.ts')}) / 64) ** 2) AS s FROM vox a JOIN vox b ON a.vid <> b.vid AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1 GROUP BY a.vid) SELECT vox.vid, " + _r("CASE WHEN x BETWEEN 1 AND 8 AND y BETWEEN 1 AND 8 AND z > 0 AND z < (SELECT max(z) FROM vox) THEN sqrt(s) ELSE 0 END", "g") + " FROM vox LEFT JOIN p ON p.vid = vox.vid",
    "difference_gradient": f"WITH {Q.VOX} SELECT a.vid, " + _r("sqrt(coalesce((a.ts[1] - b.ts[1]) ** 2, 0) + coalesce((a.ts[1] - c.ts[1]) ** 2, 0) + coalesce((a.ts[1] - f.ts[1]) ** 2, 0))", "g") + " FROM vox a LEFT JOIN vox b ON b.x = a.x - 1 AND b.y = a.y AND b.z = a.z LEFT JOIN vox c ON c.x = a.x AND c.y = a.y - 1 AND c.z = a.z LEFT JOIN vox f ON f.x = a.x AND f.y = a.y AND f.z = a.z - 1",
    "candidate_labels": f"WITH {Q.VOX}, {KNN}, {CAND} SELECT vid, cid FROM cand",
    "best_candidate": f"WITH {CEN}, {KNN}, {CAND} SELECT vox.vid, cand.cid FROM cand JOIN vox ON vox.vid = cand.vid JOIN cen ON cen.cid = cand.cid QUALIFY row_number() OVER (PARTITION BY vox.vid ORDER BY exp(-{SQF} / 128 / 2) + exp(-{D2} / 12.5) DESC, cand.cid) = 1",
    "assign_binned": f"WITH {CEN} SELECT vid, cen.cid FROM vox JOIN cen ON {D2} <= 16 QUALIFY row_number() OVER (PARTITION BY vid ORDER BY exp(-{SQF} / 2) + exp(-{D2} / 12.5) DESC, cen.cid) = 1",
    "refine_step": REFINE,
    "medoids": f"WITH {OWN} SELECT cid, vid FROM own QUALIFY row_number() OVER (PARTITION BY cid ORDER BY sq, vid) = 1",
    "cluster_quality": f"WITH {OWN}, fl AS (SELECT cid, unnest(range(64)) AS t, unnest(feat) AS f FROM feat), c AS (SELECT vid, corr(v, f) AS r FROM s JOIN vox USING (vid) JOIN fl ON fl.cid = vox.cid AND fl.t = s.t GROUP BY vid) SELECT " + _r("avg(0.5 * ln((1 + r) / (1 - r)))", "within_corr") + ", " + _r("avg(sqrt(d2))", "within_dist") + " FROM own JOIN c USING (vid)",
    "center_correlation": f"WITH {CEN}, {Q._edges_sql(1)}, fl AS (SELECT cid, unnest(range(64)) AS t, unnest(feat) AS f FROM feat), p AS (SELECT DISTINCT least(a.cid, b.cid) AS src, greatest(a.cid, b.cid) AS dst FROM e JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst WHERE a.cid <> b.cid) SELECT src, dst, " + _r("corr(a.f, b.f)", "r") + " FROM p JOIN fl a ON a.cid = src JOIN fl b ON b.cid = dst AND a.t = b.t GROUP BY src, dst",
    "label_order": f"WITH {CEN}, k AS (SELECT {RANKS} FROM pos), c AS (SELECT " + ", ".join(f"corr(r_cid, r_c{c}) AS cor_{c}" for c in "xyz") + " FROM k) SELECT " + ", ".join(_r(f"cor_{c}", f"cor_{c}") for c in "xyz") + ", greatest(abs(cor_x), abs(cor_y), abs(cor_z)) > 0.3 AS ordered, greatest(abs(cor_x), abs(cor_y), abs(cor_z)) > 0.7 AS strongly FROM c",
    "label_validity": f"WITH {Q.VOX}, c AS (SELECT cid * 2 AS cid, count(*) AS n FROM vox GROUP BY 1) SELECT count(*) AS k, (max(cid) - count(*))::BIGINT AS missing, count(*) FILTER (n < 5) AS tiny, 0::BIGINT AS unlabelled FROM c",
    "partition_overlap": f"WITH {Q.TABLE} SELECT " + _r("(2 * (SELECT sum(n * n) FROM tab) + (SELECT sum(n) ** 2 FROM tab) - (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM tab GROUP BY a)) - (SELECT sum(m * m) FROM (SELECT sum(n) AS m FROM tab GROUP BY b))) / (SELECT sum(n) ** 2 FROM tab)", "overlap"),
    "mcl_matrix": f"WITH {MAT} SELECT row, col, " + _r("x", "x") + " FROM m",
    "mcl_expand": f"WITH {MAT} SELECT a.row, b.col, " + _r("sum(a.x * b.x)", "x") + " FROM m a JOIN m b ON a.col = b.row GROUP BY a.row, b.col",
    "mcl_inflate": f"WITH {MAT} SELECT row, col, " + _r("x ** 1.6 / sum(x ** 1.6) OVER (PARTITION BY col)", "x") + " FROM m",
    "checkerboard": f"WITH {Q.VOX} SELECT vid, ((x // 3 + y // 3 + z // 3) % 4 + 1)::INT AS cid FROM vox",
}
