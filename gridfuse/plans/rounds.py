"""Queries of forests, slices, feature neighbours, communities, growth and spectra, and their SQL.

SQL that follows a sequential pass holds its state in lists: one row a step.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import ensemble, forest, louvain, methods, neighbours, slices, spatial, spectral
from gridfuse.plans import more as M
from gridfuse.plans import queries as Q
from gridfuse.sources import synthetic

rounded, _r, vox, labels = Q.rounded, Q._r, M.vox, M.labels
VOX = Q.VOX

# -- forests --------------------------------------------------------------------


def edges_d(s, d):
    """Grid edges with the squared distance of their features, rounded."""
    return rounded(Q.edge_d(s, d), "d").withColumnRenamed("d", "w")


def hash_sql(a: str, b: str) -> str:
    x = f"(((({a} % {forest.PRIME}) * {forest.LEFT}) % {forest.PRIME} + (({b} % {forest.PRIME}) * {forest.RIGHT}) % {forest.PRIME}) % {forest.PRIME})"
    return f"({x} * {x}) % {forest.PRIME}"


EDGES = Q.DIST + ", w AS (SELECT src, dst, " + _r("d", "w") + " FROM d)"
#: Edges of `w` in their order, from 1.
ORDER = "o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, h, src, dst) AS i, src, dst, w FROM (SELECT *, " + hash_sql("src", "dst") + " AS h FROM w))"
#: An edge belongs to the forest unless earlier edges join its ends already.
TREE = "ways AS MATERIALIZED (SELECT i, src AS p, dst AS q FROM o UNION ALL SELECT i, dst, src FROM o), reach(i, node) AS (SELECT i, src FROM o UNION SELECT r.i, b.q FROM reach r JOIN ways b ON b.p = r.node AND b.i < r.i), tree AS (SELECT o.* FROM o LEFT JOIN reach r ON r.i = o.i AND r.node = o.dst WHERE r.i IS NULL)"


def united_sql(k: int) -> str:
    """The label of each voxel, the smallest of its part, after edges in order have united parts down to k; one row a step."""
    return (
        "run(i, lab, parts) AS (SELECT 0::BIGINT, (SELECT range(count(*)) FROM vox), (SELECT count(*) FROM vox) "
        f"UNION ALL SELECT i, CASE WHEN p <> q AND parts > {k} THEN list_transform(lab, lambda v: CASE WHEN v = q THEN p ELSE v END) ELSE lab END, parts - (p <> q AND parts > {k})::INT "
        "FROM (SELECT o.i, lab, parts, least(lab[src + 1], lab[dst + 1]) AS p, greatest(lab[src + 1], lab[dst + 1]) AS q FROM run JOIN o ON o.i = run.i + 1)), done AS (SELECT lab FROM run ORDER BY i DESC LIMIT 1)"
    )


LABELLED = "SELECT vid, (SELECT lab FROM done)[vid + 1]::BIGINT AS cid FROM vox"


def segmented_sql(scale: float) -> str:
    """The sequential pass with bounds: labels, sizes and dearest inner edges in three lists, one row a step."""
    put = lambda of, what: f"CASE WHEN ok THEN list_transform({of}, lambda v, j: CASE WHEN j = p + 1 THEN {what} ELSE v END) ELSE {of} END"
    return (
        "run(i, lab, num, inn) AS (SELECT 0::BIGINT, (SELECT range(count(*)) FROM vox), (SELECT list(1::BIGINT) FROM vox), (SELECT list(0::DOUBLE) FROM vox) "
        f"UNION ALL SELECT i, CASE WHEN ok THEN list_transform(lab, lambda v: CASE WHEN v = q THEN p ELSE v END) ELSE lab END, {put('num', 'pair')}, {put('inn', 'w')} "
        f"FROM (SELECT *, num[p + 1] + num[q + 1] AS pair, p <> q AND w <= inn[p + 1] + {scale} / num[p + 1] AND w <= inn[q + 1] + {scale} / num[q + 1] AS ok "
        "FROM (SELECT o.i, w, lab, num, inn, least(lab[src + 1], lab[dst + 1]) AS p, greatest(lab[src + 1], lab[dst + 1]) AS q FROM run JOIN o ON o.i = run.i + 1))), "
        "done AS (SELECT lab FROM run ORDER BY i DESC LIMIT 1)"
    )


def tree(s, d):
    return forest.spanning(vox(s, d).select("vid"), edges_d(s, d))[1]


def cut_at(s, d):
    nodes = vox(s, d).select("vid")
    return forest.first_members(forest.cut(nodes, tree(s, d), 12))


def partitions(s, d):
    v = vox(s, d)
    return [labels(s, d), synthetic.checkerboard(v, 4, 5), synthetic.checkerboard(v, 3, 3)]


def voted(s, d):
    return forest.first_members(methods.consensus(vox(s, d), partitions(s, d), 12))


PARTS = "pt AS (SELECT vid, cid AS a, (x // 5 + y // 5 + z // 5) % 4 + 1 AS b, (x // 3 + y // 3 + z // 3) % 3 + 1 AS c FROM vox)"
VOTES = f"{VOX}, {Q._edges_sql(1)}, {PARTS}, w AS (SELECT src, dst, ((p.a <> q.a)::INT + (p.b <> q.b)::INT + (p.c <> q.c)::INT) / 3.0::DOUBLE AS w FROM e JOIN pt p ON p.vid = src JOIN pt q ON q.vid = dst)"

FORESTS = {
    "spanning_forest": (lambda s, d: rounded(tree(s, d).select("src", "dst", "w"), "w"), f"WITH RECURSIVE {EDGES}, {ORDER}, {TREE} SELECT src, dst, w FROM tree"),
    "forest_cut": (cut_at, f"WITH RECURSIVE {EDGES}, {ORDER}, {united_sql(12)} {LABELLED}"),
    "forest_segments": (lambda s, d: forest.first_members(forest.segments(vox(s, d).select("vid"), edges_d(s, d), 1.9)), f"WITH RECURSIVE {EDGES}, {ORDER}, {segmented_sql(1.9)} {LABELLED}"),
    "partition_votes": (lambda s, d: rounded(methods.votes(vox(s, d), partitions(s, d)), "w"), f"WITH {VOTES} SELECT src, dst, " + _r("w", "w") + " FROM w"),
    "consensus": (voted, f"WITH RECURSIVE {VOTES}, {ORDER}, {united_sql(12)} {LABELLED}"),
}

# -- slices -----------------------------------------------------------------------


def slice_runs(s, d):
    v = vox(s, d)
    weights = v.select("vid", (F.col("vid") % 3 + 1).cast("double").alias("w"))
    return [(labels(s, d), None), (synthetic.checkerboard(v, 4, 5), weights), (cluster_thirds(v), None)]


def cluster_thirds(v):
    """Labels of which some are 0, which belong to no part."""
    return v.select("vid", F.expr("cast(vid % 5 as int)").alias("cid"))


def slice_prices(s, d):
    v = vox(s, d)
    return rounded(slices.fused_edges(v, slice_runs(s, d), [v.select("vid", "ts")] * 3, 0.7, beta=0.5), "w")


SLICE = (
    "se AS (SELECT a.vid AS src, b.vid AS dst, 1 + 0.5 * (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) - 1) AS f FROM vox a JOIN vox b ON a.z = b.z AND ((b.x = a.x + 1 AND b.y - a.y IN (-1, 0, 1)) OR (b.x = a.x AND b.y = a.y + 1))), "
    f"un AS (SELECT vid, cid, vid % 5 AS third, (x // 5 + y // 5 + z // 5) % 4 + 1 AS board, (vid % 3 + 1)::DOUBLE AS g, list_transform(ts, lambda q: q / {M._N.format('ts')}) AS ts FROM vox), "
    "sp AS (SELECT src, dst, f, 2 + p.g * q.g AS z, (p.cid = q.cid)::INT + p.g * q.g * (p.board = q.board)::INT + (p.third = q.third AND p.third <> 0)::INT AS c, " + M._DOT.format("p.ts", "q.ts") + " AS r FROM se JOIN un p ON p.vid = src JOIN un q ON q.vid = dst), "
    "w AS (SELECT src, dst, " + _r("least(greatest((0.7 * (1 - c / z) + 0.3 * (1 - r)) * f, 0), 2)", "w") + " FROM sp)"
)


def slice_labels(s, d):
    return slices.segment_slices(vox(s, d), slice_prices(s, d), 0.6)


SLICES = {
    "slice_fused_edges": (slice_prices, f"WITH {VOX}, {SLICE} SELECT * FROM w"),
    "slice_segments": (slice_labels, f"WITH RECURSIVE {VOX}, {SLICE}, w1 AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, w FROM w), {ORDER.replace('FROM w)', 'FROM w1)')}, {segmented_sql(0.6)} {LABELLED}"),
}

# -- neighbours by features, communities -----------------------------------------------

UNIT = f"un AS (SELECT vid, list_transform(ts, lambda q: q / {M._N.format('ts')}) AS ts FROM vox)"
SQ = "list_sum(list_transform(range(1, 65), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))"


def nearest_sql(table: str, k: int) -> str:
    return f"nn AS (SELECT * FROM (SELECT a.vid AS src, b.vid AS dst, sqrt({SQ.format('a.ts', 'b.ts')}) AS d, row_number() OVER (PARTITION BY a.vid ORDER BY {SQ.format('a.ts', 'b.ts')}, b.vid)::INT AS rank FROM {table} a JOIN {table} b ON a.vid <> b.vid) WHERE rank <= {k})"


BLOCKS = (
    "bk AS (SELECT vid, (x // 2 + 5 * (y // 2 + 5 * (z // 2)) + 1)::BIGINT AS b, x, y, z, ts FROM vox), bm AS (SELECT b, list(v ORDER BY t) AS ts FROM (SELECT b, t, avg(v) AS v FROM (SELECT b, unnest(range(len(ts))) AS t, unnest(ts) AS v FROM bk) GROUP BY ALL) GROUP BY b), "
    f"pl AS (SELECT b AS vid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM bk GROUP BY b), bu AS (SELECT b AS vid, list_transform(ts, lambda q: q / {M._N.format('ts')}) AS ts FROM bm), "
)
GRAPH = BLOCKS + nearest_sql("bu", 6) + ", w AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(0.4 * greatest(0, 1 - d) + 0.6 * exp(-((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) / 8)) AS w FROM nn JOIN pl a ON a.vid = src JOIN pl b ON b.vid = dst GROUP BY ALL)"
#: Degrees and totals of the graph w with labels lb (vid, cid).
SUMS = "m AS (SELECT sum(w) AS m FROM w), wy AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w), dg AS (SELECT lb.vid, cid, coalesce(sum(w), 0) AS k FROM lb LEFT JOIN wy ON src = lb.vid GROUP BY ALL), tt AS (SELECT cid, sum(k) AS total FROM dg GROUP BY cid)"
LB = "lb AS (SELECT vid, vid % 7 AS cid FROM bu)"


def blocks_of(s, d):
    return neighbours.block_graph(vox(s, d), 2, 6, 0.4)


def quality(s, d):
    edges, nodes, _ = blocks_of(s, d)
    return rounded(louvain.modularity(nodes.select("vid", (F.col("vid") % 7).alias("cid")), edges, 1.3), "q")


def wanted_moves(s, d, only: bool = False):
    edges, nodes, _ = blocks_of(s, d)
    edges, nodes = edges.withColumn("g", F.lit(0)), nodes.withColumn("g", F.lit(0)).select("g", "vid")
    m = edges.agg(F.sum("w")).first()[0] or 1.0
    labelled = louvain.degrees(nodes, edges).withColumn("cid", F.col("vid") % 7)
    found = louvain.moves(labelled, edges, F.lit(1.3), F.lit(m))
    return rounded((louvain.apart(found) if only else found).select("vid", "a", "c", "gain"), "gain")


WANTED = (
    f"{SUMS}, kc AS (SELECT src AS vid, cid AS c, sum(w) AS w FROM wy JOIN lb ON lb.vid = dst GROUP BY ALL), "
    "gn AS (SELECT dg.vid, dg.cid AS a, kc.c, (kc.w - coalesce(o.w, 0)) / m - 1.3 * k * (t.total - own.total + k) / (2 * m * m) AS gain FROM dg JOIN kc ON kc.vid = dg.vid AND kc.c <> dg.cid LEFT JOIN kc o ON o.vid = dg.vid AND o.c = dg.cid JOIN tt t ON t.cid = kc.c JOIN tt own ON own.cid = dg.cid, m), "
    "mv AS (SELECT * FROM gn WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY vid ORDER BY gain DESC, c) = 1)"
)
COMMUNITIES = {
    "feature_knn": (lambda s, d: rounded(neighbours.feature_knn(vox(s, d), 6), "d"), f"WITH {VOX}, {UNIT}, {nearest_sql('un', 6)} SELECT src, dst, rank, " + _r("d", "d") + " FROM nn"),
    "block_graph": (lambda s, d: rounded(blocks_of(s, d)[0], "w"), f"WITH {VOX}, {GRAPH} SELECT src, dst, " + _r("w", "w") + " FROM w"),
    "modularity": (quality, f"WITH {VOX}, {GRAPH}, {LB}, {SUMS} SELECT " + _r("(SELECT sum(w) FROM w JOIN lb a ON a.vid = src JOIN lb b ON b.vid = dst WHERE a.cid = b.cid) / any_value(m) - 1.3 * sum(total * total) / (4 * any_value(m) ** 2)", "q") + ", count(*) AS communities FROM tt, m"),
    "louvain_moves": (wanted_moves, f"WITH {VOX}, {GRAPH}, {LB}, {WANTED} SELECT vid, a, c, " + _r("gain", "gain") + " FROM mv"),
    "louvain_apart": (lambda s, d: wanted_moves(s, d, True), f"WITH {VOX}, {GRAPH}, {LB}, {WANTED}, tc AS (SELECT vid, gain, unnest([a, c]) AS x FROM mv), tb AS (SELECT vid FROM tc QUALIFY row_number() OVER (PARTITION BY x ORDER BY gain DESC, vid) = 1) SELECT vid, a, c, " + _r("gain", "gain") + " FROM mv WHERE vid IN (SELECT vid FROM tb GROUP BY vid HAVING count(*) = 2)"),
}

# -- spectra ------------------------------------------------------------------------------

#: The 8 nearest places, ties to the smaller voxel, weights with kernels of both.
COMMUTE = (
    "pd AS (SELECT a.vid AS src, b.vid AS dst, a.ts AS ta, b.ts AS tb, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM vox a JOIN vox b ON a.vid <> b.vid AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND abs(a.z - b.z) <= 3), "
    "pk AS (SELECT * FROM pd QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 8), "
    f"pw AS (SELECT src, dst, 0.6 * exp(-{SQ.format('ta', 'tb')} / (2 * 64) / (2 * 0.5329)) + 0.4 * exp(-d2 / 50) AS w FROM pk), "
    "ps AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) / 2 AS w FROM pw), w AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM ps GROUP BY ALL)"
)


def weights(s, d):
    return methods.commute_weights(vox(s, d), 9, alpha=0.6, mode="heat")


def one_step(s, d):
    """The graph times the roots of the degrees, which it leaves as they are, and times the places."""
    v = vox(s, d)
    g, steps = spectral.normalised(v, weights(s, d))
    own = v.select(F.col("vid").alias("src"), F.col("vid").alias("dst"), F.lit(0.0).alias("s"), F.lit(1.0).alias("own"))
    block = v.join(g, "vid").select("vid", F.lit(0.0).alias("p0"), F.lit(0.0).alias("p1"), F.sqrt("g").alias("c0"), F.col("x").cast("double").alias("c1"))
    return rounded(spectral.stepped(block, steps.withColumn("own", F.lit(0.0)).union(own), 2, 1.0, -0.5, 0.0).select("vid", "c0", "c1"), "c0", "c1")


SPECTRA = {
    "commute_weights": (lambda s, d: rounded(weights(s, d), "w"), f"WITH {VOX}, {COMMUTE} SELECT src, dst, " + _r("w", "w") + " FROM w"),
    "graph_step": (one_step, f"WITH {VOX}, {COMMUTE}, wy AS (SELECT src, dst, w FROM w UNION ALL SELECT dst, src, w FROM w), dg AS (SELECT src AS vid, sum(w) AS g FROM wy GROUP BY src), ad AS (SELECT src AS vid, sum(w / sqrt(a.g * b.g) * v.x) AS sx FROM wy JOIN dg a ON a.vid = src JOIN dg b ON b.vid = dst JOIN vox v ON v.vid = dst GROUP BY src) SELECT vid, " + _r("0.5 * sqrt(g)", "c0") + ", " + _r("sx - 0.5 * x", "c1") + " FROM ad JOIN dg USING (vid) JOIN vox USING (vid)"),
}

# -- ranks, robust location, soft memberships ------------------------------------------------


def rank_correlations(s, d):
    pairs = spatial.with_features(Q.edges(s, d), tens(s, d))
    return rounded(pairs.select("src", "dst", V.spearman("a", "b").alias("r")), "r")


def tens(s, d):
    """Series rounded to tenths, so that ranks have ties."""
    return vox(s, d).withColumn("ts", F.transform("ts", lambda v: F.round(v * 10, 0)))


def locations(s, d):
    return rounded(vox(s, d).select("vid", V.huber_location("ts").alias("mu")), "mu")


RANKED = f"tn AS (SELECT vid, t, round(v * 10, 0) AS v FROM s), rk AS (SELECT vid, t, rank() OVER (PARTITION BY vid ORDER BY v) + (count(*) OVER (PARTITION BY vid, v) - 1) / 2.0 AS r FROM tn), {Q._edges_sql(1)}"
HUBER = (
    "md AS (SELECT vid, median(v) AS m FROM s GROUP BY vid), mad AS (SELECT vid, any_value(m) AS m, 1.4826 * median(abs(v - m)) AS sp FROM s JOIN md USING (vid) GROUP BY vid), "
    "it(vid, ts, sp, i, mu) AS (SELECT vid, ts, sp, 0, m FROM mad JOIN vox USING (vid) UNION ALL SELECT vid, ts, sp, i + 1, list_avg(list_transform(ts, lambda v: least(greatest(v, mu - 1.5 * sp), mu + 1.5 * sp))) FROM it WHERE i < 50)"
)


def memberships(s, d):
    """Shares of three partitions after fixed renamings."""
    v = vox(s, d)
    turned = [{c: (c + by - 1) % 10 + 1 for c in range(1, 11)} for by in (0, 3, 5)]
    return rounded(ensemble.averaged([labels(s, d), synthetic.checkerboard(v, 4, 5), synthetic.checkerboard(v, 3, 3)], turned), "p")


ROBUST = {
    "rank_correlation": (rank_correlations, f"WITH {Q.LONG}, {RANKED} SELECT src, dst, " + _r("corr(a.r, b.r)", "r") + " FROM e JOIN rk a ON a.vid = src JOIN rk b ON b.vid = dst AND b.t = a.t GROUP BY src, dst"),
    "huber_location": (locations, f"WITH RECURSIVE {Q.LONG}, {HUBER} SELECT vid, " + _r("mu", "mu") + " FROM it WHERE i = 50"),
    "soft_memberships": (memberships, f"WITH {VOX}, {PARTS}, al AS (SELECT vid, a AS c FROM pt UNION ALL SELECT vid, (b + 2) % 10 + 1 FROM pt UNION ALL SELECT vid, (c + 4) % 10 + 1 FROM pt) SELECT vid, c::INT AS c, " + _r("count(*) / 3.0", "p") + " FROM al GROUP BY vid, c"),
}

ALL = FORESTS | SLICES | COMMUNITIES | SPECTRA | ROBUST
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
