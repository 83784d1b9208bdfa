"""Queries of sources, sketches, graphs, seeds, reports and single steps of the methods, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import embed, exact, flow, forest, graph, groups, local, measures, merge, result, seeds, series, spatial
from gridfuse.plans import more as M
from gridfuse.plans import queries as Q
from gridfuse.sources import synthetic, volumes

rounded, _r, vox, labels, centers = Q.rounded, Q._r, M.vox, M.labels, M.centers
VOX, LONG = Q.VOX, Q.LONG
E6, E26 = Q._edges_sql(1), Q._edges_sql(3)
DOT, NORM = M._DOT, M._N
R = lambda e, n: _r(e, n)


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows, for matrices that are parameters."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(repr(float(v)) if isinstance(v, float) else str(v) for v in r) + ")" for r in rows) + ")"


def matrix_sql(name: str, basis) -> str:
    return values(name, "k, t, b", [(k, t, float(basis[k, t])) for k in range(basis.shape[0]) for t in range(basis.shape[1])])


def exploded(df, column="ts"):
    return df.select("vid", F.posexplode(column).alias("k", "c"))


def edges(s, d, connectivity=6):
    return Q.edges(s, d, connectivity)


def own(s, d):
    """Voxels beside the center of their label."""
    return vox(s, d).join(labels(s, d), "vid").join(centers(s, d), "cid")


OWN = M.OWN
CEN = M.CEN
D2, SQF = M.D2, M.SQF
COS = lambda a, b: f"({DOT.format(a, b)} / ({NORM.format(a)} * {NORM.format(b)}))"

# -- sources ------------------------------------------------------------------


def masked(s, d):
    rows = series.masked(vox(s, d).withColumn("mask", F.col("vid") % 3), (3.0, 3.0, 4.0), (1.0, 2.0, 3.0))
    return rounded(rows.select("vid", "mx", "my", "mz", F.posexplode("ts").alias("t", "v")), "mx", "my", "mz", "v")


def nifti(s, d):
    """Labels through a file and back. The file is a whole box; a mask, written beside it, tells its voxels from the rest of the last slice."""
    v = vox(s, d)
    depth = v.agg(F.max("z")).first()[0] + 1
    folder = f"{graph.folder(s)}/nifti-{graph.uuid.uuid4().hex}"
    here = v.select("vid", F.lit(1).alias("cid"))
    path, mask = [graph.saved(volumes.write_nifti(v, l, f"{folder}/{name}", (10, 10, depth), (2.0, 2.0, 3.0), only)).first().path for name, l, only in (("labels", labels(s, d), None), ("mask", here, 1))]
    return volumes.read_nifti(s, path, mask).select(F.col("vid"), F.col("ts")[0].cast("int").alias("cid"), F.col("mx").alias("mx"), F.col("mz").alias("mz"))


def cube_volume(s, d, side: int = 5, k: int = 8):
    """The table's places with orthogonal series for cubes, whose labels go round from k to 1."""
    places = vox(s, d).select("vid", "x", "y", "z")
    labelled = synthetic.cubes(places, side, 2).select("vid", ((F.col("cid") - 1) % k + 1).cast("int").alias("cid"))
    return synthetic.with_patterns(places, labelled, synthetic.patterns(k, 20), 0.0)


def cube_products(s, d):
    return rounded(spatial.with_features(edges(s, d), cube_volume(s, d)).select("src", "dst", V.dot("a", "b").alias("product")), "product")


BLOBS = [(1, 2.0, 3.0, 1.5), (2, 8.0, 2.0, 2.0), (3, 3.0, 9.0, 3.0), (4, 9.0, 8.0, 4.5)]


def blobs(s, d):
    c = s.createDataFrame(BLOBS, "cid int, cx double, cy double, cz double")
    return rounded(synthetic.blobs(vox(s, d), c, (3.0, 3.0, 2.0)), "weight")


def pattern_peaks(s, d):
    """Peaks of the series that voxels get by their label, and how far labels differ from the first."""
    places, lab = vox(s, d).select("vid", "x", "y", "z"), labels(s, d)
    out = None
    for kind in ("harmonic", "random"):
        rows = synthetic.with_patterns(places, lab, synthetic.patterns(10, 40, kind)).select("vid", F.lit(kind).alias("kind"), F.array_max(F.transform("ts", F.abs)).alias("peak"))
        out = rows if out is None else out.union(rows)
    return rounded(out, "peak")


def band_series(s, d):
    places = vox(s, d).select("vid", "x", "y", "z")
    rows = Q.long(synthetic.with_patterns(places, synthetic.thirds(places, 10), synthetic.band_series(16)))
    # A square wave at its jumps is the sign of rounding errors: those times are left out on both sides.
    return rows.filter("t % 5 > 0 OR vid % 10 < 3 OR vid % 10 >= 6")


def index(s, d):
    v = vox(s, d).select("vid", synthetic.linear("x", "y", "z", 10, 10).alias("from_zero"), synthetic.linear(F.col("x") + 1, F.col("y") + 1, F.col("z") + 1, 10, 10, 1).alias("from_one"))
    return v.select("*", *synthetic.place("from_one", 10, 10, 1))


SOURCES = {
    "promote_3d": (lambda s, d: Q.long(series.promoted(vox(s, d).select("vid", F.col("ts")[0].alias("v")))), f"WITH {VOX} SELECT vid, 0 AS t, " + R("ts[1]", "v") + " FROM vox"),
    "contract_check": (lambda s, d: result.contract(vox(s, d)), f"WITH {VOX} SELECT count(*) AS n_voxels, count(DISTINCT vid) AS n_ids, count(DISTINCT len(ts)) AS n_lengths, count(*) FILTER (len(ts) < 1) AS n_empty, count(*) FILTER (len(list_filter(ts, lambda q: isnan(q) OR isinf(q))) > 0) AS n_not_finite FROM vox"),
    "masked_scan": (masked, f"WITH {LONG} SELECT vid, " + R("x * 3.0 + 1", "mx") + ", " + R("y * 3.0 + 2", "my") + ", " + R("z * 4.0 + 3", "mz") + ", t, " + R("(v - avg(v) OVER (PARTITION BY t)) / stddev_samp(v) OVER (PARTITION BY t)", "v") + " FROM s JOIN vox USING (vid) WHERE vid % 3 > 0"),
    "nifti_round_trip": (nifti, f"WITH {VOX} SELECT vid, cid::INT AS cid, x * 2.0::DOUBLE AS mx, z * 3.0::DOUBLE AS mz FROM vox"),
    "cube_labels": (lambda s, d: synthetic.cubes(vox(s, d), 3, 4), f"WITH {VOX} SELECT vid, (x // 3 + 4 * (y // 3 + 4 * (z // 3)) + 1)::INT AS cid FROM vox"),
    "cube_signal_products": (cube_products, f"WITH {VOX}, {E6}, cb AS (SELECT vid, (x // 5 + 2 * (y // 5 + 2 * (z // 5))) % 8 AS c FROM vox) SELECT src, dst, CASE WHEN a.c = b.c THEN 20.0 ELSE 0.0 END::DOUBLE AS product FROM e JOIN cb a ON a.vid = src JOIN cb b ON b.vid = dst"),
    "blob_labels": (blobs, f"WITH {VOX}, " + values("c", "cid, cx, cy, cz", BLOBS) + ", f AS (SELECT vid, c.cid, ((x + 1 - cx) / 3) ** 2 + ((y + 1 - cy) / 3) ** 2 + ((z + 1 - cz) / 2) ** 2 AS far FROM vox, c), b AS (SELECT vid, cid, exp(-far / 2) AS w FROM f QUALIFY row_number() OVER (PARTITION BY vid ORDER BY far, cid) = 1) SELECT vid, cid::INT AS cid, " + R("greatest(w / max(w) OVER (), 0.2)", "weight") + " FROM b"),
    "layer_labels": (lambda s, d: synthetic.layers(vox(s, d), 3), f"WITH {VOX} SELECT vid, ceil((z + 0.5) * 3 / (SELECT max(z) + 1 FROM vox))::INT AS cid FROM vox"),
    "pattern_peaks": (pattern_peaks, f"WITH {VOX} SELECT vid, kind, 1.0::DOUBLE AS peak FROM vox, (VALUES ('harmonic'), ('random')) a(kind)"),
    "band_series": (band_series, f"WITH {VOX}, t AS (SELECT t, 2 * pi() * t / 15 AS a FROM range(16) r(t)) SELECT vid, t::INT AS t, " + R("CASE WHEN x < 3 THEN sin(a) WHEN x < 6 THEN 0.8 * sign(sin(3 * a)) ELSE 0.6 * sin(2 * a + pi() / 4) END", "v") + " FROM vox, t WHERE t % 5 > 0 OR x < 3 OR x >= 6"),
    "linear_index": (index, f"WITH {VOX} SELECT vid, (x + 10 * (y + 10 * z))::BIGINT AS from_zero, (x + 10 * (y + 10 * z) + 1)::BIGINT AS from_one, x + 1 AS x, y + 1 AS y, z + 1 AS z FROM vox"),
}
# -- scalars and sketches -------------------------------------------------------


def repaired(s, d):
    v = vox(s, d).withColumn("ts", F.when(F.col("vid") % 50 == 0, F.transform("ts", lambda x: F.lit(3.0))).otherwise(F.col("ts")))
    found = v.select("vid", F.col("ts").alias("old"), V.repaired(F.col("ts"), F.col("vid")).alias("new"))
    return found.select("vid", (F.col("old") != F.col("new")).alias("changed"), (V.deviation("new") > 0.001).alias("varies"))


def int8(s, d):
    v = vox(s, d).select("vid", V.quantise_unit(V.unit("ts")).alias("ts"))
    return rounded(spatial.with_features(edges(s, d), v).select("src", "dst", V.dot_int8("a", "b").alias("w")), "w")


def codes(s, d):
    return embed.hash_bits(vox(s, d), 64)


def hammings(s, d):
    v = codes(s, d).withColumnRenamed("h", "ts")
    return spatial.with_features(edges(s, d), v).select("src", "dst", V.hamming(F.col("a"), F.col("b")).cast("int").alias("n"))


def sizes_of(s, d):
    """For the voxels of each label, with series cut to 1, 20 or all samples."""
    rows = vox(s, d).join(labels(s, d), "vid").groupBy("cid").agg(F.count("*").alias("n"), F.max(F.size("ts")).alias("all"))
    rows = rows.select("cid", "n", F.explode(F.array(F.lit(1), F.lit(20), F.col("all"))).alias("t"))
    return rows.select("cid", "n", "t", embed.embedding_sizes(F.col("n"), F.col("t")).alias("size"))


def trained(s, d):
    v = vox(s, d)
    fitted = embed.Components(v.filter("vid % 2 = 0"), 10)
    return rounded(fitted.transform(v.filter("vid % 2 = 1")).select("vid", V.norm("ts").alias("length")), "length")


def variance(s, d):
    fitted = embed.Components(vox(s, d), 64, 1.0)
    return s.createDataFrame([(round(float(fitted.values.sum()), 4), fitted.basis.shape[0])], "total double, n int")


SKETCH = embed.hash_projection(64, 16, embed.splitmix(1)) + embed.hash_projection(64, 16, embed.splitmix(2))
SUMS = LONG + ", " + matrix_sql("basis", SKETCH) + ", dm AS (SELECT vid, t, v - avg(v) OVER (PARTITION BY vid) AS v FROM s), c AS (SELECT vid, k, sum(v * b) / sqrt(2) AS c FROM dm JOIN basis USING (t) GROUP BY vid, k)"
WHITE = SUMS + ", wh AS (SELECT vid, k, (c - avg(c) OVER (PARTITION BY k)) / (stddev_samp(c) OVER (PARTITION BY k) + 1e-8) AS c FROM c)"
UNIT_OF = "SELECT vid, k::INT AS k, " + R("c / sqrt(sum(c * c) OVER (PARTITION BY vid))", "c") + " FROM {}"
PAIRS = values("p", "b, i, j", [(b, i, j) for b, (i, j) in enumerate(embed.bit_pairs(12, 64))])
CODES = (
    LONG + ", " + PAIRS + ", dm AS (SELECT vid, t, v - avg(v) OVER (PARTITION BY vid) AS v FROM s), c AS (SELECT vid, k, CASE WHEN k = 0 THEN 0 ELSE sum(v * cos(pi() * (t + 0.5) * k / 64)) END AS c FROM dm, range(12) r(k) GROUP BY vid, k), "
    "bits AS (SELECT a.vid, p.b, (a.c > o.c) AS hit FROM p JOIN c a ON a.k = p.i JOIN c o ON o.k = p.j AND o.vid = a.vid), "
    "hh AS (SELECT vid, sum(CASE WHEN hit AND b < 63 THEN 1::HUGEINT << b WHEN hit THEN -(1::HUGEINT << 63) ELSE 0 END)::BIGINT AS h FROM bits GROUP BY vid)"
)
ZT = LONG + ", z AS (SELECT vid, t, (v - avg(v) OVER (PARTITION BY t)) / stddev_samp(v) OVER (PARTITION BY t) AS v FROM s)"

SCALARS = {
    "unit_strict": (lambda s, d: rounded(vox(s, d).select("vid", V.total(V.unit_strict("ts")).alias("total")), "total"), f"WITH {VOX} SELECT vid, " + R("list_sum(ts) / " + NORM.format("ts"), "total") + " FROM vox"),
    "int8_dot": (int8, f"WITH {VOX}, {E6}, q AS (SELECT vid, list_transform(ts, lambda q: round(q / n * 127)::INT) AS ts FROM (SELECT vid, ts, {NORM.format('ts')} AS n FROM vox)) SELECT src, dst, " + R(DOT.format("a.ts", "b.ts") + " / 16129.0", "w") + " FROM e JOIN q a ON a.vid = src JOIN q b ON b.vid = dst"),
    "center_cosine": (lambda s, d: (lambda c: rounded(c.select(F.col("cid").alias("src"), F.col("feat").alias("a")).join(c.select(F.col("cid").alias("dst"), F.col("feat").alias("b")), F.col("src") < F.col("dst")).select("src", "dst", V.cosine("a", "b").alias("w")), "w"))(centers(s, d).select("cid", "feat")), f"WITH {CEN} SELECT a.cid AS src, b.cid AS dst, " + R(COS("a.feat", "b.feat"), "w") + " FROM cen a JOIN cen b ON a.cid < b.cid"),
    "growth_cost": (lambda s, d: rounded(own(s, d).select("vid", V.seed_cost("ts", "feat", F.sqrt(local.space()), 0.4, 3.0).alias("cosine"), V.seed_cost("ts", "feat", F.sqrt(local.space()), 0.4, 3.0, True).alias("euclid")), "cosine", "euclid"), f"WITH {OWN} SELECT vid, " + R(f"0.4 * (1 - {COS('ts', 'feat')}) + 0.6 * sqrt(d2) / 3", "cosine") + ", " + R("0.4 * sqrt(sq) + 0.6 * sqrt(d2) / 3", "euclid") + " FROM own"),
    "region_distance": (lambda s, d: rounded(own(s, d).select("vid", V.region_distance("ts", "feat", local.space(), 4.0, 5.0).alias("v")), "v"), f"WITH {OWN} SELECT vid, " + R("d2 / 4 + sq / 5", "v") + " FROM own"),
    "weight_16bit": (lambda s, d: Q.edge_d(s, d).select("src", "dst", V.quantise_weight(F.round("d", 9)).alias("q")), f"WITH {Q.DIST} SELECT src, dst, floor(least(greatest(round(d, 9), 0), 2) * 32767.5)::INT AS q FROM d"),
    "repaired_series": (repaired, f"WITH {VOX} SELECT vid, vid % 50 = 0 AS changed, true AS varies FROM vox"),
    "hash_bits": (codes, f"WITH {CODES} SELECT vid, h FROM hh"),
    "hamming_edges": (hammings, f"WITH {CODES}, {E6} SELECT src, dst, bit_count(xor(a.h, b.h))::INT AS n FROM e JOIN hh a ON a.vid = src JOIN hh b ON b.vid = dst"),
    "count_sketch": (lambda s, d: rounded(exploded(embed.count_sketch(vox(s, d), 64, 16, 1, 2)), "c"), f"WITH {SUMS.replace('basis(', 'basis(')} " + UNIT_OF.format("c")),
    "count_sketch_white": (lambda s, d: rounded(exploded(embed.count_sketch(vox(s, d), 64, 16, 1, 2, True)), "c"), f"WITH {WHITE} " + UNIT_OF.format("wh")),
    "cosine_embedding": (lambda s, d: rounded(exploded(embed.cosine_embedding(vox(s, d), 64, 5)).withColumn("k", F.col("k") + 1), "c"), f"WITH {LONG}, c AS (SELECT vid, k, sum(v * sqrt(2 / 64.0) * cos(pi() * (t + 0.5) * k / 64)) AS c FROM s, range(1, 6) r(k) GROUP BY vid, k) " + UNIT_OF.format("c")),
    "embedding_size": (sizes_of, f"WITH {VOX}, c AS (SELECT cid, count(*) AS n FROM vox GROUP BY cid) SELECT cid, n, t::INT AS t, greatest(1, least(8 * round_even(greatest(16, least(128, 8 * log2(greatest(n, 2)))) / 8, 0), CASE WHEN t > 1 THEN t - 1 ELSE 1 END))::INT AS size FROM c, (VALUES (1), (20), (64)) u(t)"),
    "scaled_gram": (lambda s, d: rounded(embed.gram(embed.Components(vox(s, d), 4).prepared(vox(s, d))).filter("s < 8 AND t < 8"), "g"), f"WITH {ZT} SELECT a.t AS s, b.t AS t, " + R("sum(a.v * b.v)", "g") + " FROM z a JOIN z b USING (vid) WHERE a.t < 8 AND b.t < 8 GROUP BY a.t, b.t"),
    "svd_variance": (variance, f"WITH {ZT} SELECT round(sum(v * v), 4) AS total, 64 AS n FROM z"),
    "svd_new_rows": (trained, f"WITH {VOX} SELECT vid, 1.0::DOUBLE AS length FROM vox WHERE vid % 2 = 1"),
    "random_projection": (lambda s, d: rounded(exploded(embed.random_projection(vox(s, d), 64, 4)), "c"), f"WITH {LONG}, " + matrix_sql("basis", embed.np.random.default_rng(123).normal(size=(4, 64)) / 2.0) + " SELECT vid, k::INT AS k, " + R("sum(v * b)", "c") + " FROM s JOIN basis USING (t) GROUP BY vid, k"),
    "block_projection": (lambda s, d: rounded(exploded(embed.block_projection(vox(s, d), 64, 3)), "c"), f"WITH {LONG}, {Q.COS} SELECT vid, k, " + R("sum(v * b)", "c") + " FROM s JOIN basis USING (t) WHERE k < 3 GROUP BY vid, k"),
    "block_cleaning": (lambda s, d: Q.long(series.clean_for_blocks(vox(s, d))), Q.ORACLES["normalize_detrend"]),
    "sketch_z_smooth": (lambda s, d: rounded(series.smooth_z(vox(s, d).select("vid", "x", "y", "z", F.slice("ts", 1, 2).alias("ts")), "ts").select("vid", F.posexplode("smooth").alias("k", "c")), "c"), f"WITH {VOX}, k AS (SELECT unnest([0, 1]) AS k) SELECT a.vid, k::INT AS k, " + R("0.5 * a.ts[k + 1] + 0.25 * (coalesce(b.ts[k + 1], a.ts[k + 1]) + coalesce(c.ts[k + 1], a.ts[k + 1]))", "c") + " FROM k, vox a LEFT JOIN vox b ON b.vid = a.vid - 100 LEFT JOIN vox c ON c.vid = a.vid + 100"),
    "series_statistics": (lambda s, d: rounded(vox(s, d).select("vid", V.mean("ts").alias("mean"), V.deviation("ts").alias("sd")), "mean", "sd"), f"WITH {LONG} SELECT vid, " + R("avg(v)", "mean") + ", " + R("stddev_samp(v)", "sd") + " FROM s GROUP BY vid"),
}

# -- graphs and assignments -----------------------------------------------------

D3 = "((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
KNN7 = f"k AS (SELECT a.vid AS src, b.vid AS dst, row_number() OVER (PARTITION BY a.vid ORDER BY {D3}, b.vid)::INT AS rank, sqrt({D3}) AS d FROM vox a JOIN vox b ON a.vid <> b.vid QUALIFY rank <= 7)"
SIM = LONG + f", {E6}, w AS (SELECT src, dst, (corr(a.v, b.v) + 1) / 2 AS w FROM e JOIN s a ON a.vid = src JOIN s b ON b.vid = dst AND a.t = b.t GROUP BY src, dst)"
FWD = values("o", "dx, dy, dz, f", [(*o, 1 + 0.5 * (float(embed.np.sqrt((o[0] * 2.0) ** 2 + (o[1] * 2.0) ** 2 + (o[2] * 3.0) ** 2)) / 2.0 - 1)) for o in spatial.FORWARD[26]])
AT27 = "abs(floor(x / {0}) - floor(cx / {0})) <= 1 AND abs(floor(y / {0}) - floor(cy / {0})) <= 1 AND abs(floor(z / {0}) - floor(cz / {0})) <= 1"
STEP = 3.0
CLOSE = "(SELECT vid, cid, {cost} AS cost, " + AT27.format(STEP) + " AS near FROM vox v CROSS JOIN (SELECT cid AS c2, feat, cx, cy, cz FROM {cen}) c)"


def spread_centers(s, d):
    """Centers of the labels moved apart, so that windows matter."""
    return graph.saved(centers(s, d).withColumns({f"c{c}": F.col(f"c{c}") + F.col("cid") % 3 * 2 - 2 for c in "xyz"}))


SPREAD = CEN + ", cc AS (SELECT cid, feat, cx + cid % 3 * 2 - 2 AS cx, cy + cid % 3 * 2 - 2 AS cy, cz + cid % 3 * 2 - 2 AS cz FROM cen)"


def slic_assigned(s, d):
    return spatial.assign(vox(s, d), spread_centers(s, d), STEP / 2, 2.0)


def corr_assigned(s, d):
    units = vox(s, d).withColumn("ts", V.unit("ts"))
    c = spread_centers(s, d).withColumn("feat", V.unit("feat"))
    return local.nearest_center(units, c, STEP, 1 - V.dot("ts", "feat") + 0.3 * local.space() / 9)


def relax(s, d):
    v = vox(s, d)
    rows = graph.saved(v.select("vid", "x", "y", "z").join(codes(s, d), "vid"))
    seeds_at = rows.filter("vid % 60 = 7").select((F.col("vid") + 1).alias("cid"), *[F.col(c).alias(f"c{c}") for c in "xyz"], F.col("h").alias("g"))
    carried = rows.select("vid", (F.expr("vid div 60") * 60 + 8).alias("cid")).filter("cid <= 488")
    price = 0.6 * local.space() / 9 + V.hamming(F.col("h"), F.col("g")) / 64
    return local.relaxed(rows, carried, seeds_at, 2, price)


def single(s, d):
    return vox(s, d).withColumn("ts", F.slice("ts", 1, 1))


def points(s, d):
    return s.createDataFrame([(1, 0, 0, 0), (2, 5, 5, 2), (3, 11, 3, 1), (4, 40, 40, 40), (5, -1, -1, 0)], "cid int, x int, y int, z int")


def sparse(s, d):
    return vox(s, d).filter("vid % 3 <> 1")


LAP = (
    "WITH " + VOX + ", " + E26 + ", m AS (SELECT vid, x, y, z, list_avg(ts) AS v FROM vox), b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), "
    "w AS (SELECT src, dst, exp(-((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2) / 0.5) AS w FROM b JOIN m p ON p.vid = src JOIN m q ON q.vid = dst), "
    "sm AS (SELECT src AS vid, sum(w * v) / sum(w) AS s FROM w JOIN m ON m.vid = dst GROUP BY src) "
    "SELECT src AS vid, " + _r("abs(sum(w * (p.s - q.s)))", "g") + " FROM w JOIN sm p ON p.vid = src JOIN sm q ON q.vid = dst GROUP BY src"
)


def steps_row(step):
    return lambda s, d: step(s, d).select("vid", "cid")


UN = "un AS (SELECT vid, cid, x, y, z, list_transform(dm, lambda q: q / n) AS ts FROM (SELECT *, sqrt(list_sum(list_transform(dm, lambda q: q * q))) AS n FROM (SELECT *, list_transform(ev, lambda q: q - list_avg(ev)) AS dm FROM (SELECT *, list_transform(range(32), lambda i: ts[2 * i + 1]) AS ev FROM vox))))"
UNC = UN + ", lg AS (SELECT cid, unnest(range(32)) AS t, unnest(ts) AS v FROM un), mean AS (SELECT cid, list(v ORDER BY t) AS f FROM (SELECT cid, t, avg(v) AS v FROM lg GROUP BY cid, t) GROUP BY cid), pos AS (SELECT cid, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM vox GROUP BY cid), cc AS (SELECT cid, list_transform(f, lambda q: q / " + NORM.format("f") + ") AS feat, cx, cy, cz FROM mean JOIN pos USING (cid))"
DOT32 = DOT.replace("65", "33")
EDGE = "b AS (SELECT src AS vid, dst AS n FROM e UNION ALL SELECT dst, src FROM e), edge AS (SELECT DISTINCT b.vid FROM b JOIN vox p ON p.vid = b.vid JOIN vox q ON q.vid = b.n WHERE p.cid <> q.cid), cand AS (SELECT vid, cid FROM vox UNION SELECT b.vid, q.cid FROM b JOIN vox q ON q.vid = b.n)"
NEAREST27 = "pr AS (SELECT v.vid, c.cid, {cost} AS cost, " + AT27.format(STEP) + " AS near FROM {rows} v CROSS JOIN cc c), ok AS (SELECT *, max(near::INT) OVER (PARTITION BY vid) AS any_near FROM pr), win AS (SELECT vid, cid FROM ok WHERE near OR any_near = 0 QUALIFY row_number() OVER (PARTITION BY vid ORDER BY cost, cid) = 1)"


def exact_all(s, d):
    return local.exact_step(vox(s, d), labels(s, d), None, STEP, 0.2, 2)


def exact_edges(s, d):
    return local.exact_step(vox(s, d), labels(s, d), edges(s, d), STEP, 0.2, 2)


def boundary_pass(s, d):
    return local.boundary_step(vox(s, d), labels(s, d), edges(s, d), STEP, 0.2, 0.5, 1)


GRAPHS = {
    "knn_any": (lambda s, d: rounded(spatial.knn(vox(s, d), 7), "d"), f"WITH {VOX}, {KNN7} SELECT src, dst, rank, " + R("d", "d") + " FROM k"),
    "knn_edges": (lambda s, d: spatial.knn_edges(vox(s, d), 7), f"WITH {VOX}, {KNN7} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM k"),
    "heat_similarity": (lambda s, d: rounded(spatial.heat_similarity(edges(s, d), vox(s, d)), "w"), f"WITH {Q.DIST} SELECT src, dst, " + R("exp(-d / (2 * (SELECT median(sqrt(d)) FROM d WHERE d > 0) ** 2))", "w") + " FROM d"),
    "weighted_graph": (lambda s, d: rounded(spatial.weighted_graph(vox(s, d), 6, 0.3), "w"), f"WITH {SIM} SELECT src, dst, " + R("greatest(0.7 * w + 0.3 * exp(-0.5), 1e-6)", "w") + " FROM w"),
    "forward_edges": (lambda s, d: rounded(spatial.forward_edges(vox(s, d), 26, (2.0, 2.0, 3.0), 0.5), "w"), f"WITH {VOX}, {FWD} SELECT a.vid AS src, b.vid AS dst, " + R("least(greatest((1 - " + COS("a.ts", "b.ts") + ") * f, 0), 2)", "w") + " FROM vox a CROSS JOIN o JOIN vox b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz"),
    "region_pairs": (lambda s, d: spatial.region_pairs(vox(s, d), labels(s, d), True, False), f"WITH {VOX} SELECT DISTINCT least(a.cid, b.cid) AS src, greatest(a.cid, b.cid) AS dst FROM vox a JOIN vox b ON a.z = b.z AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.cid <> b.cid"),
    "label_switches": (lambda s, d: local.switched(labels(s, d), M.best(s, d)), f"WITH b AS ({M.ORACLES['best_candidate']}) SELECT count(*) FILTER (b.cid <> e.label + 1) AS n FROM b JOIN embeddings e ON e.vec_id = b.vid"),
    "slic_assign": (slic_assigned, f"WITH {SPREAD}, {NEAREST27.format(cost=SQF + ' + ' + D2 + ' * 4 / 2.25', rows='vox')} SELECT * FROM win"),
    "corr_assign": (corr_assigned, f"WITH {SPREAD}, {NEAREST27.format(cost='1 - ' + COS('ts', 'feat') + ' + 0.3 * ' + D2 + ' / 9', rows='vox')} SELECT * FROM win"),
    "boundary_flag": (lambda s, d: local.boundary_flag(vox(s, d), labels(s, d)), f"SELECT vid, score > 0 AS edge FROM ({M.ORACLES['boundary_score']})"),
    "relax_step": (relax, f"WITH {CODES}, seed AS (SELECT vid + 1 AS cid, x AS cx, y AS cy, z AS cz, h AS g FROM vox JOIN hh USING (vid) WHERE vid % 60 = 7), ca AS (SELECT *, vid // 60 * 60 + 8 AS c FROM vox WHERE vid // 60 * 60 + 8 <= 488), met AS (SELECT DISTINCT b.vid, a.c AS cid FROM vox b JOIN ca a ON abs(a.x - b.x) IN (0, 2) AND abs(a.y - b.y) IN (0, 2) AND abs(a.z - b.z) IN (0, 2)) SELECT vid, cid FROM met JOIN vox USING (vid) JOIN hh USING (vid) JOIN seed USING (cid) QUALIFY row_number() OVER (PARTITION BY vid ORDER BY 0.6 * {D2} / 9 + bit_count(xor(h, g)) / 64.0, cid) = 1".replace("FROM met JOIN vox USING (vid)", "FROM met JOIN (SELECT vid, x, y, z FROM vox) v USING (vid)")),
    "snapped_points": (lambda s, d: seeds.snapped(points(s, d), sparse(s, d), 2), f"WITH {VOX}, p(c, px, py, pz) AS (VALUES (1, 0, 0, 0), (2, 5, 5, 2), (3, 11, 3, 1), (4, 40, 40, 40), (5, -1, -1, 0)) SELECT c AS cid, vid FROM p JOIN vox ON vid % 3 <> 1 AND abs(x - px) <= 2 AND abs(y - py) <= 2 AND abs(z - pz) <= 2 QUALIFY row_number() OVER (PARTITION BY c ORDER BY (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2, vid) = 1"),
    "graph_gradient": (lambda s, d: rounded(local.gradient(vox(s, d), "graph"), "g"), LAP),
    "mean_difference_gradient": (lambda s, d: rounded(local.gradient(vox(s, d), "difference"), "g"), M.ORACLES["difference_gradient"].replace("ts[1]", "m").replace("embedding::DOUBLE[] AS ts", "list_avg(embedding::DOUBLE[]) AS m")),
    "single_sample_gradient": (lambda s, d: rounded(local.functional_gradient(single(s, d), spatial.both_ways(edges(s, d))), "g"), f"WITH {VOX}, {E6} SELECT a.vid, " + R("avg((a.ts[1] - b.ts[1]) ** 2)", "g") + " FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) p JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst GROUP BY a.vid"),
    "exact_step_all": (steps_row(exact_all), f"WITH {VOX}, {UNC}, {NEAREST27.format(cost='1 - ' + DOT32.format('ts', 'feat') + ' + 0.2 * ' + D2 + ' / 9', rows='un')} SELECT * FROM win"),
    "exact_step_edges": (steps_row(exact_edges), f"WITH {VOX}, {E6}, {EDGE}, {UNC}, {NEAREST27.format(cost='1 - ' + DOT32.format('ts', 'feat') + ' + 0.2 * ' + D2 + ' / 9', rows='un')} SELECT vox.vid, CASE WHEN edge.vid IS NULL THEN vox.cid ELSE win.cid END AS cid FROM vox JOIN win ON win.vid = vox.vid LEFT JOIN edge ON edge.vid = vox.vid"),
    "boundary_pass": (steps_row(boundary_pass), f"WITH {CEN}, {E6}, {EDGE}, fl AS (SELECT cid, unnest(range(64)) AS t, unnest(feat) AS f FROM feat), r AS (SELECT c.vid, c.cid, corr(v, f) AS r FROM cand c JOIN edge USING (vid) JOIN s ON s.vid = c.vid JOIN fl ON fl.cid = c.cid AND fl.t = s.t GROUP BY ALL), win AS (SELECT r.vid, r.cid FROM r JOIN vox ON vox.vid = r.vid JOIN cen ON cen.cid = r.cid QUALIFY row_number() OVER (PARTITION BY r.vid ORDER BY 1 - r + 0.5 * {SQF} / 64 + 0.2 * {D2} / 9, r.cid) = 1) SELECT vox.vid, coalesce(win.cid, vox.cid) AS cid FROM vox LEFT JOIN win ON win.vid = vox.vid"),
}

# -- reports --------------------------------------------------------------------


def other(s, d):
    return vox(s, d).select("vid", (F.col("z") % 3 + 1).alias("cid"))


def members(s, d):
    return groups.central_members(vox(s, d), labels(s, d))


TAB = Q.TABLE
SPLIT = "sz AS (SELECT cid, count(*) AS n FROM vox GROUP BY cid)"
PAIRC = CEN + ", fl AS (SELECT cid, unnest(range(64)) AS t, unnest(feat) AS f FROM feat), pc AS (SELECT a.cid AS src, b.cid AS dst, corr(a.f, b.f) AS r FROM fl a JOIN fl b ON a.t = b.t AND a.cid < b.cid GROUP BY ALL)"
GREEDY = (
    "g(i, ua, ub, n) AS (SELECT 0, []::BIGINT[], []::BIGINT[], 0::BIGINT UNION ALL SELECT i + 1, list_append(ua, m.a), list_append(ub, m.b), m.n FROM g, LATERAL (SELECT first(a ORDER BY n DESC, a, b) AS a, first(b ORDER BY n DESC, a, b) AS b, first(n ORDER BY n DESC, a, b) AS n "
    "FROM tab WHERE NOT list_contains(ua, tab.a) AND NOT list_contains(ub, tab.b)) m WHERE m.n IS NOT NULL)"
)
AGREE = Q.ORACLES["partition_agreement"]
SIZES = "count(*) AS k, min(n) AS smallest, " + R("quantile_cont(n, 0.25)", "first") + ", " + R("median(n)", "median") + ", " + R("quantile_cont(n, 0.75)", "third") + ", max(n) AS largest, " + R("avg(n)", "mean") + ", " + R("stddev_samp(n)", "sd")
FLOATS = ("first", "median", "third", "mean", "sd", "low_x", "high_x", "low_y", "high_y", "low_z", "high_z", "center_corr")
BITS = ", ".join(f"(CASE WHEN 2 * count(*) FILTER ((h >> {b}) & 1 = 1) >= count(*) THEN {1 << b if b < 63 else -(1 << 63)}::HUGEINT ELSE 0 END)" for b in range(64)).replace("), (", ") + (")


def compared(s, d):
    return measures.compared(vox(s, d), {"a": labels(s, d), "b": other(s, d)})


def compared_sql(name: str, column: str) -> str:
    return f"(WITH {CEN.replace('vec_id AS vid', 'vec_id AS vid').replace('label + 1 AS cid', column)}, fl AS (SELECT cid, unnest(range(64)) AS t, unnest(feat) AS f FROM feat), pc AS (SELECT corr(a.f, b.f) AS r FROM fl a JOIN fl b ON a.t = b.t AND a.cid < b.cid GROUP BY a.cid, b.cid), sz AS (SELECT cid, count(*) AS n FROM vox GROUP BY cid) SELECT '{name}' AS method, count(*) AS n_clusters, min(n) AS min_size, max(n) AS max_size, round(avg(n), 1) AS mean_size, round(stddev_samp(n), 1) AS sd_size, (SELECT round(avg(r), 3) FROM pc) AS temporal_coherence FROM sz)"


REPORTS = {
    "central_members": (members, f"WITH {LONG}, u AS (SELECT vid, cid, t, (v - m) / nullif(sqrt(sum((v - m) ** 2) OVER (PARTITION BY vid)), 0) AS v FROM (SELECT vid, t, v, avg(v) OVER (PARTITION BY vid) AS m FROM s) JOIN (SELECT vid, cid FROM vox) USING (vid)), p AS (SELECT a.cid, a.vid, sum(a.v * b.v) AS r FROM u a JOIN u b ON a.cid = b.cid AND a.t = b.t GROUP BY ALL), f AS (SELECT cid, vid AS feature_vid FROM p QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(-r, 9), vid) = 1), q AS (SELECT a.cid, a.vid, sum(sqrt({D3})) AS d FROM vox a JOIN vox b ON a.cid = b.cid GROUP BY ALL), g AS (SELECT cid, vid AS place_vid FROM q QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(d, 9), vid) = 1) SELECT cid, feature_vid, place_vid FROM f JOIN g USING (cid)"),
    "unit_centers": (lambda s, d: rounded(groups.unit_centers(vox(s, d), labels(s, d)).select("cid", V.total("feat").alias("total")), "total"), f"WITH {CEN} SELECT cid, " + R("list_sum(feat) / " + NORM.format("feat"), "total") + " FROM cen"),
    "block_labels": (lambda s, d: groups.block_labels(vox(s, d).withColumns({c: F.col(c) + 3 for c in "xyz"}), 4), f"WITH {VOX} SELECT vid, (x // 4)::INT AS bx, (y // 4)::INT AS by, (z // 4)::INT AS bz FROM vox"),
    "blocks_to_voxels": (lambda s, d: groups.from_blocks(vox(s, d), groups.block_labels(vox(s, d), 4).select("bx", "by", "bz", (F.col("bx") + 3 * F.col("by") + 9 * F.col("bz")).alias("cid")).distinct(), 4), f"WITH {VOX} SELECT vid, (x // 4 + 3 * (y // 4) + 9 * (z // 4))::INT AS cid FROM vox"),
    "bit_majority": (lambda s, d: groups.bit_majority(codes(s, d), labels(s, d)), f"WITH {CODES} SELECT cid, count(*) AS n, ({BITS})::BIGINT AS h FROM hh JOIN (SELECT vid, cid FROM vox) USING (vid) GROUP BY cid"),
    "outermost_members": (lambda s, d: groups.outermost(vox(s, d), labels(s, d)), f"WITH {OWN} SELECT cid, vid FROM own QUALIFY row_number() OVER (PARTITION BY cid ORDER BY round(d2, 9) DESC, vid) = 1"),
    "prototype_stats": (lambda s, d: rounded(groups.prototype_stats(centers(s, d)), "sum", "mean", "inverse_sd", "energy"), f"WITH {CEN} SELECT cid, " + R("list_sum(feat)", "sum") + ", " + R("list_avg(feat)", "mean") + ", " + R("1 / sqrt(list_sum(list_transform(feat, lambda q: q * q)) - 64 * list_avg(feat) ** 2)", "inverse_sd") + ", " + R("list_sum(list_transform(feat, lambda q: q * q))", "energy") + " FROM cen"),
    "permuted_labels": (lambda s, d: groups.permuted(labels(s, d), None, 7)[0], f"WITH {VOX}, n AS (SELECT cid, row_number() OVER (ORDER BY md5('7:' || cid), cid)::INT AS new FROM (SELECT DISTINCT cid FROM vox)) SELECT vid, new AS cid FROM vox JOIN n USING (cid)"),
    "agreement_degenerate": (lambda s, d: groups.agreement(groups.contingency(*[vox(s, d).select("vid", F.lit(1).alias("cid"))] * 2), degenerate=0.0).select("n", "ari", "nmi"), "SELECT count(*) AS n, 0.0::DOUBLE AS ari, 1.0::DOUBLE AS nmi FROM embeddings"),
    "accuracy_bundle": (lambda s, d: rounded(measures.accuracy(labels(s, d), other(s, d)), "ari", "nmi", "accuracy"), f"WITH RECURSIVE {TAB}, {GREEDY}, ag AS ({AGREE.replace('WITH ' + TAB + ', ', 'WITH ')}) SELECT n, ari, nmi, " + R("(SELECT sum(n) FROM g) / n::DOUBLE", "accuracy") + ", (SELECT count(DISTINCT a) FROM tab) AS n_predicted, (SELECT count(DISTINCT b) FROM tab) AS n_truth, false AS perfect FROM ag"),
    "greedy_matching": (lambda s, d: measures.matching(Q.table(s, d)), f"WITH RECURSIVE {TAB}, {GREEDY} SELECT ua[i]::INT AS a, ub[i]::INT AS b, n FROM g WHERE i > 0"),
    "cluster_summary": (lambda s, d: rounded(measures.summary(vox(s, d), labels(s, d)), *FLOATS), f"WITH {PAIRC}, {SPLIT} SELECT {SIZES}, " + ", ".join(R(f"(SELECT {f}(c{c}) FROM pos)", f"{n}_{c}") for c in "xyz" for f, n in (("min", "low"), ("max", "high"))) + ", " + R("(SELECT avg(r) FROM pc)", "center_corr") + " FROM sz"),
    "cluster_metrics": (lambda s, d: rounded(measures.metrics(vox(s, d), labels(s, d), other(s, d)), "median", "within_corr", "within_dist", "between_corr", "ari"), f"WITH {PAIRC}, {SPLIT}, qu AS ({M.ORACLES['cluster_quality']}), ag AS ({AGREE}) SELECT count(*) AS k, min(n) AS smallest, " + R("median(n)", "median") + ", max(n) AS largest, (SELECT within_corr FROM qu) AS within_corr, (SELECT within_dist FROM qu) AS within_dist, " + R("(SELECT avg(0.5 * ln((1 + r) / (1 - r))) FROM pc)", "between_corr") + ", (SELECT ari FROM ag) AS ari FROM sz"),
    "method_comparison": (lambda s, d: rounded(compared(s, d), "overlap"), "SELECT *, (SELECT overlap FROM (" + M.ORACLES["partition_overlap"] + ")) AS overlap FROM (" + compared_sql("a", "label + 1 AS cid") + " UNION ALL " + compared_sql("b", "((vec_id // 100) % 3) + 1 AS cid") + ")"),
    "center_pairs": (lambda s, d: rounded(measures.all_pairs(centers(s, d)), "r"), f"WITH {PAIRC} SELECT src, dst, " + R("r", "r") + " FROM pc"),
    "unmatched_centers": (lambda s, d: measures.unmatched_centers(labels(s, d), centers(s, d).filter("cid > 2").union(centers(s, d).withColumn("cid", F.col("cid") + 100))), f"WITH {VOX} SELECT 2::BIGINT AS without_center, count(DISTINCT cid) AS without_voxels FROM vox"),
    "center_correlation_or_one": (lambda s, d: rounded(own(s, d).select("vid", F.coalesce(V.correlation("ts", "feat"), F.lit(1.0)).alias("r")), "r"), f"WITH {OWN}, fl AS (SELECT cid, unnest(range(64)) AS t, unnest(feat) AS f FROM feat) SELECT vid, " + R("coalesce(corr(v, f), 1)", "r") + " FROM s JOIN vox USING (vid) JOIN fl ON fl.cid = vox.cid AND fl.t = s.t GROUP BY vid"),
    "pruned_columns": (lambda s, d: rounded(flow.pruned(M.matrix(s, d), 3, 0.05), "x"), f"WITH {M.MAT} SELECT row, col, " + R("x", "x") + " FROM m WHERE x > 0.05 QUALIFY row_number() OVER (PARTITION BY col ORDER BY x DESC, row) <= 3"),
    "attractor_labels": (lambda s, d: groups.dense(flow.attractors(M.matrix(s, d).filter("row <> col")).withColumn("cid", F.col("cid") + 1)), f"WITH {M.MAT}, a AS (SELECT col AS vid, row AS cid FROM m WHERE row <> col QUALIFY row_number() OVER (PARTITION BY col ORDER BY x DESC, row) = 1) SELECT vid, dense_rank() OVER (ORDER BY cid)::INT AS cid FROM a"),
    "columns_with_loops": (lambda s, d: rounded(flow.with_loops(M.matrix(s, d).filter("col % 5 > 0"), vox(s, d)), "x"), f"WITH {M.MAT} SELECT row, col, " + R("x", "x") + " FROM m WHERE col % 5 > 0 UNION ALL SELECT vid, vid, 1.0 FROM vox WHERE vid % 5 = 0"),
    "exact_k_down": (lambda s, d: exact.exact_k(vox(s, d), labels(s, d), 4).agg(F.count("*").alias("n"), F.countDistinct("cid").alias("k"), F.max("cid").alias("top")), "SELECT count(*) AS n, 4::BIGINT AS k, 4::INT AS top FROM embeddings"),
    "exact_k_up": (lambda s, d: exact.exact_k(vox(s, d), labels(s, d), 33).agg(F.count("*").alias("n"), F.countDistinct("cid").alias("k"), F.max("cid").alias("top")), "SELECT count(*) AS n, 33::BIGINT AS k, 33::INT AS top FROM embeddings"),
}

# -- seeds ----------------------------------------------------------------------


def ramp(s, d):
    """A gradient that SQL can give too."""
    return vox(s, d).select("vid", (F.expr("(vid * 37) % 101") / 101.0).alias("g"))


RAMP = VOX + ", gr AS (SELECT *, ((vid * 37) % 101) / 101.0 AS g FROM vox)"
#: The nearest voxel to a point, over all voxels.


def greedy_sql(order: str, radius: str, k: int, rows: str) -> str:
    return (
        f"ord AS (SELECT *, row_number() OVER (ORDER BY {order}, vid) AS i, ({radius}) ** 2 AS rr FROM {rows}), "
        f"gs(i, got) AS (SELECT 0::BIGINT, []::STRUCT(vid BIGINT, x INT, y INT, z INT)[] UNION ALL SELECT o.i, CASE WHEN len(got) < {k} AND len(list_filter(got, lambda q: (q.x - o.x) ** 2 + (q.y - o.y) ** 2 + (q.z - o.z) ** 2 <= o.rr)) = 0 THEN list_append(got, {{'vid': o.vid, 'x': o.x, 'y': o.y, 'z': o.z}}) ELSE got END FROM gs JOIN ord o ON o.i = gs.i + 1), "
        "chosen AS (SELECT unnest(got).vid AS vid FROM (SELECT got FROM gs ORDER BY i DESC LIMIT 1))"
    )


BOX = "(SELECT (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) FROM vox)"
NUMBERED = "SELECT vid, row_number() OVER (ORDER BY vid)::INT AS cid FROM chosen"
SOME = values("sd", "cid, vid", [(1, 5), (2, 144), (3, 250), (4, 333), (5, 499)])


def some(s, d):
    return s.createDataFrame([(1, 5), (2, 144), (3, 250), (4, 333), (5, 499)], "cid int, vid long")


def lloyd_sql(k: int, rounds: int) -> str:
    out = f"c0 AS (SELECT i::INT + 1 AS cid, x::DOUBLE AS cx, y::DOUBLE AS cy, z::DOUBLE AS cz FROM range({k}) r(i) JOIN (SELECT *, row_number() OVER (ORDER BY vid) - 1 AS place FROM vox) ON place = floor(i * (SELECT count(*) - 1 FROM vox) / {k - 1}.0))"
    for i in range(rounds):
        out += f", l{i} AS (SELECT vid, v.x, v.y, v.z, c.cid FROM vox v CROSS JOIN c{i} c QUALIFY row_number() OVER (PARTITION BY vid ORDER BY (v.x - cx) ** 2 + (v.y - cy) ** 2 + (v.z - cz) ** 2, c.cid) = 1)"
        out += f", c{i + 1} AS (SELECT c.cid, coalesce(avg(x), any_value(cx)) AS cx, coalesce(avg(y), any_value(cy)) AS cy, coalesce(avg(z), any_value(cz)) AS cz FROM c{i} c LEFT JOIN l{i} l ON l.cid = c.cid GROUP BY c.cid)"
    return out


SEEDS = {
    "seeds_low_gradient": (lambda s, d: seeds.low_gradient(vox(s, d), ramp(s, d), 8, 0.6), f"WITH RECURSIVE {RAMP}, low AS (SELECT * FROM gr ORDER BY g, vid LIMIT 24), {greedy_sql('g', f'0.6 * ({BOX} / 8) ** (1 / 3.0)', 8, 'low')} {NUMBERED}"),
    "seeds_filled": (lambda s, d: seeds.low_gradient(vox(s, d), ramp(s, d), 8, 2.0, fill="index"), f"WITH RECURSIVE {RAMP}, low AS (SELECT * FROM gr ORDER BY g, vid LIMIT 24), {greedy_sql('g', f'2.0 * ({BOX} / 8) ** (1 / 3.0)', 8, 'low').replace('chosen AS', 'part AS')}, free AS (SELECT vid, row_number() OVER (ORDER BY vid) AS i FROM vox WHERE vid NOT IN (SELECT vid FROM part)), chosen AS (SELECT vid FROM part UNION ALL SELECT vid FROM free WHERE i <= 8 - (SELECT count(*) FROM part)) {NUMBERED}"),
    "seeds_random_fill": (lambda s, d: seeds.low_gradient(vox(s, d), ramp(s, d), 8, 2.0, fill="random"), f"WITH RECURSIVE {RAMP}, low AS (SELECT * FROM gr ORDER BY g, vid LIMIT 24), {greedy_sql('g', f'2.0 * ({BOX} / 8) ** (1 / 3.0)', 8, 'low').replace('chosen AS', 'part AS')}, free AS (SELECT vid, row_number() OVER (ORDER BY md5('1:' || vid)) AS i FROM vox WHERE vid NOT IN (SELECT vid FROM part)), chosen AS (SELECT vid FROM part UNION ALL SELECT vid FROM free WHERE i <= 8 - (SELECT count(*) FROM part)) {NUMBERED}"),
    "seeds_poisson": (lambda s, d: seeds.poisson(vox(s, d), 40, 2.5), f"WITH RECURSIVE {VOX}, {greedy_sql(chr(109) + 'd5(' + chr(39) + '12345:' + chr(39) + ' || vid)', '2.5', 40, 'vox')} {NUMBERED}"),
    "seeds_random": (lambda s, d: seeds.random(vox(s, d), 12), f"WITH {VOX}, chosen AS (SELECT vid FROM vox ORDER BY md5('1:' || vid), vid LIMIT 12) {NUMBERED}"),
    "seeds_nudged": (lambda s, d: seeds.nudged(some(s, d), ramp(s, d), vox(s, d)), f"WITH {RAMP}, {SOME}, o(i, dx, dy) AS (VALUES (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)), m AS (SELECT cid, b.vid, i FROM (SELECT sd.cid, gr.* EXCLUDE (cid) FROM sd JOIN gr USING (vid)) a CROSS JOIN o JOIN gr b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z AND b.g < a.g QUALIFY row_number() OVER (PARTITION BY a.cid ORDER BY i) = 1) SELECT sd.cid, coalesce(m.vid, sd.vid) AS vid FROM sd LEFT JOIN m ON m.cid = sd.cid".replace("SELECT cid, b.vid, i FROM", "SELECT a.cid, b.vid, i FROM")),
    "seeds_relocated": (lambda s, d: seeds.relocated(some(s, d), ramp(s, d), vox(s, d), 2), f"WITH {RAMP}, {SOME} SELECT a.cid, b.vid FROM (SELECT sd.cid, gr.* EXCLUDE (cid) FROM sd JOIN gr USING (vid)) a JOIN gr b ON abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND abs(a.z - b.z) <= 2 QUALIFY row_number() OVER (PARTITION BY a.cid ORDER BY b.g, b.vid <> a.vid, b.vid) = 1"),
    "seeds_grid": (lambda s, d: seeds.grid(vox(s, d), 8), f"WITH {VOX}, e AS (SELECT min(x) AS lx, max(x) AS mx, min(y) AS ly, max(y) AS my, min(z) AS lz, max(z) AS mz FROM vox), p AS (SELECT i + 2 * j + 4 * k AS p, lx + i * (mx - lx) AS px, ly + j * (my - ly) AS py, lz + k * (mz - lz) AS pz FROM e, range(2) a(i), range(2) b(j), range(2) c(k)), chosen AS (SELECT vid FROM p CROSS JOIN vox QUALIFY row_number() OVER (PARTITION BY p ORDER BY (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2, vid) = 1) {NUMBERED}"),
    "seeds_mask_grid": (lambda s, d: seeds.mask_grid(vox(s, d), 10, 4.6), f"WITH {VOX}, e AS (SELECT min(x) AS lx, max(x) AS mx, min(y) AS ly, max(y) AS my, min(z) AS lz, max(z) AS mz FROM vox), n AS (SELECT *, greatest(1, floor((mx - lx) / 4.6 + 0.5)) AS nx, greatest(1, floor((my - ly) / 4.6 + 0.5)) AS ny, greatest(1, floor((mz - lz) / 4.6 + 0.5)) AS nz FROM e), p AS (SELECT i + 100 * j + 10000 * k AS p, lx + (i + 0.5) * (mx - lx) / nx AS px, ly + (j + 0.5) * (my - ly) / ny AS py, lz + (k + 0.5) * (mz - lz) / nz AS pz FROM n, range(9) a(i), range(9) b(j), range(9) c(k) WHERE i < nx AND j < ny AND k < nz), c0 AS (SELECT DISTINCT vid FROM (SELECT vid FROM p CROSS JOIN vox QUALIFY row_number() OVER (PARTITION BY p ORDER BY (x - px) ** 2 + (y - py) ** 2 + (z - pz) ** 2, vid) = 1) ORDER BY vid LIMIT 10)" + "".join(f", c{i + 1} AS (SELECT vid FROM c{i} UNION ALL SELECT vid FROM (SELECT a.vid, min({D3}) AS d FROM vox a CROSS JOIN (SELECT v.* FROM vox v JOIN c{i} USING (vid)) b GROUP BY a.vid) WHERE d > 0 AND (SELECT count(*) FROM c{i}) < 10 QUALIFY row_number() OVER (ORDER BY d DESC, vid) = 1)" for i in range(10)) + ", chosen AS (SELECT vid FROM c10) " + NUMBERED),
    "seeds_cells": (lambda s, d: seeds.cell_members(vox(s, d), 9), f"WITH {VOX}, n AS (SELECT count(*) AS n, max(x) + 1 AS sx, max(y) + 1 AS sy, max(z) + 1 AS sz FROM vox), st AS (SELECT *, greatest(1.0, (n / 9.0) ** (1 / 3.0)) AS s FROM n), g AS (SELECT *, greatest(1, floor(sx / s)) AS gx, greatest(1, floor(sy / s)) AS gy, greatest(1, floor(sz / s)) AS gz FROM st), ce AS (SELECT vid, x, y, z, gx, gy, gz, sx, sy, sz, least(floor(x * gx / sx), gx - 1) AS a, least(floor(y * gy / sy), gy - 1) AS b, least(floor(z * gz / sz), gz - 1) AS c FROM vox, g), re AS (SELECT vid, row_number() OVER (ORDER BY c, b, a) - 1 AS place FROM ce QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY (x - (a + 0.5) * sx / gx) ** 2 + (y - (b + 0.5) * sy / gy) ** 2 + (z - (c + 0.5) * sz / gz) ** 2, vid) = 1), re2 AS (SELECT vid, row_number() OVER (ORDER BY place) - 1 AS place FROM re), m AS (SELECT count(*) AS m FROM re2), pick AS (SELECT vid, (i + 1)::INT AS cid FROM range(9) r(i), m JOIN re2 ON true WHERE m >= 9 AND place = floor(i * m / 9.0)), few AS (SELECT vid, (place + 1)::INT AS cid FROM re2, m WHERE m < 9 UNION ALL SELECT v.vid, (i + m + 1)::INT FROM range(9) r(i), m, n, (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS spot FROM vox) v WHERE m < 9 AND i < 9 - m AND spot = floor(i * n / (9.0 - m))) SELECT * FROM pick UNION ALL SELECT * FROM few"),
    "lloyd_step": (lambda s, d: seeds.lloyd_step(vox(s, d), seeds.even_starts(vox(s, d), 7)), f"WITH {VOX}, {lloyd_sql(7, 1)} SELECT vid, cid FROM l0"),
    "tesselate": (lambda s, d: seeds.tesselate(vox(s, d), 7, 3), f"WITH {VOX}, {lloyd_sql(7, 3)} SELECT vid, dense_rank() OVER (ORDER BY cid)::INT AS cid FROM l2"),
    "seeds_kmeans": (lambda s, d: seeds.kmeans(vox(s, d), 7, 3), f"WITH {VOX}, {lloyd_sql(7, 3)} SELECT vid, row_number() OVER (ORDER BY cid)::INT AS cid FROM (SELECT l.vid, l.cid FROM l2 l JOIN c3 c ON c.cid = l.cid QUALIFY row_number() OVER (PARTITION BY l.cid ORDER BY (x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2, l.vid) = 1)"),
}

# -- steps of merging -------------------------------------------------------------


def halves(s, d):
    """Nodes of the labels, their edges and sizes: the state in which a round of merging begins."""
    v = vox(s, d)
    own = v.select("vid", F.expr("vid div 4").alias("cid"))
    c = groups.centers(v, own.withColumn("cid", F.col("cid") + 1))
    nodes = c.select((F.col("cid") - 1).alias("vid"), "n", F.col("feat").alias("ts"), F.lit(0.0).alias("inner"))
    return graph.saved(nodes), graph.saved(graph.contract(edges(s, d), own).withColumn("w", F.lit(0.0)))


HALF = LONG + f", {E6}, no AS (SELECT vid // 4 AS node, count(*) AS n FROM vox GROUP BY 1), ft AS (SELECT node, list(v ORDER BY t) AS ts FROM (SELECT vid // 4 AS node, t, avg(v) AS v FROM s GROUP BY 1, 2) GROUP BY node), nd AS (SELECT node, n, ts FROM no JOIN ft USING (node)), ed AS (SELECT DISTINCT least(src // 4, dst // 4) AS src, greatest(src // 4, dst // 4) AS dst FROM e WHERE src // 4 <> dst // 4), pr AS (SELECT src, dst, a.n * b.n / (a.n + b.n) * {Q.SQ} AS d FROM ed JOIN nd a ON a.node = src JOIN nd b ON b.node = dst)"
PAIRED = HALF + ", tw AS (SELECT src, dst, d FROM pr UNION ALL SELECT dst, src, d FROM pr), ne AS (SELECT * FROM tw QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1), mu AS (SELECT a.src, a.dst, a.d FROM ne a JOIN ne b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst)"


def mutual_pairs(s, d):
    nodes, e = halves(s, d)
    near = graph.nearest_edge(merge.priced(nodes, e, "ward"))
    return nodes, e, graph.saved(near.join(near.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi").filter("src < dst"))


def merged_nodes(s, d):
    nodes, _, pairs = mutual_pairs(s, d)
    return rounded(merge.united(nodes, pairs).select("vid", "n", V.total("ts").alias("total"), "inner"), "total", "inner")


def merged_edges(s, d):
    _, e, pairs = mutual_pairs(s, d)
    return merge.rewired(e, pairs.select(F.col("dst").alias("old"), F.col("src").alias("new"))).select("src", "dst")


def penalty(s, d):
    return rounded(graph.penalised(Q.edge_d(s, d), ramp(s, d), 2.0), "d")


def one_step(s, d):
    v = vox(s, d)
    near = graph.nearest_edge(graph.penalised(Q.edge_d(s, d), ramp(s, d), 2.0))
    parts = graph.pointed(near, v)
    least = parts.groupBy("cid").agg(F.min("vid").alias("least"))
    return parts.join(least, "cid").select("vid", F.col("least").alias("cid"))


PEN = RAMP + ", " + E6 + f", d AS (SELECT src, dst, {Q.SQ} * (1 + 2 * abs(a.g - b.g)) AS d FROM e JOIN gr a ON a.vid = src JOIN gr b ON b.vid = dst)"
STEPPED = PEN + ", w AS (SELECT src, dst, d FROM d UNION ALL SELECT dst, src, d FROM d), n AS (SELECT src, dst FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) = 1), g AS (SELECT src AS p, dst AS q FROM n UNION SELECT dst, src FROM n), r(vid, seen) AS (SELECT vid, vid FROM vox UNION SELECT r.vid, g.q FROM r JOIN g ON g.p = r.seen)"
SAME = VOX + f", {E6}, g AS (SELECT src AS p, dst AS q FROM e JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst WHERE a.cid = b.cid UNION SELECT dst, src FROM e JOIN vox a ON a.vid = src JOIN vox b ON b.vid = dst WHERE a.cid = b.cid), r(vid, seen) AS (SELECT vid, vid FROM vox UNION SELECT r.vid, g.q FROM r JOIN g ON g.p = r.seen), part AS (SELECT vid, min(seen) AS part FROM r GROUP BY vid)"
ISLANDS = SAME + ", pt AS (SELECT vid, cid, part FROM part JOIN (SELECT vid, cid FROM vox) USING (vid)), cn AS (SELECT cid, part, count(*) AS n FROM pt GROUP BY ALL), main AS (SELECT part FROM cn QUALIFY row_number() OVER (PARTITION BY cid ORDER BY n DESC, part) = 1), bo AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), tch AS (SELECT p.part, q.cid AS new, count(*) AS n FROM bo JOIN pt p ON p.vid = src JOIN pt q ON q.vid = dst WHERE p.part NOT IN (SELECT part FROM main) AND q.cid <> p.cid GROUP BY ALL), nw AS (SELECT part, new FROM tch QUALIFY row_number() OVER (PARTITION BY part ORDER BY n DESC, new) = 1)"

MERGES = {
    "merge_prices": (lambda s, d: rounded(merge.priced(*halves(s, d), "ward"), "d"), f"WITH {HALF} SELECT src, dst, " + R("d", "d") + " FROM pr"),
    "merge_pairs": (lambda s, d: rounded(mutual_pairs(s, d)[2], "d"), f"WITH {PAIRED} SELECT src, dst, " + R("d", "d") + " FROM mu"),
    "merge_means": (merged_nodes, f"WITH {PAIRED}, gone AS (SELECT src AS node, o.n AS on_, list_sum(o.ts) AS ot, d FROM mu JOIN nd o ON o.node = dst) SELECT nd.node AS vid, (nd.n + coalesce(on_, 0))::BIGINT AS n, " + R("coalesce((nd.n * list_sum(ts) + on_ * ot) / (nd.n + on_), list_sum(ts))", "total") + ", " + R("coalesce(d, 0)", "inner") + " FROM nd LEFT JOIN gone ON gone.node = nd.node WHERE nd.node NOT IN (SELECT dst FROM mu)"),
    "merge_edges": (merged_edges, f"WITH {PAIRED}, rn AS (SELECT coalesce(a.src, ed.src) AS s, coalesce(b.src, ed.dst) AS t FROM ed LEFT JOIN mu a ON a.dst = ed.src LEFT JOIN mu b ON b.dst = ed.dst) SELECT DISTINCT least(s, t) AS src, greatest(s, t) AS dst FROM rn WHERE s <> t"),
    "penalised_edges": (penalty, f"WITH {PEN} SELECT src, dst, " + R("d", "d") + " FROM d"),
    "reciprocal_step": (one_step, f"WITH RECURSIVE {STEPPED} SELECT vid, min(seen) AS cid FROM r GROUP BY vid"),
    "fragments": (lambda s, d: graph.fragments(labels(s, d), edges(s, d)), f"WITH RECURSIVE {SAME} SELECT vid, part AS cid FROM part"),
    "islands": (lambda s, d: local.islands(labels(s, d), edges(s, d)), f"WITH RECURSIVE {ISLANDS} SELECT vid, coalesce(new, cid) AS cid FROM pt LEFT JOIN nw USING (part)"),
    "refine_fixed": (lambda s, d: local.refine(vox(s, d), labels(s, d), edges(s, d), 1, fixed=True), M.ORACLES["refine_step"]),
}

# -- methods on a volume with known regions, made from the table --------------------


def planted(s, d, strength: float = 2.0):
    """(vid, x, y, z, ts, cid): cubes of 5 voxels a side; a voxel's series is `strength` times the unit mean of one label's embeddings, another for each cube in turn, plus its own embedding."""
    rows = vox(s, d)
    regions = graph.saved(synthetic.cubes(rows, 5, 2))
    means = centers(s, d).select(F.col("cid").alias("of"), V.unit("feat").alias("m"))
    joined = rows.join(regions, "vid").withColumn("of", ((F.col("cid") - 1) % 10 + 1).cast("int")).join(means, "of")
    return joined.select("vid", "x", "y", "z", F.zip_with("ts", "m", lambda e, m: e + strength * m).alias("ts"), "cid")


def fitted(s, d, method, **options):
    volume = graph.saved(planted(s, d))
    k = volume.agg(F.max("cid")).first()[0] or 1
    return volume, k, result.fit(volume.drop("cid"), k, method, **options)


def recovered(method, bar, **options):
    """One row: whether a method finds the regions with at least this index."""

    def query(s, d):
        volume, k, found = fitted(s, d, method, **options)
        a = measures.accuracy(found.labels, volume.select("vid", "cid"))
        return a.select(F.lit(method).alias("method"), F.lit(k).cast("long").alias("k"), (F.col("n_predicted") == k).alias("has_k"), (F.col("ari") >= bar).alias("recovered"))

    return query


def pure(method, bar, **options):
    """For a method that finds its own number of parts: whether these lie inside regions, by the share of voxels of each part's commonest region."""

    def query(s, d):
        volume, k, found = fitted(s, d, method, **options)
        table = groups.contingency(volume.select("vid", "cid"), found.labels)
        return groups.agreement(table).select(F.lit(method).alias("method"), F.lit(k).cast("long").alias("k"), F.lit(found.n_clusters >= k).alias("has_k"), (F.col("purity") >= bar).alias("recovered"))

    return query


def partition(method, **options):
    """The regions that a method finds, each named by its smallest voxel; the SQL has the planted ones."""

    def query(s, d):
        _, _, found = fitted(s, d, method, **options)
        return forest.first_members(found.labels).select("vid", F.col("cid").cast("long").alias("cid"))

    return query


PLANTED = f"WITH {VOX}, rg AS (SELECT vid, x // 5 + 2 * (y // 5 + 2 * (z // 5)) AS r FROM vox) SELECT vid, min(vid) OVER (PARTITION BY r) AS cid FROM rg"
#: Methods that find every voxel's region.
EXACT: dict[str, dict] = {m: {} for m in ("flash3d", "slice_msf", "rena", "rena_plus", "acsc", "commute", "corr_slic", "brs_slic", "supervoxels", "slic")}
#: Least adjusted Rand index of the two that grow from seeds.
BARS: dict[str, float] = {"g3s": 0.9, "snic": 0.4}
REGIONS = f"WITH {VOX} SELECT '{{0}}' AS method, max(x // 5 + 2 * (y // 5 + 2 * (z // 5)) + 1)::BIGINT AS k, true AS has_k, true AS recovered FROM vox"
RECOVERY = {f"recovery_{m}": (partition(m, **options), PLANTED) for m, options in EXACT.items()} | {f"recovery_{m}": (recovered(m, bar), REGIONS.format(m)) for m, bar in BARS.items()} | {"recovery_mcl": (pure("mcl", 0.9), REGIONS.format("mcl"))}

ALL = SOURCES | SCALARS | GRAPHS | REPORTS | SEEDS | MERGES | RECOVERY
QUERIES = {name: query for name, (query, _) in ALL.items()}
ORACLES = {name: sql for name, (_, sql) in ALL.items() if sql}
