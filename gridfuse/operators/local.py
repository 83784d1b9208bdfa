"""Values and label moves that depend on a voxel's surroundings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, groups, spatial
from gridfuse.operators.spatial import unsent


def space() -> Column:
    """Squared distance of a voxel and a center."""
    return sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")


def slice_boundary(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(vid, score): how many of the 8 neighbours in the slice have another label; 0 at the rim of the volume.

    A neighbour outside the mask counts as another label.
    """
    at = voxels.select("vid", "x", "y", "z").join(labels, "vid")
    most = at.agg(F.max("x").alias("mx"), F.max("y").alias("my"), F.min("x").alias("lx"), F.min("y").alias("ly")).first()
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    asked = at.withColumn("o", moves).select("vid", "cid", "z", (F.col("x") + F.col("o.i")).alias("x"), (F.col("y") + F.col("o.j")).alias("y"))
    same = asked.join(at.select("x", "y", "z", F.col("cid").alias("other")), ["x", "y", "z"]).groupBy("vid").agg(F.count_if(F.col("cid") == F.col("other")).alias("same"))
    inner = (F.col("x") > most.lx) & (F.col("x") < most.mx) & (F.col("y") > most.ly) & (F.col("y") < most.my)
    return at.join(same, "vid", "left").select("vid", F.when(inner, 8 - F.coalesce("same", F.lit(0))).otherwise(0).cast("long").alias("score"))


def boundary_flag(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(vid, edge): whether a neighbour in the slice has another label."""
    return slice_boundary(voxels, labels).select("vid", (F.col("score") > 0).alias("edge"))


def functional_gradient(voxels: DataFrame, near: DataFrame) -> DataFrame:
    """(vid, g): one less the mean product of unit features with the neighbours; of single samples the mean squared difference.

    A voxel without neighbours has 1, or 0 for single samples.
    """
    units = voxels.select("vid", F.when(F.size("ts") > 1, V.unit("ts")).otherwise(F.col("ts")).alias("ts"))
    price = F.when(F.size("a") > 1, 1 - V.dot("a", "b")).otherwise(V.sq_distance("a", "b"))
    found = spatial.with_features(near.select("src", "dst"), units).groupBy(F.col("src").alias("vid")).agg(F.avg(price).alias("g"))
    return voxels.select("vid", F.size("ts").alias("n")).join(found, "vid", "left").select("vid", F.coalesce("g", F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("g"))


def graph_gradient(rows: DataFrame, edges: DataFrame, value: str, sigma: float = 0.5) -> DataFrame:
    """(vid, g): how far a value, smoothed once over the neighbours by heat weights that sum to 1, is from its neighbours' sum, |sum w (s - s')|.

    `edges` (src, dst) are half of the neighbour pairs; weights are exp(-gap**2 / (2 sigma**2)) of the places.
    """
    at = rows.select(F.col("vid").alias("src"), F.struct("x", "y", "z").alias("a"))
    both = spatial.both_ways(edges.select("src", "dst")).join(at, "src").join(at.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    gap = sum((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in "xyz")
    weights = both.select("src", "dst", V.heat(gap, sigma).alias("w"))
    seen = weights.join(rows.select(F.col("vid").alias("dst"), F.col(value).alias("v")), "dst").groupBy("src").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("s"))
    smooth = rows.select("vid", F.col(value).alias("v")).join(seen.withColumnRenamed("src", "vid"), "vid", "left").select("vid", F.coalesce("s", "v").alias("s"))
    pairs = weights.join(smooth.withColumnRenamed("vid", "src"), "src").join(smooth.select(F.col("vid").alias("dst"), F.col("s").alias("t")), "dst")
    lap = pairs.groupBy(F.col("src").alias("vid")).agg(F.abs(F.sum(F.col("w") * (F.col("s") - F.col("t")))).alias("g"))
    return rows.select("vid").join(lap, "vid", "left").select("vid", F.coalesce("g", F.lit(0.0)).alias("g"))


def gradient(voxels: DataFrame, method: str = "functional") -> DataFrame:
    """(vid, g) by `functional` (over the 26 neighbours), `product`, `difference` or `graph` (of the mean of each series)."""
    if method == "functional":
        return functional_gradient(voxels, spatial.both_ways(spatial.grid_edges(voxels, 26)))
    if method == "product":
        return product_gradient(voxels)
    means = voxels.select("vid", "x", "y", "z", V.mean("ts").alias("v"))
    if method == "difference":
        return difference_gradient(means, "v")
    if method == "graph":
        return graph_gradient(means, spatial.grid_edges(voxels, 26), "v")
    raise ValueError("method must be functional, product, difference or graph")


def product_gradient(voxels: DataFrame) -> DataFrame:
    """(vid, g): root of the squared differences between mean products with the 26 neighbours and with itself; 0 at the rim."""
    edges = spatial.both_ways(spatial.grid_edges(voxels, 26))
    own = voxels.select(F.col("vid").alias("src"), (V.dot("ts", "ts") / F.size("ts")).alias("own"))
    sums = spatial.with_features(edges, voxels).select("src", (V.dot("a", "b") / F.size("a")).alias("p")).join(own, "src").groupBy("src").agg(F.sum((F.col("p") - F.col("own")) * (F.col("p") - F.col("own"))).alias("s"))
    rim = voxels.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "m"))]).first()
    inner = None
    for c in "xyz":
        here = (F.col(c) > rim[f"l{c}"]) & (F.col(c) < rim[f"m{c}"])
        inner = here if inner is None else inner & here
    return voxels.join(sums.withColumnRenamed("src", "vid"), "vid", "left").select("vid", F.when(inner, F.sqrt(F.coalesce("s", F.lit(0.0)))).otherwise(0.0).alias("g"))


def difference_gradient(rows: DataFrame, value: str) -> DataFrame:
    """(vid, g): length of the differences with the voxel before on each axis; 0 for an axis that has none."""
    before = rows.select(F.struct("x", "y", "z").alias("p"), F.col(value).alias("w"))
    out = rows.withColumn("sum", F.lit(0.0))
    for c in "xyz":
        place = F.struct(*[(F.col(d) - F.lit(int(d == c))).alias(d) for d in "xyz"])
        out = out.withColumn("p", place).join(before, "p", "left").withColumn("sum", F.col("sum") + F.coalesce((F.col(value) - F.col("w")) * (F.col(value) - F.col("w")), F.lit(0.0))).drop("p", "w")
    return out.select("vid", F.sqrt("sum").alias("g"))


def candidates(labels: DataFrame, near: DataFrame, within: float | None = None) -> DataFrame:
    """(vid, cid): a voxel's own label and those of its neighbours nearer than `within`."""
    asked = near if within is None else near.filter(F.col("d") < within)
    other = asked.select(F.col("src").alias("vid"), F.col("dst").alias("n")).join(unsent(labels.select(F.col("vid").alias("n"), "cid")), "n").select("vid", "cid")
    return labels.select("vid", "cid").union(other).distinct()


def heat_score(alpha: float, sigma1: float, sigma2: float, normalised: bool = False) -> Column:
    sq = V.sq_distance("ts", "feat")
    return alpha * (V.normalised_heat(sq, F.size("ts"), sigma1) if normalised else V.heat(sq, sigma1)) + (1 - alpha) * V.heat(space(), sigma2)


def best(voxels: DataFrame, asked: DataFrame, centers: DataFrame, score: Column) -> DataFrame:
    """(vid, cid): the candidate of greatest score; ties go to the smaller label."""
    rows = asked.join(centers, "cid").join(unsent(voxels.select("vid", "x", "y", "z", "ts")), "vid")
    return rows.groupBy("vid").agg(F.min(F.struct((-score).alias("s"), F.col("cid"))).alias("m")).select("vid", F.col("m.cid").alias("cid"))


def switched(labels: DataFrame, new: DataFrame) -> DataFrame:
    """(n): how many voxels have another label."""
    return kept_or(labels, new).agg(F.count_if("moved").alias("n"))


def nearest_center(voxels: DataFrame, centers: DataFrame, size: float, cost: Column) -> DataFrame:
    """(vid, cid): the center of least cost in the 27 bins of side `size` around a voxel; of all centers where those hold none.

    Ids are joined first and features come to the pairs after; centers are as many as clusters.
    """
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "ijk", strict=True)]) for o in [*spatial.offsets(26), (0, 0, 0)]]))
    spread = centers.withColumn("o", moves).select("cid", *[(cell(f"c{c}") + F.col(f"o.{n}")).alias(n) for c, n in zip("xyz", "ijk", strict=True)])
    points = voxels.select("vid", *[cell(c).alias(n) for c, n in zip("xyz", "ijk", strict=True)])
    pairs = points.join(spread, list("ijk")).select("vid", "cid")
    lone = points.join(unsent(pairs.select("vid").distinct()), "vid", "left_anti").select("vid")
    # As many pairs a far voxel as there are clusters.
    pairs = pairs.union(lone.crossJoin(F.broadcast(centers.select("cid"))))
    rows = pairs.join(centers, "cid").join(unsent(voxels.select("vid", "x", "y", "z", "ts")), "vid")
    return rows.groupBy("vid").agg(F.min(F.struct(cost.alias("s"), "cid")).alias("m")).select("vid", F.col("m.cid").alias("cid"))


def relaxed(codes: DataFrame, carried: DataFrame, centers: DataFrame, stride: int, price: Column) -> DataFrame:
    """(vid, cid): the seed of least price among those that a voxel and its 26 neighbours at a stride carry.

    codes: (vid, x, y, z, h), carried: (vid, cid), centers: (cid, cx, cy, cz, g).
    """
    o = F.explode(F.array(*[F.struct(*[F.lit(d * stride).alias(n) for d, n in zip(m, ("dx", "dy", "dz"), strict=True)]) for m in [(0, 0, 0), *spatial.offsets(26)]]))
    sent = carried.join(codes.select("vid", "x", "y", "z"), "vid").withColumn("o", o).select("cid", *[(F.col(c) + F.col(f"o.d{c}")).alias(c) for c in "xyz"])
    met = sent.distinct().join(codes, ["x", "y", "z"]).join(centers, "cid")
    return met.groupBy("vid").agg(F.min(F.struct(price.alias("d"), F.col("cid"))).alias("m")).select("vid", F.col("m.cid").alias("cid"))


def strided(ts, stride: int) -> Column:
    """Every stride-th sample."""
    return F.filter(ts, lambda x, i: i % stride == 0)


def exact_step(voxels: DataFrame, labels: DataFrame, edges: DataFrame | None, size: float, alpha: float, stride: int = 1) -> DataFrame:
    """(vid, cid, moved): voxels (at the boundaries of `edges`, or all) take the center of least 1 - product + alpha * gap**2 / size**2 in the 27 bins around.

    Features are demeaned unit series of every stride-th sample, centers their unit means.
    """
    from gridfuse.operators import series

    units = voxels.select("vid", "x", "y", "z", V.unit(series.demeaned(strided("ts", stride))).alias("ts"))
    centers = groups.unit_centers(units, labels)
    asked = units if edges is None else units.join(unsent(spatial.boundary(labels, edges)), "vid", "left_semi")
    return kept_or(labels, nearest_center(asked, centers, size, 1 - V.dot("ts", "feat") + alpha * space() / (size * size)))


def boundary_step(voxels: DataFrame, labels: DataFrame, edges: DataFrame, size: float, alpha: float, l2: float = 0.0, stride: int = 1) -> DataFrame:
    """(vid, cid, moved): boundary voxels take the label around them of least (1 - correlation) + l2 * mean squared difference + alpha * gap**2 / size**2 against the mean series."""
    rows = voxels.select("vid", "x", "y", "z", strided("ts", stride).alias("ts"))
    centers = groups.centers(rows, labels)
    edge = spatial.boundary(labels, edges)
    asked = candidates(labels, spatial.both_ways(edges.select("src", "dst"))).join(unsent(edge), "vid", "left_semi")
    price = 1 - F.coalesce(V.correlation("ts", "feat"), F.lit(0.0)) + l2 * V.sq_distance("ts", "feat") / F.size("ts") + alpha * space() / (size * size)
    return kept_or(labels, best(rows, asked, centers, -price))


def own_scores(voxels: DataFrame, labels: DataFrame, centers: DataFrame, sigma1: float, sigma2: float) -> DataFrame:
    """(vid, score): both kernels of a voxel and its own center, summed."""
    rows = voxels.select("vid", "x", "y", "z", "ts").join(labels, "vid").join(centers, "cid")
    return rows.select("vid", (V.normalised_heat(V.sq_distance("ts", "feat"), F.size("ts"), sigma1) + V.heat(space(), sigma2)).alias("score"))


def assign_within(voxels: DataFrame, centers: DataFrame, radius: float, score: Column) -> DataFrame:
    """(vid, cid): the center of greatest score within `radius`; centers are dealt to cells of that size. Voxels with none get no row."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "ijk", strict=True)]) for o in [*spatial.offsets(26), (0, 0, 0)]]))
    spread = centers.withColumn("o", moves).select("cid", "feat", "cx", "cy", "cz", *[(cell(f"c{c}") + F.col(f"o.{n}")).alias(n) for c, n in zip("xyz", "ijk", strict=True)])
    rows = voxels.select("vid", "ts", "x", "y", "z", *[cell(c).alias(n) for c, n in zip("xyz", "ijk", strict=True)]).join(spread, list("ijk")).filter(space() <= radius * radius)
    return rows.groupBy("vid").agg(F.min(F.struct((-score).alias("s"), F.col("cid"))).alias("m")).select("vid", F.col("m.cid").alias("cid"))


def kept_or(labels: DataFrame, new: DataFrame) -> DataFrame:
    """(vid, cid, moved): the new label, or the old one where there is none."""
    rows = labels.select("vid", F.col("cid").alias("old")).join(unsent(new), "vid", "left")
    return rows.select("vid", F.coalesce("cid", "old").alias("cid"), F.expr("coalesce(cid <> old, false)").alias("moved"))


def refine_step(voxels: DataFrame, labels: DataFrame, edges: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """(vid, cid, moved): voxels at a boundary (or in `edge`) take the label around them whose unit mean has the greatest product with theirs."""
    units = voxels.select("vid", "x", "y", "z", V.unit("ts").alias("ts"))
    edge = spatial.boundary(labels, edges) if edge is None else edge
    asked = candidates(labels, spatial.both_ways(edges.select("src", "dst"))).join(unsent(edge), "vid", "left_semi")
    return kept_or(labels, best(units, asked, groups.unit_centers(units, labels), V.dot("ts", "feat")))


def refine(voxels: DataFrame, labels: DataFrame, edges: DataFrame, most: int = 3, fixed: bool = False) -> DataFrame:
    """Steps until no voxel moves; with `fixed` the boundary of the start stays the set that may move."""
    edge = graph.saved(spatial.boundary(labels, edges)) if fixed else None
    for _ in range(most):
        new = graph.saved(refine_step(voxels, labels, edges, edge))
        labels = new.select("vid", "cid")
        if new.filter("moved").isEmpty():
            break
    return labels


def islands(labels: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """(vid, cid): of each label the largest connected part stays if it has `min_size` voxels, other parts take the label that they touch most, in one simultaneous pass."""
    a = labels.select(F.col("vid").alias("src"), F.col("cid").alias("a"))
    marked = edges.select("src", "dst").join(unsent(a), "src").join(unsent(a.select(F.col("src").alias("dst"), F.col("a").alias("b"))), "dst")
    parts = graph.components(labels.select("vid"), marked.filter("a = b").select("src", "dst")).withColumnRenamed("cid", "part")
    parts = graph.saved(parts.join(unsent(labels), "vid"))
    count = parts.groupBy("cid", "part").agg(F.count("*").alias("n"))
    main = count.filter(F.col("n") >= min_size).groupBy("cid").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("part"))).alias("m")).select(F.col("m.part").alias("part"))
    loose = parts.join(main, "part", "left_anti")
    touch = spatial.both_ways(edges.select("src", "dst")).join(unsent(loose.select(F.col("vid").alias("src"), "part", "cid")), "src").join(unsent(a.select(F.col("src").alias("dst"), F.col("a").alias("b"))), "dst").filter("b <> cid")
    most = touch.groupBy("part", "b").agg(F.count("*").alias("n")).groupBy("part").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("b"))).alias("m")).select("part", F.col("m.b").alias("new"))
    return parts.join(most, "part", "left").select("vid", F.coalesce("new", "cid").alias("cid"))
