"""Starting voxels of clusters: by gradients, spacing, grids, k-means; all as joins and ranked selections."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.operators import graph, groups, ranges, spatial


def extent(voxels: DataFrame) -> dict:
    """Smallest and greatest place on each axis and the number of voxels."""
    row = voxels.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "l"), (F.max, "m"))]).first()
    if not row.n:
        raise ValueError("no voxels")
    return row.asDict()


def spacing(voxels: DataFrame, k: int) -> float:
    """Side of the share of the bounding box that each of k seeds has; a flat box counts by its area, a line by its length."""
    e = extent(voxels)
    sides = [e[f"m{c}"] - e[f"l{c}"] for c in "xyz"]
    wide = [s for s in sides if s > 0]
    return (math.prod(wide) / k) ** (1 / len(wide)) if wide else 1.0


def pseudo_random(seed: int, key: str = "vid") -> Column:
    """A text that orders rows as if shuffled, the same on every engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))


def spaced(voxels: DataFrame, order: Column, radius: float, most: int | None = None) -> DataFrame:
    """(vid, x, y, z, o): the voxels that a greedy pass in the order (then vid) keeps, each over `radius` away from all that it kept before; the first `most` of these.

    A voxel is kept once all nearer ones before it are out, so each round settles many; pairs come from cells of the radius.
    """
    rows = graph.saved(voxels.select("vid", "x", "y", "z", order.alias("o")))
    cell = [F.floor(F.col(c) / max(radius, 1e-9)).cast("long").alias(f"c{c}") for c in "xyz"]
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(m, "xyz", strict=True)]) for m in itertools.product((-1, 0, 1), repeat=3)]))
    here = rows.select("*", *cell)
    sent = here.withColumn("m", moves).select(F.struct("o", "vid").alias("a"), *[F.col(c).alias(f"a{c}") for c in "xyz"], *[(F.col(f"c{c}") + F.col(f"m.{c}")).alias(f"c{c}") for c in "xyz"])
    gap = sum((F.col(c) - F.col(f"a{c}")) * (F.col(c) - F.col(f"a{c}")) for c in "xyz")
    pairs = sent.join(here, ["cx", "cy", "cz"]).filter((F.struct("o", "vid") > F.col("a")) & (gap <= radius * radius))
    before = graph.saved(pairs.select(F.col("a.vid").alias("first"), F.col("vid").alias("second")))
    left, kept = rows.select("vid"), None
    while True:
        open_pairs = before.join(left.withColumnRenamed("vid", "first"), "first", "left_semi")
        new = graph.saved(left.join(open_pairs.select(F.col("second").alias("vid")), "vid", "left_anti"))
        if new.isEmpty():
            break
        kept = new if kept is None else kept.union(new)
        out = before.join(new.withColumnRenamed("vid", "first"), "first", "left_semi").select(F.col("second").alias("vid"))
        left = graph.saved(left.join(new, "vid", "left_anti").join(out, "vid", "left_anti"))
    found = rows if kept is None else rows.join(kept, "vid", "left_semi")
    return found if most is None else found.orderBy("o", "vid").limit(most)


def numbered(seeds: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(vid, cid) of chosen voxels, cid from 1 in the order."""
    return ranges.numbered(seeds, order or ["vid"]).select("vid", (F.col("place") + 1).cast("int").alias("cid"))


def low_gradient(voxels: DataFrame, gradient: DataFrame, k: int, factor: float = 1.5, over: int = 3, fill: str | None = None) -> DataFrame:
    """(vid, cid): of the over * k voxels of least gradient up to k, greedily, each over `factor` spacings from those before.

    Where that gives fewer than k, `fill` tops up with the smallest free `index`, or with `random` ones.
    """
    if fill not in (None, "index", "random"):
        raise ValueError("fill must be index or random")
    rows = voxels.select("vid", "x", "y", "z").join(gradient, "vid")
    lowest = graph.saved(rows.orderBy("g", "vid").limit(over * k))
    chosen = graph.saved(spaced(lowest, F.col("g"), factor * spacing(voxels, k), k).select("vid"))
    if fill and (short := k - chosen.count()) > 0:
        free = voxels.select("vid").join(chosen, "vid", "left_anti")
        chosen = chosen.union(free.orderBy("vid" if fill == "index" else pseudo_random(1)).limit(short).select("vid"))
    return numbered(chosen)


def nudged(seeds: DataFrame, gradient: DataFrame, voxels: DataFrame) -> DataFrame:
    """(cid, vid): each seed, or the first of its neighbours in the plane (x - 1, x + 1, y - 1, y + 1) of lower gradient."""
    at = graph.saved(voxels.select("vid", "x", "y", "z").join(gradient, "vid"))
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)])]))
    own = seeds.join(at, "vid")
    asked = own.withColumn("m", moves).select("cid", F.col("g").alias("own"), F.col("m.i").alias("i"), (F.col("x") + F.col("m.dx")).alias("x"), (F.col("y") + F.col("m.dy")).alias("y"), "z")
    lower = asked.join(at, ["x", "y", "z"]).filter("g < own").groupBy("cid").agg(F.min(F.struct("i", "vid")).alias("m"))
    return seeds.select("cid", "vid").join(lower, "cid", "left").select("cid", F.coalesce("m.vid", "vid").alias("vid"))


def box_moves(radius: int) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(m, "xyz", strict=True)]) for m in itertools.product(range(-radius, radius + 1), repeat=3)]))


def relocated(seeds: DataFrame, gradient: DataFrame, voxels: DataFrame, radius: int = 1) -> DataFrame:
    """(cid, vid): the voxel of least gradient in the cube around each seed; the seed itself where none is lower, else the smaller vid."""
    at = graph.saved(voxels.select("vid", "x", "y", "z").join(gradient, "vid"))
    asked = seeds.join(at, "vid").withColumn("m", box_moves(radius)).select("cid", F.col("vid").alias("old"), *[(F.col(c) + F.col(f"m.{c}")).alias(c) for c in "xyz"])
    best = asked.join(at, ["x", "y", "z"]).groupBy("cid").agg(F.min(F.struct("g", (F.col("vid") != F.col("old")).alias("other"), "vid")).alias("m"))
    return best.select("cid", F.col("m.vid").alias("vid"))


def snapped(points: DataFrame, voxels: DataFrame, radius: int) -> DataFrame:
    """(cid, vid): the voxel nearest to each point (cid, x, y, z) in the box around it; points with none get no row."""
    asked = points.withColumn("m", box_moves(radius)).select("cid", (F.col("m.x") * F.col("m.x") + F.col("m.y") * F.col("m.y") + F.col("m.z") * F.col("m.z")).alias("d"), *[(F.col(c) + F.col(f"m.{c}")).alias(c) for c in "xyz"])
    best = asked.join(voxels.select("vid", "x", "y", "z"), ["x", "y", "z"]).groupBy("cid").agg(F.min(F.struct("d", "vid")).alias("m"))
    return best.select("cid", F.col("m.vid").alias("vid"))


def poisson(voxels: DataFrame, k: int, radius: float, seed: int = 12345) -> DataFrame:
    """(vid, cid): up to k voxels, greedily in a shuffled order, each over `radius` from those before."""
    return numbered(spaced(voxels, pseudo_random(seed), radius, k).select("vid"))


def poisson_to_k(voxels: DataFrame, k: int, seed: int = 1, shrink: float = 0.8, most: int = 20) -> DataFrame:
    """`poisson` with a radius that shrinks until there are k seeds, or `most` times."""
    radius = spacing(voxels, k)
    for _ in range(most):
        found = graph.saved(poisson(voxels, k, radius, seed))
        if found.count() >= k:
            break
        radius *= shrink
    return found


def random(voxels: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """(vid, cid): k voxels of a shuffled order."""
    return numbered(voxels.select("vid").orderBy(pseudo_random(seed), "vid").limit(k))


def nearest_voxels(voxels: DataFrame, points: DataFrame) -> DataFrame:
    """(p, vid): the voxel nearest to each point (p, px, py, pz) of the bounding box, ties to the smaller vid.

    A point meets the voxels of the 27 cells around it, whose side doubles until one is no farther than the side: then no other cell holds a nearer one.
    """
    places = voxels.select("vid", "x", "y", "z")
    e = extent(voxels)
    span, side, asked, done = max(e[f"m{c}"] - e[f"l{c}"] for c in "xyz") + 1, 1, points, None
    gap = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz")
    while True:
        cell = lambda c, side=side: F.floor(F.col(c) / side).cast("long")
        sent = asked.withColumn("m", box_moves(1)).select("p", "px", "py", "pz", *[(cell(f"p{c}") + F.col(f"m.{c}")).alias(f"c{c}") for c in "xyz"])
        met = sent.join(places.select("*", *[cell(c).alias(f"c{c}") for c in "xyz"]), ["cx", "cy", "cz"])
        found = graph.saved(met.groupBy("p").agg(F.min(F.struct(gap.alias("d"), "vid")).alias("m")).select("p", "m.d", "m.vid"))
        near = found if side >= span else found.filter(F.col("d") <= side * side)
        done = near.select("p", "vid") if done is None else done.union(near.select("p", "vid"))
        asked = graph.saved(asked.join(near.select("p"), "p", "left_anti"))
        if side >= span or asked.isEmpty():
            return done
        side *= 2


def grid_points(voxels: DataFrame, sides: tuple[int, int, int], middle: bool) -> DataFrame:
    """(p, px, py, pz) over the bounding box, x fastest: from border to border, or in the middle of equal parts."""
    e = extent(voxels)
    axes = []
    for c, n in zip("xyz", sides, strict=True):
        low, high = e[f"l{c}"], e[f"m{c}"]
        axes.append([low + (i + 0.5) * (high - low) / n for i in range(n)] if middle else [low + i * (high - low) / max(n - 1, 1) for i in range(n)])
    rows = [(i, float(x), float(y), float(z)) for i, (z, y, x) in enumerate(itertools.product(axes[2], axes[1], axes[0]))]
    return voxels.sparkSession.createDataFrame(rows, "p int, px double, py double, pz double")


def topped_up(voxels: DataFrame, chosen: DataFrame, k: int, seed: int = 1) -> DataFrame:
    short = k - chosen.count()
    if short <= 0:
        return chosen
    return chosen.union(voxels.select("vid").join(chosen, "vid", "left_anti").orderBy(pseudo_random(seed), "vid").limit(short))


def grid(voxels: DataFrame, k: int) -> DataFrame:
    """(vid, cid): the voxels nearest to a grid of ceil(k ** (1/3)) points a side, the first k of them, or topped up at random."""
    side = math.ceil(round(k ** (1 / 3), 9))
    found = nearest_voxels(voxels, grid_points(voxels, (side, side, side), False)).groupBy("vid").agg(F.min("p").alias("p"))
    chosen = graph.saved(found.orderBy("p").limit(k).select("vid"))
    return numbered(topped_up(voxels, chosen, k))


def farthest(voxels: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """`chosen` (vid) and, one after another, the voxel farthest from all chosen so far, up to k; ties go to the smaller vid.

    Each voxel keeps its distance to the nearest seed, so a step compares it with the new seed only.
    """
    places = voxels.select("vid", "x", "y", "z")
    have = chosen.join(places, "vid").select(F.col("vid").alias("p"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    gap = sum((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in "xyz")
    reach = places.crossJoin(F.broadcast(have)).groupBy("vid", "x", "y", "z").agg(F.min(gap).alias("d"))  # as many points as seeds
    reach, n = graph.saved(reach), chosen.count()
    added = []
    while n < k:
        far = reach.filter("d > 0").orderBy(F.desc("d"), "vid").first()
        if far is None:
            break
        added.append((far.vid,))
        step = sum((F.col(c) - F.lit(far[c])) * (F.col(c) - F.lit(far[c])) for c in "xyz")
        reach = reach.withColumn("d", F.least("d", step))
        n += 1
        if n % 8 == 0:
            reach = graph.saved(reach)
    return chosen.select("vid").union(voxels.sparkSession.createDataFrame(added, "vid long")) if added else chosen.select("vid")


def mask_grid(voxels: DataFrame, k: int, step: float) -> DataFrame:
    """(vid, cid): the voxels nearest to the middles of boxes of side `step`, thinned to the first k by vid or topped up by the farthest voxels."""
    e = extent(voxels)
    sides = tuple(max(1, math.floor((e[f"m{c}"] - e[f"l{c}"]) / step + 0.5)) for c in "xyz")
    found = nearest_voxels(voxels, grid_points(voxels, sides, True)).select("vid").distinct()
    chosen = graph.saved(found.orderBy("vid").limit(k))
    return numbered(farthest(voxels, chosen, k))


def axis_grid(voxels: DataFrame, k: int) -> DataFrame:
    """(vid, cid): about k points evenly along the axes, snapped to voxels; thinned by taking the farthest ones, or topped up with those."""
    e = extent(voxels)
    step = max(1.0, (e["n"] / k) ** (1 / 3))
    sides = tuple(max(1, math.ceil((e[f"m{c}"] - e[f"l{c}"] + 1) / step)) for c in "xyz")
    points = grid_points(voxels, sides, True).select(F.col("p").alias("cid"), *[F.round(f"p{c}").cast("int").alias(c) for c in "xyz"])
    found = graph.saved(snapped(points, voxels, max(1, round(step))).select("vid").distinct())
    if found.count() <= k:
        return numbered(farthest(voxels, found, k))
    first = found.orderBy("vid").limit(1)
    return numbered(farthest(voxels.join(found, "vid", "left_semi"), graph.saved(first), k))


def cell_members(voxels: DataFrame, k: int) -> DataFrame:
    """(vid, cid): in each of about k equal cells of the box from 0 the voxel nearest to the middle; every (cells / k)-th of them if there are more than k.

    With fewer cells than k, voxels at even steps of vid follow.
    """
    e = extent(voxels)
    n = [e[f"m{c}"] + 1 for c in "xyz"]
    step = max(1.0, (e["n"] / k) ** (1 / 3))
    parts = [max(1, math.floor(s / step)) for s in n]
    cell = [F.least(F.floor(F.col(c) * g / F.lit(s)), F.lit(g - 1)).cast("int") for c, g, s in zip("xyz", parts, n, strict=True)]
    gap = sum((F.col(c) - (b + 0.5) * F.lit(s / g)) * (F.col(c) - (b + 0.5) * F.lit(s / g)) for c, b, s, g in zip("xyz", cell, n, parts, strict=True))
    best = voxels.groupBy(cell[2].alias("cz"), cell[1].alias("cy"), cell[0].alias("cx")).agg(F.min(F.struct(gap.alias("d"), "vid")).alias("m"))
    best = graph.saved(ranges.numbered(best.select("cz", "cy", "cx", F.col("m.vid").alias("vid")), ["cz", "cy", "cx"]))
    found = best.count()
    if found >= k:
        steps = found / k
        picks = voxels.sparkSession.createDataFrame([(i, int(i * steps)) for i in range(k)], "i int, place long")
        return best.join(F.broadcast(picks), "place").select("vid", (F.col("i") + 1).alias("cid"))
    every = e["n"] / max(1, k - found)
    picks = voxels.sparkSession.createDataFrame([(i, int(i * every)) for i in range(k - found)], "i int, place long")
    rest = ranges.numbered(voxels.select("vid"), ["vid"]).join(F.broadcast(picks), "place").select("vid", (F.col("i") + found + 1).alias("cid"))
    return best.select("vid", (F.col("place") + 1).cast("int").alias("cid")).union(rest)


def even_starts(voxels: DataFrame, k: int) -> DataFrame:
    """(cid, cx, cy, cz): the places of k voxels at even steps of vid, first and last included."""
    n = voxels.count()
    picks = voxels.sparkSession.createDataFrame([(i + 1, int(i * (n - 1) / max(k - 1, 1))) for i in range(min(k, n))], "cid int, place long")
    return ranges.numbered(voxels.select("vid", "x", "y", "z"), ["vid"]).join(F.broadcast(picks), "place").select("cid", *[F.col(c).cast("double").alias(f"c{c}") for c in "xyz"])


def lloyd_step(voxels: DataFrame, centers: DataFrame) -> DataFrame:
    """(vid, cid): the nearest of k centers in space, ties to the smaller cid. Centers are broadcast: k is a parameter."""
    gap = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")
    met = voxels.select("vid", "x", "y", "z").crossJoin(F.broadcast(centers.select("cid", "cx", "cy", "cz")))
    return met.groupBy("vid").agg(F.min(F.struct(gap.alias("d"), "cid")).alias("m")).select("vid", F.col("m.cid").alias("cid"))


def lloyd(voxels: DataFrame, centers: DataFrame, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """Labels and centers after `rounds` of k-means on places from given centers; a center without voxels stays where it is."""
    for _ in range(rounds):
        labels = graph.saved(lloyd_step(voxels, centers))
        means = voxels.join(labels, "vid").groupBy("cid").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        new = graph.saved(centers.join(means, "cid", "left").select("cid", *[F.coalesce(f"m{c}", f"c{c}").alias(f"c{c}") for c in "xyz"]))
        moved = new.join(centers.select("cid", *[F.col(f"c{c}").alias(f"o{c}") for c in "xyz"]), "cid").agg(F.max(F.greatest(*[F.abs(F.col(f"c{c}") - F.col(f"o{c}")) for c in "xyz"]))).first()[0]
        centers = new
        if (moved or 0.0) < 1e-9:
            break
    return labels, centers


def tesselate(voxels: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(vid, cid): k-means of the places alone, from even starts; k over the number of voxels less one is lowered to that."""
    k = min(k, voxels.count() - 1)
    return groups.dense(lloyd(voxels, even_starts(voxels, max(1, k)), rounds)[0])


def kmeans(voxels: DataFrame, k: int, rounds: int = 10) -> DataFrame:
    """(vid, cid): the member nearest to each center of `tesselate`'s k-means."""
    labels, centers = lloyd(voxels, even_starts(voxels, k), rounds)
    gap = sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz")
    best = voxels.select("vid", "x", "y", "z").join(labels, "vid").join(centers, "cid").groupBy("cid").agg(F.min(F.struct(gap.alias("d"), "vid")).alias("m"))
    return numbered(best.select(F.col("m.vid").alias("vid"), "cid"), ["cid"])


def initial(voxels: DataFrame, k: int, method: str = "gradient", gradient: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """(vid, cid) of k seeds by `gradient` (least functional gradient over the 26 neighbours, unless one is given), `kmeans`, `poisson`, `grid` or `random`."""
    if method == "gradient":
        from gridfuse.operators import local

        found = gradient if gradient is not None else local.functional_gradient(voxels, spatial.both_ways(spatial.grid_edges(voxels, 26)))
        return low_gradient(voxels, found, k, fill="random")
    ways = {"kmeans": lambda: kmeans(voxels, k), "poisson": lambda: poisson_to_k(voxels, k, seed), "grid": lambda: grid(voxels, k), "random": lambda: random(voxels, k, seed)}
    if method not in ways:
        raise ValueError(f"method must be gradient or one of {sorted(ways)}")
    return ways[method]()
