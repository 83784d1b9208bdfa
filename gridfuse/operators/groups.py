"""Centers of labelled voxels, and measures that compare partitions through their contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def centers(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, n, feat, cx, cy, cz): means of features and places; partial sums are combined before the shuffle."""
    # No broadcast of labels, a row a voxel: it would pass through the driver.
    rows = voxels.join(labels.filter("cid > 0").hint("merge"), "vid")
    feats = rows.select("cid", F.posexplode("ts").alias("t", "v")).groupBy("cid", "t").agg(F.avg("v").alias("v"))
    feats = feats.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s.v).alias("feat"))
    places = rows.groupBy("cid").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    return places.join(feats, "cid").select("cid", "n", "feat", "cx", "cy", "cz")


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n) of two labelings of the same voxels; labels of 0 or null are left out."""
    rows = a.filter("cid > 0").select("vid", F.col("cid").alias("a")).join(b.filter("cid > 0").select("vid", F.col("cid").alias("b")), "vid")
    return rows.groupBy("a", "b").agg(F.count("*").alias("n"))


def agreement(table: DataFrame, degenerate: float = 1.0) -> DataFrame:
    """(n, ari, nmi, purity) of a contingency table, in one row; `degenerate` is the index where chance alone agrees fully."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = table.agg(F.sum("n").alias("n"))
    sides = [table.groupBy(c).agg(F.sum("n").alias("m"), F.max("n").alias("top")) for c in ("a", "b")]
    sums = [s.crossJoin(F.broadcast(total)).agg(pairs("m").alias(f"pairs_{c}"), F.sum(-F.col("m") / F.col("n") * F.log(F.col("m") / F.col("n"))).alias(f"h_{c}"), F.sum("top").alias(f"top_{c}")) for s, c in zip(sides, "ab", strict=True)]
    joint = table.crossJoin(F.broadcast(total.withColumnRenamed("n", "all"))).agg(pairs("n").alias("pairs"), F.sum(-F.col("n") / F.col("all") * F.log(F.col("n") / F.col("all"))).alias("h"), F.first("all").alias("n"))
    rows = joint.crossJoin(sums[0]).crossJoin(sums[1])  # one row each
    expected = F.col("pairs_a") * F.col("pairs_b") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("pairs_a") + F.col("pairs_b")) / 2
    mutual = F.col("h_a") + F.col("h_b") - F.col("h")
    return rows.select(
        "n",
        F.when(most == expected, degenerate).otherwise((F.col("pairs") - expected) / (most - expected)).alias("ari"),
        F.when(F.col("h_a") + F.col("h_b") == 0, 1.0).otherwise(2 * mutual / (F.col("h_a") + F.col("h_b"))).alias("nmi"),
        (F.col("top_b") / F.col("n")).alias("purity"),
    )


def counts(labels: DataFrame) -> DataFrame:
    return labels.filter("cid > 0").groupBy("cid").agg(F.count("*").alias("n"))


def sizes(labels: DataFrame) -> DataFrame:
    """(k, smallest, first, median, third, largest, mean, sd) of the cluster sizes; quartiles are interpolated."""
    quartile = lambda q: F.percentile("n", F.lit(q))
    return counts(labels).agg(
        F.count("*").alias("k"), F.min("n").alias("smallest"), quartile(0.25).alias("first"), F.median("n").alias("median"), quartile(0.75).alias("third"),
        F.max("n").alias("largest"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"),
    )


def block_labels(voxels: DataFrame, side: int) -> DataFrame:
    """(vid, bx, by, bz): cubes of `side` voxels, counted from the smallest place on each axis."""
    low = voxels.agg(*[F.min(c).alias(f"l{c}") for c in "xyz"])
    rows = voxels.crossJoin(F.broadcast(low))  # one row
    return rows.select("vid", *[F.expr(f"cast(({c} - l{c}) div {side} as int)").alias(f"b{c}") for c in "xyz"])


def blocks(voxels: DataFrame, side: int) -> DataFrame:
    """(bx, by, bz, n, feat, cx, cy, cz): means of features and places over those cubes."""
    rows = voxels.join(block_labels(voxels, side), "vid")
    keys = ["bx", "by", "bz"]
    feats = rows.select(*keys, F.posexplode("ts").alias("t", "v")).groupBy(*keys, "t").agg(F.avg("v").alias("v"))
    feats = feats.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s.v).alias("feat"))
    places = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{c}") for c in "xyz"])
    return places.join(feats, keys).select(*keys, "n", "feat", "cx", "cy", "cz")


def from_blocks(voxels: DataFrame, names: DataFrame, side: int) -> DataFrame:
    """(vid, cid): each voxel takes the label of its block (bx, by, bz, cid)."""
    return block_labels(voxels, side).join(names, ["bx", "by", "bz"]).select("vid", "cid")


def unit_centers(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """`centers` whose features are scaled to length one."""
    from gridfuse.functions import vectors as V

    return centers(voxels, labels).withColumn("feat", V.unit("feat"))


def central_members(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, feature_vid, place_vid): the member of the least sum of 1 - correlation with all members, and that of the least sum of distances to them.

    The first sum needs only the sum of the members' z-scores; the second compares the places of a cluster in pairs.
    """
    from gridfuse.functions import vectors as V
    from gridfuse.operators import series

    rows = voxels.join(labels.filter("cid > 0"), "vid")
    z = rows.select("cid", "vid", V.unit(series.demeaned("ts")).alias("ts"))
    total = z.select("cid", F.posexplode("ts").alias("t", "v")).groupBy("cid", "t").agg(F.sum("v").alias("v"))
    total = total.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s.v).alias("sum"))
    by_feature = z.join(total, "cid").groupBy("cid").agg(F.min(F.struct(F.round(-V.dot("ts", "sum"), 9).alias("d"), "vid")).alias("m")).select("cid", F.col("m.vid").alias("feature_vid"))
    a = rows.select("cid", "vid", "x", "y", "z")
    pairs = a.join(a.select("cid", *[F.col(c).alias(f"o{c}") for c in "xyz"]), "cid")
    gap = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz"))
    by_place = pairs.groupBy("cid", "vid").agg(F.round(F.sum(gap), 9).alias("d")).groupBy("cid").agg(F.min(F.struct("d", "vid")).alias("m")).select("cid", F.col("m.vid").alias("place_vid"))
    return by_feature.join(by_place, "cid")


def bit_majority(codes: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """(cid, n, h): bit b is set where at least half the members' codes (vid, h) have it; one pass of partial sums."""
    rows = codes.join(labels.filter("cid > 0"), "vid")
    one = lambda b: F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}")
    found = rows.groupBy("cid").agg(F.count("*").alias("n"), *[one(b) for b in range(bits)])
    word = F.lit(0).cast("long")
    for b in range(bits):
        word = word.bitwiseOR(F.when(2 * F.col(f"b{b}") >= F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return found.select("cid", "n", word.alias("h"))


def outermost(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """(cid, vid): the member farthest from the mean place; ties go to the smaller vid."""
    rows = voxels.select("vid", "x", "y", "z").join(labels.filter("cid > 0"), "vid")
    middle = rows.groupBy("cid").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    gap = F.round(sum((F.col(c) - F.col(f"c{c}")) * (F.col(c) - F.col(f"c{c}")) for c in "xyz"), 9)
    return rows.join(middle, "cid").groupBy("cid").agg(F.min(F.struct((-gap).alias("d"), "vid")).alias("m")).select("cid", F.col("m.vid").alias("vid"))


def prototype_stats(centers: DataFrame) -> DataFrame:
    """(cid, sum, mean, inverse_sd, energy) of each mean series; inverse_sd is over the root of the summed squared differences, 0 for a constant one."""
    from gridfuse.functions import vectors as V
    from gridfuse.operators import series

    spread = V.norm(series.demeaned("feat"))
    return centers.select("cid", V.total("feat").alias("sum"), V.mean("feat").alias("mean"), F.when(spread > 1e-12, 1 / spread).otherwise(0.0).alias("inverse_sd"), V.dot("feat", "feat").alias("energy"))


def permuted(labels: DataFrame, centers: DataFrame | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """Labels, and their centers with them, under names 1..K in a shuffled order that a seed fixes."""
    from gridfuse.operators import ranges

    order = labels.filter("cid > 0").select("cid").distinct().withColumn("o", F.md5(F.concat_ws(":", F.lit(seed), "cid")))
    names = ranges.numbered(order, ["o", "cid"]).select("cid", (F.col("place") + 1).cast("int").alias("new"))
    moved = lambda t: t.join(names, "cid").withColumn("cid", F.col("new")).drop("new")
    return moved(labels).select("vid", "cid"), None if centers is None else moved(centers)


def dense(labels: DataFrame) -> DataFrame:
    """Labels renamed 1..K in their order; distinct labels are ranked in ranges."""
    from gridfuse.operators import ranges  # it builds on tables that `graph` saves

    names = ranges.numbered(labels.select("cid").filter("cid > 0").distinct(), ["cid"])
    return labels.join(names, "cid").select("vid", (F.col("place") + 1).cast("int").alias("cid"))
