"""Reports on partitions: quality, order of labels, validity, matching; and a choice of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, groups, local, ranges


def medoids(voxels: DataFrame, labels: DataFrame, centers: DataFrame) -> DataFrame:
    """(cid, vid): the member nearest to the mean feature; ties go to the smaller vid."""
    rows = voxels.select("vid", "ts").join(labels, "vid").join(centers.select("cid", "feat"), "cid")
    return rows.groupBy("cid").agg(F.min(F.struct(V.sq_distance("ts", "feat").alias("d"), F.col("vid"))).alias("m")).select("cid", F.col("m.vid").alias("vid"))


def quality(voxels: DataFrame, labels: DataFrame, centers: DataFrame) -> DataFrame:
    """(within_corr, within_dist): means of the Fisher z of the correlation with the own center, and of the distance to it."""
    rows = voxels.select("vid", "x", "y", "z", "ts").join(labels, "vid").join(centers, "cid")
    return rows.agg(F.avg(V.fisher_z(F.coalesce(V.correlation("ts", "feat"), F.lit(0.0)))).alias("within_corr"), F.avg(F.sqrt(local.space())).alias("within_dist"))


def between(pairs: DataFrame, centers: DataFrame) -> DataFrame:
    """(src, dst, r): correlation of the centers of two labels, for the pairs asked."""
    a = centers.select(F.col("cid").alias("src"), F.col("feat").alias("a"))
    rows = pairs.select("src", "dst").join(a, "src").join(a.select(F.col("src").alias("dst"), F.col("a").alias("b")), "dst")
    return rows.select("src", "dst", V.correlation("a", "b").alias("r"))


def _mean_rank(centers: DataFrame, column: str) -> DataFrame:
    """(cid, r): mean ranks; places come from a sort in ranges."""
    placed = ranges.numbered(centers.select(*dict.fromkeys((column, "cid"))), list(dict.fromkeys((column, "cid"))))
    ranks = placed.groupBy(column).agg((F.avg("place") + 1).alias("r"))
    return placed.join(ranks, column).select("cid", F.col("r").alias(f"r_{column}"))


def label_order(centers: DataFrame) -> DataFrame:
    """(cor_x, cor_y, cor_z, ordered, strongly): Spearman's correlation of the label with each axis; ordered if one is over 0.3, strongly if over 0.7."""
    rows = _mean_rank(centers, "cid")
    for c in ("cx", "cy", "cz"):
        rows = rows.join(_mean_rank(centers, c), "cid")
    found = rows.agg(*[F.corr("r_cid", f"r_c{c}").alias(f"cor_{c}") for c in "xyz"])
    most = F.greatest(*[F.abs(f"cor_{c}") for c in "xyz"])
    return found.withColumns({"ordered": most > 0.3, "strongly": most > 0.7})


def validity(labels: DataFrame, tiny: int = 5) -> DataFrame:
    """(k, missing, tiny, unlabelled): labels in use, unused ones below the greatest, labels of under `tiny` voxels, voxels with none."""
    counts = labels.groupBy("cid").agg(F.count("*").alias("n"))
    used = F.col("cid") > 0
    rows = counts.agg(F.count_if(used).alias("k"), F.max(F.when(used, F.col("cid"))).alias("top"), F.count_if(used & (F.col("n") < tiny)).alias("tiny"), F.sum(F.when(F.coalesce(~used, F.lit(True)), F.col("n")).otherwise(0)).alias("unlabelled"))
    return rows.select("k", (F.coalesce("top", F.lit(0)) - F.col("k")).cast("long").alias("missing"), "tiny", F.coalesce("unlabelled", F.lit(0)).cast("long").alias("unlabelled"))


def overlap(table: DataFrame) -> DataFrame:
    """(overlap): share of voxel pairs on which two partitions agree, each voxel with itself included, from their contingency table."""
    squares = lambda df: df.agg(F.sum(F.col("n") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    parts = [squares(table).select("s", "n"), *[squares(table.groupBy(c).agg(F.sum("n").alias("n"))).select(F.col("s").alias(c)) for c in ("a", "b")]]
    rows = parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each
    return rows.select(((2 * F.col("s") + F.col("n") * F.col("n") - F.col("a") - F.col("b")) / (F.col("n") * F.col("n"))).alias("overlap"))


def matching(table: DataFrame) -> DataFrame:
    """(a, b, n): greedy matching of two labelings: the greatest count first, then of what is left.

    A cell that comes first both in its row and in its column would be taken by the greedy order too, so each round takes all of them.
    """
    left, taken = graph.saved(table), None
    while not left.isEmpty():
        key = F.struct((-F.col("n")).alias("n"), F.col("a"), F.col("b"))
        rows = left.groupBy("a").agg(F.min(key).alias("m")).select("m.*")
        columns = left.groupBy("b").agg(F.min(key).alias("m")).select("m.*")
        new = graph.saved(rows.join(columns, ["n", "a", "b"], "left_semi").select("a", "b", (-F.col("n")).alias("n")))
        taken = new if taken is None else taken.union(new)
        left = graph.saved(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti"))
    return taken if taken is not None else table


def all_pairs(centers: DataFrame) -> DataFrame:
    """(src, dst, r), src < dst: correlations of all pairs of centers, whose number the caller chose."""
    ids = centers.select(F.col("cid").alias("src"))
    pairs = ids.crossJoin(F.broadcast(ids.withColumnRenamed("src", "dst"))).filter("src < dst")
    return between(pairs, centers)


def metrics(voxels: DataFrame, labels: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """(k, smallest, median, largest, within_corr, within_dist, between_corr[, ari]) in one row; constant series count as 0, ari is 0 where chance alone agrees fully."""
    centers = graph.saved(groups.centers(voxels, labels))
    z = F.avg(V.fisher_z(F.coalesce("r", F.lit(0.0)))).alias("between_corr")
    rows = groups.sizes(labels).select("k", "smallest", "median", "largest").crossJoin(quality(voxels, labels, centers)).crossJoin(all_pairs(centers).agg(z))  # one row each
    if truth is not None:
        rows = rows.crossJoin(groups.agreement(groups.contingency(labels, truth), degenerate=0.0).select("ari"))
    return rows


def summary(voxels: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: sizes with quartiles, the ranges of the centers on each axis, and the mean correlation between centers."""
    centers = graph.saved(groups.centers(voxels, labels))
    extent = centers.agg(*[f(f"c{c}").alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))])
    return groups.sizes(labels).crossJoin(extent).crossJoin(all_pairs(centers).agg(F.avg("r").alias("center_corr")))  # one row each


def compared(voxels: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """One row a result: its sizes, the mean correlation between its centers, and, of two results, their overlap (else null)."""
    rows = None
    for name, labels in results.items():
        centers = graph.saved(groups.centers(voxels, labels))
        one = groups.sizes(labels).select(F.lit(name).alias("method"), F.col("k").alias("n_clusters"), F.col("smallest").alias("min_size"), F.col("largest").alias("max_size"), F.round("mean", 1).alias("mean_size"), F.round("sd", 1).alias("sd_size"))
        one = one.crossJoin(all_pairs(centers).agg(F.round(F.avg("r"), 3).alias("temporal_coherence")))  # one row each
        rows = one if rows is None else rows.union(one)
    if len(results) != 2:
        return rows.withColumn("overlap", F.lit(None).cast("double"))
    return rows.crossJoin(F.broadcast(overlap(groups.contingency(*results.values()))))


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, ari, nmi, accuracy, n_predicted, n_truth, perfect) over voxels that have both labels; accuracy is that of the greedy matching."""
    table = graph.saved(groups.contingency(predicted, truth))
    matched = matching(table).agg(F.sum("n").alias("matched"))
    kinds = table.agg(F.countDistinct("a").alias("n_predicted"), F.countDistinct("b").alias("n_truth"))
    rows = groups.agreement(table).crossJoin(matched).crossJoin(kinds)  # one row each
    return rows.select("n", "ari", "nmi", (F.col("matched") / F.col("n")).alias("accuracy"), "n_predicted", "n_truth", (F.abs(F.col("ari") - 1) < 1e-10).alias("perfect"))


def unmatched_centers(labels: DataFrame, centers: DataFrame) -> DataFrame:
    """(without_center, without_voxels): labels in use that have no center, and centers of labels that no voxel has."""
    used = labels.filter("cid > 0").select("cid").distinct()
    sides = [used.join(centers, "cid", "left_anti"), centers.select("cid").join(used, "cid", "left_anti")]
    return sides[0].agg(F.count("*").alias("without_center")).crossJoin(sides[1].agg(F.count("*").alias("without_voxels")))  # one row each


def suggest(n_voxels: int, n_times: int, priority: str = "balanced") -> dict:
    """A method and a number of clusters for data of this size."""
    # Share of the basic number of clusters by priority, and the rule of the method.
    share = {"speed": 0.7, "quality": 1.2, "memory": 0.8, "balanced": 1.0}
    rules = {
        "speed": lambda n: "slice_msf" if n > 50_000 else "flash3d",
        "quality": lambda n: "supervoxels" if n < 20_000 else "slic",
        "memory": lambda n: "snic",
        "balanced": lambda n: "flash3d" if n > 30_000 else "slic",
    }
    if priority not in rules:
        raise ValueError(f"priority must be one of {sorted(rules)}")
    return {"method": rules[priority](n_voxels), "n_clusters": round(min(1000, max(10, n_voxels / 250)) * share[priority]), "memory_mb": round(n_voxels * n_times * 8 / 1e6)}
