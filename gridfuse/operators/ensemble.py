"""Consensus of partitions by soft memberships: labels are matched to the average and averaged again until the matchings stay."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.operators import graph, groups


def assignment(gain: np.ndarray) -> list[int]:
    """The column of each row in the one-to-one matching of greatest total gain (shortest augmenting paths, n**3 for n labels)."""
    cost = -np.asarray(gain, float)
    n = len(cost)
    rows, columns = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)  # row of each column, both from 1
    for row in range(1, n + 1):
        match[0], at = row, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while match[at]:
            used[at] = True
            i = match[at]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i - 1, free - 1] - rows[i] - columns[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], at
            nearest = free[np.argmin(least[free])]
            delta = least[nearest]
            rows[match[used]] += delta
            columns[used] -= delta
            least[free] -= delta
            at = nearest
        while at:
            match[at], at = match[way[at]], way[at]
    out = [0] * n
    for column in range(1, n + 1):
        out[match[column] - 1] = column - 1
    return out


def averaged(partitions: list[DataFrame], names: list[dict[int, int]]) -> DataFrame:
    """(vid, c, p): the share of partitions (vid, cid) that put a voxel in c, after each has had its labels renamed."""
    rows = None
    for labels, new in zip(partitions, names, strict=True):
        table = F.create_map(*[F.lit(x) for old, to in sorted(new.items()) for x in (old, to)])
        one = labels.select("vid", F.element_at(table, F.col("cid").cast("int")).alias("c"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("vid", "c").agg((F.count("*") / len(partitions)).alias("p"))


def overlap(soft: DataFrame, labels: DataFrame, k: int) -> np.ndarray:
    """k x k: how much of the membership in c (columns) lies in each label (rows), both from 1; k rows and columns are all that comes to the driver."""
    out = np.zeros((k, k))
    for r in soft.join(labels, "vid").groupBy("cid", "c").agg(F.sum("p").alias("w")).collect():
        out[r.cid - 1, r.c - 1] = r.w
    return out


def soft_consensus(partitions: list[DataFrame], rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Soft memberships (vid, c, p) of least squared distance to the partitions, each under its best renaming, and the hard labels (vid, cid) from them; ties go to the smaller label.

    Labels are made dense first; partitions with fewer of them than the largest have empty ones. Rounds match every partition to the average and average
    again, which never raises the distance, until no matching changes.
    """
    if len(partitions) < 2:
        raise ValueError("consensus needs two partitions or more")
    dense = [graph.saved(groups.dense(p)) for p in partitions]
    k = max(p.agg(F.max("cid")).first()[0] or 0 for p in dense)
    same = {c: c for c in range(1, k + 1)}
    # The first partition names the classes.
    soft, names = graph.saved(averaged(dense[:1], [same])), [same] * len(dense)
    for _ in range(rounds if k else 0):
        new = [{c + 1: to + 1 for c, to in enumerate(assignment(overlap(soft, p, k)))} for p in dense]
        graph.discard(soft)
        soft = graph.saved(averaged(dense, new))
        if new == names:
            break
        names = new
    best = soft.groupBy("vid").agg(F.min(F.struct((-F.col("p")).alias("n"), "c")).alias("m"))
    return soft, best.select("vid", F.col("m.c").alias("cid"))


def temporal_consensus(partitions: list[DataFrame]) -> DataFrame:
    """(vid, cid) for partitions of times instead of voxels: the same, and hard labels only."""
    return soft_consensus(partitions)[1]
