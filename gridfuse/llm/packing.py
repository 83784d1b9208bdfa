"""Operator 10: length buckets that minimise padding, and token-budget batches inside each.

Texts longer than `max_len` are cut into parts of `max_len`, all kept. The global
histogram of part lengths (at most max_len + 1 rows) goes to the driver,
where dynamic programming finds the bucket boundaries with the least padding. In a bucket,
a batch holds budget // boundary parts. Parts get their numbers in groups of
about `group_rows` by a hash, from the groups' counts, so no bucket
meets in one task.

Defined results: a length of zero or null makes one part of length 0; repeated
rows are parts of their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.llm import common

MAX_LEN, BUCKETS, TOKEN_BUDGET, GROUP_ROWS = 2048, 16, 1 << 16, 2000


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets for which sum(count * (bound - length)) is least. Lengths ascend."""
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    s = np.concatenate(([0], np.cumsum(counts.astype(np.int64) * lengths)))
    # cost[i, j]: the padding of a bucket of lengths i..j, bounded by length j.
    cost = lengths[None, :].astype(np.int64) * (c[None, 1:] - c[:-1, None]) - (s[None, 1:] - s[:-1, None])
    cost = np.where(np.arange(n)[:, None] <= np.arange(n)[None, :], cost, np.iinfo(np.int64).max // 4)
    best, back = cost[0].copy(), [np.zeros(n, np.int64)]
    for _ in range(min(buckets, n) - 1):
        total = np.concatenate(([0], best[:-1]))[:, None] + cost
        back.append(total.argmin(0))
        best = total.min(0)
    out, j = [], n - 1
    for choice in reversed(back):
        if j < 0:
            break
        out.append(int(lengths[j]))
        j = int(choice[j]) - 1
    return out[::-1]


def parts(lengths: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, n) -> (doc_id, part, start, length)."""
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("long")
    last = F.greatest(F.ceil(n / max_len), F.lit(1)) - 1
    return lengths.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part")).select(
        "doc_id", "part", (F.col("part") * max_len).alias("start"), F.least(F.col("n") - F.col("part") * max_len, F.lit(max_len)).alias("length")
    )


def pack(lengths: DataFrame, *, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n) -> (doc_id, part, start, length, bucket, bound, batch, slot)."""
    rows = parts(lengths, max_len)
    histogram = rows.groupBy("length").agg(F.count("*").alias("n")).toPandas().sort_values("length")
    bounds = best_boundaries(histogram.length.to_numpy(np.int64), histogram.n.to_numpy(np.int64), buckets) or [max_len]
    # The histogram tells each bucket's rows, hence its number of groups.
    which = np.searchsorted(bounds, histogram.length.to_numpy(np.int64))
    groups = [int(-(-histogram.n.to_numpy(np.int64)[which == b].sum() // group_rows)) or 1 for b in range(len(bounds))]
    bucket = sum((F.when(F.col("length") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).cast("int")
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("bucket") + 1)
    rows = rows.withColumn("bucket", bucket).withColumn("bound", at(bounds).cast("long")).withColumn("group", F.pmod(F.xxhash64("doc_id", "part"), at(groups)))
    sizes = rows.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    # One row for each group_rows rows of the input.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("bucket", "group", before.alias("before"))
    order = Window.partitionBy("bucket", "group").orderBy(F.xxhash64("part", "doc_id"), "doc_id", "part")
    placed = rows.withColumn("k", F.row_number().over(order)).join(sizes, ["bucket", "group"]).withColumn("k", F.col("k") - 1 + F.col("before"))
    per_batch = F.greatest(F.floor(F.lit(budget) / F.greatest("bound", F.lit(1))), F.lit(1))
    return placed.select("doc_id", "part", "start", "length", "bucket", "bound", F.floor(F.col("k") / per_batch).alias("batch"), (F.col("k") % per_batch).alias("slot"))


def word_lengths(documents: DataFrame) -> DataFrame:
    """(doc_id, n): words of each whole text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return common.as_table(documents, "doc_id", "text").select("doc_id", words.cast("long").alias("n"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths, _ = common.cut(word_lengths(common.read(spark, sf_dir, "documents")), "lengths")
    return pack(lengths)
