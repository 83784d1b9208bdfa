"""Operator 4: a quality classifier by importance resampling.

Texts are bags of hashed words and word pairs. Generative models over the
buckets are counted for target text (labelled good and not toxic), for raw text (every document)
and for toxic text. A document's log weight comes from the log ratio of target to raw,
a mean over its n-grams, and from that of target to toxic, a sum. Both are shrunk smoothly by their standard errors, half of a ratio being left at RAW_Z
or TOXIC_Z of them, so that rare words count too and no size switches them on or off. Both are put on
one scale by the scores that all but `lost` of the labelled target texts exceed; the log weight is
the smaller margin. Gumbel top-k sampling without replacement then keeps k documents, k being the
number with a log weight of at least zero.

Labels only fit the models: at most `sample` ids of each kind, those of least hash, are used. Counts, scores and
the choice cover every document.

Defined results: null or word-less text has no evidence, both ratios are 0; repeated doc_ids
are scored alike; labels that repeat count as good only if every row says so; null doc_ids are scored as any other; with no
labelled target every document has margin 0 and is kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import bytes_np, common

BUCKETS, SAMPLE, TEMPERATURE, LOST = 1 << 18, 50_000, 0.05, 0.002
RAW_Z, TOXIC_Z = 4.0, 4.0


def features(values: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of a run of texts, and the text that each belongs to."""
    data = np.frombuffer(b" ".join(values) + b" ", np.uint8)
    start, end = bytes_np.word_spans(data)
    ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1)
    row = np.searchsorted(ends, start, side="right")
    word = bytes_np.span_hash(bytes_np.prefix_hash(bytes_np.BYTE_VALUE[data]), start, end)
    paired = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
    pair = bytes_np.mix(word[paired] * np.uint64(3) + word[paired + 1]) if len(paired) else word[:0]
    return (np.concatenate((word, pair)) & np.uint64(buckets - 1)).astype(np.int64), np.concatenate((row, row[paired]))


def labelled(labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of at most `sample` target and toxic documents each."""
    rows = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))

    def some(condition: str) -> np.ndarray:
        return np.sort(rows.filter(condition).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).toPandas().doc_id.to_numpy(np.int64))

    return some("quality = 1 AND coalesce(toxic, 0) = 0"), some("toxic = 1")


def count(documents: DataFrame, target: np.ndarray, toxic: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """(raw, target, toxic) counts of each bucket; each task sends at most one row a bucket."""
    sent = documents.sparkSession.sparkContext.broadcast((target, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, buckets), np.int64)
        for ids, values in common.chunks(batches, "text", "doc_id"):
            bucket, row = features(values, buckets)
            ids = np.array([-1 if i is None else i for i in ids], np.int64)
            sums[0] += np.bincount(bucket, minlength=buckets)
            for k, wanted in enumerate(sent.value, 1):
                sums[k] += np.bincount(bucket[np.isin(ids, wanted)[row]], minlength=buckets)
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(s[used]) for s in sums)], ["bucket", "n0", "n1", "n2"])

    rows = common.as_table(documents, "doc_id", "text").mapInArrow(run, "bucket int, n0 long, n1 long, n2 long")
    found = rows.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "n2")]).toPandas()  # at most `buckets` rows
    out = np.zeros((3, buckets), np.int64)
    out[:, found.bucket.to_numpy()] = found[["n0", "n1", "n2"]].to_numpy().T
    return out


def ratio(target: np.ndarray, other: np.ndarray, z: float) -> np.ndarray:
    """log p_target - log p_other of each bucket, add-one smoothed, shrunk by its evidence: half is left where the counts differ by z standard errors.

    Counts are compared as square roots, whose error hardly depends on the count. Nothing is cut off, so few labels give weak ratios and not none.
    """
    n, m = int(target.sum()), int(other.sum())
    if not n or not m:
        return np.zeros(len(target), np.float32)
    found = np.log((target + 1) / (n + len(target))) - np.log((other + 1) / (m + len(other)))
    apart = 2 * np.abs(np.sqrt(other + 0.375) - np.sqrt(target * (m / n) + 0.375)) / np.sqrt(1 + m / n)
    return (found * apart**4 / (apart**4 + z**4)).astype(np.float32)


class Classifier:
    """Fitted ratios, the margins' scale and the sampling threshold; small, sent to tasks as it is."""

    def __init__(self, documents: DataFrame, labels: DataFrame, *, buckets: int = BUCKETS, sample: int = SAMPLE, lost: float = LOST, temperature: float = TEMPERATURE, seed: int = 1):
        spark = documents.sparkSession
        self.temperature, self.seed = temperature, seed
        self.target, toxic = labelled(labels, sample)
        raw_n, target_n, toxic_n = count(documents, self.target, toxic, buckets)
        self.sent = spark.sparkContext.broadcast((ratio(target_n, raw_n, RAW_Z), ratio(target_n, toxic_n, TOXIC_Z)))
        self.scored, _ = common.cut(self._ratios(documents), "ratios")
        known = self.scored.filter("is_target").select("mean_raw", "sum_toxic").toPandas()  # rows of at most `sample` ids
        self.bounds = [float(known[c].quantile(lost)) if len(known) else 0.0 for c in ("mean_raw", "sum_toxic")]
        keys = self.weighted(self.scored)
        self.k = keys.filter("log_weight >= 0").count()
        self.threshold = kth_largest(keys, "key", self.k)

    def _ratios(self, documents: DataFrame) -> DataFrame:
        sent, target = self.sent, documents.sparkSession.sparkContext.broadcast(self.target)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, values in common.chunks(batches, "text", "doc_id"):
                a, b = evidence(values, *sent.value)
                known = np.isin(np.array([-1 if i is None else i for i in ids], np.int64), target.value)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a), pa.array(b), pa.array(known)], ["doc_id", "mean_raw", "sum_toxic", "is_target"])

        return common.as_table(documents, "doc_id", "text").mapInArrow(run, "doc_id long, mean_raw double, sum_toxic double, is_target boolean")

    def weighted(self, rows: DataFrame) -> DataFrame:
        """Adds log_weight and the Gumbel key, which depend on the ratios and the doc_id alone."""
        margins = [(F.col(c) - F.lit(b)) / F.lit(max(abs(b), 1e-6)) for c, b in zip(("mean_raw", "sum_toxic"), self.bounds, strict=True)]
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.coalesce("doc_id", F.lit(-1))), 11)
        gumbel = -F.log(-F.log((bits + F.lit(0.5)) / F.lit(2.0**53)))
        return rows.withColumn("log_weight", F.least(*margins)).withColumn("key", F.col("log_weight") / F.lit(self.temperature) + gumbel)

    def result(self) -> DataFrame:
        """(doc_id, log_weight, key, kept) of every document."""
        return self.weighted(self.scored).select("doc_id", "log_weight", "key", (F.col("key") >= F.lit(self.threshold)).alias("kept"))

    def keep(self, documents: DataFrame) -> DataFrame:
        """The documents kept, with their columns; texts are scored again where they are rather than joined."""
        sent = self.sent

        @F.pandas_udf("struct<mean_raw:double,sum_toxic:double>")
        def ratios(text: pd.Series) -> pd.DataFrame:
            out = [evidence(v, *sent.value) for (v,) in common.chunks([pa.record_batch({"t": pa.array(text, pa.string(), from_pandas=True)})], "t")]
            return pd.DataFrame({c: np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i, c in enumerate(("mean_raw", "sum_toxic"))})

        columns = [F.col(f"`{c}`") for c in documents.columns]
        rows = documents.select(F.struct(*columns).alias("row"), F.col("doc_id"), ratios("text").alias("r")).select("row", "doc_id", "r.*")
        return self.weighted(rows).filter(F.col("key") >= F.lit(self.threshold)).select("row.*")


def evidence(values: list[bytes], raw: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bucket, row = features(values, len(raw))
    n = np.maximum(np.bincount(row, minlength=len(values)), 1)
    return np.bincount(row, raw[bucket], len(values)) / n, np.bincount(row, toxic[bucket], len(values))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 1024, few: int = 10_000) -> float:
    """The k-th largest value, exactly: histograms narrow the range until few values are left. -inf takes all."""
    if k <= 0:
        return float("inf")
    value: Column = F.col(column)
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if n is None or k >= n:
        return float("-inf")
    above = 0
    while n > few and high > low:
        step = (high - low) / bins
        at = F.least(F.floor((value - F.lit(low)) / F.lit(step)), F.lit(bins - 1))
        inside = rows.filter(value.between(F.lit(low), F.lit(high)))
        found = sorted(inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect(), reverse=True)
        for _, m, lo, hi in found:
            if above + m >= k:
                break
            above += m
        if m == n:
            break
        low, high, n = lo, hi, m
    left = rows.filter(value.between(F.lit(low), F.lit(high))).groupBy(value.alias("v")).count().orderBy(F.desc("v")).collect() if n <= few or high == low else []
    for v, m in left:
        above += m
        if above >= k:
            return v
    return low


def op4_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Classifier(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")).result()
