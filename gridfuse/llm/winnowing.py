"""Operator 6: benchmark decontamination by winnowing.

A window of L words keeps the smallest hash of its k-grams, k = ceil(L / 2). Two
equal windows keep equal hashes, so a document window can equal a benchmark
window only if its kept hash is among the benchmark's: every shared span of L words is found.
Those hashes go to the tasks in a Bloom filter of a fixed number of bits;
candidates that pass are joined with the benchmark's windows on the hash of
the whole window and its words, which settles them, and hits that overlap extend each other to spans.

Items of fewer than `window` words are one window of their own length.

Defined results: null or word-less text has no words and is never hit; an item
without words has no window; items with a null item_id cause hits but are not
listed; repeated doc_ids give a row each; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import bytes_np, common

#: Bytes outside `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z is lower-cased.
NO_WORD = np.zeros(256, bool)
NO_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
WINDOW = 10
FILTER_BITS = 1 << 23


class Words:
    """Words of a run of texts as hashes, with the windows of any length that stay inside one text."""

    def __init__(self, values: list[bytes]):
        data = bytes_np.LOWER[np.frombuffer(b" ".join(values) + b" ", np.uint8)]
        start, end = bytes_np.word_spans(data, NO_WORD)
        self.data, self.start, self.end = data, start, end
        ends = np.cumsum(np.fromiter(map(len, values), np.int64, len(values)) + 1)
        self.before = np.searchsorted(start, np.concatenate(([0], ends)))
        self.n = np.diff(self.before)
        self.row = np.repeat(np.arange(len(values)), self.n)
        self.prefix = bytes_np.prefix_hash(bytes_np.span_hash(bytes_np.prefix_hash(bytes_np.BYTE_VALUE[data]), start, end))

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, kept hash) of each window of `length` words."""
        k = (length + 1) // 2
        at = np.arange(max(0, len(self.row) - length + 1))
        at = at[self.row[at] == self.row[at + length - 1]] if len(at) else at
        grams = np.arange(max(0, len(self.row) - k + 1))
        kept = bytes_np.sliding_min(bytes_np.span_hash(self.prefix, grams, grams + k), length - k + 1)
        return at, kept[at]

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return bytes_np.span_hash(self.prefix, at, at + length)

    def strings(self, at: np.ndarray, length: int) -> list[str]:
        """The words of each window, with one space between."""
        return [b" ".join(self.data[self.start[k] : self.end[k]].tobytes() for k in range(i, i + length)).decode() for i in at.tolist()]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, length, kept, h, words): every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in common.chunks(batches, "text", "item_id"):
            words = Words(values)
            for length in range(1, window + 1):
                at, kept = words.windows(length)
                whole = (words.n[words.row[at]] == length) | (length == window)
                at, kept = at[whole], kept[whole]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids).take(pa.array(words.row[at])).cast(pa.string()), pa.array(np.full(len(at), length, np.int32)), pa.array(kept.view(np.int64)), pa.array(words.hashes(at, length).view(np.int64)), pa.array(words.strings(at, length), pa.string())],
                    ["item_id", "length", "kept", "h", "words"],
                )

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, length int, kept long, h long, words string")


def kept_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter with two probes taken from the kept hashes themselves."""
    found = windows.select("kept").distinct().select(F.explode(F.array(F.expr(f"shiftrightunsigned(kept, 8) % {bits}"), F.expr(f"shiftrightunsigned(kept, 31) % {bits}"))).alias("p"))
    words = found.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words.w.to_numpy(np.int64)] = words.b.to_numpy(np.int64)
    return out.view(np.uint8)


def in_filter(filter_bytes: np.ndarray, kept: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(filter_bytes) * 8)
    ok = np.ones(len(kept), bool)
    for shift in (8, 31):
        p = (kept >> np.uint64(shift)) % bits
        ok &= (filter_bytes[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def candidates(documents: DataFrame, lengths: list[int], filter_bytes: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, spots): for each document the windows whose kept hash may be the benchmark's."""
    sent = documents.sparkSession.sparkContext.broadcast(filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = common.task_number(), 0
        for ids, values in common.chunks(batches, "text", "doc_id"):
            words = Words(values)
            found = []
            for length in lengths:
                at, kept = words.windows(length)
                at = at[in_filter(sent.value, kept)]
                found.append((at, np.full(len(at), length, np.int32), words.hashes(at, length).view(np.int64), np.array(words.strings(at, length), object)))
            at, length, h, strings = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, object))
            order = np.argsort(words.row[at], kind="stable")
            at, length, h, strings = at[order], length[order], h[order], strings[order]
            row = words.row[at]
            offsets = np.searchsorted(row, np.arange(len(values) + 1)).astype(np.int32)
            spots = pa.StructArray.from_arrays([pa.array((at - words.before[row]).astype(np.int32)), pa.array(length), pa.array(h), pa.array(strings, pa.string())], ["pos", "length", "h", "words"])
            rows = pa.array([f"{task}-{number + i}" for i in range(len(values))])
            number += len(values)
            yield pa.RecordBatch.from_arrays([rows, pa.array(ids, pa.int64()), pa.array(words.n), pa.ListArray.from_arrays(pa.array(offsets), spots)], ["row", "doc_id", "n_words", "spots"])

    return common.as_table(documents, "doc_id", "text").mapInArrow(run, "row string, doc_id long, n_words long, spots array<struct<pos:int,length:int,h:long,words:string>>")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_words, hits, n_hit, items): hits are the hit word spans, sorted; items the item_ids (as strings), sorted."""
    windows, _ = common.cut(benchmark_windows(benchmark, window), "windows")
    lengths = sorted(r.length for r in windows.select("length").distinct().collect())
    base, _ = common.cut(candidates(documents, lengths, kept_filter(windows, filter_bits)), "candidates")
    spots = base.filter("size(spots) > 0").select("row", F.inline("spots"))
    items = windows.groupBy("length", "h", "words").agg(F.collect_set("item_id").alias("items"))
    found = spots.join(items, ["length", "h", "words"]).groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("pos", F.expr("pos + length AS stop")))).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    none = F.expr("cast(array() as array<struct<pos:int,stop:int>>)")
    out = base.drop("spots").join(found, "row", "left").withColumn("hits", F.coalesce("hits", none)).withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(F.greatest(acc.stop, x.stop).alias("stop"), (acc.n + F.greatest(F.lit(0), x.stop - F.greatest(acc.stop, x.pos))).alias("n")),
        lambda acc: acc.n,
    )
    return out.select("doc_id", "n_words", "hits", covered.alias("n_hit"), "items")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
