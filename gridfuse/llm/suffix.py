"""Operator 8: exact repeats of 400 bytes by distributed difference-cover suffix sorting.

The texts are first written as strings over pieces. Every 400-byte window
keeps the smallest hash of its `gram`-byte strings; a run of windows that keep the same
value is a phrase. Equal windows keep equal values, so a window whose value is kept in one phrase only stands nowhere else.
A phrase's piece is its bytes up to the first gram of its last window (of a text's last phrase, to the end): less than the phrase,
which the pieces from there on hold together.

`suffix_ranks` sorts the suffixes of all those strings with the difference cover
of period 3: sampled triples are sorted and named, names recurse, the remaining suffixes
are merged by counting how many of each class are smaller. Neighbours in suffix order whose prefixes hold a phrase in common
tell that it repeats, with every window in it. Where a repeat begins or ends inside a phrase, its windows are sorted too, first in blocks
of up to STEP windows by (core, whole block), then, where whole blocks of one core differ, one by one;
adjacent prefixes (`neighbours`) decide there as well, so nothing is grouped or joined by what repeats.

Names are polynomials of 62 bits modulo a prime; equal ones are taken as equal bytes. Two given
strings of n bytes have equal names with a chance of at most (n / 2**31) ** 2.

Defined results: null text is empty; texts under `length` bytes keep everything;
a text that stands twice (also under one doc_id) loses every byte if it has
`length`; rows with null doc_id are as any other; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.llm import bytes_np, common

LENGTH, GRAM = 400, 256
#: Most bits of the filter that is broadcast, 8 MB; with more values than it suits, more windows are looked at, none is lost.
FILTER_BITS = 1 << 26
#: Windows of a block.
STEP = 16
#: Bytes of text that are looked at together; a longer text alone.
TOGETHER = 1 << 17
#: Pieces to which suffixes are sorted. A phrase is held by 4 on average; one that needs more, or ends inside a piece, may be left to its windows.
DEPTH = 9


# -- suffix sorting of many strings of names ---------------------------------


def smaller(rows: DataFrame, keys: list[str], weights: list[str]) -> DataFrame:
    """Distinct keys with `less_<weight>`: the sum of each weight over all smaller keys (nulls first).

    Equal keys are summed up before they are dealt out by ranges; running sums are within ranges, and one
    row a range carries them on.
    """
    summed = rows.groupBy(*keys).agg(*[F.sum(w).cast("long").alias(w) for w in weights])
    order = [F.col(k).asc_nulls_first() for k in keys]
    schema = ", ".join([f"{k} {dict(rows.dtypes)[k]}" for k in keys] + [f"{w} long, less_{w} long" for w in weights] + ["part int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), dict.fromkeys(weights, 0)
        for batch in batches:
            columns = [batch.column(k) for k in keys]
            for w in weights:
                n = batch.column(w).to_numpy(zero_copy_only=False).astype(np.int64)
                sums = np.cumsum(n) + done[w]
                columns += [pa.array(n), pa.array(sums - n)]
                done[w] = int(sums[-1]) if len(sums) else done[w]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, part, np.int32))], [*keys, *(x for w in weights for x in (w, f"less_{w}")), "part"])

    found, _ = common.cut(summed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranks")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = found.groupBy("part").agg(*[F.sum(w).alias(w) for w in weights])
    totals = totals.select("part", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"before_{w}") for w in weights])
    return found.join(totals, "part").select(*keys, *[(F.col(f"less_{w}") + F.col(f"before_{w}")).alias(f"less_{w}") for w in weights])


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the other columns of `table`; null keys match null keys."""
    renamed = table.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in table.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(renamed, condition).drop(*[f"_{k}" for k in keys])


def ahead(column: str, by: int, missing: Column) -> Column:
    """The column at position k + by of the same string, if no position up to there is absent."""
    w = Window.partitionBy("s").orderBy("k")
    return F.coalesce(F.when(F.lead("k", by).over(w) == F.col("k") + by, F.lead(column, by).over(w)), missing)


def suffix_ranks(strings: DataFrame, depth: int | None = None) -> DataFrame:
    """Strings (s, k, x), one row for name x at position k of string s -> (s, k, x0, x1, x2, rank).

    A position that is absent ends the suffixes before it. rank is the number of
    suffixes, of all strings, that are smaller; equal suffixes share it. With `depth`,
    suffixes that agree in that many names at least may share it too.
    """
    null = F.lit(None).cast("long")
    # What follows an absent position is another string, so positions are counted from 0 without gaps.
    island = F.col("k") - F.row_number().over(Window.partitionBy("s").orderBy("k"))
    rows = strings.withColumn("island", island + 1)
    rows = rows.select(F.concat_ws("@", "s", "island").alias("s"), (F.col("k") - F.col("island")).alias("k"), F.col("x").alias("x0"))
    rows = rows.withColumn("x1", ahead("x0", 1, null)).withColumn("x2", ahead("x0", 2, null))
    rows, _ = common.cut(rows.withColumn("one", F.lit(1)), "strings")
    sampled = rows.filter("k % 3 <> 0")
    triples = ["x0", "x1", "x2"]
    names = smaller(sampled, triples, ["one"])
    named = looked_up(sampled, names, triples).withColumnRenamed("less_one", "name")
    if depth is None or depth > 3:
        named, _ = common.cut(named, "names")
        distinct, total = named.agg(F.countDistinct("name"), F.count("*")).first()
        if distinct < total:
            shorter = named.select(F.concat_ws(".", "s", (F.col("k") % 3).cast("string")).alias("s"), F.expr("k div 3").alias("k"), F.col("name").alias("x"))
            deeper = suffix_ranks(shorter, None if depth is None else -(-depth // 3))
            back = deeper.select(F.expr("substring(s, 1, length(s) - 2)").alias("s"), (F.col("k") * 3 + F.expr("cast(right(s, 1) as long)")).alias("k"), F.col("rank").alias("name"))
            named = back
    ranks = named.select("s", "k", F.col("name").alias("r"))
    rows = rows.join(ranks, ["s", "k"], "left").withColumn("r1", ahead("r", 1, F.lit(-1))).withColumn("r2", ahead("r", 2, F.lit(-1)))
    rows = rows.withColumn("n0", F.expr("int(k % 3 = 0)")).withColumn("n1", F.expr("int(k % 3 = 1)")).withColumn("n2", F.expr("int(k % 3 = 2)"))
    rows, _ = common.cut(rows.drop("one"), "merge")
    # Class 0 meets class 1 on (name, rank of the next) and class 2 on (name, name, rank of the one after).
    first = smaller(rows.filter("n2 = 0"), ["x0", "r1"], ["n0", "n1"])
    second = smaller(rows.filter("n1 = 0"), ["x0", "x1", "r2"], ["n0", "n2"]).withColumnRenamed("less_n0", "less_m0")
    zero = looked_up(looked_up(rows.filter("n0 = 1"), first, ["x0", "r1"]), second, ["x0", "x1", "r2"]).withColumn("rank", F.expr("less_n0 + less_n1 + less_n2"))
    one = looked_up(rows.filter("n1 = 1"), first, ["x0", "r1"]).withColumn("rank", F.expr("r + less_n0"))
    two = looked_up(rows.filter("n2 = 1"), second, ["x0", "x1", "r2"]).withColumn("rank", F.expr("r + less_m0"))
    out = [
        F.expr("substring(s, 1, length(s) - 1 - length(substring_index(s, '@', -1)))").alias("s"),
        (F.col("k") + F.substring_index("s", "@", -1).cast("long")).alias("k"),
        *triples,
        "rank",
    ]
    return zero.select(out).union(one.select(out)).union(two.select(out))


def neighbours(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """The rows that share something with a neighbour in the order, with `before` and `after`.

    These are the lengths of the prefixes of `keys` (longs, never null) that a row shares with the row before and the row
    after it. Rows are sorted in ranges, so equal keys spread over as many ranges as they fill; the first
    and the last row of each range, two at most, are compared with those of the ranges beside it.
    """
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, opened, edge = TaskContext.get().partitionId(), None, 0, 1

        def out(batch: pa.RecordBatch, before: np.ndarray, after: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            use = np.flatnonzero((before > 0) | (after > 0) | (ends > 0))
            more = [before[use].astype(np.int32), after[use].astype(np.int32), ends[use].astype(np.int32), np.full(len(use), part, np.int32)]
            return pa.RecordBatch.from_arrays([*batch.take(pa.array(use)).columns, *(pa.array(x) for x in more)], [*batch.schema.names, "before", "after", "edge", "part"])

        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            shared, alike = np.zeros(both.num_rows - 1, np.int64), np.ones(both.num_rows - 1, bool)
            for k in keys:
                x = both.column(k).to_numpy()
                alike &= x[1:] == x[:-1]
                shared += alike
            before, ends = np.concatenate(([opened], shared)), np.zeros(both.num_rows, np.int64)
            ends[0] = edge
            held, opened = both.slice(both.num_rows - 1), before[-1]
            if both.num_rows > 1:
                edge = 0
                yield out(both.slice(0, both.num_rows - 1), before[:-1], shared, ends[:-1])
        if held is not None:
            yield out(held, np.array([opened]), np.array([0]), np.array([edge + 2]))

    columns = [F.col(c) for c in order]
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", before int, after int, edge int, part int"
    found, _ = common.cut(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, schema), "neighbours")
    # Two rows a range.
    ranges = Window.orderBy("part", "edge")

    def across(by: int) -> Column:
        alike, total = F.lit(True), F.lit(0)
        for k in keys:
            alike = alike & F.coalesce(F.lag(k, by).over(ranges) == F.col(k), F.lit(False))
            total = total + alike.cast("int")
        return total

    edges = found.filter("edge > 0").withColumns({"_before": across(1), "_after": across(-1)})
    edges = edges.withColumns({"before": F.expr("IF(edge % 2 = 1, _before, before)"), "after": F.expr("IF(edge >= 2, _after, after)")})
    names = [*rows.columns, "before", "after"]
    return found.filter("edge = 0").select(names).union(edges.select(names)).filter(f"before BETWEEN 1 AND {width} OR after BETWEEN 1 AND {width}")


def repeated_phrases(candidates: DataFrame) -> DataFrame:
    """(row, k) of the phrases that a neighbour in suffix order has as its prefix too.

    The order comes from the pieces alone; `name`, the hash of the whole phrase, only compares the prefixes of two neighbours.
    """
    strings = candidates.select(F.col("row").cast("string").alias("s"), "k", F.col("piece").alias("x"))
    ranks = suffix_ranks(strings, depth=DEPTH).select(F.col("s").cast("long").alias("row"), "k", "rank")
    ordered, _ = common.cut(ranks.join(candidates.select("row", "k", "name"), ["row", "k"]), "order")
    return neighbours(ordered, ["rank", "row", "k"], ["name"]).select("row", "k")


# -- phrases and windows -----------------------------------------------------


def word_values(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The start, end and hash of each word."""
    data = np.frombuffer(text, np.uint8)
    start, end = bytes_np.word_spans(data)
    return start, end, bytes_np.Spans(bytes_np.BYTE_VALUE[data]).hash(start, end)


def phrases_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, words: bool = False) -> tuple[np.ndarray, ...] | None:
    """(first window, end, kept value, text) of each run of windows that keep one value; where the texts begin and end, the values, and the hashes of their grams.

    All places count through the joined texts; no window leaves its text. With `words`, lengths and places count words, whatever stands between them.
    """
    sizes = np.array([len(text) for text in texts], np.int64)
    if words:
        start, _, values = word_values(b" ".join(texts))
        sizes = np.diff(np.searchsorted(start, np.cumsum(np.concatenate(([0], sizes + 1)))))
    else:
        values = bytes_np.BYTE_VALUE[np.frombuffer(b"".join(texts), np.uint8)]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    windows = np.maximum(sizes - length + 1, 0)
    if not windows.any():
        return None
    grams = bytes_np.run_hashes(bytes_np.prefix_hash(values), gram)
    kept = bytes_np.sliding_min(grams, length - gram + 1)
    change = np.concatenate(([True], kept[1:] != kept[:-1]))
    change[offset[:-1][windows > 0]] = True
    first = np.flatnonzero(change)
    owner, stop = np.searchsorted(offset[1:], first, "right"), np.append(first[1:], len(kept))
    last = offset[:-1] + windows
    inside = first < last[owner]
    first, owner = first[inside], owner[inside]
    return first, np.minimum(stop[inside], last[owner]), kept[first], owner, offset, values, grams


def kept_places(kept: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct kept values in order, the places of grams that have one of them, and which one each has; places rise.

    Kept values are minima of many grams, so few grams are as small as the greatest of them.
    """
    value = np.unique(kept)
    place = np.flatnonzero(grams <= value[-1])
    which = np.searchsorted(value, grams[place])
    hit = value[which] == grams[place]
    return value, place[hit], which[hit]


def occurrences(kept: np.ndarray, first: np.ndarray, stop: np.ndarray, grams: np.ndarray, length: int, gram: int) -> np.ndarray:
    """How often each phrase's value is kept in these texts: a phrase of a periodic text repeats windows inside itself."""
    width = length - gram + 1
    value, place, which = kept_places(kept, grams)
    # A gram is kept if the greatest value that the windows around it keep is its own.
    low, high = np.searchsorted(stop, place - width + 1, "right"), np.searchsorted(first, place, "right")
    met = low < high
    most = np.maximum.reduceat(np.append(kept, kept[-1]), np.stack((low[met], high[met]), 1).ravel())[::2]
    n = np.bincount(which[met][most == value[which[met]]], minlength=len(value))
    return n[np.searchsorted(value, kept)]


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text and a key; rows with equal keys are equal, and have equal results."""
    return common.as_table(documents, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))


def numbered(batches: Iterator[pa.RecordBatch], length: int, key_filter: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(row numbers over all tasks, keys, texts) of some texts together; those of fewer than `length` bytes, or whose key is not in the filter, are left out."""
    row = TaskContext.get().partitionId() << 40
    for keys, values in common.chunks(batches, "text", "key", size=TOGETHER):
        key = np.array(keys, np.int64)
        use = np.array([len(v) >= length for v in values], bool)
        if key_filter is not None:
            use &= in_filter(key_filter, key.view(np.uint64))
        if use.any():
            yield row + np.flatnonzero(use), key[use], [v for v, u in zip(values, use.tolist(), strict=True) if u]
        row += len(keys)


def phrases(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(row, key, k, first, stop, n_kept, kept, name, piece): the k-th phrase of a text and its windows first..stop-1; name and piece are hashes."""
    names = ["row", "key", "k", "first", "stop", "n_kept", "kept", "name", "piece"]

    def some(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for row, key, some_texts in numbered(batches, length):
            if found := phrases_of(some_texts, length, gram, words):
                first, stop, kept, owner, offset, values, grams = found
                n = occurrences(kept, first, stop, grams, length, gram)
                spans = bytes_np.Spans(values)
                ends = np.where(np.append(owner[1:] != owner[:-1], True), offset[owner + 1], stop + gram - 1)
                name, piece = (spans.hash(first, end).view(np.int64) for end in (stop + length - 1, ends))
                base, k = offset[owner], np.arange(len(first)) - np.searchsorted(owner, owner)
                out.append((row[owner], key[owner], k, first - base, stop - base, n, kept.view(np.int64), name, piece))
                held += len(first)
                if held > 1 << 15:
                    yield some(out)
                    out, held = [], 0
        if out:
            yield some(out)

    return documents.select("key", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def value_filter(values: DataFrame, column: str, most_bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter (two probes) of a long column, 16 bits a value up to `most_bits`."""
    bits = min(most_bits, max(1 << 16, 1 << int(16 * values.count()).bit_length()))
    probes = values.select(F.explode(F.array(*[F.expr(f"shiftrightunsigned({column}, {s}) % {bits}") for s in (8, 31)])).alias("p"))
    words = probes.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[words.w.to_numpy(np.int64)] = words.b.to_numpy(np.int64)
    return out.view(np.uint8)


def in_filter(filter_bytes: np.ndarray, values: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(filter_bytes) * 8)
    ok = np.ones(len(values), bool)
    for shift in (8, 31):
        p = (values >> np.uint64(shift)) % bits
        ok &= (filter_bytes[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def identity(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each phrase as a place in a text."""
    return bytes_np.mix(bytes_np.mix(key.view(np.uint64)) + first.astype(np.uint64))


def filtered(rows: DataFrame, filter_bytes: np.ndarray) -> DataFrame:
    """Phrases whose kept value may be in the filter."""
    sent = rows.sparkSession.sparkContext.broadcast(filter_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_filter(sent.value, batch.column("kept").to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def identities(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(identity(batch.column("key").to_numpy(), batch.column("first").to_numpy()).view(np.int64))], ["id"])

    return rows.select("key", "first").mapInArrow(run, "id long")


def blocks_of(batches: Iterator[pa.RecordBatch], phrase_filter: np.ndarray, length: int, gram: int, words: bool = False, key_filter: np.ndarray | None = None) -> Iterator[tuple]:
    """For some texts together, their runs of up to STEP windows in the phrases that may be in the filter.

    Blocks are cut at fixed distances from the kept gram, so equal windows are in blocks of one `core`, the
    bytes that all windows of such a block hold. Yields of each block the row number, the key, where its text begins, its first window and
    the one after its last, and where its core begins and ends; and the spans, in which all places count.
    """
    width = length - gram + 1
    for row, text_key, some_texts in numbered(batches, length, key_filter):
        if not (found := phrases_of(some_texts, length, gram, words)):
            continue
        first, stop, kept, owner, offset, values, grams = found
        ok = in_filter(phrase_filter, identity(text_key[owner], first - offset[owner]))
        if not ok.any():
            continue
        # The places of the gram that a phrase keeps: the last one in a window is the anchor of the window.
        value, place, which = kept_places(kept, grams)
        order = np.argsort(which, kind="stable")
        places, span = place[order], len(grams) + width
        keys, own = which[order] * span + places, np.searchsorted(value, kept[ok]) * span
        low, high = (np.searchsorted(keys, own + last, "right") - 1 for last in (first[ok] + width - 1, stop[ok] + width - 2))
        i, phrase = spread(low, high + 1)
        anchor, after = places[i], np.append(places, 0)[i + 1]
        begin = np.where(i == low[phrase], first[ok][phrase], anchor - width + 1)
        end = np.where(i == high[phrase], stop[ok][phrase], after - width + 1)
        # Steps back from the anchor: a block is the windows of one step.
        least, most = (anchor - end + 1) // STEP, (anchor - begin) // STEP
        down, run = spread(-most, -least + 1)
        step, anchor = -down, anchor[run]
        latest = anchor - step * STEP
        earliest = anchor - np.minimum(step * STEP + STEP - 1, width - 1)
        of = owner[ok][phrase][run]
        yield row[of], text_key[of], offset[of], np.maximum(begin[run], latest - STEP + 1), np.minimum(end[run], latest + 1), latest, earliest + length, bytes_np.Spans(values)


def window_blocks(documents: DataFrame, phrase_filter: np.ndarray, length: int, gram: int, words: bool) -> DataFrame:
    """(core, whole, row, key, first, stop): each block with the hashes of its core and of all its bytes."""
    sent = documents.sparkSession.sparkContext.broadcast(phrase_filter)
    names = ["core", "whole", "row", "key", "first", "stop"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, key, base, first, stop, low, high, spans in blocks_of(batches, sent.value, length, gram, words):
            core, whole = spans.hash(low, high), spans.hash(first, stop - 1 + length)
            columns = (core.view(np.int64), whole.view(np.int64), row, key, first - base, stop - base)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return documents.select("key", "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def block_windows(documents: DataFrame, phrase_filter: np.ndarray, wanted: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    """(key, first, windows): the hash of each window of the blocks (key, first) of `wanted`."""
    filters = phrase_filter, value_filter(wanted.select("key").distinct(), "key"), value_filter(identities(wanted), "id")
    sent = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        phrases, keys, ids = sent.value
        for _, key, base, first, stop, _, _, spans in blocks_of(batches, phrases, length, gram, words, keys):
            use = np.flatnonzero(in_filter(ids, identity(key, first - base)))
            if not len(use):
                continue
            mine, _ = spread(first[use], stop[use])
            hashes, edge = spans.hash(mine, mine + length).view(np.int64), np.cumsum(stop[use] - first[use])
            for i, e in zip(use.tolist(), edge.tolist(), strict=True):
                yield int(key[i]), int(first[i] - base[i]), hashes[e - int(stop[i] - first[i]) : e]

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in itertools.batched(run(batches), 1 << 14):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["key", "first", "windows"])

    # The filters let a few others through, the join does not; rows that stand twice give one block.
    return documents.select("key", "text").mapInArrow(batched, "key long, first long, windows array<long>").join(wanted, ["key", "first"], "left_semi").dropDuplicates(["key", "first"])


def spread(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first..stop-1 of each range, and which range each is of."""
    n = stop - first
    ends = np.cumsum(n)
    return np.arange(ends[-1]) + np.repeat(first - ends + n, n), np.repeat(np.arange(len(n)), n)


def settled(documents: DataFrame, phrase_filter: np.ndarray, length: int, gram: int, words: bool) -> DataFrame:
    """(key, first, stop): the runs of windows in blocks that stand in other blocks too.

    Blocks are sorted by core and whole. One that is equal to a neighbour repeats whole. Beside one of the same core that differs,
    it is taken apart into windows, which are sorted in turn; equal blocks that are not beside such a one need none.
    """
    blocks, path = common.cut(window_blocks(documents, phrase_filter, length, gram, words), "blocks")
    beside, _ = common.cut(neighbours(blocks, ["core", "whole", "row", "first"], ["core", "whole"]), "beside")
    common.drop(documents.sparkSession, path)
    same = beside.filter("before = 2 OR after = 2").select("key", "first", "stop")
    wanted, _ = common.cut(beside.filter("before = 1 OR after = 1").select("key", "first").distinct(), "wanted")
    rows = block_windows(documents, phrase_filter, wanted, length, gram, words)
    windows, _ = common.cut(rows.select("key", "first", F.posexplode("windows").alias("i", "h")), "windows")
    again = neighbours(windows, ["h", "key", "first", "i"], ["h"])
    return same.union(again.select("key", F.expr("first + i").alias("first"), F.expr("first + i + 1").alias("stop")))


def repeated_windows(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(key, first, stop): runs of windows that stand elsewhere too. `documents` is as from `keyed`."""
    found, path = common.cut(phrases(documents, length, gram, words), "phrases")
    shared = found.groupBy("kept").agg(F.sum("n_kept").alias("n")).filter("n > 1").select("kept")
    shared, _ = common.cut(shared, "shared")
    # What the filter lets through besides is only looked at again below.
    candidates, _ = common.cut(filtered(found, value_filter(shared, "kept")), "candidates")
    common.drop(documents.sparkSession, path)
    sure, _ = common.cut(repeated_phrases(candidates).withColumn("sure", F.lit(True)), "sure")
    marked, _ = common.cut(candidates.drop("piece").join(sure, ["row", "k"], "left"), "marked")
    # Windows are settled in blocks in phrases that are not sure; of sure ones that keep a value of these, one of each name stands for all.
    unsure = marked.filter("sure IS NULL")
    ones = marked.filter("sure").join(unsure.select("kept").distinct(), "kept", "left_semi").groupBy("name").agg(F.min(F.struct("key", "first")).alias("one"))
    wanted = identities(unsure.select("key", "first").union(ones.select("one.key", "one.first")))
    return marked.filter("sure").select("key", "first", "stop").union(settled(documents, value_filter(wanted, "id"), length, gram, words))


def gone_bytes(n: int, first: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Which of n bytes the windows first..stop-1 cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, np.minimum(stop + length - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


def with_runs(rows: DataFrame, length: int, gram: int, words: bool = False) -> DataFrame:
    """Rows of `keyed` with the runs of repeated windows as the lists `first` and `stop`, null where there are none."""
    runs = repeated_windows(rows.select("key", "text"), length, gram, words).distinct().groupBy("key").agg(F.collect_list("first").alias("first"), F.collect_list("stop").alias("stop"))
    return rows.join(runs, "key", "left")


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, spans, kept): the removed byte spans of each whole text, and its remaining bytes."""

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, first, stop in zip(common.texts(batch.column("text")), batch.column("first"), batch.column("stop"), strict=True):
                if not first.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                gone = gone_bytes(len(text), first.values.to_numpy(), stop.values.to_numpy(), length)
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                spans.append([{"start": s, "stop": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)])
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), spans, pa.array(kept, pa.binary())], ["doc_id", "text", "spans", "kept"])

    joined = with_runs(keyed(documents), length, gram).select("doc_id", "text", "first", "stop")
    return joined.mapInArrow(cut_out, "doc_id long, text string, spans array<struct<start:long,stop:long>>, kept binary")


def gone_words(text: bytes, first: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Which bytes the windows of words first..stop-1 cover, with what stands between their words."""
    start, end, _ = word_values(text)
    edge = np.diff(np.concatenate(([0], gone_bytes(len(start), first, stop, length).view(np.int8), [0])))
    step = np.zeros(len(text) + 1, np.int64)
    step[start[np.flatnonzero(edge == 1)]] += 1
    step[end[np.flatnonzero(edge == -1) - 1]] -= 1
    return np.cumsum(step[:-1]) > 0


def cut_from(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """The documents with repeated bytes (or words) taken out of their texts, and n_chars as it then is; a null text stays null."""

    @F.pandas_udf("string")
    def rest(text: pd.Series, first: pd.Series, stop: pd.Series) -> pd.Series:
        out = []
        for t, a, b in zip(text, first, stop, strict=True):
            if t is not None and a is not None:
                data = t.encode()
                gone = gone_words(data, np.asarray(a), np.asarray(b), length) if words else gone_bytes(len(data), np.asarray(a), np.asarray(b), length)
                t = np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore")
            out.append(t)
        return pd.Series(out, dtype=object)

    # The row travels as one column, so that no column of it can clash with those of this module.
    rows = documents.select(F.struct("*").alias("row"), F.col("text"), F.xxhash64("doc_id", "text").alias("key"))
    found = with_runs(rows, length, gram, words)
    found = found.withColumn("text", F.when(F.col("first").isNull(), F.col("text")).otherwise(rest("text", "first", "stop")))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in documents.columns:
        row = row.withField("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return found.select(row.alias("row")).select("row.*")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest columns, then the text that is left (what is left of a cut character stands as U+FFFD) and whether it lost any."""
    found = remove_repeats(common.read(spark, sf_dir, "documents"))
    n, left = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), F.octet_length("kept")
    return found.select(
        "doc_id",
        n.alias("n_bytes"),
        (n - left).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.when(left == n, F.col("text")).otherwise(F.make_valid_utf8(F.col("kept").cast("string"))).alias("text"),
        (left < n).alias("changed"),
    )
