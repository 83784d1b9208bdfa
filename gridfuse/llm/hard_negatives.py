"""Operator 12: hard negatives by a two-dimensional block product of anchors and rows.

Rows and anchors are dealt into shards of bounded size, and their dimensions into chunks. A cell of the grid (anchor shard, row shard, chunk) multiplies one pair
of blocks into a partial tile of int64 scores; the partial tiles of one pair of shards are shuffled, in strips of a few anchors, and added; a strip of whole
scores then keeps the first few rows that its anchors ask for, and these are reduced over all shards. This is done twice: with shards of one
label each, for the positives, and with mixed shards, for the windows of scores that the positives open. No task holds more than
two blocks and a tile, and no score leaves its strip but the first few.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component, take no part; repeated rows are rows of their own and may be
each other's positives; shorter vectors count as if zeros followed; scores are exact as long as they fit in 64 bits;
components beyond 2**31 after scaling are held there; anchors without a positive, or positives without a row in their window, give no row; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridfuse.llm import common

#: Rows in a shard, anchors in a shard, dimensions in a chunk, anchors in a strip.
ROWS, ANCHORS, CHUNK, STRIP = 4096, 512, 32, 16
MOST = float(2**31)

BLOCK = "label long, shard long, chunk int, n int, kind string, data binary, ids binary, labels binary, asked binary"
PART = "label long, a long, b long, strip int, chunk int, n int, kind string, data binary, anchors binary, ids binary, labels binary, asked binary"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def packed(x: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the narrowest type that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("i1", "i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, x.astype(f"<{kind}").tobytes()


def unpacked(kind: str, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<{kind}").astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers, exactly: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def scaled(embeddings: DataFrame, label: Column, scale: int = 256) -> DataFrame:
    """(row, vec_id, label, x) of the rows that take part, as a table in the shared folder; `row` tells repeated rows apart."""
    value = F.col("embedding")
    fine = ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.least(F.greatest(F.floor(v.cast("double") * scale).cast("double"), F.lit(-MOST)), F.lit(MOST)).cast("long")
    rows = common.as_table(embeddings, "vec_id", "embedding", "label").filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & value.isNotNull()).filter(fine)
    return common.cut(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", label.cast("long").alias("label"), F.transform(value, held).alias("x")), "rows")[0]


def shards_of(rows: DataFrame, size: int) -> DataFrame:
    """(label, shards): how many shards of `size` a label has."""
    return rows.groupBy("label").agg(F.ceil(F.count("*") / size).alias("shards"))


def blocks(rows: DataFrame, shards: int | DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each shard: so many mixed shards (their label is null), or those of one label each as `shards_of` counts them."""
    with_windows = "asked" in rows.columns

    def build(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), max(map(len, group["x"]))), np.int64)
        for i, v in enumerate(group["x"]):
            x[i, : len(v)] = v
        ids, labels = (group[c].to_numpy(np.int64).tobytes() for c in (["row", "vec_id"], "label"))
        asked = np.concatenate([np.asarray(v, np.int64) for v in group["asked"]]).tobytes() if with_windows else None
        out = []
        for k in range(max(1, -(-x.shape[1] // chunk))):
            # Ids and what else goes along stand in the first chunk only.
            out.append((key[0], key[1], k, len(x), *packed(x[:, k * chunk : (k + 1) * chunk]), *((ids, labels, asked) if k == 0 else (None, None, None))))
        return pd.DataFrame(out, columns=names(BLOCK))

    if isinstance(shards, int):
        dealt = rows.withColumns({"of": F.lit(None).cast("long"), "shard": F.pmod(F.xxhash64("row"), F.lit(shards))})
    else:
        dealt = rows.join(shards, "label").withColumns({"of": F.col("label"), "shard": F.pmod(F.xxhash64("row"), F.col("shards"))})
    return dealt.select("of", "shard", *rows.columns).groupBy("of", "shard").applyInPandas(build, BLOCK)


def repeated(block: DataFrame, side: int, others: Column) -> DataFrame:
    """Each block once for every shard number in `others` of the other side."""
    here, there = ("a", "b") if side == 0 else ("b", "a")
    return block.select("label", F.col("shard").alias(here), F.explode(others).alias(there), F.lit(side).alias("side"), *names(BLOCK)[2:])


def cells(left: DataFrame, right: DataFrame) -> DataFrame:
    """Partial tiles of all cells (label, a, b, chunk); a cell gets one block of either side. Tiles are cut into strips of anchors."""

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(group) == 2:  # else one of the two has no dimension of this chunk
            (one, two) = (r for _, r in group.sort_values("side").iterrows())
            a, b = (unpacked(r["kind"], r["data"]).reshape(r["n"], -1) for r in (one, two))
            width = min(a.shape[1], b.shape[1])
            whole, first = product(a[:, :width], b[:, :width]), key[3] == 0
            wide = len(one["asked"]) // len(a) if first and one["asked"] is not None else 0
            for strip, s in enumerate(range(0, len(a), STRIP)):
                e = min(len(a), s + STRIP)
                along = (one["ids"][s * 16 : e * 16] + one["labels"][s * 8 : e * 8], two["ids"], two["labels"], one["asked"][s * wide : e * wide] if wide else None) if first else (None,) * 4
                out.append((*key[:3], strip, key[3], e - s, *packed(whole[s:e]), *along))
        return pd.DataFrame(out, columns=names(PART))

    return left.unionByName(right).groupBy("label", "a", "b", "chunk").applyInPandas(multiply, PART)


class Strip:
    """The whole scores of a few anchors with all rows of a shard: the sum of the partial tiles."""

    def __init__(self, parts: pd.DataFrame):
        first = parts[parts["chunk"] == 0].iloc[0]
        n = int(first["n"])
        self.scores = sum(unpacked(k, d).reshape(n, -1) for k, d in zip(parts["kind"], parts["data"], strict=True))
        ids = np.frombuffer(first["anchors"], "<i8")
        self.anchors, self.anchor_labels = ids[: 2 * n].reshape(n, 2), ids[2 * n :]
        self.rows = np.frombuffer(first["ids"], "<i8").reshape(-1, 2)
        self.labels = np.frombuffer(first["labels"], "<i8")
        self.asked = None if first["asked"] is None else np.frombuffer(first["asked"], "<i8").reshape(n, -1)

    def order(self, i: int, which: np.ndarray) -> np.ndarray:
        """Rows by falling score, then by vec_id."""
        return which[np.lexsort((self.rows[which, 0], self.rows[which, 1], -self.scores[i, which]))]


def added(parts: DataFrame, pick, schema: str) -> DataFrame:
    """What `pick` finds in each strip of added tiles. A group is the chunks of one strip."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(pick(Strip(group)), columns=names(schema))

    return parts.groupBy("label", "a", "b", "strip").applyInPandas(add, schema)


def first_rows(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first `most` of the rows kept in tiles."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def positives(rows: DataFrame, anchors: DataFrame, most: int = 5, row_size: int = ROWS, anchor_size: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """(anchor_row, anchor_id, row, vec_id, score, rank): the first `most` other rows of each anchor's label."""

    def pick(strip: Strip) -> list[tuple]:
        out = []
        for i, (row, vec_id) in enumerate(strip.anchors.tolist()):
            which = np.flatnonzero((strip.labels == strip.anchor_labels[i]) & (strip.rows[:, 0] != row))
            if len(which) > most:  # the score of the last that can be among the first, then ties with it
                least = np.partition(strip.scores[i, which], len(which) - most)[len(which) - most]
                which = which[strip.scores[i, which] >= least]
            out += [(row, vec_id, *strip.rows[j].tolist(), int(strip.scores[i, j])) for j in strip.order(i, which)[:most]]
        return out

    per_label, per_anchor = shards_of(rows, row_size), shards_of(anchors, anchor_size)
    # Each block is sent to every shard that its label has on the other side.
    met = [blocks(x, own, chunk).join(other, "label") for x, own, other in ((anchors, per_anchor, per_label), (rows, per_label, per_anchor))]
    numbers = F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)
    parts = cells(repeated(met[0], 0, numbers), repeated(met[1], 1, numbers))
    found = added(parts, pick, "anchor_row long, anchor_id long, row long, vec_id long, score long")
    return first_rows(found, ["anchor_row"], most)


def negatives(rows: DataFrame, anchors: DataFrame, chosen: DataFrame, most: int = 3, low: int = 50, high: int = 95, row_size: int = ROWS, anchor_size: int = ANCHORS, chunk: int = CHUNK) -> DataFrame:
    """For each anchor and positive the first `most` rows of another label whose score lies from `low` to `high` per cent of the positive's."""
    count = chosen.agg(F.max("rank").alias("n")).first().n or 0

    def window(score: int) -> tuple[int, int]:
        return -((-low * score) // 100), high * score // 100

    def pick(strip: Strip) -> list[tuple]:
        out = []
        for i, (row, vec_id) in enumerate(strip.anchors.tolist()):
            asked = [(int(p), int(v), int(s), *window(int(s))) for p, v, s in strip.asked[i].reshape(-1, 3) if p >= 0]
            least, greatest = min(a[3] for a in asked), max(a[4] for a in asked)
            scores = strip.scores[i]
            which = strip.order(i, np.flatnonzero((scores >= least) & (scores <= greatest) & (strip.labels != strip.anchor_labels[i])))
            falling = -scores[which]
            for p, v, s, lo, hi in asked:
                begin, end = np.searchsorted(falling, -hi, "left"), np.searchsorted(falling, -lo, "right")
                out += [(row, vec_id, p, v, s, *strip.rows[j].tolist(), int(scores[j])) for j in which[begin : min(end, begin + most)]]
        return out

    schema = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, vec_id long, score long"
    # Up to `count` positives go with their anchor; missing ones are marked by a row of -1.
    one = F.struct("rank", F.array("row", "vec_id", "score").alias("of"))
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(one)), lambda s: s.of))
    asked = F.slice(F.concat(listed, F.array_repeat(F.lit(-1).cast("long"), 3 * count)), 1, 3 * count) if count else listed
    windows = anchors.join(chosen.groupBy("anchor_row").agg(asked.alias("asked")).withColumnRenamed("anchor_row", "row"), "row")
    n_left, n_right = (max(1, -(-x.count() // size)) for x, size in ((anchors, anchor_size), (rows, row_size)))
    left, right = blocks(windows, n_left, chunk), blocks(rows, n_right, chunk)
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    parts = cells(repeated(left, 0, every(n_right)), repeated(right, 1, every(n_left)))
    return first_rows(added(parts, pick, schema), ["anchor_row", "positive_row"], most)


def mine(rows: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, **sizes: int) -> DataFrame:
    """Hard negatives of the anchors, which are the rows whose vec_id is divisible by `every`; rows as `scaled` makes them."""
    anchors = rows.filter(F.col("vec_id") % every == 0)
    chosen, _ = common.cut(positives(rows, anchors, n_positives, **sizes), "positives")
    found = negatives(rows, anchors, chosen, n_negatives, **sizes)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(scaled(common.read(spark, sf_dir, "embeddings"), label))


#: The same by comparing every anchor with every row.
OP12_SQL = """
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * b.x[i]))::BIGINT AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
) SELECT * FROM n WHERE rank <= 3
"""
