"""Operator 3: near duplicates by SimHash fingerprints, searched in BK-trees.

A fingerprint is compared with others of its bucket only; buckets are bands of
bits, as in `tables`: the bits fall into m blocks, and each choice of m - 3 of them is a band. Three
differing bits leave m - 3 blocks untouched, so no link is lost; m grows with the number of fingerprints, so that
buckets don't. In a bucket, the fingerprints form a
BK-tree (children keyed by their integer Hamming distance to the parent), and a
search follows only edges within the radius of the distance to the node. A
bucket larger than `shard_nodes` is dealt into blocks; each pair of blocks is a
tree of the one searched with the other, so memory is bounded and no
pair is missed. Trees travel to the tasks as shards of their own bucket rather than as one
broadcast: the trees of all documents have no size bound. A task hands on only a
spanning set of the links that it finds, and components come from those.

Defined results: null or word-less text has fingerprint zero, linked like any
other; equal fingerprints link; rows with a null doc_id take part, link others, and come back
with the component of their fingerprint (null if no doc_id is in it); repeated doc_ids come back as often as
they stand and tie nothing: each row has the component of its fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfuse.llm import bytes_np, common
from gridfuse.llm.components import connected

SEED = 42
#: Frontier entries handled at once in a search.
FRONTIER = 1 << 17
#: Rows of whole buckets handled at once.
ROWS = 1 << 16
#: Shingles of the sets that are compared at once.
UNIT = 1 << 20


# -- fingerprints -----------------------------------------------------------


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, ASCII lower-cased and joined by one space; of fewer words, that of all."""
    import xxhash

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = np.concatenate(([0], ends[: len(found) - words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` 64-bit words; a bit is 1 if set in over half the hashes. Lane 0 takes the hashes as they are."""
    out = np.zeros(lanes, np.uint64)
    if len(hashes):
        for lane in range(lanes):
            h = hashes if lane == 0 else bytes_np.mix(hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            counts = np.zeros(64, np.int64)
            for i in range(0, len(h), 1 << 14):
                counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[lane] = np.packbits((2 * counts > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(documents: DataFrame, words: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, f0, f1, ...) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, values in common.chunks(batches, "text", "doc_id"):
            prints = np.array([simhash(shingle_hashes(v, words), lanes) for v in values], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(prints[:, i]) for i in range(lanes))], ["doc_id", *(f"f{i}" for i in range(lanes))])

    schema = "doc_id long, " + ", ".join(f"f{i} long" for i in range(lanes))
    return common.as_table(documents, "doc_id", "text").mapInArrow(run, schema)


# -- BK-trees ---------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distance of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


class Forest:
    """A BK-tree for each group of rows, built and searched level by level with numpy."""

    def __init__(self, prints: np.ndarray, group: np.ndarray, in_tree: np.ndarray):
        self.prints = prints
        rows = np.flatnonzero(in_tree)
        rows = rows[np.argsort(group[rows], kind="stable")]
        self.groups, first = np.unique(group[rows], return_index=True)
        self.roots = rows[first]
        left = np.setdiff1d(rows, self.roots, assume_unique=True)
        parent = self.roots[np.searchsorted(self.groups, group[left])]
        edges = []
        while len(left):
            d = distance(prints[left], prints[parent])
            key = parent * 4096 + d
            order = np.argsort(key, kind="stable")
            key, left = key[order], left[order]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            edges.append((key[new], left[new]))
            parent = left[new][np.cumsum(new) - 1]
            left, parent = left[~new], parent[~new]
        self.keys = np.concatenate([e[0] for e in edges]) if edges else np.zeros(0, np.int64)
        self.child = np.concatenate([e[1] for e in edges]) if edges else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.child = self.keys[order], self.child[order]

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, tree row) within the radius, in pieces; memory is bounded by FRONTIER."""
        at = np.minimum(np.searchsorted(self.groups, group[queries]), max(0, len(self.groups) - 1))
        known = self.groups[at] == group[queries] if len(self.groups) else np.zeros(len(queries), bool)
        stack = [(queries[known], self.roots[at[known]])] if len(self.groups) else []
        while stack:
            q, node = stack.pop()
            if len(q) > FRONTIER:
                stack += [(q[i : i + FRONTIER], node[i : i + FRONTIER]) for i in range(0, len(q), FRONTIER)]
                continue
            d = distance(self.prints[q], self.prints[node])
            near = (d <= radius) & (q != node)
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 4096 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 4096 + d + radius, side="right") - low
            if n.sum():
                ends = np.cumsum(n)
                stack.append((np.repeat(q, n), self.child[np.arange(ends[-1]) + np.repeat(low - ends + n, n)]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of each pair; a class is named by its smallest row."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label[label] != label).any():
            label[:] = label[label]


# -- search over all fingerprints -------------------------------------------


def blocks(lanes: int, n: int) -> list[np.ndarray]:
    """The bits in n equal contiguous blocks: a pair with fewer than n differing bits shares one."""
    return np.array_split(np.arange(64 * lanes), n)


def tables(lanes: int, radius: int, n: int, bucket: int = 1024) -> list[np.ndarray]:
    """Bands in which every pair within the radius meets, with buckets of about `bucket` of n fingerprints that are spread evenly.

    With m blocks each choice of m - radius of them is a band; m is the least that gives few enough, or radius + 4.
    """
    for m in range(radius + 1, radius + 5):
        if n <= bucket << (64 * lanes * (m - radius) // m):
            break
    return [np.concatenate(c) for c in itertools.combinations(blocks(lanes, m), m - radius)]


def link(prints: DataFrame, bands: list[np.ndarray], radius: int, shard_nodes: int = 1024) -> DataFrame:
    """Distinct fingerprints (node, f0, f1, ...) -> links (a, b) that connect whatever is within the radius in a shared bucket."""
    lanes = len(prints.columns) - 1
    names = [f"f{i}" for i in range(lanes)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            f = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1).view(np.uint64)
            bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1, bitorder="little")
            keys = []
            for i, band in enumerate(bands):
                weights = np.uint64(1) << np.arange(len(band), dtype=np.uint64)
                keys.append((bits[:, band].astype(np.uint64) @ weights).astype(np.int64) * 64 + i if len(band) <= 50 else bytes_np.mix(bits[:, band].astype(np.uint64) @ weights + np.uint64(i)).view(np.int64))
            n = batch.num_rows
            pick = np.tile(np.arange(n), len(bands))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(batch.column(c).take(pa.array(pick)) for c in ("node", *names))], ["bucket", "node", *names])

    dealt = prints.mapInArrow(deal, "bucket long, node long, " + ", ".join(f"{c} long" for c in names))

    def spanning(c: dict, pairs: Iterator[tuple[np.ndarray, np.ndarray]], prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        label = np.arange(len(prints))
        for q, t in pairs:
            unite(label, q, t)
        moved = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(c["node"][moved]), pa.array(c["node"][label[moved]])], ["a", "b"])

    return searched(dealt, names, radius, shard_nodes, spanning, "a long, b long").distinct()


def searched(dealt: DataFrame, names: list[str], radius: int, shard_nodes: int, found, schema: str, extra: tuple[str, ...] = (), rows_at_once: int = ROWS, facts: DataFrame | None = None) -> DataFrame:
    """Rows (bucket, node, *names, *extra) -> what `found` makes of the pairs of each bucket within the radius.

    If a component `home` is among `extra`, buckets of a single one are left out. Columns that `dealt` lacks come from `facts`, by node, once it is
    known which buckets count, so that wide rows are dealt out for those only.
    """
    home = "home" in extra
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n"), *([F.min("home").alias("lo"), F.max("home").alias("hi")] if home else [])).filter("n > 1 AND lo < hi" if home else "n > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("n") / shard_nodes).cast("int").alias("m"))
    rows = dealt.join(sizes, "bucket")
    rows = rows if facts is None else rows.join(facts, "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("m")).cast("int"))
    # Blocks i <= j of a bucket meet in the shard (i, j): the tree of i, searched with j.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", *extra, *names)
    rows = rows.withColumn("shard", F.xxhash64("bucket", "i", "j"))
    ordered = rows.repartition("shard").sortWithinPartitions("bucket", "i", "j", "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, ["bucket", "i", "j"], rows_at_once):
            c = {n: part.column(n).to_numpy() if not pa.types.is_list(part.column(n).type) else part.column(n).combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1) for n in part.column_names}
            f = np.stack([c[n] for n in names], 1).view(np.uint64)
            new = (np.diff(c["bucket"]) != 0) | (np.diff(c["i"]) != 0) | (np.diff(c["j"]) != 0)
            c["group"] = group = np.concatenate(([0], np.cumsum(new)))
            pairs = Forest(f, group, c["block"] == c["i"]).search(np.flatnonzero(c["block"] == c["j"]), group, radius)
            yield from found(c, pairs, f)

    return ordered.mapInArrow(search, schema)


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches in tables of about `rows` rows that end where a group ends."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            last = np.zeros(n - 1, bool)
            for c in by:
                x = table.column(c).to_numpy()
                last |= x[1:] != x[:-1]
            cuts = np.flatnonzero(last)
            if len(cuts):
                end = int(cuts[-1]) + 1
                yield table.slice(0, end)
                held, n = table.slice(end).to_batches(), n - end
    if n:
        yield pa.Table.from_batches(held)


def classes(prints: DataFrame, radius: int, bands: list[np.ndarray] | None = None, shard_nodes: int = 1024) -> DataFrame:
    """Fingerprints (doc_id, f0, ...) -> the same rows with component_id, the smallest doc_id that links reach; `tables` are the bands if none are given."""
    names = [c for c in prints.columns if c != "doc_id"]
    # A node is a fingerprint, whoever has it.
    node = F.col("f0") if len(names) == 1 else F.xxhash64(*names)
    distinct, _ = common.cut(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).select(node.alias("node"), *names, "least"), "prints")
    found = connected(link(distinct.select("node", *names), bands or tables(len(names), radius, distinct.count()), radius, shard_nodes))
    named = distinct.join(found, "node", "left").select(*names, "least", F.coalesce("component", "node").alias("home"))
    least = named.groupBy("home").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(least, "home").select(*names, "component_id"), names)


# -- near copies by exact similarity ----------------------------------------


def shingle_set(text: bytes, words: int) -> tuple[np.ndarray, int]:
    """The distinct shingles of a text, and a 64-bit hash of that set."""
    import xxhash

    found = np.unique(shingle_hashes(text, words))
    return found, int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key a band: equal in two sets of similarity s with probability s**rows, being hashes of `rows` minima."""
    if not len(found):
        return np.arange(bands)
    xor, times = (np.random.default_rng(s).integers(0, 2**63, (bands, rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for s in (11, 12))
    least = np.stack([((found ^ x) * m).min(1) for x, m in zip(xor, times, strict=True)])
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = bytes_np.mix(key ^ least[:, i]) + np.uint64(i)
    return key.view(np.int64)


def set_prints(documents: DataFrame, words: int, lanes: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, key, node, n, f0, ..., keys): a hash of the text, that of the set of shingles, its size, its fingerprint and its band keys."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, key, values in common.chunks(batches, "text", "doc_id", "key"):
            sets = [shingle_set(v, words) for v in values]
            prints = np.array([simhash(s, lanes) for s, _ in sets], np.uint64).reshape(-1, lanes).view(np.int64)
            keys = pa.array([band_keys(s, bands, rows) for s, _ in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(key, pa.int64()), pa.array([n for _, n in sets], pa.int64()), pa.array([len(s) for s, _ in sets], pa.int64()), *(pa.array(prints[:, i]) for i in range(lanes)), keys], ["doc_id", "key", "node", "n", *names, "keys"])

    schema = "doc_id long, key long, node long, n long, " + ", ".join(f"{c} long" for c in names) + ", keys array<long>"
    return common.as_table(documents, "doc_id", "text").withColumn("key", F.xxhash64("text")).mapInArrow(run, schema)


def shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (values,) in common.chunks(batches, "text"):
            sets = [shingle_set(v, words) for v in values]
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in sets], pa.int64()), pa.array([s.view(np.int64) for s, _ in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return common.as_table(documents, "text").mapInArrow(run, "node long, shingles array<long>")


def sets_of(nodes: DataFrame, documents: DataFrame, distinct: DataFrame, words: int) -> DataFrame:
    """(node, shingles), once, of the nodes."""
    wanted, _ = common.cut(distinct.join(nodes, "node", "left_semi").select("node", "doc_id"), "wanted")
    texts = common.as_table(documents, "doc_id", "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    # A doc_id that stands twice may have texts of other nodes.
    return common.cut(shingle_sets(texts, words).join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "shingles")[0]


def similar(pairs: DataFrame, documents: DataFrame, distinct: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles are alike by `percent` at least, of all that either holds."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), documents, distinct, words)
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return shared.filter(F.col("n") * 100 >= (F.col("m") - F.col("n")) * percent).select("a", "b")


def alike(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (a, b) of sorted sets are alike by `percent` at least."""
    size = np.array([len(s) for s in sets], np.int64)
    shared = np.empty(len(a), np.int64)
    value, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    found, which, times = np.unique(value, return_inverse=True, return_counts=True)
    # Values of one set only are in no intersection; the others are bits.
    place = np.cumsum(times > 1) - 1
    words = int((times > 1).sum()) // 64 + 1
    if len(a) > 4 * len(sets) and words * len(sets) < 1 << 25:
        keep = times[which] > 1
        owner, at = owner[keep], place[which[keep]]
        shared[:] = 0
        # A run of words at a time: what the pairs share adds up over the runs.
        wide = max(1, (1 << 21) // len(sets))
        for low in range(0, words, wide):
            part = slice(None) if wide >= words else (at >= low << 6) & (at < (low + wide) << 6)
            bits = np.zeros((len(sets), min(wide, words - low)), np.uint64)
            np.bitwise_or.at(bits, (owner[part], (at[part] >> 6) - low), np.uint64(1) << (at[part] & 63).astype(np.uint64))
            step = max(1, (1 << 20) // bits.shape[1])
            for i in range(0, len(a), step):
                shared[i : i + step] += np.bitwise_count(bits[a[i : i + step]] & bits[b[i : i + step]]).sum(1, dtype=np.int64)
    else:
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            shared[i] = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    return shared * 100 >= (size[a] + size[b] - shared) * percent


def links_between(asked: DataFrame, documents: DataFrame, distinct: DataFrame, words: int, percent: int) -> DataFrame:
    """Units (unit, nodes, pairs) of candidate pairs -> links (a, b) that connect all pairs that are alike.

    A unit's sets meet in one task, which compares its pairs there, so no row is made for a pair.
    """
    nodes = asked.select("unit", F.explode("nodes").alias("node"))
    sets = sets_of(nodes.select("node").distinct(), documents, distinct, words)
    none = lambda t: F.lit(None).cast(t)
    rows = asked.select("unit", F.lit(0).alias("kind"), none("long").alias("node"), none("array<long>").alias("shingles"), "nodes", "pairs").union(
        nodes.join(sets, "node").select("unit", F.lit(1), "node", "shingles", none("array<long>"), none("binary"))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, order, pairs, held = None, [], b"", {}

        def finish() -> pa.RecordBatch:
            a, b = np.frombuffer(pairs, "<u4").reshape(2, -1).astype(np.int64)
            sets = [np.sort(held[x]) for x in order]
            ok, label = alike(sets, a, b, percent), np.arange(len(order))
            unite(label, a[ok], b[ok])
            moved, ids = np.flatnonzero(label != np.arange(len(label))), np.array(order, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], ["a", "b"])

        for batch in batches:
            shingles = batch.column("shingles")
            for i, (unit, kind, node, names, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("unit", "kind", "node", "nodes", "pairs")), strict=True)):
                if kind == 0:
                    if current is not None:
                        yield finish()
                    current, order, pairs, held = unit, names, packed, {}
                else:
                    held[node] = shingles[i].values.to_numpy()
        if current is not None:
            yield finish()

    return rows.repartition("unit").sortWithinPartitions("unit", "kind").mapInArrow(compare, "a long, b long")


def near_copies(documents: DataFrame, words: int, lanes: int, radius: int, bands: int, rows: int, percent: int = 80, shard_nodes: int = 1024) -> DataFrame:
    """(doc_id, key, home, component_id) of documents with a doc_id: classes (`home`) of texts (`key`, their xxhash64) linked by a similarity of `percent`, named by their smallest doc_id.

    Buckets are bands of minima, the BK-trees' radius narrows them, and the shingles themselves decide. First each node
    is tried with the nearest before it, which joins most copies; then all pairs that are still of two classes are
    compared, in units whose sets meet in one task; a pair is compared in the first band that it shares only.
    """
    names = [f"f{i}" for i in range(lanes)]
    prints, _ = common.cut(set_prints(documents.filter("doc_id IS NOT NULL"), words, lanes, bands, rows), "prints")
    distinct, _ = common.cut(prints.groupBy("node", *names).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")

    def nearest(c: dict, pairs: Iterator[tuple[np.ndarray, np.ndarray]], f: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, none = c["node"], np.iinfo(np.int64).max
        best = np.full(len(node), none)
        for q, t in pairs:
            q, t = np.where(node[q] > node[t], q, t), np.where(node[q] > node[t], t, q)
            np.minimum.at(best, q, (distance(f[q], f[t]) << 40) + t)
        q = np.flatnonzero(best < none)
        yield pa.RecordBatch.from_arrays([pa.array(node[q]), pa.array(best[q] >> 40), pa.array(node[best[q] & ((1 << 40) - 1)])], ["a", "d", "b"])

    def apart(c: dict, pairs: Iterator[tuple[np.ndarray, np.ndarray]], f: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, home, size, keys, group = c["node"], c["home"], c["n"], c["keys"], c["group"]
        held = [np.zeros((2, 0), np.int64)]
        for q, t in pairs:
            # Sets alike by `percent` differ in size by no more than that.
            ok = (home[q] != home[t]) & (np.minimum(size[q], size[t]) * 100 >= np.maximum(size[q], size[t]) * percent)
            q, t = q[ok], t[ok]
            first = (keys[q] == keys[t]).argmax(1) == c["band"][q]
            held.append(np.stack((q[first], t[first])))
        q, t = np.concatenate(held, 1)
        if not len(q):
            return
        # A group of more than UNIT shingles is cut into blocks of half of that (a longer text is one alone); its pairs meet block by block.
        before, first = np.cumsum(size) - size, np.searchsorted(group, group)
        heavy = np.bincount(group, size)[group] > UNIT
        block = np.where(heavy, (before - before[first]) // (UNIT // 2), 0)
        order = np.lexsort((block[t], block[q], group[q]))
        q, t = q[order], t[order]
        edges = (np.diff(group[q]) != 0) | (np.diff(block[q]) != 0) | (np.diff(block[t]) != 0)
        # Units are whole blocks' pairs, together of about UNIT shingles.
        ends = np.append(np.flatnonzero(edges) + 1, len(q))
        begin, total, at = 0, 0, 0
        out = []
        for end in ends.tolist():
            total += int(size[np.unique(np.concatenate((q[at:end], t[at:end])))].sum())
            at = end
            if total >= UNIT or end == len(q):
                ids, which = np.unique(node[np.concatenate((q[begin:end], t[begin:end]))], return_inverse=True)
                out.append((common.task_number(), ids.tolist(), which.astype("<u4").tobytes()))
                begin, total = end, 0
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.binary())], ["unit", "nodes", "pairs"])

    dealt = distinct.select(F.explode("keys").alias("bucket"), "node")
    first = searched(dealt, names, radius, shard_nodes, nearest, "a long, d long, b long", facts=distinct.select("node", *names))
    first, _ = common.cut(first.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "pairs")
    links, _ = common.cut(similar(first, documents, distinct, words, percent), "links")
    homes, _ = common.cut(connected(links), "homes")
    placed = distinct.join(homes, "node", "left").select(F.posexplode("keys").alias("band", "bucket"), "node", F.coalesce("component", "node").alias("home"))
    asked = searched(placed, names, radius, shard_nodes, apart, "unit string, nodes array<long>, pairs binary", ("home", "n", "keys", "band"), ROWS >> 3, facts=distinct.select("node", "n", "keys", *names))
    asked, _ = common.cut(asked, "units")
    more, _ = common.cut(links_between(asked, documents, distinct, words, percent), "links")
    classes = connected(links.union(more))
    named = distinct.join(classes, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("home"))
    least = named.groupBy("home").agg(F.min("doc_id").alias("component_id"))
    return prints.select("doc_id", "key", "node").join(named.select("node", "home"), "node").join(least, "home").select("doc_id", "key", "home", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints, _ = common.cut(fingerprints(common.read(spark, sf_dir, "documents"), words=3), "fingerprints")
    found = classes(prints, radius=3)
    return found.select("doc_id", common.unsigned_hex(F.col("f0")).alias("fingerprint"), "component_id")
