"""Regions that grow from seeds in order of price: a queue of offers as a table, settled in bands.

A band takes the cheapest open offers, and only these become labels; means follow between bands, and a cheaper offer replaces a dearer one. With a share of zero a
band is the single cheapest offer, which is what one queue over the whole volume does.

`grow_in_slabs` settles a band inside tasks: each slab of voxels of near ids has a queue of its own, which goes on with the offers that it makes up to the band's price.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfuse.functions import vectors as V
from gridfuse.operators import graph, spatial

#: Share of the open offers that a band settles; tables of labels that are read as one before they are written together.
SHARE, TABLES = 0.35, 8
#: Voxels of near ids that have one queue.
SLAB = 8192


def running_sums(sums: DataFrame | None, new: DataFrame) -> DataFrame:
    """(cid, n, x, y, z, ts) sums of labelled rows (cid, x, y, z, ts), added to those so far."""
    feats = new.select("cid", F.posexplode("ts").alias("t", "v"))
    places = new.select("cid", F.lit(1).cast("long").alias("n"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    if sums is not None:
        feats = feats.union(sums.select("cid", F.posexplode("ts").alias("t", "v")))
        places = places.union(sums.select("cid", "n", "x", "y", "z"))
    feats = feats.groupBy("cid", "t").agg(F.sum("v").alias("v")).groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s.v).alias("ts"))
    return places.groupBy("cid").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "z")]).join(feats, "cid")


def centers_of(sums: DataFrame, unit: bool) -> DataFrame:
    """(cid, feat, cx, cy, cz): means of running sums, of length one with `unit`."""
    feat = F.transform("ts", lambda v: v / F.col("n"))
    return sums.select("cid", (V.unit(feat) if unit else feat).alias("feat"), *[(F.col(c) / F.col("n")).alias(f"c{c}") for c in "xyz"])


def band(open_offers: DataFrame, share: float) -> Column | None:
    """Which offers are settled next: those up to the `share` quantile of all prices, the cheapest at least; None where there is none."""
    row = open_offers.agg(F.min(F.struct("d", "vid", "cid")).alias("first"), F.percentile_approx("d", F.lit(share), F.lit(1000)).alias("t")).first()
    if row.first is None:
        return None
    if share <= 0:
        return F.col("vid") == row.first.vid
    return F.col("d") <= max(row.t, row.first.d)


def grow(voxels: DataFrame, seeds: DataFrame, edges: DataFrame, cost: Column, unit: bool = False, share: float = SHARE) -> DataFrame:
    """(vid, cid): regions of the seeds (vid, cid). An offer is made to the unlabelled neighbours of a voxel when it is labelled, at the `cost` against the region's mean
    at that time (ts and feat, places x and cx); each voxel keeps its cheapest, then the smaller cid. Seeds are offered at prices below one, in the order of their labels, and
    stand twice in their mean, from the start and once they are labelled. Voxels that no offer reaches get no row.
    """
    rows = graph.saved(voxels.select("vid", "x", "y", "z", "ts"))
    both = graph.saved(spatial.both_ways(edges.select("src", "dst")))
    k = seeds.count()
    offers = graph.saved(seeds.select("vid", (F.col("cid").cast("double") - 1).alias("d"), "cid").withColumn("d", F.col("d") / (k + 1)))
    sums = graph.saved(running_sums(None, seeds.select("vid", "cid").join(rows, "vid")))
    done: list[DataFrame] = []
    while (taken := band(offers, share)) is not None:
        if len(done) >= TABLES:
            whole = graph.saved(together(done))
            graph.discard(*done)
            done = [whole]
        front = graph.saved(offers.filter(taken).select("vid", "cid"))
        done.append(front)
        new_sums = graph.saved(running_sums(sums, front.join(rows, "vid")))
        labels = together(done)
        asked = both.join(front.withColumnRenamed("vid", "dst"), "dst").select(F.col("src").alias("vid"), "cid").distinct().join(labels.select("vid"), "vid", "left_anti")
        made = asked.join(centers_of(new_sums, unit), "cid").join(rows, "vid").select("vid", cost.alias("d"), "cid")
        left = offers.join(front.select("vid"), "vid", "left_anti").union(made)
        new_offers = graph.saved(left.groupBy("vid").agg(F.min(F.struct("d", "cid")).alias("m")).select("vid", "m.d", "m.cid"))
        graph.discard(sums, offers)
        sums, offers = new_sums, new_offers
    graph.discard(both, sums)
    return graph.saved(together(done)) if done else seeds.select("vid", "cid").limit(0)


def together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for one in tables[1:]:
        out = out.union(one)
    return out


Price = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def offset_price(s: float, compactness: float) -> Price:
    """`vectors.region_distance` of many voxels (ts, places) and one region (feat, place)."""
    return lambda ts, at, feat, place: ((at - place) ** 2).sum(1) / s + ((ts - feat) ** 2).sum(1) / compactness


def cosine_price(alpha: float, compactness: float) -> Price:
    """`vectors.seed_cost` of many voxels (ts, places) and one region (feat, place)."""

    def price(ts, at, feat, place):
        near = ts @ feat / np.maximum(np.sqrt((ts * ts).sum(1)) * np.sqrt(feat @ feat), 1e-12)
        return alpha * (1 - near) + (1 - alpha) * np.sqrt(((at - place) ** 2).sum(1)) / compactness

    return price


STATE = "kind int, slab int, vid long, d double, cid long, n double, place array<double>, ts array<double>"
LABEL, OFFER, SUMS = 0, 1, 2


def queue(slab: int, voxels: pd.DataFrame, state: pd.DataFrame, limit: float, price: Price, unit: bool) -> pd.DataFrame:
    """What a slab's queue adds up to the price `limit`: new labels, open offers (also to voxels of other slabs), and what regions gain.

    voxels: the slab's own and those that touch it, state: labels and offers of its own and the sums of the regions that have offers.
    """
    voxels = voxels.sort_values("vid", ignore_index=True)
    ids, own, near = voxels["vid"].to_numpy(), voxels["own"].to_numpy(bool), voxels["near"].to_numpy()
    ts, at = np.stack(voxels["ts"].to_numpy()), voxels[["x", "y", "z"]].to_numpy(float)
    done, best, by = np.zeros(len(ids), bool), np.full(len(ids), np.inf), np.zeros(len(ids), np.int64)
    kinds = {kind: state[state["kind"] == kind] for kind in (LABEL, OFFER, SUMS)}
    done[np.searchsorted(ids, kinds[LABEL]["vid"])] = True
    asked = np.searchsorted(ids, kinds[OFFER]["vid"])
    best[asked], by[asked] = kinds[OFFER]["d"], kinds[OFFER]["cid"]
    sums = {int(c): [float(n), np.array(p), np.array(f)] for c, n, p, f in kinds[SUMS][["cid", "n", "place", "ts"]].itertuples(index=False)}
    gained = {c: [0.0, np.zeros(3), np.zeros(ts.shape[1])] for c in sums}
    line = [(best[i], int(ids[i]), int(by[i]), int(i)) for i in asked]
    heapq.heapify(line)
    new = []
    while line and line[0][0] <= limit:
        d, _, c, i = heapq.heappop(line)
        if done[i] or (d, c) != (best[i], by[i]):
            continue
        done[i] = True
        new.append(i)
        for have in (sums[c], gained[c]):
            have[0] += 1
            have[1] = have[1] + at[i]
            have[2] = have[2] + ts[i]
        place, feat = sums[c][1] / sums[c][0], sums[c][2] / sums[c][0]
        size = np.sqrt(feat @ feat)
        feat = feat / size if unit and size >= 1e-8 else feat
        to = np.searchsorted(ids, np.asarray(near[i], np.int64))
        to = to[~done[to]]
        cost = price(ts[to], at[to], feat, place)
        for j, e in zip(to.tolist(), cost.tolist(), strict=True):
            if e < best[j] or (e == best[j] and c < by[j]):
                best[j], by[j] = e, c
                if own[j]:
                    heapq.heappush(line, (e, int(ids[j]), c, j))
    left = np.flatnonzero(np.isfinite(best) & ~done)
    parts = [
        pd.DataFrame({"kind": LABEL, "vid": ids[new], "d": best[new], "cid": by[new]}),
        pd.DataFrame({"kind": OFFER, "vid": ids[left], "d": best[left], "cid": by[left]}),
        pd.DataFrame([(SUMS, c, n, place.tolist(), feat.tolist()) for c, (n, place, feat) in gained.items() if n], columns=["kind", "cid", "n", "place", "ts"]),
    ]
    out = pd.concat([one for one in parts if len(one)]).assign(slab=slab).reindex(columns=["kind", "slab", "vid", "d", "cid", "n", "place", "ts"])
    for c in ("place", "ts"):
        out[c] = out[c].astype(object).where(out[c].notna(), None)
    return out


def in_task(limit: float, price: Price, unit: bool) -> Callable:
    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return queue(int(key[0]), a, b.rename(columns=lambda c: c.removeprefix("s_")), limit, price, unit)

    return run


def added(sums: DataFrame) -> DataFrame:
    """Sums (cid, n, place, ts) of rows with equal cid as one."""
    whole = sums.groupBy("cid").agg(F.sum("n").alias("n"))
    for c in ("place", "ts"):
        entries = sums.select("cid", F.posexplode(c).alias("t", "v")).groupBy("cid", "t").agg(F.sum("v").alias("v"))
        whole = whole.join(entries.groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s.v).alias(c)), "cid")
    return whole.select("cid", "n", "place", "ts")


def grow_in_slabs(voxels: DataFrame, seeds: DataFrame, edges: DataFrame, price: Price, unit: bool = False, ahead: bool = False, share: float = SHARE, slab: int = SLAB) -> DataFrame:
    """(vid, cid) as `grow`: in a round each slab settles all offers up to the `share` quantile of the open prices, those among them that it makes on the way too.

    Means follow inside a slab at once and between slabs after the round. One slab's queue needs no rounds: the order is the same without them.
    With `ahead` seeds are labelled before all else and stand once in their mean.
    """
    from gridfuse.operators import spectral

    rows = graph.saved(voxels.select("vid", *[F.col(c).cast("double").alias(c) for c in "xyz"], "ts"))
    of = spectral.slabs(rows, slab)
    both = graph.saved(spatial.both_ways(edges.select("src", "dst")).withColumns({"slab": of("src"), "home": of("dst")}))
    near = both.groupBy(F.col("src").alias("vid")).agg(F.collect_list("dst").alias("near"))
    none = F.array().cast("array<long>")
    own = rows.join(near, "vid", "left").select(of("vid").alias("slab"), "vid", "x", "y", "z", "ts", F.lit(True).alias("own"), F.coalesce("near", none).alias("near"))
    beyond = both.filter("slab <> home").select("slab", F.col("dst").alias("vid")).distinct().join(rows, "vid")
    given = graph.saved(own.union(beyond.select("slab", "vid", "x", "y", "z", "ts", F.lit(False), none)))
    one = rows.count() <= slab
    k = seeds.count()
    first = (F.col("cid").cast("double") - 1) / (k + 1) - (1.0 if ahead else 0.0)
    offers = graph.saved(seeds.select("vid", first.alias("d"), F.col("cid").cast("long").alias("cid"), of("vid").alias("slab")))
    sums = graph.saved(seeds.select("vid", "cid").join(rows, "vid").select(F.col("cid").cast("long").alias("cid"), F.lit(0.0 if ahead else 1.0).alias("n"), *[F.transform(a, lambda v: v * (0.0 if ahead else 1.0)).alias(c) for c, a in (("place", F.array("x", "y", "z")), ("ts", F.col("ts")))]))
    done: list[DataFrame] = []
    while (row := offers.agg(F.min("d").alias("d"), F.percentile_approx("d", F.lit(share), F.lit(1000)).alias("t")).first()).d is not None:
        limit = float("inf") if one else max(row.d, row.t)
        active = offers.filter(F.col("d") <= limit).select(F.col("slab").alias("at")).distinct()
        here = F.col("slab") == F.col("at")
        open_ = graph.saved(offers.join(active, here, "left_semi"))
        known = open_.select("slab", "cid").distinct().join(sums, "cid")
        gone = F.lit(None)
        state = open_.select(F.lit(OFFER).alias("kind"), "slab", "vid", "d", "cid", gone.cast("double").alias("n"), gone.cast("array<double>").alias("place"), gone.cast("array<double>").alias("ts"))
        state = state.union(known.select(F.lit(SUMS), "slab", gone.cast("long"), gone.cast("double"), "cid", "n", "place", "ts"))
        for table in done:
            state = state.union(table.join(active, here, "left_semi").select(F.lit(LABEL), "slab", "vid", gone.cast("double"), "cid", gone.cast("double"), gone.cast("array<double>"), gone.cast("array<double>")))
        state = state.select("kind", F.col("slab").alias("part"), *[F.col(c).alias(f"s_{c}") for c in ("vid", "d", "cid", "n", "place", "ts")])

        task = in_task(limit, price, unit)
        out = graph.saved(given.join(active, here, "left_semi").groupBy("slab").cogroup(state.groupBy("part")).applyInPandas(task, STATE))
        done.append(graph.saved(out.filter(F.col("kind") == LABEL).select("vid", "cid", "slab")))
        if len(done) > TABLES:
            whole = graph.saved(together(done))
            graph.discard(*done)
            done = [whole]
        rest = offers.join(active, here, "left_anti").select("vid", "d", "cid")
        made = rest.union(out.filter(F.col("kind") == OFFER).select("vid", "d", "cid")).join(together(done).select("vid"), "vid", "left_anti")
        new_offers = graph.saved(made.groupBy("vid").agg(F.min(F.struct("d", "cid")).alias("m")).select("vid", "m.d", "m.cid", of("vid").alias("slab")))
        new_sums = graph.saved(added(sums.union(out.filter(F.col("kind") == SUMS).select("cid", "n", "place", "ts"))))
        graph.discard(sums, offers, open_, out)
        sums, offers = new_sums, new_offers
    graph.discard(both, given, sums)
    return graph.saved(together(done).select("vid", F.col("cid").cast("int").alias("cid"))) if done else seeds.select("vid", "cid").limit(0)
