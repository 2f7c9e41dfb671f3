"""Ward's clusters by rounds of reciprocal nearest neighbours.

Ward's cost is reducible: joining two clusters brings no other one nearer. So all pairs that are each other's nearest may join in one round, and
the tree is the one that joining the cheapest pair of all, again and again, gives. Equal points cost nothing to join and are one place from
the start. The nearest cluster is found by pivots: the cost of joining a pivot bounds the distance at which a cheaper cluster can be, and a
cluster asks only the cells within. Once few clusters are left (`local`, a constant), the rest of the tree is built on the driver.

Ties go by a hash of the two ids, so that many equal pairs join in one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import near
from .density import _jumped
from .near import distances
from .stored import discard, stored

#: So many clusters are joined on the driver.
LOCAL = 1024
MERGE = "id long, to long, cost double, turn long"


def _tie(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.minimum(a, b).astype(np.uint64), np.maximum(a, b).astype(np.uint64)
    h = (low + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(1)).astype(np.int64)


def _costs(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    return distances(x, y) ** 2 * (n[:, None] * m[None, :] / (n[:, None] + m[None, :]))


def chain(x: np.ndarray, weights: np.ndarray) -> list[tuple[float, int, int]]:
    """(cost, kept, joined) of all joins of weighted points, by a chain of nearest neighbours; the smaller number is kept."""
    centre, size, alive = x.astype(float).copy(), weights.astype(float).copy(), np.ones(len(x), bool)
    merges, path = [], []

    def cost(i: int) -> np.ndarray:
        d = _costs(centre[i : i + 1], size[i : i + 1], centre, size)[0]
        d[~alive] = np.inf
        d[i] = np.inf
        return d

    for _ in range(len(x) - 1):
        if not path:
            path = [int(np.argmax(alive))]
        while True:
            d = cost(path[-1])
            best = int(np.argmin(d))
            if len(path) > 1 and d[path[-2]] <= d[best]:
                break
            path.append(best)
        b, a = sorted(path[-2:])
        merges.append((float(cost(a)[b]), b, a))
        del path[-2:]
        centre[b] = (centre[a] * size[a] + centre[b] * size[b]) / (size[a] + size[b])
        size[b] += size[a]
        alive[a] = False
    return merges


def _nearest(clusters: DataFrame, cell: int, tile: int) -> DataFrame:
    """(id, to, cost): each cluster's nearest other one; clusters: (id, x, n)."""
    some = max(2, min(near.PIVOTS, clusters.count() // cell))
    rows = clusters.orderBy(F.xxhash64("id")).limit(some).collect()
    centres, sizes, names = np.array([r.x for r in rows], float), np.array([r.n for r in rows], float), np.array([r.id for r in rows])
    smallest = float(clusters.agg(F.min("n")).first()[0])

    def bounded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n, ids = p.n.to_numpy(float), p.id.to_numpy()
            d = distances(np.stack(p.x.to_numpy()), centres)
            cost = d**2 * (n[:, None] * sizes[None] / (n[:, None] + sizes[None]))
            cost[ids[:, None] == names[None]] = np.inf
            yield p.assign(cell=d.argmin(axis=1).astype("int32"), r=d.min(axis=1), radius=np.sqrt(cost.min(axis=1) * (1 / n + 1 / smallest)))

    cells = stored(clusters.mapInPandas(bounded, "id long, x array<double>, n double, cell int, r double, radius double"), "ward-cells")
    reach = np.full(len(centres), -np.inf)
    for c in cells.groupBy("cell").agg(F.max("r").alias("r")).collect():  # one a pivot
        reach[c.cell] = c.r
    asks = near.reaching(cells.select("id", "x", "n", "radius"), centres, reach)
    gives = cells.select("id", "x", "n", F.col("cell").alias("to"))

    def cheapest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        out = [pd.DataFrame({"id": [], "other": [], "cost": [], "tie": []}).astype({"id": "int64", "other": "int64", "cost": float, "tie": "int64"})]
        if len(a) and len(b):
            y, m, names_b = np.stack(b.x.to_numpy()), b.n.to_numpy(), b.id.to_numpy()
            for low in range(0, len(a), 512):
                own = a.iloc[low : low + 512]
                ids = own.id.to_numpy()
                cost = _costs(np.stack(own.x.to_numpy()), own.n.to_numpy(), y, m)
                cost[ids[:, None] == names_b[None]] = np.inf
                tie = np.where(cost == cost.min(axis=1)[:, None], _tie(ids[:, None], names_b[None]), np.iinfo(np.int64).max)
                at = tie.argmin(axis=1)
                row = np.arange(len(at))
                found = pd.DataFrame({"id": ids, "other": names_b[at], "cost": cost[row, at], "tie": tie[row, at]})
                out.append(found[np.isfinite(found.cost)])
        return pd.concat(out, ignore_index=True)

    found = near.tiled(asks, gives, tile).groupBy("to", "i", "j").applyInPandas(cheapest, "id long, other long, cost double, tie long")
    return found.groupBy("id").agg(F.min(F.struct("cost", "tie", "other")).alias("b")).select("id", F.col("b.other").alias("to"), "b.cost")


def joins(places: DataFrame, local: int = LOCAL, cell: int = near.CELL, tile: int = near.TILE) -> DataFrame:
    """MERGE rows of the whole tree: `id` is joined to the smaller `to`, which stays; places: (id, x, n)."""
    spark = places.sparkSession
    clusters, parts, turn = stored(places.select("id", "x", F.col("n").cast("double").alias("n")), "ward-clusters"), [spark.createDataFrame([], MERGE)], 0
    while clusters.count() > local:
        best = stored(_nearest(clusters, cell, tile), "ward-nearest")
        back = best.select(F.col("id").alias("to"), F.col("to").alias("_back"))
        merged = stored(best.join(back, "to").filter("_back = id AND id > to").select("id", "to", "cost", F.lit(turn).cast("long").alias("turn")), "ward-merges")
        gone = clusters.join(merged.select("id", "to"), "id").select("to", F.col("x").alias("_x"), F.col("n").alias("_n"))
        rest = clusters.join(merged.select("id"), "id", "left_anti").join(gone.withColumnRenamed("to", "id"), "id", "left")
        centre = F.zip_with("x", "_x", lambda a, b: (b * F.col("_n") + a * F.col("n")) / (F.col("_n") + F.col("n")))
        new = stored(rest.select("id", F.when(F.col("_n").isNull(), F.col("x")).otherwise(centre).alias("x"), (F.col("n") + F.coalesce("_n", F.lit(0.0))).alias("n")), "ward-clusters")
        discard(best, clusters)
        clusters, turn = new, turn + 1
        parts.append(merged)
    rows = clusters.orderBy("id").collect()
    if len(rows) > 1:
        left = chain(np.array([r.x for r in rows], float), np.array([r.n for r in rows], float))
        parts.append(spark.createDataFrame([(rows[a].id, rows[b].id, cost, turn + k) for k, (cost, b, a) in enumerate(left)], MERGE))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled(places: DataFrame, k: int, **options) -> DataFrame:
    """(id, cluster): the k clusters, named by their smallest id; places: (id, x, n)."""
    tree = joins(places, **options)
    # the dearest joins are undone; of equal ones the later
    undone = tree.orderBy(F.desc("cost"), F.desc("turn"), "id").limit(max(0, k - 1)).select("id", F.lit(True).alias("_undone"))
    roots = places.select("id").join(tree.join(F.broadcast(undone), "id", "left").filter("_undone IS NULL").select("id", "to"), "id", "left")
    return _jumped(roots.select(F.col("id").alias("c"), F.coalesce("to", "id").alias("to"))).select(F.col("c").alias("id"), F.col("root").cast("long").alias("cluster"))
