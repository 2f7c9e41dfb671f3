"""Exact nearest neighbours by a pivot (Voronoi) partition with triangle-inequality bounds.

Equal points are one place, so a crowd of them is looked up once. Pivots are places of a deterministic sample; each place lies in the cell of
its nearest pivot. For a point r of cell i (radius U_i) and any s, |s, p_i| - U_i <= |r, s| <= |s, p_i| + U_i, so no neighbour is
farther than U_i plus the k-th smallest |s, p_i|, and a place is sent only to the cells whose bound it reaches. Bounds come from the k + 1
nearest members of each cell: pivots x k numbers, whatever the number of points.

Crowded cells are cut into tiles. A place goes to the few cells around it, so shuffled rows grow in proportion to the points while pivots do
(up to PIVOTS of them; beyond, cells grow).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Places of a cell on average, and the most pivots: the distances to all of them are worked out for each place.
CELL, PIVOTS = 256, 4096
#: Asking and answering places that are compared in one task at a time.
TILE = 2048
#: Tables up to so many rows, once counted, are broadcast.
SMALL = 20_000
#: Rounding of distances must not hide a place.
SLACK = 1e-9


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, coordinates summed in order."""
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - y[None, :, c]) ** 2
    return np.sqrt(d)


def pivots(places: DataFrame, cell: int = CELL) -> np.ndarray:
    """At least one place for every `cell` of them, PIVOTS at most: those of the smallest hashes."""
    some = max(1, min(PIVOTS, places.count() // cell))
    return np.array([r.x for r in places.orderBy(F.xxhash64("x"), "x").limit(some).collect()], float)


def in_cells(places: DataFrame, centres: np.ndarray) -> DataFrame:
    """places (with x) with cell and r, the distance to its pivot."""

    def assigned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for low in range(0, len(p), 1024):
                own = p.iloc[low : low + 1024].copy()
                d = distances(np.stack(own.x.to_numpy()), centres)
                own["cell"] = d.argmin(axis=1).astype("int32")
                own["r"] = d.min(axis=1)
                yield own

    return places.mapInPandas(assigned, f"{_ddl(places)}, cell int, r double")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def reaching(df: DataFrame, centres: np.ndarray, reach: np.ndarray | None = None) -> DataFrame:
    """Rows of df (x, cell and, without reach, radius), each sent to every cell that it reaches (`to`): |x, p| <= reach of the cell (or of
    cell and row: reach[cell] plus the row's radius)."""

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for low in range(0, len(p), 1024):
                own = p.iloc[low : low + 1024]
                limit = reach[None, :] + (own.radius.to_numpy()[:, None] if "radius" in own else 0.0)
                row, to = np.nonzero(distances(np.stack(own.x.to_numpy()), centres) <= limit * (1 + SLACK) + 1e-300)
                yield own.iloc[row].assign(to=to.astype("int32"))

    return df.mapInPandas(sent, f"{_ddl(df)}, to int")


def tiled(asks: DataFrame, gives: DataFrame, tile: int) -> DataFrame:
    """asks and gives (both with `to` and `id`) side by side, dealt into tiles (to, i, j) in which every ask meets every give of its cell once."""
    parts = asks.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_i")).join(gives.groupBy("to").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_j")), "to")
    parts = F.broadcast(parts)  # a row a pivot at most
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = asks.join(parts, "to").withColumn("i", block("_i")).withColumn("j", every("_j")).withColumn("asks", F.lit(True))
    b = gives.join(parts, "to").withColumn("j", block("_j")).withColumn("i", every("_i")).withColumn("asks", F.lit(False))
    return a.drop("_i", "_j").unionByName(b.drop("_i", "_j"), allowMissingColumns=True)


def places_of(points: DataFrame, keys: int) -> DataFrame:
    """(id, x, keys) of the different x: the smallest keys of each, at most so many."""
    rank = F.row_number().over(Window.partitionBy("x").orderBy("key"))
    # ranks beyond the limit are cut before the shuffle, so a crowd of equal points is no large group
    few = points.withColumn("_rank", rank).filter(F.col("_rank") <= keys)
    return few.groupBy("x").agg(F.array_sort(F.collect_list("key")).alias("keys")).select(F.monotonically_increasing_id().alias("id"), "x", "keys")


def bounds(cells: DataFrame, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(radius of each cell, upper bound of the distance of each of its places to k + 1 places, itself included)."""
    near = Window.partitionBy("cell").orderBy("r", "id")
    members = cells.select("cell", "r", "id").withColumn("_rank", F.row_number().over(near)).filter(F.col("_rank") <= k + 1).groupBy("cell").agg(F.collect_list("r").alias("nearest"))
    rows = members.join(cells.groupBy("cell").agg(F.max("r").alias("radius")), "cell").collect()  # a row a pivot
    radius, cell, r = np.zeros(len(centres)), [], []
    for row in rows:
        radius[row.cell] = row.radius
        cell += [row.cell] * len(row.nearest)
        r += row.nearest
    if len(r) <= k:
        return radius, np.full(len(centres), np.inf)
    cell, r = np.array(cell), np.array(r)
    bound = [radius[i] + np.partition(distances(centres[i : i + 1], centres)[0][cell] + r, k)[k] for i in range(len(centres))]
    return radius, np.array(bound)


def neighbours(points: DataFrame, key: str, features: list[str], k: int, tile: int = TILE, cell: int = CELL) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest other points, equal distances by key; keys as strings.

    Points with a null or non-finite coordinate neither ask nor answer.
    """
    x = F.array(*[F.col(c).cast("double") for c in features])
    p = stored(points.select(F.col(key).cast("string").alias("key"), x.alias("x")).filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))), "points")
    places = stored(places_of(p, k + 1), "places")
    centres = pivots(places, cell)
    if not len(centres):
        return p.select("key", F.col("key").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).filter("false")
    cells = stored(in_cells(places, centres), "cells")
    radius, bound = bounds(cells, centres, k)
    gives = stored(reaching(cells.select("id", "x", "keys"), centres, radius + bound), "sent-places")
    asks = cells.select("id", "x", F.col("cell").alias("to"))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "distance": [], "neighbour": []}).astype({"id": "int64", "distance": float, "neighbour": str})
        at = np.repeat(np.arange(len(b)), b["keys"].map(len))
        names = np.concatenate(b["keys"].to_numpy())
        order = np.argsort(names, kind="stable")  # then equal distances stay in the order of the keys
        at, names = at[order], names[order]
        y, ids, out = np.stack(b.x.to_numpy()), a.id.to_numpy(), []
        for low in range(0, len(a), 256):
            d = distances(np.stack(a.x.to_numpy()[low : low + 256]), y)[:, at]
            best = np.argsort(d, axis=1, kind="stable")[:, : k + 1]
            out.append(pd.DataFrame({"id": np.repeat(ids[low : low + 256], best.shape[1]), "distance": np.take_along_axis(d, best, axis=1).ravel(), "neighbour": names[best].ravel()}))
        return pd.concat(out, ignore_index=True)

    found = tiled(asks, gives, tile).groupBy("to", "i", "j").applyInPandas(nearest, "id long, distance double, neighbour string")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    best = found.withColumn("_rank", rank).filter(F.col("_rank") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))).alias("best"))
    best = stored(best.join(places.select("id", "x"), "id").select("x", "best"), "nearest")
    own = _crowded_join(p, best)
    listed = F.slice(F.filter("best", lambda n: n["neighbour"] != F.col("key")), 1, k)
    return own.select("key", F.posexplode(listed)).select("key", F.col("col.neighbour").alias("neighbour"), F.col("col.distance").alias("distance"), (F.col("pos") + 1).alias("rank"))


def neighbours_of_all(points: DataFrame, key: str, features: list[str], k: int, **options) -> DataFrame:
    """neighbours() of all points, as SQL orders them: a coordinate that is not a number makes a distance none, and such distances (NaN) come
    after all numbers, by key. Points with a null or infinite coordinate are left out."""
    given = points.select(F.col(key).cast("string").alias("key"), *[F.col(c).cast("double").alias(c) for c in features])
    given = stored(given.filter(F.forall(F.array(*features), lambda v: v.isNotNull() & (F.isnan(v) | (F.abs(v) < float("inf"))))), "given-points")
    nan = F.exists(F.array(*features), F.isnan)
    found, off = neighbours(given.filter(~nan), "key", features, k, **options), given.filter(nan)
    last = [r.key for r in off.orderBy("key").limit(k).collect()]
    if not last:
        return found
    first = [r.key for r in given.orderBy("key").limit(k + 1).collect()]
    placed = given.filter(~nan).limit(k + 1).count()

    def by_key(asking: DataFrame, names: list[str], ranked: int) -> DataFrame:
        others = F.slice(F.filter(F.array(*[F.lit(n) for n in names]), lambda n: n != F.col("key")), 1, k - ranked)
        return asking.select("key", F.posexplode(others)).select("key", F.col("col").alias("neighbour"), F.lit(float("nan")).alias("distance"), (F.col("pos") + ranked + 1).alias("rank"))

    found = found.unionByName(by_key(off, first, 0))
    return found.unionByName(by_key(given.filter(~nan), last, placed - 1)) if 0 < placed <= k else found


def _crowded_join(p: DataFrame, best: DataFrame) -> DataFrame:
    """p with the row of best for its x: the places of many points are broadcast (fewer than a thousand are), the others joined."""
    if best.limit(SMALL + 1).count() <= SMALL:
        return p.join(F.broadcast(best), "x")
    crowds = p.groupBy("x").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > p.count() // 1000).select("x")
    hot = best.join(F.broadcast(crowds), "x", "left_semi")
    return p.join(F.broadcast(hot), "x").unionByName(p.join(F.broadcast(crowds), "x", "left_anti").join(best, "x"))
