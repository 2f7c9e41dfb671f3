"""Density clusters: a spanning tree of mutual reachability by Boruvka rounds, condensed by contraction. No task or driver holds all points.

The reachability of two points is the largest of their distance and their core distances (to the `samples`-th neighbour). Equal points have
equal cores and are one place with a count.

Tree. Each round every component takes its lightest outgoing edge. A first bound is a real edge to the nearest place of another component
that is known to the place's cell (the two nearest components of each pivot are kept, so one of them is another). Places whose core
distance is below their component's bound then ask the cells that this radius reaches and that hold other components. Components' choices
are made once more among all choices, so both ends know them and, edges being totally ordered, they form no cycle.

Condensing. At threshold t, points are joined by edges of weight <= t. A kernel is a component that reaches `least` points by joining smaller ones.
Small components follow their lightest edges: those that end in a large one leave it at the weight of their own edge; those that end in
two small ones join in the order of weights, as far as no edge leads out before, until they are large. What is left is the tree of
the kernels, at most N / least of them, whose splits, masses and choice are worked out on the driver. Joins of equal weight happen at once, so
the result does not depend on which of equal edges the tree has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import near
from .near import distances
from .stored import discard, stored

#: The inverse of a weight of nothing.
DENSEST = 1e12
EDGE = "w double, lo long, hi long"


def _edge(w, a, b):
    return F.struct(w.alias("w"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _jumped(pointers: DataFrame) -> DataFrame:
    """(c, root) of pointers (c, to): a root points to itself; of two that point to each other the smaller is the root."""
    back = pointers.select(F.col("c").alias("to"), F.col("to").alias("_back"))
    own = (F.col("_back") == F.col("c")) & (F.col("c") <= F.col("to"))
    few = pointers.select("c", "to").limit(near.SMALL + 1).collect()
    if len(few) <= near.SMALL:  # counted: followed here; more are followed by joins
        to = {r.c: r.to for r in few}
        to |= {c: c for c, t in to.items() if to.get(t) == c and c <= t}
        while (further := {c: to.get(t, t) for c, t in to.items()}) != to:
            to = further
        return pointers.sparkSession.createDataFrame(list(to.items()), "c long, root long")
    p = stored(pointers.join(back, "to", "left").select("c", F.when(own, F.col("c")).otherwise(F.col("to")).alias("root")), "pointers")
    while True:
        step = p.select(F.col("c").alias("root"), F.col("root").alias("_next"))
        jumped = stored(p.join(step, "root", "left").select("c", F.coalesce("_next", "root").alias("root"), (F.coalesce("_next", "root") != F.col("root")).alias("_moved")), "pointers")
        discard(p)
        p = jumped.drop("_moved")
        if jumped.filter("_moved").isEmpty():
            return p


def _nearest_foreign(nodes: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, list]:
    """For each pivot the best place (by the larger of distance and core) of the two best components, as arrays of two."""

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            comp, ids, core, x = p.comp.to_numpy(), p.id.to_numpy(), p.core.to_numpy(), np.stack(p.x.to_numpy())
            for low in range(0, len(centres), 256):
                v = np.maximum(distances(centres[low : low + 256], x), core[None, :])
                for _ in range(2):
                    at = v.argmin(axis=1)
                    value = v[np.arange(len(v)), at]
                    ok = np.flatnonzero(np.isfinite(value))
                    if len(ok):
                        yield pd.DataFrame({"pivot": low + ok, "comp": comp[at[ok]], "v": value[ok], "id": ids[at[ok]], "core": core[at[ok]], "x": list(x[at[ok]])})
                    v[comp[None, :] == comp[at][:, None]] = np.inf

    rows = nodes.select("comp", "id", "core", "x").mapInPandas(best, "pivot int, comp long, v double, id long, core double, x array<double>")
    rows = rows.groupBy("pivot", "comp").agg(F.min(F.struct("v", "id", "core", "x")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy("b.v", "comp"))
    found = rows.withColumn("_rank", rank).filter("_rank <= 2").select("pivot", "_rank", "comp", "b.*").collect()  # two a pivot
    out = [[None, None] for _ in range(len(centres))]
    for r in found:
        out[r.pivot][r["_rank"] - 1] = (r.comp, r.id, r.core, r.x)
    return out


def _first_edges(nodes: DataFrame, known: list) -> DataFrame:
    """(comp, e): for each component the lightest of the edges from its places to their cells' known places of other components."""
    comps = np.array([[k[0] if k else -1 for k in pair] for pair in known])
    ids = np.array([[k[1] if k else -1 for k in pair] for pair in known])
    cores = np.array([[k[2] if k else np.inf for k in pair] for pair in known])
    width = len(next(k for pair in known for k in pair if k)[3])
    x = np.array([[k[3] if k else [0.0] * width for k in pair] for pair in known])

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            cell, comp, own = p.cell.to_numpy(), p.comp.to_numpy(), np.stack(p.x.to_numpy())
            side = (comps[cell, 0] == comp).astype(int)
            d = np.zeros(len(p))
            for c in range(width):
                d += (own[:, c] - x[cell, side, c]) ** 2
            w = np.maximum(np.maximum(np.sqrt(d), p.core.to_numpy()), cores[cell, side])
            e = pd.DataFrame({"comp": comp, "w": w, "a": p.id.to_numpy(), "b": ids[cell, side]})[comps[cell, side] >= 0]
            yield e.sort_values(["w", "a", "b"]).drop_duplicates("comp")

    found = nodes.select("comp", "id", "core", "x", "cell").mapInPandas(edges, "comp long, w double, a long, b long")
    return found.groupBy("comp").agg(F.min(_edge(F.col("w"), F.col("a"), F.col("b"))).alias("e"))


def _searched(nodes: DataFrame, limits: DataFrame, centres: np.ndarray, tile: int) -> DataFrame:
    """(comp, e): the lightest edge that a component's places find below its bound."""
    cells = nodes.groupBy("cell").agg(F.max("r").alias("radius"), F.min("comp").alias("least"), F.max("comp").alias("most")).collect()  # one a pivot
    radius, single = np.full(len(centres), -np.inf), np.full(len(centres), -1)
    for c in cells:
        radius[c.cell] = c.radius
        single[c.cell] = c.least if c.least == c.most else -1
    asks = nodes.join(limits.select("comp", F.col("e.w").alias("radius")), "comp").filter(F.col("core") < F.col("radius")).select("id", "x", "core", "comp", "radius")
    asks = near.reaching(asks, centres, radius)
    alone = F.array(*[F.lit(int(s)) for s in single])
    asks = asks.filter(F.get(alone, F.col("to")) != F.col("comp"))
    gives = nodes.select("id", "x", "core", "comp", F.col("cell").alias("to"))

    def lightest(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks]
        none = pd.DataFrame({"comp": [], "w": [], "a": [], "b": []}).astype({"comp": "int64", "w": float, "a": "int64", "b": "int64"})
        if not len(a) or not len(b):
            return none
        b = b.sort_values("id")
        y, core, comp, ids, out = np.stack(b.x.to_numpy()), b.core.to_numpy(), b.comp.to_numpy(), b.id.to_numpy(), [none]
        for low in range(0, len(a), 512):
            own = a.iloc[low : low + 512]
            w = np.maximum(np.maximum(distances(np.stack(own.x.to_numpy()), y), core[None, :]), own.core.to_numpy()[:, None])
            w[own.comp.to_numpy()[:, None] == comp[None, :]] = np.inf
            at = w.argmin(axis=1)
            best = w[np.arange(len(w)), at]
            ok = best < own.radius.to_numpy()
            out.append(pd.DataFrame({"comp": own.comp.to_numpy()[ok], "w": best[ok], "a": own.id.to_numpy()[ok], "b": ids[at[ok]]}))
        return pd.concat(out, ignore_index=True).sort_values(["w", "a", "b"]).drop_duplicates("comp")

    found = near.tiled(asks, gives, tile).groupBy("to", "i", "j").applyInPandas(lightest, "comp long, w double, a long, b long")
    return found.groupBy("comp").agg(F.min(_edge(F.col("w"), F.col("a"), F.col("b"))).alias("e"))


def spanning_tree(places: DataFrame, cell: int = near.CELL, tile: int = near.TILE) -> DataFrame:
    """Edges (w, lo, hi) of a lightest spanning tree of mutual reachability; places: (id, x, core)."""
    spark = places.sparkSession
    centres = near.pivots(places, cell)
    tree = []
    none = spark.createDataFrame([], EDGE)
    if not len(centres):
        return none
    nodes = stored(near.in_cells(places, centres).withColumn("comp", F.col("id")), "nodes")
    while nodes.select(F.min("comp") < F.max("comp")).first()[0]:
        first = stored(_first_edges(nodes, _nearest_foreign(nodes, centres)), "first-edges")
        own = first.unionByName(_searched(nodes, first, centres, tile)).groupBy("comp").agg(F.min("e").alias("e")).select("e.*").distinct()
        comp_of = lambda end: nodes.select(F.col("id").alias(end), F.col("comp").alias(f"c_{end}"))  # noqa: E731, B023
        edges = stored(own.join(comp_of("lo"), "lo").join(comp_of("hi"), "hi"), "edges")
        both = edges.select(F.col("c_lo").alias("c"), F.struct("w", "lo", "hi", F.col("c_hi").alias("to")).alias("e")).unionByName(edges.select(F.col("c_hi").alias("c"), F.struct("w", "lo", "hi", F.col("c_lo").alias("to")).alias("e")))
        choice = stored(both.groupBy("c").agg(F.min("e").alias("e")), "choices")
        tree.append(choice.select("e.w", "e.lo", "e.hi"))
        roots = _jumped(choice.select("c", F.col("e.to").alias("to")))
        joined = stored(nodes.join(roots.withColumnRenamed("c", "comp"), "comp").drop("comp").withColumnRenamed("root", "comp"), "nodes")
        discard(first, edges, nodes, roots)
        nodes = joined
    return stored(reduce(DataFrame.unionByName, tree, none).distinct(), "tree")


def contracted(places: DataFrame, tree: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places with their kernel and t, kernels (kernel, level), edges between kernels (w, a, b)); places: (id, core, n).

    t is the weight from which on the place belongs to a component of `least` points; no kernel and no t if there is none.
    """
    large = F.col("n") >= least
    own = stored(places.select("id", F.col("id").alias("c"), F.when(large, F.col("core")).alias("t")), "places")
    comps = stored(places.select(F.col("id").alias("c"), "n", F.when(large, F.col("core")).alias("level")), "components")
    edges = stored(tree.select("w", "lo", "hi", F.col("lo").alias("a"), F.col("hi").alias("b")), "edges")
    while not edges.isEmpty() and not comps.filter("level IS NULL").isEmpty():
        both = edges.select(F.col("a").alias("c"), F.struct("w", "lo", "hi", F.col("b").alias("to")).alias("e")).unionByName(edges.select(F.col("b").alias("c"), F.struct("w", "lo", "hi", F.col("a").alias("to")).alias("e")))
        lightest = both.groupBy("c").agg(F.min("e").alias("e"))
        comp = comps.join(lightest, "c", "left").select("c", "n", "level", F.when(F.col("level").isNull(), F.col("e.w")).alias("w"), F.when(F.col("level").isNull(), F.col("e.to")).otherwise(F.col("c")).alias("to"))
        comp = stored(comp, "followed")
        roots = _jumped(comp.select("c", "to"))
        comp = comp.join(roots, "c").join(comp.select(F.col("c").alias("root"), F.col("level").alias("root_level")), "root")
        comp = stored(comp.select("c", "n", "level", "w", "root", "root_level"), "rooted")
        place = lambda end: comp.select(F.col("c").alias(end), F.col("root").alias(f"r_{end}"))  # noqa: E731, B023
        across = edges.join(place("a"), "a").join(place("b"), "b").filter("r_a <> r_b")
        out = across.select(F.explode(F.array("r_a", "r_b")).alias("root"), "w").groupBy("root").agg(F.min("w").alias("w_out"))
        small = comp.filter("root_level IS NULL")
        # the first `least` members, by weight, tell when a tree becomes large: ranks beyond are cut before the shuffle
        by = Window.partitionBy("root").orderBy("w", "c")
        cum = F.sum("n").over(Window.partitionBy("root").orderBy("w").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        reached = small.withColumn("_rank", F.row_number().over(by)).filter(F.col("_rank") <= least).withColumn("_cum", cum)
        reached = reached.groupBy("root").agg(F.min(F.when(F.col("_cum") >= least, F.col("w"))).alias("w_kernel")).join(out, "root", "left")
        within = F.coalesce(F.col("w_kernel") <= F.col("w_out"), F.col("w_kernel").isNotNull())
        reached = reached.select("root", F.when(within, F.col("w_kernel")).alias("w_kernel"), F.when(within, F.col("w_kernel")).otherwise(F.col("w_out")).alias("w_last"))
        comp = comp.join(reached, "root", "left")
        joins = F.col("level").isNull() & (F.col("root_level").isNotNull() | F.coalesce(F.col("w") <= F.col("w_last"), F.col("w_last").isNull()))
        leaves = F.when(F.col("root_level").isNotNull(), F.col("w")).otherwise(F.col("w_kernel"))  # of those that now belong to a large one
        moved = stored(comp.select("c", "n", "level", "w_kernel", joins.alias("joins"), F.when(joins, F.col("root")).otherwise(F.col("c")).alias("to"), F.when(joins, leaves).alias("t_new")), "moved")
        new_own = stored(own.join(moved.select("c", "to", "t_new"), "c").select("id", F.col("to").alias("c"), F.coalesce("t", "t_new").alias("t")), "places")
        level = F.coalesce(F.max("level"), F.max(F.when(F.col("joins"), F.col("w_kernel"))))
        new_comps = stored(moved.groupBy(F.col("to").alias("c")).agg(F.sum("n").alias("n"), level.alias("level")), "components")
        rename = lambda end: moved.select(F.col("c").alias(end), F.col("to").alias(f"n_{end}"))  # noqa: E731, B023
        new_edges = stored(edges.join(rename("a"), "a").join(rename("b"), "b").filter("n_a <> n_b").select("w", "lo", "hi", F.col("n_a").alias("a"), F.col("n_b").alias("b")), "edges")
        discard(own, comps, edges, roots, moved)
        own, comps, edges = new_own, new_comps, new_edges
    return own.select("id", F.when(F.col("t").isNotNull(), F.col("c")).alias("kernel"), "t"), comps.filter("level IS NOT NULL").select(F.col("c").alias("kernel"), "level"), edges.select("w", "a", "b")


class Condensed:
    """The tree of clusters over the kernels: clusters join where edges of one weight join two or more of them that were there before."""

    def __init__(self, kernels: list[tuple[int, float]], edges: list[tuple[float, int, int]]):
        self.kernel = [k for k, _ in kernels]
        at = {k: j for j, k in enumerate(self.kernel)}
        self.bottom, self.top, self.parent = [level for _, level in kernels], [np.inf] * len(kernels), [None] * len(kernels)
        root = list(range(len(kernels)))  # of union-find; `now`: the cluster that a root's component is
        now = list(range(len(kernels)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges = sorted(edges)
        low = 0
        while low < len(edges):
            high = low
            while high < len(edges) and edges[high][0] == edges[low][0]:
                high += 1
            w, groups = edges[low][0], {}
            before = {find(at[k]) for _, a, b in edges[low:high] for k in (a, b)}
            old = {r: now[r] for r in before}
            for _, a, b in edges[low:high]:
                root[find(at[a])] = find(at[b])
            for r in before:
                groups.setdefault(find(r), []).append(old[r])
            for r, clusters in groups.items():
                there = [c for c in clusters if self.bottom[c] < w]
                if len(there) == 1:  # the others have only now become large: they join what is there
                    now[r] = there[0]
                else:
                    self.bottom.append(w)
                    self.top.append(np.inf)
                    self.parent.append(None)
                    now[r] = len(self.bottom) - 1
                for c in clusters:
                    if c != now[r]:
                        self.parent[c], self.top[c] = now[r], w
            low = high
        self.born = [0.0 if t == np.inf else min(1 / t if t > 0 else np.inf, DENSEST) for t in self.top]

    def segments(self) -> list[tuple[int, float, float, int, float]]:
        """(kernel, low, high, cluster, born): which cluster a kernel is part of from threshold low to below high."""
        rows = []
        for k, name in enumerate(self.kernel):
            c = k
            while c is not None:
                rows.append((name, float(self.bottom[c]), float(self.top[c]), c, float(self.born[c])))
                c = self.parent[c]
        return rows

    def chosen(self, points: dict[int, int], mass: dict[int, float]) -> dict[int, int | None]:
        """For each cluster the chosen one that it is part of: those of more mass than the chosen ones below them. A top one is none."""
        n = len(self.bottom)
        order = sorted(range(n), key=lambda c: (self.top[c], c))  # children before parents
        below: dict[int, list[int]] = {}
        size, total, take = {}, {}, {}
        for c in order:
            size[c] = points.get(c, 0) + sum(size[s] for s in below.get(c, []))
            if self.parent[c] is not None:
                below.setdefault(self.parent[c], []).append(c)
        for c in order:
            inner = [s for s in below.get(c, []) if self.bottom[s] < self.top[s]]  # one that joins as it forms is no cluster of its own
            own = mass.get(c, 0.0) + sum(size[s] * (self.born[s] - self.born[c]) for s in below.get(c, []))
            under = sum(total[s] for s in inner)
            take[c] = self.parent[c] is not None and self.bottom[c] < self.top[c] and own >= under
            total[c] = own if take[c] else under
        final: dict[int, int | None] = {}
        for c in reversed(order):
            up = final[self.parent[c]] if self.parent[c] is not None else None
            final[c] = up if up is not None else (c if take[c] else None)
        return final


def labelled(places: DataFrame, tree: DataFrame, least: int) -> DataFrame:
    """(id, cluster): the chosen cluster of each place, null outside; places: (id, core, n)."""
    spark = places.sparkSession
    own, kernels, edges = contracted(places, tree, least)
    own = stored(own.join(places.select("id", "n"), "id"), "kernel-places")
    condensed = Condensed([tuple(r) for r in kernels.collect()], [tuple(r) for r in edges.collect()])  # N / least of each at most
    segments = spark.createDataFrame(condensed.segments(), "kernel long, low double, high double, cluster int, born double")
    part = own.join(segments, "kernel").filter((F.col("t") >= F.col("low")) & (F.col("t") < F.col("high")))
    dense = F.when(F.col("t") > 0, F.least(1 / F.col("t"), F.lit(DENSEST))).otherwise(DENSEST)
    sums = part.groupBy("cluster").agg(F.sum("n").alias("points"), F.sum(F.col("n") * (dense - F.col("born"))).alias("mass")).collect()  # as many as clusters
    final = condensed.chosen({r.cluster: r.points for r in sums}, {r.cluster: r.mass for r in sums})
    names = spark.createDataFrame([(c, f) for c, f in final.items() if f is not None], "cluster int, label int")
    inside = part.join(names, "cluster").select("id", F.col("label").alias("cluster"))
    return places.select("id").join(inside, "id", "left")
