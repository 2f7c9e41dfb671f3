"""Density clusters and Ward against brute force over all points at once."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalforge.operators import cluster, density, ward


def brute(x, least, samples):
    """Clusters of all points from the full matrix: components at every threshold, joins of equal weight at once."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    others = np.sort(d + np.diag(np.full(n, np.inf)), axis=1)
    core = others[:, : min(samples, n - 1)].max(axis=1) if n > 1 else np.zeros(n)
    m = np.maximum(d, np.maximum(core[:, None], core[None]))
    np.fill_diagonal(m, np.inf)
    parts = [frozenset([i]) for i in range(n)]
    inverse = lambda w: min(1 / w if w > 0 else np.inf, 1e12)
    live, clusters = {}, []  # component -> cluster; clusters: [bottom, top, parent, {point: weight it leaves at}]
    for w in np.unique(m[np.isfinite(m)]):
        groups = []
        for p in parts:
            near = [g for g in groups if any(m[a, b] <= w for q in g for a in p for b in q)]
            groups = [g for g in groups if g not in near] + [[p, *itertools.chain(*near)]]
        for g in (g for g in groups if len(g) > 1):
            whole = frozenset().union(*g)
            had = [live.pop(p) for p in g if p in live]
            if len(whole) < least:
                continue
            if len(had) == 1:
                c = had[0]
            else:
                clusters.append([w, np.inf, None, {}])
                c = len(clusters) - 1
                for h in had:
                    clusters[h][1:3] = w, c
            live[whole] = c
            for p in g:
                if len(p) < least:
                    clusters[c][3].update({i: w for i in p})
        parts = [frozenset().union(*g) for g in groups]
    born = [0.0 if np.isinf(c[1]) else inverse(c[1]) for c in clusters]
    size, mass, total, take = {}, {}, {}, {}
    for k, c in enumerate(clusters):
        inner = [j for j in range(k) if clusters[j][2] == k]
        size[k] = len(c[3]) + sum(size[j] for j in inner)
        mass[k] = sum(inverse(w) - born[k] for w in c[3].values()) + sum(size[j] * (born[j] - born[k]) for j in inner)
        under = sum(total[j] for j in inner)
        take[k] = c[2] is not None and mass[k] >= under * (1 - 1e-12)
        total[k] = mass[k] if take[k] else under
    final = {}
    for k in range(len(clusters) - 1, -1, -1):
        up = final.get(clusters[k][2])
        final[k] = up if up is not None else (k if take[k] else None)
    label = [-1] * n
    for k, c in enumerate(clusters):
        for i in c[3]:
            label[i] = -1 if final[k] is None else final[k]
    order = {c: r for r, c in enumerate(dict.fromkeys(v for v in label if v >= 0))}
    return [order.get(v, -1) for v in label]


def frame(spark, x):
    return spark.createDataFrame([("d", f"{k:05d}", *map(float, p)) for k, p in enumerate(x)], "drug string, side_effect string, x double, y double").repartition(3)


def cases():
    rng = np.random.default_rng(8)
    blobs = np.concatenate([rng.normal(c, 0.5, (25, 2)) for c in ((0, 0), (5, 0), (0, 6))] + [rng.uniform(-3, 9, (15, 2))])
    grid = np.array([(a, b) for a in range(6) for b in range(5)] + [(a + 20, b) for a in range(5) for b in range(5)] + [(40, 40)], float)  # ties everywhere
    crowd = np.concatenate([np.zeros((30, 2)), np.full((12, 2), 4.0), rng.normal(8, 0.3, (20, 2)), rng.normal(0, 0.4, (20, 2))])
    line = np.array([(k * (k + 1) / 2, 0) for k in range(40)], float)  # gaps that grow: a chain of lightest edges
    return {"blobs": (blobs, 10, 4), "ties": (grid, 6, 3), "crowd": (crowd, 8, 5), "line": (line, 5, 2), "one": (blobs[:1], 2, 2)}


@pytest.mark.parametrize("name", sorted(cases()))
def test_density_equals_brute_force(spark, name):
    x, least, samples = cases()[name]
    got = [r.hdbscan_cluster for r in cluster.hdbscan(frame(spark, x), ["x", "y"], least, samples, cell=12).orderBy("side_effect").collect()]
    assert got == brute(x, least, samples)


def test_spanning_tree_is_lightest(spark):
    rng = np.random.default_rng(2)
    x, core = np.round(rng.normal(size=(120, 2)), 1), np.round(rng.uniform(0, 0.4, 120), 1)
    _, first = np.unique(x, axis=0, return_index=True)
    x, core = x[first], core[first]
    places = spark.createDataFrame([(k, [float(v) for v in p], float(c)) for k, (p, c) in enumerate(zip(x, core, strict=True))], "id long, x array<double>, core double")
    edges = density.spanning_tree(places, cell=10).collect()
    m = np.maximum(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), np.maximum(core[:, None], core[None]))
    inside, total = {0}, 0.0
    while len(inside) < len(x):
        w, b = min((m[a, b], b) for a in inside for b in range(len(x)) if b not in inside)
        inside.add(b)
        total += w
    assert len({(r.lo, r.hi) for r in edges}) == len(edges) == len(x) - 1 and all(m[r.lo, r.hi] == r.w for r in edges)
    assert np.isclose(sum(r.w for r in edges), total)


def test_odd_points(spark):
    d = frame(spark, np.zeros((3, 2))).unionByName(frame(spark, np.zeros((1, 2))).withColumn("x", F.lit(None).cast("double")).withColumn("side_effect", F.lit("null")))
    assert {r.hdbscan_cluster for r in cluster.hdbscan(d, ["x", "y"], 2, 2).collect()} == {-1}
    assert cluster.hdbscan(d.filter("false"), ["x", "y"], 2, 2).count() == 0


def ward_by_hand(x, k):
    """The cheapest pair of all joined, again and again."""
    groups = [[i] for i in range(len(x))]

    def cost(a, b):
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()

    while len(groups) > k:
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: cost(groups[p[0]], groups[p[1]]))
        groups[j] += groups.pop(i)
    order = {i: r for r, g in enumerate(sorted(map(sorted, groups))) for i in g}
    return [order[i] for i in range(len(x))]


@pytest.mark.parametrize("local", [6, 1024])
def test_ward_equals_brute_force(spark, local):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(45, 2)), np.full((7, 2), 0.25), rng.normal(3, 0.1, size=(8, 2))])
    got = [r.agglo_cluster for r in cluster.ward(frame(spark, x), ["x", "y"], k=5, local=local, cell=10, tile=20).orderBy("side_effect").collect()]
    assert got == ward_by_hand(x, 5)


def test_ward_joins_many_ties_at_once(spark):
    x = np.array([(k, 0) for k in range(64)], float)
    places = frame(spark, x).select(F.col("side_effect").cast("long").alias("id"), F.array("x", "y").alias("x"), F.lit(1).alias("n"))
    rows = ward.joins(places, local=8, cell=16).collect()
    assert len(rows) == 63 and sum(r.turn == 0 for r in rows) > 10
    d = frame(spark, x[:1])
    assert [r.agglo_cluster for r in cluster.ward(d, ["x", "y"]).collect()] == [0]
    assert cluster.ward(d.filter("false"), ["x", "y"]).count() == 0
