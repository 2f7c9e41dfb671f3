"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine >= c are within T = 2 - 2c of squared distance. Vectors are rotated (a fixed random rotation) and
split into blocks of a few dimensions; a linked pair is within T x (block's share of the dimensions) in one block at least.
Each block is range-joined on a grid: a vector is at home in its cell and visits the later cells that its ball touches. In a
cell, pairs within the block's budget are verified by cosine in double precision over the whole vectors, and counted in the
first block that holds them. A cell yields one row a vector (links counted, and its component within the cell), never pairs.
Cells with many vectors are cut into tiles, and each pair of tiles is compared on its own, so that no cell lands in one task.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link
with nothing; vectors of different lengths do not link; equal vectors of a label are joined once, and their number counted
(repeated rows too are other vectors); vectors with null or repeated ids link as all others do, but null ids name no component (it
is null where no member has an id); an empty table gives an empty result; other columns are not looked at. Vectors of doubles
are compared as they are, all others as floats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import attach, materialise, q
from .textops import mix

COSINE = 0.98
BLOCK = 4
#: Vectors of one cell that are compared in one go.
TILE = 512
_WIDTH = 4  # of a cell, in radii


@cache
def _rotation(dims: int) -> np.ndarray:
    matrix = np.random.default_rng(dims).normal(size=(dims, dims))
    return np.linalg.qr(matrix)[0]


@cache
def _blocks(dims: int, cosine: float) -> list[tuple[slice, float]]:
    """(dimensions, squared-distance budget) of each block."""
    ends = np.linspace(0, dims, max(1, round(dims / BLOCK)) + 1).astype(int)
    budget = (2 - 2 * cosine) * (1 + 1e-9) + 1e-12
    return [(slice(a, b), budget * (b - a) / dims) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _rotated(unit: np.ndarray) -> np.ndarray:
    """Rotation by sums in a fixed order: a vector's result is the same in whichever batch it comes."""
    matrix, out = _rotation(unit.shape[1]), np.zeros_like(unit)
    for k in range(unit.shape[1]):
        out += unit[:, k : k + 1] * matrix[k]
    return out


def _cells(rotated: np.ndarray, labels: np.ndarray, cosine: float, visits: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(block, 0 at home or 1 on a visit, rows, cell keys)."""
    dims = rotated.shape[1]
    for number, (part, budget) in enumerate(_blocks(dims, cosine)):
        x, radius = rotated[:, part], np.sqrt(budget)
        width = _WIDTH * radius
        reach = radius * (1 + 1e-9)
        base, low, high = (np.floor((x + d) / width).astype(np.int64) for d in (0, -reach, reach))
        seed = mix(mix(labels.astype(np.int64).view(np.uint64) + np.uint64(dims << 8)) + np.uint64(number))
        span = int(np.ceil(1 / width)) + 2

        def code(c: np.ndarray, span=span) -> np.ndarray:
            out = np.zeros(len(c), np.int64)
            for k in range(c.shape[1]):
                out = out * (2 * span + 1) + c[:, k] + span
            return out

        def key(c: np.ndarray, seed=seed) -> np.ndarray:
            return mix(seed ^ mix(c.view(np.uint64)))

        home = code(base)
        every = np.arange(len(x))
        yield number, 0, every, key(home)
        for bits in range(1 << x.shape[1]) if visits else ():
            up = np.array([bits >> k & 1 for k in range(x.shape[1])], bool)
            there = code(np.where(up, high, low))
            some = np.flatnonzero(((high != low) | ~up).all(axis=1) & (there > home))
            if len(some):
                yield number, 1, some, mix(seed[some] ^ mix(there[some].view(np.uint64)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component among 0..n-1 with edges a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _tile(left: np.ndarray, right: np.ndarray, same: bool, unit: np.ndarray, rotated: np.ndarray, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows left x right (same: each pair once) whose first block within budget is this one."""
    blocks = _blocks(unit.shape[1], cosine)
    part, budget = blocks[block]
    x, y = rotated[left, part], rotated[right, part]
    near = ((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2) <= budget
    if same:
        near = np.triu(near, 1)
    a, b = np.nonzero(near)
    if len(a) > 0.05 * near.size and len(a) > 1000:
        cosines = (unit[left] @ unit[right].T)[a, b]
    else:
        cosines = np.einsum("ij,ij->i", unit[left[a]], unit[right[b]])
    linked = cosines >= cosine
    a, b = left[a[linked]], right[b[linked]]
    first = np.ones(len(a), bool)
    for part, budget in blocks[:block]:
        first &= ((rotated[a, part] - rotated[b, part]) ** 2).sum(axis=1) > budget
    return a[first], b[first]


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) by vector length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    return [(rows := np.flatnonzero(sizes == d), flat[starts[rows][:, None] + np.arange(d)]) for d in np.unique(sizes).tolist()]


def _visit(cosine: float, visits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            for low in range(0, batch.num_rows, 1024):
                for rows, v in _vectors(vectors.slice(low, 1024)):
                    rotated = _rotated(_unit(v))
                    for block, role, some, keys in _cells(rotated, labels[low + rows], cosine, visits):
                        key = pa.array(keys.view(np.int64))
                        if not visits:
                            yield pa.RecordBatch.from_arrays([key], names=["cell"])
                            continue
                        at = pa.array(low + rows[some])
                        fill = lambda value, n: pa.array(np.full(n, value, np.int32))
                        yield pa.RecordBatch.from_arrays([key, fill(block, len(some)), fill(role, len(some)), ids.take(at), batch.column(3).take(at), vectors.take(at)], names=["cell", "block", "role", "id", "n", "vector"])

    return run


def _compare(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            columns = [rows.column(k).combine_chunks() if rows.column(k).num_chunks != 1 else rows.column(k).chunk(0) for k in range(rows.num_columns)]
            cell, i, j, block, role, ids, n = (c.to_numpy(zero_copy_only=False) for c in columns[:7])
            unit, rotated, place = {}, {}, np.zeros(len(ids), np.int64)
            for some, v in _vectors(columns[7]):
                unit[v.shape[1]] = _unit(v)
                rotated[v.shape[1]] = _rotated(unit[v.shape[1]])
                place[some] = np.arange(len(some))
            dims = np.diff(columns[7].offsets.to_numpy())
            edge = np.flatnonzero((np.diff(cell) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(block) != 0) | (np.diff(dims) != 0)) + 1
            bounds = np.concatenate([[0], edge, [len(cell)]])
            found = [[], [], []]
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if high - low < 2:
                    continue
                rows_here = np.arange(low, high)
                homes, guests = rows_here[role[low:high] == 0], rows_here[role[low:high] == 1]
                if not len(homes):
                    continue
                d, pairs = int(dims[low]), []
                for left, right, same in [(homes, homes, True)] * bool(i[low] == j[low]) + [(homes, guests, False)]:
                    for p in range(0, len(left), TILE):
                        for k in range(p if same else 0, len(right), TILE):
                            a, b = place[left[p : p + TILE]], place[right[k : k + TILE]]
                            one, two = _tile(a, b, same and p == k, unit[d], rotated[d], int(block[low]), cosine)
                            if len(one):
                                pairs.append((one, two))
                if not pairs:
                    continue
                back = np.full(len(unit[d]), -1)
                back[place[rows_here]] = rows_here
                a, b = (back[np.concatenate(x)] for x in zip(*pairs, strict=True))
                members, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
                a_at, b_at = inverse[: len(a)], inverse[len(a) :]
                links = np.bincount(a_at, n[b], len(members)) + np.bincount(b_at, n[a], len(members))
                order = np.argsort(ids[members], kind="stable")
                rank = np.argsort(order)
                roots = _roots(len(members), rank[a_at], rank[b_at])
                found[0].append(ids[members])
                found[1].append(links.astype(np.int64))
                found[2].append(ids[members][order][roots[rank]])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in found], names=["id", "links", "root"])

        for batch in batches:  # rows come sorted: the last cell of a batch may go on in the next
            rows = pa.Table.from_batches([*held, batch])
            key = [rows.column(k).to_numpy() for k in range(3)]
            same = (key[0] == key[0][-1]) & (key[1] == key[1][-1]) & (key[2] == key[2][-1])
            cut = int(np.argmax(same))
            if cut:
                yield from cells(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield from cells(pa.Table.from_batches(held))

    return run


def links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row a vector: _id, n_links, component_id."""
    kind = vectors.select(q(vector_col)).schema[0].dataType
    element = "double" if isinstance(kind, T.ArrayType) and kind.elementType == T.DoubleType() else "float"
    rows = vectors.select(q(id_col).cast("long").alias("_id"), q(label_col).cast("long").alias("_label"), q(vector_col).cast(f"array<{element}>").alias("_vector"))
    finite = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.col("_label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("_vector", lambda x: x != 0), F.lit(False))
    unique = rows.filter(fit).groupBy("_label", "_vector").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    unique = materialise(unique.withColumn("_key", F.monotonically_increasing_id()), "vectors")
    source = unique.select("_key", "_label", "_vector", "_n")
    homes = source.mapInArrow(_visit(cosine, False), "cell long").groupBy("cell").agg(F.count(F.lit(1)).alias("_homes"))
    crowded = materialise(homes.filter(F.col("_homes") > TILE).select("cell", F.ceil(F.col("_homes") / TILE).cast("int").alias("_tiles")), "crowded-cells")
    seated = source.mapInArrow(_visit(cosine, True), "cell long, block int, role int, id long, n long, vector array<" + element + ">")
    seated = attach(seated, crowded, ["cell"], "id").withColumn("_tiles", F.coalesce("_tiles", F.lit(1)))
    seated = seated.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_tiles")).cast("int"))
    # at home: tile pairs (own, k) on the left and (k, own) on the right; on a visit: every (k, k)
    tile = lambda i, j, role: F.struct(i.alias("i"), j.alias("j"), role.alias("role"))
    one, own, every = F.lit(1), F.col("_own"), F.sequence(F.lit(0), F.col("_tiles") - 1)
    at_home = F.transform(every, lambda k: tile(F.least(own, k), F.greatest(own, k), F.when(k < own, one).otherwise(0)))
    visiting = F.transform(every, lambda k: tile(k, k, one))
    seated = seated.withColumn("_tile", F.explode(F.when(F.col("role") == 0, at_home).otherwise(visiting)))
    seated = seated.select("cell", F.col("_tile.i").alias("i"), F.col("_tile.j").alias("j"), "block", F.col("_tile.role").alias("role"), "id", "n", "vector")
    seated = seated.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "block", F.size("vector"))
    found = materialise(seated.mapInArrow(_compare(cosine), "id long, links long, root long"), "vector-links")
    counts = found.groupBy("id").agg(F.sum("links").alias("_links"))
    comp = components(counts.select(F.col("id").alias("node")), found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = materialise(counts.withColumnRenamed("id", "_key").join(comp.withColumnRenamed("node", "_key"), "_key", "left"), "linked-vectors")
    # only vectors with links or copies are looked up again
    known = unique.join(linked, "_key", "left").filter("_n > 1 or comp is not null")
    known = materialise(known.select("_label", "_vector", "_key", "_first", (F.coalesce("_links", F.lit(0)) + F.col("_n") - 1).alias("_all_links"), F.coalesce("comp", "_key").alias("_comp")), "known-vectors")
    names = materialise(known.groupBy("_comp").agg(F.min("_first").alias("_name")), "component-names")
    named = attach(known, names, ["_comp"], "_key").select("_label", "_vector", "_all_links", "_name")
    result = attach(rows, named, ["_label", "_vector"], "_id")
    return result.select("_id", F.coalesce("_all_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_name", "_id").alias("component_id"))
