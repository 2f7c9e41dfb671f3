"""Anomaly detectors: adaptive rolling Z-score, isolation forest, local outlier factor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hof import let
from .features import COUPLE, fence_of
from .near import neighbours
from .stored import stored


def window_width(n: Column) -> Column:
    """Rows looked back at, by the length of the series."""
    part = lambda k: F.floor(n / k).cast("int")
    return F.when(n < 3, 0).when(n < 4, 1).when(n < 12, part(3)).when(n < 24, part(4)).otherwise(part(6))


def rolling_zscore(series: DataFrame) -> DataFrame:
    """Z-score of each row against the rows before it, and whether it is above its couple's Tukey fence.

    One shuffle by couple: the series is folded into a sorted array, so windows of any width, computed from its length, need no
    self-join. Rows before the first full window score 0 and are held against the fence too. Rows with a null key are left out.
    """
    rows = F.array_sort(F.collect_list(F.struct("period", "mention_count")))
    g = series.dropna(subset=COUPLE).groupBy(*COUPLE).agg(rows.alias("_s"))
    g = g.withColumn("_n", F.size("_s")).withColumn("_w", window_width(F.col("_n")))
    values = F.transform("_s", lambda e: e["mention_count"].cast("double"))

    def stats(x: Column) -> Column:
        def at(i: Column) -> Column:
            def of(h: Column) -> Column:
                mean = F.aggregate(h, F.lit(0.0), lambda a, v: a + v) / F.size(h)
                spread = lambda m: F.when(F.size(h) > 1, F.sqrt(F.aggregate(h, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (F.size(h) - 1)))
                scored = lambda m: let(spread(m), lambda s: F.struct(m.alias("mean"), s.alias("std"), F.when(s > 0, (F.get(x, i) - m) / s).otherwise(0.0).alias("z")))
                return let(mean, scored)

            return F.when((F.col("_w") > 0) & (i >= F.col("_w")), let(F.slice(x, i - F.col("_w") + 1, F.col("_w")), of))

        return F.transform(F.sequence(F.lit(0), F.size(x) - 1), at)

    g = g.withColumn("_t", let(values, stats))
    g = g.withColumn("_z", F.transform("_t", lambda t: F.coalesce(F.bround(t["z"], 4), F.lit(0.0))))

    def fence(z: Column) -> Column:
        def quantile(p: float) -> Column:
            at = (F.size(z) - 1) * p
            low, high, part = F.get(z, F.floor(at).cast("int")), F.get(z, F.ceil(at).cast("int")), at - F.floor(at)
            # from the nearer end, so that equal steps give equal quantiles: a score at the fence is not above it
            return F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))

        return quantile(0.75) + 1.5 * (quantile(0.75) - quantile(0.25))

    tail = F.sort_array(F.slice(F.col("_z"), F.col("_w") + 1, F.greatest(F.col("_n") - F.col("_w"), F.lit(0))))
    g = g.withColumn("_fence", F.when((F.col("_w") > 0) & (F.col("_n") > F.col("_w")), let(tail, fence)))
    out = g.select(*COUPLE, "_n", "_w", "_fence", F.explode(F.arrays_zip("_s", "_t", "_z")).alias("r"))
    method = F.when(F.col("_w") > 0, F.format_string("zscore_rolling_auto_%dmois", F.col("_w"))).otherwise("trop_court")
    return out.select(
        *COUPLE, F.col("r._s.period").alias("period"), F.col("r._s.mention_count").alias("mention_count"), F.bround("r._t.mean", 4).alias("rolling_mean"), F.bround("r._t.std", 4).alias("rolling_std"),
        F.col("r._z").alias("z_score_rolling"), F.coalesce(F.col("r._z") > F.col("_fence"), F.lit(False)).alias("is_anomaly"), F.col("_w").alias("window_used"), method.alias("method"),
    )


# ---- isolation forest ----


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Append a random tree on x to nodes (feature, split, left, right, rows); returns its root."""
    me = len(nodes)
    nodes.append([-1, 0.0, -1, -1, len(x)])
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth >= limit or not len(spread):
        return me
    feature = int(rng.choice(spread))
    split = float(rng.uniform(x[:, feature].min(), x[:, feature].max()))
    below = x[:, feature] <= split
    nodes[me][:2] = feature, split
    nodes[me][2] = _grow(x[below], rng, depth + 1, limit, nodes)
    nodes[me][3] = _grow(x[~below], rng, depth + 1, limit, nodes)
    return me


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    more = 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, more, np.where(n == 2, 1.0, 0.0))


def isolation_forest(df: DataFrame, features: list[str], trees: int = 100, rows: int = 256, seed: int = 42) -> DataFrame:
    """df with if_score (2 to the minus mean path over its expectation) and if_anomaly (0/1: above Tukey's upper fence).

    Trees are grown on bounded samples (trees x rows at most), so the model is small whatever the data; scoring is Arrow
    batches against the broadcast trees.
    """
    spark = df.sparkSession
    order = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))
    sample = df.select(*[F.col(c).cast("double") for c in features], order.alias("_o")).orderBy("_o").limit(trees * rows).drop("_o").toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(rows, len(sample))
    forest = []
    for _ in range(trees if size else 0):
        nodes: list = []
        _grow(sample[rng.choice(len(sample), size, replace=False)], rng, 0, int(np.ceil(np.log2(max(size, 2)))), nodes)
        forest.append(np.array(nodes))
    shared = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            x = np.column_stack([c.to_numpy(float) for c in columns])
            total = np.zeros(len(x))
            for tree in shared.value:
                at, depth = np.zeros(len(x), int), np.zeros(len(x))
                while (inner := tree[at, 0] >= 0).any():
                    rows_in = np.flatnonzero(inner)
                    node = tree[at[rows_in]]
                    below = x[rows_in, node[:, 0].astype(int)] <= node[:, 1]
                    at[rows_in] = np.where(below, node[:, 2], node[:, 3]).astype(int)
                    depth[rows_in] += 1
                total += depth + _mean_path(tree[at, 4])
            yield pd.Series(2.0 ** (-total / max(len(shared.value), 1) / max(float(_mean_path(np.array([size]))[0]), 1e-9)))

    scored = stored(df.withColumn("if_score", score(*[F.col(c).cast("double") for c in features])), "forest-scores")
    return scored.withColumn("if_anomaly", (F.col("if_score") > F.lit(fence_of(scored, "if_score")).cast("double")).cast("int"))


# ---- local outlier factor ----


def local_outlier_factor(points: DataFrame, key: str, features: list[str], k: int = 30, threshold: float = 1.5, search=neighbours) -> DataFrame:
    """(key, lof_score, is_anomaly): density of the neighbours over one's own, from k-distances and reach distances by joins."""
    near = search(points, key, features, k)
    far = near.groupBy("key").agg(F.max("distance").alias("k_distance"))
    reach = near.join(far.withColumnRenamed("key", "neighbour"), "neighbour").withColumn("reach", F.greatest("distance", "k_distance"))
    density = reach.groupBy("key").agg((1.0 / (F.avg("reach") + 1e-10)).alias("density"))
    around = near.join(density.withColumnRenamed("key", "neighbour").withColumnRenamed("density", "near_density"), "neighbour").groupBy("key").agg(F.avg("near_density").alias("around"))
    lof = around.join(density, "key").select(F.col("key"), (F.col("around") / F.col("density")).alias("lof_score"))
    return lof.withColumn("is_anomaly", F.col("lof_score") > threshold)
