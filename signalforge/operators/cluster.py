"""Clusterers of couple features and their quality: k-means, Ward, density-based, PCA."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import density, near
from . import ward as ward_tree
from .features import COUPLE, KEY
from .stored import stored

def assembled(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_v").transform(df)


def kmeans(df: DataFrame, columns: list[str], k: int = 4, starts: int = 10, seed: int = 42, name: str = "kmeans_cluster") -> DataFrame:
    """df with the clustering of the least cost of several starts; clusters numbered by their first coordinates."""
    v = stored(assembled(df, columns), "assembled")
    v = v.coalesce(max(1, min(v.rdd.getNumPartitions(), v.count() // 20_000 + 1))).cache()  # starts x iterations jobs: no idle tasks on few rows
    fit = lambda s: KMeans(k=k, seed=seed + s, featuresCol="_v", predictionCol="_p").fit(v)
    with ThreadPoolExecutor(min(starts, 5)) as threads:  # the starts do not depend on each other: their jobs share the cluster
        models = list(threads.map(fit, range(starts)))
    best = min(models, key=lambda m: m.summary.trainingCost)
    order = np.lexsort(np.array(best.clusterCenters()).T[::-1])
    number = F.create_map(*[F.lit(x) for old, new in zip(order.tolist(), range(len(order)), strict=True) for x in (old, new)])
    v.unpersist()
    return best.transform(v).withColumn(name, number[F.col("_p")]).drop("_v", "_p")


def _places(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with its point _x, the different points as (id, x, n)); couples without one, a coordinate being no number, have no place."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    d = stored(df.withColumn("_x", F.when(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v)), x)), "couples")
    places = d.filter("_x IS NOT NULL").groupBy(F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    return d, stored(places.withColumn("id", F.monotonically_increasing_id()), "couple-places")


def _named(d: DataFrame, places: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """d with the cluster of its place, clusters being numbered by their first couple."""
    by_place = places.select("id", F.col("x").alias("_x")).join(found.filter("cluster IS NOT NULL"), "id").select("_x", "cluster")
    d = stored(d.join(by_place, "_x", "left").drop("_x"), "clustered")
    firsts = d.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct(*COUPLE)).alias("_first")).orderBy("_first").collect()  # as many as clusters
    number = d.sparkSession.createDataFrame([(r.cluster, k) for k, r in enumerate(firsts)], f"cluster long, {name} int")
    return d.join(F.broadcast(number), "cluster", "left").drop("cluster")


def ward(df: DataFrame, columns: list[str], k: int = 4, **options) -> DataFrame:
    """df with agglo_cluster: Ward's k clusters; null where a coordinate is no number."""
    d, places = _places(df, columns)
    return _named(d, places, ward_tree.labelled(places, k, **options), "agglo_cluster")


def principal(df: DataFrame, columns: list[str], keep: float = 0.95) -> tuple[DataFrame, int]:
    """df with pc (array of as many components as explain that share of the variance) and their number."""
    v = assembled(df, columns)
    model = PCA(k=len(columns), inputCol="_v", outputCol="_pc").fit(v)
    n = int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), keep) + 1)
    n = min(n, len(columns))
    return model.transform(v).withColumn("pc", F.slice(vector_to_array("_pc"), 1, n)).drop("_v", "_pc"), n


def hdbscan(df: DataFrame, columns: list[str], least: int = 100, samples: int = 20, cell: int = near.CELL) -> DataFrame:
    """df with hdbscan_cluster: density clusters; -1 outside, and where a coordinate is no number."""
    d, places = _places(df, columns)
    # equal points have equal cores: each place is asked for as often as it has points, up to `samples` + 1
    members = places.select("id", F.posexplode(F.sequence(F.lit(0), F.least(F.col("n"), F.lit(samples + 1)).cast("int") - 1)).alias("_at", "_k"), "x")
    members = members.select(F.concat_ws(":", "id", "_k").alias("_member"), *[F.get("x", k).alias(c) for k, c in enumerate(columns)])
    far = near.neighbours(members, "_member", columns, samples, cell=cell).groupBy(F.split_part("key", F.lit(":"), F.lit(1)).cast("long").alias("id")).agg(F.max("distance").alias("core"))
    places = stored(places.join(far, "id", "left").fillna(0.0, ["core"]), "density-places")  # one point alone has no neighbour
    found = density.labelled(places, density.spanning_tree(places.select("id", "x", "core"), cell), least)
    return _named(d, places, found, "hdbscan_cluster").fillna(-1, ["hdbscan_cluster"])


def to_periods(series: DataFrame, labelled: DataFrame, name: str, default: int | None = None) -> DataFrame:
    """The couples' clusters on each of their periods."""
    d = series.select(*KEY).dropDuplicates().join(labelled.select(*COUPLE, name), COUPLE, "left")
    return d.withColumn(name, F.coalesce(F.col(name), F.lit(default)).cast("int")) if default is not None else d


def quality(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """One row: Calinski-Harabasz and Davies-Bouldin indices and the simplified silhouette over centres."""
    d = df.filter(F.col(label) >= 0)
    centres = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_c_{c}") for c in columns])
    total = d.agg(F.count(F.lit(1)).alias("_all"), *[F.avg(c).alias(f"_g_{c}") for c in columns])
    c = centres.crossJoin(F.broadcast(total))
    gap = lambda a, b: sum(((F.col(a.format(x)) - F.col(b.format(x))) ** 2 for x in columns), F.lit(0.0))
    between = c.agg(F.sum(F.col("_n") * gap("_c_{}", "_g_{}")).alias("_between"), F.count(F.lit(1)).alias("_k"), F.max("_all").alias("_rows"))
    own = d.join(F.broadcast(centres), label).withColumn("_d2", gap("{}", "_c_{}"))
    spread = own.groupBy(label).agg(F.sum("_d2").alias("_within"), F.avg(F.sqrt("_d2")).alias("_s"))
    sums = spread.agg(F.sum("_within").alias("_w"))
    sized = centres.join(spread, label)
    other = sized.select(F.col(label).alias("_other"), F.col("_s").alias("_s2"), *[F.col(f"_c_{x}").alias(f"_o_{x}") for x in columns])
    ratio = sized.join(F.broadcast(other), F.col(label) != F.col("_other")).groupBy(label).agg(F.max((F.col("_s") + F.col("_s2")) / F.sqrt(gap("_c_{}", "_o_{}"))).alias("_r"))
    index = (F.col("_between") / (F.col("_k") - 1)) / (F.col("_w") / (F.col("_rows") - F.col("_k")))
    return between.crossJoin(sums).crossJoin(ratio.agg(F.avg("_r").alias("davies_bouldin"))).select(index.alias("calinski_harabasz"), "davies_bouldin", F.col("_k").alias("clusters"))


def silhouette(df: DataFrame, columns: list[str], label: str) -> float:
    """Silhouette by squared Euclidean distance."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    return ClusteringEvaluator(featuresCol="_v", predictionCol=label, metricName="silhouette").evaluate(assembled(df.filter(F.col(label) >= 0), columns))
