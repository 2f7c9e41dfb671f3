"""Votes of the detectors and clusterers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import KEY


def assemble(keys: DataFrame, zscore: DataFrame, iforest: DataFrame, lof: DataFrame) -> DataFrame:
    """One row a key with the three detectors' votes; a detector that says nothing of a key votes no."""
    vote = lambda df, flag, name: df.groupBy(*KEY).agg(F.max(F.col(flag).cast("int")).alias(name))
    d = keys.select(*KEY).dropDuplicates()
    for df, flag, name in ((zscore, "is_anomaly", "zscore_anomaly"), (iforest, "if_anomaly", "iforest_anomaly"), (lof, "is_anomaly", "lof_anomaly")):
        d = d.join(vote(df, flag, name), KEY, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)) > 0)
    return d


def alert_levels(votes: DataFrame) -> DataFrame:
    """nb_algos and alert_level of rows with zscore_anomaly, iforest_anomaly and lof_anomaly."""
    n = sum((F.coalesce(F.col(f"{d}_anomaly").cast("int"), F.lit(0)) for d in ("lof", "iforest", "zscore")), F.lit(0))
    d = votes.withColumn("nb_algos", n)
    level = F.when(F.col("nb_algos") == 3, "CRITIQUE").when(F.col("nb_algos") == 2, "ELEVEE").when(F.col("nb_algos") == 1, "MODEREE").otherwise("NORMAL")
    return d.withColumn("alert_level", level)


def fuse_clusters(kmeans: DataFrame, agglo: DataFrame, hdbscan: DataFrame) -> DataFrame:
    """The three clusterings side by side for k-means' keys; -2 where another has none."""
    d = kmeans.select(*KEY, "kmeans_cluster").join(agglo.select(*KEY, "agglo_cluster"), KEY, "left").join(hdbscan.select(*KEY, "hdbscan_cluster"), KEY, "left")
    return d.select(*KEY, *[F.coalesce(f"{c}_cluster", F.lit(-2)).cast("int").alias(f"{c}_cluster") for c in ("kmeans", "agglo", "hdbscan")])


def duplicate_keys(df: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.agg((F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("duplicates"))
