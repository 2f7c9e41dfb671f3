"""Couple statistics and model features of monthly mention series (drug, side_effect, period, mention_count)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import discard, stored

COUPLE = ["drug", "side_effect"]
KEY = [*COUPLE, "period"]
ROW_FEATURES = ["mention_count", "mean_count", "std_count", "total_mentions", "num_periods", "month"]
COUPLE_FEATURES = ["mean_count", "std_count", "num_periods", "max_count", "min_count", "cv", "year_last", "month_last"]


def mentions(records: DataFrame) -> DataFrame:
    """Mentions of each drug, side effect and month: one for each document and distinct effect; undated ones are left out."""
    rows = records.filter("year_month is not null").select(F.col("drug_name").alias("drug"), F.col("year_month").alias("period"), F.explode(F.array_distinct("side_effects")).alias("side_effect"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("mention_count"))


def year_month(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.expr("try_cast(substring(period, 1, 4) as int)")).withColumn("month", F.expr("try_cast(substring(period, 6, 2) as int)"))


def couple_stats(series: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one period), total, number, extremes, variation and last period of each couple."""
    last = F.max_by(F.struct("year", "month"), "period")
    g = year_month(series).groupBy(*COUPLE).agg(
        F.avg("mention_count").alias("mean_count"), F.coalesce(F.stddev_samp("mention_count"), F.lit(0.0)).alias("std_count"), F.sum("mention_count").alias("total_mentions"),
        F.count("mention_count").alias("num_periods"), F.max("mention_count").alias("max_count"), F.min("mention_count").alias("min_count"), last.alias("_last"),
    )
    cv = F.when(F.col("mean_count") > 0, F.col("std_count") / F.greatest("mean_count", F.lit(1.0))).otherwise(0.0)
    return g.withColumn("cv", cv).withColumn("year_last", F.col("_last.year")).withColumn("month_last", F.col("_last.month")).drop("_last")


def row_features(series: DataFrame) -> DataFrame:
    """series with its couple's statistics on every row: windows over one shuffle instead of a join back."""
    w = Window.partitionBy(*COUPLE)
    stats = {"mean_count": F.avg("mention_count"), "std_count": F.stddev_samp("mention_count"), "total_mentions": F.sum("mention_count"), "num_periods": F.count("mention_count")}
    df = year_month(series)
    for name, value in stats.items():
        value = value.over(w)
        df = df.withColumn(name, F.coalesce(value, F.lit(0.0)) if name == "std_count" else value)
    return df


def scaled(df: DataFrame, columns: list[str], digits: int | None = None, flat: float = 0.0) -> DataFrame:
    """Columns less their mean over their population deviation; constant columns are `flat`. One aggregate, broadcast as one row."""
    stats = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))
    for c in columns:
        value = F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(flat))
        out = out.withColumn(f"z_{c}", F.round(value, digits) if digits is not None else value)
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def exact_quantiles(df: DataFrame, column: str, shares: list[float], parts: int | None = None) -> list[float | None]:
    """Interpolated quantiles of a column by rank selection: no task holds more than a range of the different values.

    Equal values are counted first, so a value that a third of the rows have is one row. The counts are dealt by range, summed a range, and only
    the ranges that hold a wanted rank are looked into. None without values; nulls and NaN are left out.
    """
    spark = df.sparkSession
    value = F.col(column).cast("double")
    counts = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = stored(counts.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "value-ranges")
    sizes = ranges.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("least")).orderBy("least").collect()  # a row a range
    total = sum(r.n for r in sizes)
    if not total:
        return [None] * len(shares)
    places = [share * (total - 1) for share in shares]
    wanted = sorted({int(np.floor(p)) for p in places} | {int(np.ceil(p)) for p in places})
    before = {r.part: int(b) for r, b in zip(sizes, np.cumsum([0] + [r.n for r in sizes[:-1]]), strict=True)}
    held = {r.part for r in sizes if any(before[r.part] <= k < before[r.part] + r.n for k in wanted)}
    first = spark.createDataFrame([(part, before[part]) for part in held], "part int, before long")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("before")
    ranked = ranges.join(F.broadcast(first), "part").withColumn("last", upto).withColumn("first", F.col("last") - F.col("n"))
    at = ranked.select("v", "first", "last").filter(F.exists(F.array(*[F.lit(k) for k in wanted]), lambda k: (F.col("first") <= k) & (k < F.col("last")))).collect()
    discard(ranges)
    found = {k: next(r.v for r in at if r.first <= k < r.last) for k in wanted}
    between = lambda p, low, high: found[low] if low == high else (high - p) * found[low] + (p - low) * found[high]
    return [float(between(p, int(np.floor(p)), int(np.ceil(p)))) for p in places]


def fence_of(df: DataFrame, column: str) -> float | None:
    """Tukey's upper fence of all of a column."""
    low, high = exact_quantiles(df, column, [0.25, 0.75])
    return None if low is None else high + 1.5 * (high - low)


def upper_fence(values: Column) -> Column:
    """Tukey's upper fence of each group as an aggregate, quartiles interpolated; of a whole table fence_of() is the one to use."""
    quartiles = F.percentile(values, [0.25, 0.75])
    return quartiles[1] + 1.5 * (quartiles[1] - quartiles[0])


def coerced(c: Column) -> Column:
    """A number, 0 where it is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))
