"""Write semantics: keyed upserts by union and rank, first-wins inserts, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import exists

# Sources whose ids identify their records.
PRIORITY = ["reddit", "drugs.com", "openfda", "pubmed", "clinicaltrials"]


def last_wins(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored with new rows set over it field by field: a key's fields take the latest value that is not null."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rank = F.struct("_new", order)
    values = [c for c in both.columns if c not in (*keys, "_new")]
    return both.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in values])


def first_wins(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """stored and those new rows whose key is not there yet, one a key."""
    fresh = new.join(stored.select(*keys), keys, "left_anti")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return stored.unionByName(fresh.withColumn("_rank", rank).filter("_rank = 1").drop("_rank"))


def content_hash(columns: list[str]) -> Column:
    """16 hex digits of the columns in name order."""
    return F.substring(F.sha1(F.to_json(F.struct(*sorted(columns)))), 1, 16)


def record_key(columns: list[str]) -> Column:
    """What identifies a normalised record: the source's id for some sources, else the url, else the id, else its content."""
    sid, url = (F.nullif(F.col(c), F.lit("")) for c in ("source_id", "url"))
    by_id = F.concat(F.lit("id:"), sid)
    return F.coalesce(F.when(F.col("source").isin(PRIORITY), by_id), F.concat(F.lit("url:"), url), by_id, F.concat(F.lit("hash:"), content_hash(columns)))


def enriched_key(unreliable: list[str]) -> Column:
    """What identifies an enriched record: urls only where they are reliable, and the event date at last."""
    sid, url = (F.nullif(F.col(c), F.lit("")) for c in ("source_id", "url"))
    by_id = F.concat(F.lit("id:"), sid)
    return F.coalesce(F.when(F.col("source").isin(PRIORITY), by_id), F.when(~F.col("source").isin(unreliable), F.concat(F.lit("url:"), url)), by_id, F.concat(F.lit("date:"), F.coalesce("event_date", F.lit(""))))


def checked_unique(new: DataFrame, keys: list[list[str]], there: DataFrame | None = None) -> DataFrame:
    """new, whose writing fails if a key repeats among its rows and those there; a key with a null part is not checked.

    The check is part of the plan: the one row that every row of new is joined with raises the error, so a job that would break a key ends
    before it commits.
    """
    out = new
    for key in keys:
        rows = new.select(*key) if there is None else new.select(*key).unionByName(there.select(*key))
        repeated = rows.dropna(subset=key).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.count(F.lit(1)).alias("_n"))
        ok = F.assert_true(F.col("_n") == 0, F.concat(F.lit(f"repeated key ({', '.join(key)}): "), F.col("_n").cast("string")))
        out = out.crossJoin(F.broadcast(repeated)).withColumn("_ok", ok).filter("_ok IS NULL").drop("_n", "_ok")  # one row: the count
    return out


def append_unique(new: DataFrame, path: str, keys: list[list[str]]) -> None:
    """Append to a table whose keys are unique where they are not null; if one would repeat, the table stays as it was."""
    spark = new.sparkSession
    there = spark.read.schema(new.schema).parquet(path) if exists(spark, path) else None
    checked_unique(new, keys, there).write.mode("append").parquet(path)


def replace_source(stored: DataFrame, new: DataFrame, sources: list[str]) -> DataFrame:
    """stored without the sources' rows, and the new ones: what a dynamic partition overwrite by source leaves."""
    return stored.filter(~F.coalesce(F.col("source").isin(sources), F.lit(False))).unionByName(new)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_by_source(df: DataFrame, path: str) -> None:
    """Overwrites the partitions of the sources that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
