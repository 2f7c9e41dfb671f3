"""Best signals, the cascaded join of records with dates, class lookup and first-wins choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import drug_name, strip

TEMPORAL = ["event_date", "year_month", "signal_type", "is_range"]
UNRELIABLE_URLS = ["openfda", "drugs.com", "reddit"]


def best_signal(order: str = "ord") -> Column:
    """Aggregate: the latest signal that is no study's end, if there is one; the first of equals."""
    is_end = F.coalesce(F.array_contains("signal_type", "study_end"), F.lit(False))
    return F.max_by(F.struct(*TEMPORAL), F.struct(~is_end, F.coalesce("event_date", F.lit("0000-00-00")), -F.col(order)))


def attach_dates(records: DataFrame, signals: DataFrame, order: str = "ord") -> DataFrame:
    """records with the best signal of (drug, source, id), else of the url where urls identify records, else of (drug, source).

    Signals are reduced to one row a key for each level before the joins, so no join multiplies rows; a level's values are
    taken as a whole.
    """
    key = lambda c: F.coalesce(strip(F.col(c).cast("string")), F.lit(""))
    keyed = lambda df: df.withColumn("_d", F.lower(key("drug_name"))).withColumn("_s", F.lower(key("source"))).withColumn("_i", key("source_id")).withColumn("_u", key("url"))
    s, d = keyed(signals), keyed(records)
    named = (F.col("_d") != "") & (F.col("_s") != "")
    by_id = s.filter(named & (F.col("_i") != "")).groupBy("_d", "_s", "_i").agg(best_signal(order).alias("_l1"))
    by_url = s.filter("_u <> ''").groupBy("_u").agg(best_signal(order).alias("_l2")).withColumnRenamed("_u", "_url")
    by_source = s.filter(named).groupBy("_d", "_s").agg(best_signal(order).alias("_l3"))
    url = F.when((F.col("_u") != "") & ~F.col("_s").isin(UNRELIABLE_URLS), F.col("_u"))
    d = d.withColumn("_url", url).join(by_id, ["_d", "_s", "_i"], "left").join(by_url, "_url", "left").join(by_source, ["_d", "_s"], "left")
    best = F.coalesce("_l1", "_l2", "_l3")
    d = d.withColumn("_best", best).withColumn("match_level", F.when(F.col("_l1").isNotNull(), 1).when(F.col("_l2").isNotNull(), 2).when(F.col("_l3").isNotNull(), 3).otherwise(0))
    none = {"signal_type": F.array().cast("array<string>"), "is_range": F.lit(False)}
    for c in TEMPORAL:
        d = d.withColumn(c, F.coalesce(F.col(f"_best.{c}"), none[c]) if c in none else F.col(f"_best.{c}"))
    return d.drop("_d", "_s", "_i", "_u", "_url", "_l1", "_l2", "_l3", "_best")


def drug_classes(drugs: DataFrame, order: str = "ord") -> DataFrame:
    """(name, drug_class): every drug and synonym in lower case, later rows over earlier ones."""
    names = drugs.withColumn("_names", F.concat(F.array(F.col("name")), F.coalesce("synonyms", F.array().cast("array<string>"))))
    names = names.select(F.explode("_names").alias("name"), "category", order).withColumn("name", drug_name(F.col("name"))).filter("name <> ''")
    return names.groupBy("name").agg(F.max_by("category", order).alias("drug_class"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def not_done(new: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been done."""
    return new.join(done.select(*keys).distinct(), keys, "left_anti")


def under_quota(candidates: DataFrame, stored: DataFrame, key: str, quota: int = 25) -> DataFrame:
    """Candidates whose key has fewer stored rows than the quota, with what remains."""
    have = stored.groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
    d = candidates.join(have, key, "left").withColumn("remaining", F.lit(quota) - F.coalesce("_have", F.lit(0)))
    return d.filter("remaining > 0").drop("_have")


def best_link(links: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, link): the first link that names the drug's first word, else the first link; (page, pos, href, text, drug_name)."""
    word = F.get(F.split(F.lower("drug_name"), " "), 0)
    names = F.contains(F.lower("href"), word) | F.contains(F.lower("text"), word)
    return links.groupBy(page).agg(F.min_by("href", F.struct(~names, F.col("pos"))).alias("link"))
