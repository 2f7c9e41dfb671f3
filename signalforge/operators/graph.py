"""Source authority by hubs and authorities."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import discard, scratch, stored

# Who cites whom, and how sources are called.
CITATIONS = [
    ("medlineplus", "pubmed"), ("medlineplus", "clinicaltrials"), ("medlineplus", "openfda"), ("webmd", "pubmed"), ("webmd", "clinicaltrials"), ("webmd", "openfda"),
    ("webmd", "vigiaccess"), ("webmd", "medlineplus"), ("clinicaltrials", "pubmed"), ("openfda", "pubmed"), ("openfda", "clinicaltrials"), ("vigiaccess", "pubmed"),
    ("vigiaccess", "openfda"), ("drugscom", "webmd"), ("drugscom", "medlineplus"), ("drugscom", "openfda"), ("reddit", "webmd"), ("reddit", "drugscom"),
]
VARIANTS = {
    "pubmed": ["pubmed"], "clinicaltrials": ["clinicaltrials", "clinicaltrials.gov", "ct.gov"], "openfda": ["openfda", "fda", "faers"], "vigiaccess": ["vigiaccess", "who", "oms"],
    "medlineplus": ["medlineplus", "nlm"], "webmd": ["webmd"], "drugscom": ["drugs.com", "drugscom"], "reddit": ["reddit"],
}


def citations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CITATIONS, "hub string, authority string")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(hub, authority) of pages: each page's host and what its links name: the host of a whole address, else the path as it is written."""
    host = lambda c: F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    found = pages.select(host(F.col(url)).alias("hub"), F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("_to"))
    target = F.when(F.col("_to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), host(F.col("_to"))).otherwise(F.regexp_extract("_to", r"^[^?#]*", 0))
    return found.select("hub", target.alias("authority")).filter("hub <> '' AND authority <> '' AND hub <> authority").distinct()


def write_graph(edges: DataFrame, path: str) -> None:
    """Node and edge tables: nodes with their numbers of links out and in, edges once each. Written anew: a rerun leaves the same tables."""
    edges = stored(edges.dropna().distinct(), "edges")
    out = edges.groupBy(F.col("hub").alias("node")).agg(F.count(F.lit(1)).alias("links_out"))
    into = edges.groupBy(F.col("authority").alias("node")).agg(F.count(F.lit(1)).alias("links_in"))
    out.join(into, "node", "full").fillna(0, ["links_out", "links_in"]).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    discard(edges)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_scores(scores: DataFrame, path: str) -> None:
    """The scores beside the graph's tables, in place of earlier ones."""
    scores.write.mode("overwrite").parquet(f"{path}/scores")


def hits(edges: DataFrame, iterations: int = 100, tolerance: float = 1e-6, every: int = 4) -> DataFrame:
    """(source, authority_score, hub_score, source_type) of a graph (hub, authority), scores over their maximum, 4 digits.

    Power iteration. The edges are written once, dealt and sorted by hub and by authority (bucketed tables), so a step shuffles sums for nodes but
    no edges. Steps are planned `every` at a time and written; only norms and the change since the last ones come to the driver.
    """
    spark = edges.sparkSession
    name = f"hits_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = stored(edges.dropna().distinct(), "edges")
    for end in ("hub", "authority"):
        base.write.bucketBy(parts, end).sortBy(end).option("path", f"{scratch(spark)}/{name}_{end}").saveAsTable(f"{name}_{end}")
    by_hub, by_authority = spark.table(f"{name}_hub"), spark.table(f"{name}_authority")
    nodes = stored(base.select(F.col("hub").alias("node")).union(base.select("authority")).distinct(), "nodes")
    scores = nodes.select("node", F.lit(1.0).alias("a"), F.lit(1.0).alias("h"))
    done = 0
    while done < iterations:
        h = scores.select(F.col("node").alias("hub"), "h")
        for _ in range(min(every, iterations - done)):  # scaling changes no direction: the sums of a few steps are scaled at once
            a = by_hub.join(h, "hub").groupBy("authority").agg(F.sum("h").alias("a"))
            h = by_authority.join(a, "authority").groupBy("hub").agg(F.sum("a").alias("h"))
            done += 1
        both = nodes.join(a.withColumnRenamed("authority", "node"), "node", "left").join(h.withColumnRenamed("hub", "node"), "node", "left").fillna(0.0, ["a", "h"])
        sums = stored(both.join(scores.withColumnsRenamed({"a": "a0", "h": "h0"}), "node"), "scores")
        dot = lambda x, y: F.sum(F.col(x) * F.col(y))
        s = sums.agg(*[dot(x, y).alias(x + y) for x, y in (("a", "a"), ("h", "h"), ("a", "a0"), ("h", "h0"), ("a0", "a0"), ("h0", "h0"))]).first()
        norm = {"a": math.sqrt(s.aa or 0), "h": math.sqrt(s.hh or 0)}
        unit = lambda x: (F.col(x) / norm[x] if norm[x] else F.lit(0.0)).alias(x)  # noqa: E731, B023
        new = sums.select("node", unit("a"), unit("h"))
        gone = lambda x: math.sqrt(max(0.0, (1 - 2 * s[f"{x}{x}0"] / norm[x] if norm[x] else 0.0) + (s[f"{x}0{x}0"] or 0)))  # noqa: E731, B023
        change = gone("a") + gone("h")
        scores = new
        if change < tolerance:
            break
    for end in ("hub", "authority"):
        discard(spark.table(f"{name}_{end}"))
        spark.sql(f"DROP TABLE {name}_{end}")
    discard(base)
    top = scores.agg(F.max("a").alias("ma"), F.max("h").alias("mh"))
    over = lambda x, m: F.bround(F.when(F.col(m) > 0, F.col(x) / F.col(m)).otherwise(0.0), 4)
    out = scores.crossJoin(F.broadcast(top)).select(F.col("node").alias("source"), over("a", "ma").alias("authority_score"), over("h", "mh").alias("hub_score"))
    return out.withColumn("source_type", F.when(F.col("authority_score") >= 0.5, "authority").otherwise("hub"))


def plain_source(c: Column) -> Column:
    return F.translate(F.lower(c), ".- ", "")


def source_authority(records: DataFrame, scores: DataFrame, source: str = "source") -> DataFrame:
    """records with source_authority and source_type: the exact source without . - and spaces, else the first one that contains it
    or is contained in it (so an empty source matches the first); none: 0.5, hub. Few sources: looked up once for each distinct name."""
    names = records.select(F.col(source).alias("_name")).distinct().withColumn("_plain", plain_source(F.coalesce(F.col("_name"), F.lit(""))))
    near = F.contains(F.col("source"), F.col("_plain")) | F.contains(F.col("_plain"), F.col("source"))
    found = names.join(F.broadcast(scores), near, "left").groupBy("_name").agg(F.min_by(F.struct("authority_score", "source_type"), F.struct(F.col("source") != F.col("_plain"), F.col("source"))).alias("_hit"))
    d = records.join(found, records[source].eqNullSafe(found["_name"]), "left")
    return d.withColumn("source_authority", F.coalesce("_hit.authority_score", F.lit(0.5))).withColumn("source_type", F.coalesce("_hit.source_type", F.lit("hub"))).drop("_name", "_hit")


def variants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, k) for k, vs in VARIANTS.items() for v in vs], "variant string, source string")


def update_authority(records: DataFrame, scores: DataFrame) -> DataFrame:
    """records with the scores of the source that their source's name is a variant of; others keep what they have."""
    known = variants(records.sparkSession).join(scores, "source").select("variant", F.col("authority_score").alias("_a"), F.col("source_type").alias("_t"))
    d = records.join(F.broadcast(known), F.col("source") == F.col("variant"), "left")
    return d.withColumn("source_authority", F.coalesce("_a", "source_authority")).withColumn("source_type", F.coalesce("_t", "source_type")).drop("variant", "_a", "_t")
