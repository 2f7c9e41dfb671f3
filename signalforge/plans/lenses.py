"""The driver's tables seen as the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon

EFFECTS, SYMPTOMS = sorted(lexicon.SIDE_EFFECTS), sorted(lexicon.SYMPTOMS)
SOURCES = ["reddit", "openfda", "pubmed", "clinicaltrials", "drugs.com", "webmd", "medlineplus", "vigiaccess"]
DATES = ["2020-01-05", "2021/7/9", "March 5, 2022", "5 Mar 2023", "2024-02-30", "2018-12-31", "seen 2021-11-02 again", "2025"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _array(values: list[str]):
    return F.array(*[F.lit(v) for v in values])


def series(spark: SparkSession, d: str, lens: str = "medium") -> DataFrame:
    """data_aggregation: brand x name (medium), brand x type (long), part x return flag (short)."""
    items = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", F.date_format("l_shipdate", "yyyy-MM").alias("period"))
    if lens == "short":
        keyed = items.select(F.col("l_partkey").cast("string").alias("drug"), F.col("l_returnflag").alias("side_effect"), "period")
    else:
        part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("drug"), F.col("p_name" if lens == "medium" else "p_type").alias("side_effect"))
        # a part's months are counted before the join: its key is no longer skewed, and fewer rows meet
        counts = items.groupBy("l_partkey", "period").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(part, counts.l_partkey == part.p_partkey).groupBy("drug", "side_effect", "period").agg(F.sum("n").alias("mention_count"))
    return keyed.groupBy("drug", "side_effect", "period").agg(F.count(F.lit(1)).alias("mention_count"))


SERIES_SQL = {
    "medium": "SELECT p_brand AS drug, p_name AS side_effect, strftime(l_shipdate, '%Y-%m') AS period, count(*) AS mention_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "long": "SELECT p_brand AS drug, p_type AS side_effect, strftime(l_shipdate, '%Y-%m') AS period, count(*) AS mention_count FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "short": "SELECT CAST(l_partkey AS VARCHAR) AS drug, l_returnflag AS side_effect, strftime(l_shipdate, '%Y-%m') AS period, count(*) AS mention_count FROM lineitem GROUP BY ALL",
}


def raw_documents(spark: SparkSession, d: str) -> DataFrame:
    """documents as raw records: text with terms, doses, markup and dates put in by the id."""
    i = F.col("doc_id")
    effect = lambda k: F.element_at(_array(EFFECTS), ((i * k) % len(EFFECTS) + 1).cast("int"))
    symptom = F.element_at(_array(SYMPTOMS), (i % len(SYMPTOMS) + 1).cast("int"))
    words = F.concat(
        F.col("text"), F.lit(" Patients reported "), effect(1), F.lit(" and <i>"), symptom, F.lit("</i> after taking "), (i % 90 + 10).cast("string"), F.lit(" mg daily. May cause "), effect(7), F.lit(".  The end "),
    )
    return table(spark, d, "documents").select(
        "doc_id", F.element_at(_array(SOURCES), (i % 8 + 1).cast("int")).alias("source"), F.concat(F.lit(" Drug"), (i % 17).cast("string")).alias("drug_name"), words.alias("text"),
        F.element_at(_array(DATES), (F.floor(i / 8) % 8 + 1).cast("int")).alias("review_date"), F.when(i % 3 > 0, F.concat(F.lit("http://x/"), (i % 50).cast("string"))).alias("url"), (i % 40).cast("string").alias("source_id"),
    )


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


RAW_SQL = (
    "SELECT doc_id, " + _list_sql(SOURCES) + "[doc_id % 8 + 1] AS source, ' Drug' || (doc_id % 17) AS drug_name, text || ' Patients reported ' || " + _list_sql(EFFECTS) + f"[doc_id % {len(EFFECTS)} + 1] || ' and <i>' || "
    + _list_sql(SYMPTOMS) + f"[doc_id % {len(SYMPTOMS)} + 1] || '</i> after taking ' || (doc_id % 90 + 10) || ' mg daily. May cause ' || " + _list_sql(EFFECTS) + f"[(doc_id * 7) % {len(EFFECTS)} + 1] || '.  The end ' AS text, "
    + _list_sql(DATES) + "[(doc_id // 8) % 8 + 1] AS review_date, CASE WHEN doc_id % 3 > 0 THEN 'http://x/' || (doc_id % 50) END AS url, CAST(doc_id % 40 AS VARCHAR) AS source_id FROM documents"
)
