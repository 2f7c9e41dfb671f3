"""Rule-based quality of normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCES = ["pubmed", "openfda", "clinicaltrials", "drugs.com", "medlineplus", "reddit", "webmd"]
FIELDS = ["drug_name", "source", "text_clean", "side_effects"]


def flag_records(records: DataFrame) -> DataFrame:
    """quality_score (100 less penalties, 0 at least), quality_label, flags in rule order, text_length, has_side_effects. Null is missing."""
    text_length = F.coalesce(F.length("text_clean"), F.lit(0))
    no_effects = F.coalesce(F.size("side_effects"), F.lit(0)) <= 0
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    missing = {f: no_effects if f == "side_effects" else empty(f) for f in FIELDS}
    authority = F.coalesce("source_authority", F.lit(0.0))
    unknown = ~F.coalesce(F.col("source").isin(SOURCES), F.lit(False))
    names = F.array_compact(F.array(*[F.when(m, F.lit(f)) for f, m in missing.items()]))
    any_missing = F.size(names) > 0
    rules: list[tuple[Column, Column | str, int]] = [
        (text_length < 50, "text_too_short", 15), ((text_length >= 50) & (text_length < 100), "text_short", 5), (no_effects, "no_side_effects", 10),
        (authority == 0, "no_authority_score", 5), ((authority != 0) & (authority < 0.1), "low_authority", 5), (empty("drug_name"), "missing_drug_name", 20), (unknown, "unknown_source", 10),
    ]
    flags = [F.when(any_missing, F.concat(F.lit("missing_fields:"), F.array_join(names, ",")))] + [F.when(c, F.lit(f)) for c, f, _ in rules]
    penalty = F.size(names) * 10 + sum((F.when(c, p).otherwise(0) for c, _, p in rules), F.lit(0))
    d = records.withColumn("quality_score", F.greatest(F.lit(0), 100 - penalty))
    label = F.when(F.col("quality_score") >= 80, "good").when(F.col("quality_score") >= 50, "medium").otherwise("poor")
    return d.withColumn("quality_label", label).withColumn("flags", F.array_compact(F.array(*flags))).withColumn("text_length", text_length).withColumn("has_side_effects", ~no_effects)


def summary(flagged: DataFrame) -> DataFrame:
    """Records, and the share of each label in percent."""
    share = lambda label: F.round(F.count_if(F.col("quality_label") == label) * 100.0 / F.count(F.lit(1)), 1).alias(f"pct_{label}")
    return flagged.agg(F.count(F.lit(1)).alias("records"), *[share(x) for x in ("good", "medium", "poor")])


def top_flags(flagged: DataFrame, n: int = 10) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("records")).orderBy(F.desc("records"), "flag").limit(n)
