"""Dated signals of raw records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.text import drug_name, filled
from ..operators.enrich import attach_dates
from ..operators.stored import discard, exists, stored
from ..sources.xml import dates as xml_dates
from .normalise import by_source, conform

#: Sources that dates are taken from, and what their signals are.
TYPES = {"reddit": ["patient_review", "side_effect_report"], "openfda": ["side_effect_report"], "pubmed": ["literature_evidence"], "clinicaltrials": ["clinical_study"], "drugs.com": ["patient_review", "side_effect_report"]}
_IDS = {"reddit": "reddit_meta.post_id", "openfda": "report_id", "pubmed": "pubmed_id", "clinicaltrials": "nct_id", "drugs.com": "review_key"}


def _dates(d: DataFrame) -> DataFrame:
    """d with _dates: what a record of each source is dated by, as array<struct<day, start, end, ended>>; only its own source's is worked out."""
    day = lambda day, start, end, ended=False: F.struct(day.alias("day"), start.alias("start"), end.alias("end"), F.lit(ended).alias("ended"))
    none = F.lit(None).cast("date")
    review = D.parse_date(filled(F.col("review_date")))
    start, end = D.parse_range(F.col("date_range"))
    d = d.withColumns({"_start": start, "_end": end, "_first": F.coalesce(D.parse_date(F.col("start_date")), start)})
    xml = xml_dates(F.when(F.col("source") == "pubmed", F.col("content")))
    papers = F.transform(F.array_distinct(F.array_compact(F.concat(F.coalesce(xml, F.array().cast("array<date>")), F.array(F.col("_start"))))), lambda x: day(x, x, none))
    same = D.in_window(F.col("_first")) & F.coalesce(F.col("_first") == F.col("_end"), F.lit(False))
    trial = F.array(day(F.col("_first"), F.col("_first"), F.col("_end")), F.when(~same, day(F.col("_end"), F.col("_first"), F.col("_end"), True)))
    reviews = F.array(day(review, review, none))
    found = by_source({"pubmed": papers, "clinicaltrials": trial} | {s: reviews for s in TYPES if s not in ("pubmed", "clinicaltrials")}, F.array().cast("array<struct<day:date,start:date,end:date,ended:boolean>>"))
    return d.withColumn("_dates", F.filter(found, lambda x: x["day"].isNotNull()))


def _described(d: DataFrame, columns: list[str]) -> DataFrame:
    """One row a date in _dates within the window."""
    d = d.select(*d.columns, F.explode(F.filter("_dates", lambda x: D.in_window(x["day"]))).alias("_s"))
    iso = lambda c: F.col(f"_s.{c}").cast("string")
    types = by_source({s: F.array(*[F.lit(t) for t in names]) for s, names in TYPES.items()}, F.array().cast("array<string>"))
    types = F.when(F.col("_s.ended"), F.array_append(types, F.lit("study_end"))).otherwise(types)
    sid = F.coalesce(by_source({s: F.col(c) for s, c in _IDS.items()}, F.lit(None).cast("string")), F.lit(""))
    hashed = F.when(F.col("_s.ended"), F.concat(iso("day"), F.lit("_end"))).otherwise(iso("day"))
    return d.select(
        *columns, iso("day").alias("event_date"), D.year_month(F.col("_s.day")).alias("year_month"), F.year("_s.day").alias("year"), F.when(F.col("source") == "pubmed", "month").otherwise("day").alias("resolution"),
        types.alias("signal_type"), sid.alias("source_id"), iso("start").alias("date_start"), iso("end").alias("date_end"), F.col("_s.end").isNotNull().alias("is_range"),
        D.signal_hash(F.col("drug_name"), F.col("source"), hashed, sid).alias("sig_hash"),
    )


def _dated(raw: DataFrame) -> DataFrame:
    return _dates(conform(raw).filter(F.col("source").isin(*TYPES)).withColumn("_unnamed", F.coalesce(drug_name(F.col("drug_name")), F.lit("")) == "").withColumn("drug_name", drug_name(F.col("drug_name"))))


def signals(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row a dated signal within the window, by one pass over the records; `keep` names columns of raw to carry along."""
    return _described(_dated(raw), [*keep, "source", "drug_name", "url", "conditions"])


def new_signals(found: DataFrame, known: DataFrame) -> DataFrame:
    """Signals that are not stored yet, one a hash."""
    return found.dropDuplicates(["sig_hash"]).join(known.select("sig_hash"), "sig_hash", "left_anti")


def save_new(raw: DataFrame, path: str) -> dict[str, int]:
    """Append to path the signals of raw that it does not hold, and return the run's counters.

    records; errors: those without a drug, which give no signals; skipped_window: other records without a date in the window; extracted:
    signals; saved: new ones; skipped_duplicate: the others. The raw records are read once: what dates them is written without their
    texts, and counted and told apart from there.
    """
    spark = raw.sparkSession
    kept = ["source", "drug_name", "url", "conditions", *{c.split(".")[0] for c in _IDS.values()}, "_unnamed", "_dates"]
    d = stored(_dated(raw).select(*kept), "dated-records")
    inside = F.exists("_dates", lambda x: D.in_window(x["day"]))
    counts = d.agg(F.count(F.lit(1)).alias("records"), F.count_if("_unnamed").alias("errors"), F.count_if(~F.col("_unnamed") & ~inside).alias("skipped_window")).first().asDict()
    found = _described(d.filter(~F.col("_unnamed")), ["source", "drug_name", "url", "conditions"])
    there = spark.read.schema("sig_hash string").parquet(path) if exists(spark, path) else spark.createDataFrame([], "sig_hash string")
    new = stored(new_signals(found, there), "new-signals")
    new.write.mode("append").parquet(path)
    counts |= {"extracted": found.count(), "saved": new.count()}
    discard(d, new)
    return counts | {"skipped_duplicate": counts["extracted"] - counts["saved"]}


def save_dated(records: DataFrame, signals: DataFrame, path: str) -> dict[str, int]:
    """Write records with their best signal to path; how many have one (joined) and have none (no_temporal)."""
    attach_dates(records, signals).write.mode("overwrite").parquet(path)
    written = records.sparkSession.read.parquet(path)
    return written.agg(F.count_if(F.col("match_level") > 0).alias("joined"), F.count_if(F.col("match_level") == 0).alias("no_temporal")).first().asDict()


def counters(raw: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: raw records of dated sources, signals extracted, already known or repeated, and new."""
    found = signals(raw)
    known = found.join(stored.select("sig_hash").distinct().withColumn("_old", F.lit(1)), "sig_hash", "left")
    counts = known.agg(F.count(F.lit(1)).alias("extracted"), F.count_distinct(F.when(F.col("_old").isNull(), F.col("sig_hash"))).alias("saved"))
    records = raw.filter(F.lower("source").isin(list(TYPES))).agg(F.count(F.lit(1)).alias("records"))
    return records.crossJoin(counts).withColumn("duplicates", F.col("extracted") - F.col("saved"))
