"""Landed files of the sources: schemas, scans and the records that raw answers become."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import compact_date, epoch_date, in_window, parse_date
from ..functions.hof import let
from ..functions.text import drug_name, strip
from ..operators.stored import stored

#: Tables up to so many rows, once counted, are broadcast.
SMALL = 20_000

# Drug classes collected, trusted forums, and the words that make a post relevant.
CATEGORIES = [("NSAID", "M01A"), ("Antibiotique", "J01"), ("Antidepresseur", "N06A"), ("Antihypertenseur", "C02"), ("Anticoagulant", "B01A"), ("Statine", "C10AA"), ("Antidiabetique", "A10"), ("Corticoide", "H02")]
TRUSTED = ["askdocs", "pharmacy", "askpharmacist", "druginteractions"]
EFFECT_WORDS = [
    "nausea", "vomiting", "headache", "dizziness", "fatigue", "rash", "diarrhea", "constipation", "stomach", "abdominal", "fever", "insomnia", "anxiety", "blurred vision", "dry mouth", "sweating",
    "palpitations", "shortness of breath", "itching", "swelling", "hair loss", "muscle pain", "muscle ache", "joint pain", "chest pain", "high blood pressure", "hypertension", "bleeding", "allergic",
    "drowsiness", "sleepy", "sleepiness", "weight gain", "weight loss", "cramps", "bloating", "heartburn", "acid reflux", "back pain", "kidney", "liver", "tingling", "numbness", "confusion",
    "depression", "mood", "irritable", "panic", "tremor", "shakiness", "bruising", "dark urine", "yellow skin", "jaundice",
]
CAUSE_WORDS = [
    "side effect", "side effects", "adverse", "reaction", "caused by", "due to", "from taking", "after taking", "since taking", "since starting", "because of", "stopped taking", "stopped the",
    "quit taking", "experiencing", "experienced", "suffering from", "made me", "gave me", "causing", "causes", "triggered", "developed", "started having", "started getting", "noticed", "symptom",
    "symptoms", "prescribed", "taking it", "on it", "on the medication", "withdrawal", "tolerance", "dependence",
]
CLASS_MEMBERS = "drugMemberGroup struct<drugMember: array<struct<minConcept: struct<rxcui: string, name: string>>>>"
SYNONYMS = "allRelatedGroup struct<conceptGroup: array<struct<conceptProperties: array<struct<name: string>>>>>"
TRIAL = (
    "protocolSection struct<identificationModule: struct<nctId: string, briefTitle: string>, descriptionModule: struct<briefSummary: string>, conditionsModule: struct<conditions: array<string>>, "
    "statusModule: struct<overallStatus: string, startDateStruct: struct<date: string>>>"
)
REPORT = (
    "safetyreportid string, serious string, receivedate string, "
    "patient struct<reaction: array<struct<reactionmeddrapt: string>>, drug: array<struct<medicinalproduct: string, drugdosagetext: string, drugindication: string>>>"
)
POST = "id string, title string, selftext string, body string, score int, subreddit string, created_utc double, permalink string"


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it is read in fewer parts than there are: a small file is one part, and costly work on its texts would
    be one task. Inputs of more parts than cores, as large ones are, stay as they are and are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def scan(spark: SparkSession, path: str, sources: list[str] | None = None, limit: int = 0) -> DataFrame:
    """A landed collection; the filter by source and the columns asked for reach the files."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("source").isin(sources)) if sources else df
    return df.limit(limit) if limit else df


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The items of files that hold one JSON array each; an item that cannot be read as the schema says is in the column `corrupt`, null
    elsewhere. Items are read one by one: a bad one spoils no other."""
    items = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("_item"))
    read = F.from_json("_item", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    return items.select(read.alias("_r")).select("_r.*")


def answers(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """df with fields (path, type) of a JSON column whose shape may change from row to row, and `unreadable`.

    The column is parsed once, as a variant. A field that is absent, or that is of another kind in this row, is null; a null column is readable.
    """
    d = df.withColumn("_v", F.try_parse_json(F.col(column)))
    found = {name: F.try_variant_get("_v", path, kind) for name, (path, kind) in fields.items()}
    return d.withColumns(found).withColumn("unreadable", F.col(column).isNotNull() & F.col("_v").isNull()).drop("_v")


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """df with the fields of a JSON column beside its own; malformed rows get nulls."""
    return df.withColumn("_j", F.from_json(column, schema)).select(*[c for c in df.columns if c != column], "_j.*")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, atc_code string")


def class_members(df: DataFrame) -> DataFrame:
    """(rxcui, name) of answers with CLASS_MEMBERS; empty names are left out."""
    others = [c for c in df.columns if c != "drugMemberGroup"]
    d = df.select(*others, F.inline("drugMemberGroup.drugMember")).select(*others, "minConcept.rxcui", F.lower(strip(F.col("minConcept.name"))).alias("name"))
    return d.filter("name <> ''")


def synonyms(groups: Column) -> Column:
    """Distinct names of all concept groups."""
    names = F.flatten(F.transform(F.coalesce(groups, F.array().cast("array<struct<conceptProperties: array<struct<name: string>>>>")), lambda g: F.coalesce(F.transform(g["conceptProperties"], lambda p: p["name"]), F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def drug_list(df: DataFrame, order: str = "ord") -> DataFrame:
    """Drugs in lower case, the first of each name."""
    d = df.withColumn("name", drug_name(F.col("name"))).filter("name <> ''")
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(order))).filter("_r = 1").drop("_r")


def search_names(drug: Column, names: Column) -> Column:
    """The drug and its shorter synonyms, four at most."""
    return F.slice(F.concat(F.array(drug), F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda s: F.length(s) < 30)), 1, 4)


def trials(df: DataFrame) -> DataFrame:
    """Trials of answers with TRIAL; those without a number are left out."""
    p = "protocolSection."
    text = lambda c: F.coalesce(F.col(p + c), F.lit(""))
    d = df.withColumn("nct_id", text("identificationModule.nctId")).withColumn("title", text("identificationModule.briefTitle")).withColumn("summary", text("descriptionModule.briefSummary"))
    d = d.withColumn("conditions", F.coalesce(F.col(p + "conditionsModule.conditions"), F.array().cast("array<string>"))).withColumn("status", text("statusModule.overallStatus"))
    d = d.withColumn("start_date", text("statusModule.startDateStruct.date")).withColumn("url", F.concat(F.lit("https://clinicaltrials.gov/study/"), "nct_id"))
    return d.filter("nct_id <> ''").drop("protocolSection")


def reactions(items: Column) -> Column:
    terms = F.transform(F.filter(items, lambda r: F.coalesce(r["reactionmeddrapt"], F.lit("")) != ""), lambda r: F.lower(r["reactionmeddrapt"]))
    return F.coalesce(F.nullif(F.array_join(F.slice(terms, 1, 6), ", "), F.lit("")), F.lit("not specified"))


def reports(df: DataFrame, drug: str = "drug_name", order: str = "safetyreportid", cap: int = 150) -> DataFrame:
    """Records of answers with REPORT: those with reactions, the first `cap` of each drug."""
    target = F.col(drug)
    entry = F.get(F.filter("patient.drug", lambda d: F.contains(F.lower(F.coalesce(d["medicinalproduct"], F.lit(""))), F.lower(target))), 0)
    d = df.withColumn("symptom", reactions(F.col("patient.reaction"))).filter("symptom <> 'not specified'").withColumn("_e", entry)
    d = d.withColumn("report_id", F.coalesce("safetyreportid", F.lit(""))).withColumn("review_date", compact_date(strip(F.coalesce("receivedate", F.lit("")))))
    d = d.withColumn("indication", F.coalesce("_e.drugindication", F.lit(""))).withColumn("dosage", F.coalesce("_e.drugdosagetext", F.lit(""))).withColumn("serious", F.coalesce("serious", F.lit("0")))
    d = d.withColumn("confidence", F.when(F.col("serious") == "1", "high").otherwise("medium")).withColumn("num_reactions", F.size("patient.reaction"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(drug).orderBy(order))).filter(F.col("_r") <= cap)
    return d.drop("_r", "_e", "patient", "safetyreportid", "receivedate")


def relevant(text: Column, drug: Column) -> Column:
    """Whether a post names the drug, an effect and a cause."""
    # plain searches for one word after another: a pattern of all tries each of them at each character
    holds = lambda low, words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return let(F.lower(text), lambda low: F.contains(low, drug) & holds(low, EFFECT_WORDS) & holds(low, CAUSE_WORDS))


def confidence(score: Column, forum: Column) -> Column:
    trusted = F.lower(forum).isin(TRUSTED)
    return F.when((score >= 50) & trusted, "high").when((score >= 10) | trusted, "medium").otherwise("low")


def trial_search(df: DataFrame, drug: str = "drug_name", order: str = "pos", cap: int = 10) -> DataFrame:
    """The trials that a drug's search gives: those that begin within the window of dates, in the order of the answer, `cap` at most."""
    began = parse_date(F.col("start_date"))
    d = trials(df).filter(in_window(began)) if "protocolSection" in df.columns else df.filter(in_window(began))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(drug).orderBy(order))).filter(F.col("_r") <= cap).drop("_r")


def first_claims(found: DataFrame, stored: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Of all finds of an item the first one, unless it is stored: the first drug whose search gives an article or a trial has it."""
    place = F.struct(*order)
    firsts = found.groupBy(item).agg(F.min_by(F.struct(*[c for c in found.columns if c != item]), place).alias("_f")).select(item, "_f.*")
    return firsts.join(stored.select(item).distinct(), item, "left_anti")


def forum_pages(posts: DataFrame, comments: DataFrame, cap: int = 25, pages: int = 4, with_comments: int = 3) -> DataFrame:
    """What a drug's forum searches save: posts (drug_name, forum, page, pos and POST), comments (post_id, pos and POST).

    Forums and their pages are read in order. A page gives its relevant posts and the relevant comments, of 40 characters at least, of the first three
    of these. A forum ends with a page that gives nothing, or the fourth; no page is begun once `cap` records are there. Records with the same
    drug and first 80 characters are one, the one found first.
    """
    where = ["drug_name", "forum", "page"]
    few = lambda d: F.broadcast(d) if d.limit(SMALL + 1).count() <= SMALL else d
    row = lambda d, t, score, time, i, kind, at, *more: d.select(*where, "subreddit", F.substring(t, 1, 1000).alias("review_text"), score.alias("score"), time.alias("created_utc"), i.alias("id"), F.lit(kind).alias("kind"), at.alias("_at"), F.concat("drug_name", F.substring(t, 1, 80)).alias("review_key"), *more)
    at = lambda kind, pos, c_pos: F.struct(F.lit(kind).alias("kind"), pos.cast("long").alias("pos"), c_pos.cast("long").alias("c_pos"))
    # whole texts are read and judged once; what is ranked, counted and told apart from here on is their beginnings
    text = strip(F.concat_ws(" ", "title", "selftext"))
    p = posts.filter(F.col("page") < pages).withColumn("_text", text).withColumn("_hit", relevant(F.col("_text"), F.col("drug_name")))
    p = stored(row(p, F.when(F.col("_hit"), F.col("_text")), F.col("score"), F.col("created_utc"), F.col("id"), "post", at(0, F.col("pos"), F.lit(0)), F.col("pos").alias("_pos")), "forum-posts")
    hit = p.filter(F.col("review_text").isNotNull())
    first = hit.select(*where, "subreddit", "_pos", "id").withColumn("_nth", F.row_number().over(Window.partitionBy(*where).orderBy("_pos", "id"))).filter(F.col("_nth") <= with_comments)
    first = stored(first.select(*where, "subreddit", F.col("_pos").alias("_p_pos"), F.col("id").alias("post_id")), "commented-posts")
    said = comments.select("post_id", F.col("pos").alias("_c_pos"), F.col("body").alias("_c_text"), F.col("score").alias("_c_score"), F.col("created_utc").alias("_c_time"), F.col("id").alias("_c_id"))
    of = said.join(few(first), "post_id").filter((F.length("_c_text") >= 40) & relevant(F.col("_c_text"), F.col("drug_name")))
    of = stored(row(of, F.col("_c_text"), F.col("_c_score"), F.col("_c_time"), F.col("_c_id"), "comment", at(1, F.col("_p_pos"), F.col("_c_pos"))), "forum-comments")
    found = hit.drop("_pos").unionByName(of)
    # a row a page: what it gives, whether its forum has ended before it, and how much there is when it would be begun
    counts = p.select(*where).distinct().join(found.groupBy(*where).agg(F.count(F.lit(1)).alias("_n")), where, "left").fillna(0, ["_n"])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.min("_n").over(before(Window.partitionBy("drug_name", "forum").orderBy("page"))) == 0, F.lit(False))
    counts = counts.withColumn("_ended", ended).filter(~F.col("_ended"))
    counts = counts.withColumn("_have", F.coalesce(F.sum("_n").over(before(Window.partitionBy("drug_name").orderBy("forum", "page"))), F.lit(0)))
    kept = found.join(few(stored(counts.filter(F.col("_have") < cap).select(*where), "opened-pages")), where)
    first = F.struct("forum", "page", "_at", "id")
    columns = [c for c in kept.columns if c not in ("review_key", "_at")]
    out = kept.groupBy("review_key").agg(F.min_by(F.struct(*columns), first).alias("_f")).select("review_key", "_f.*")
    return out.withColumn("confidence", confidence(F.col("score"), F.col("subreddit"))).withColumn("review_date", epoch_date(F.col("created_utc"))).drop("created_utc")
