"""From raw records of each source to normalised records: terms by seeds, classes, authority."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T
from ..functions.hof import strings
from ..operators.enrich import drug_classes
from ..operators.graph import source_authority
from ..sources.xml import articles

# Sources whose terms are looked for anywhere in the text, and what subject headings are terms or conditions.
FORCED = ("clinicaltrials", "openfda", "vigiaccess", "medlineplus")
REVIEWS = ("reddit", "drugs.com", "webmd")
_MESH_TERMS = ["pain", "disorder", "syndrome", "disease", "injury", "cancer", "tumor", "leukemia", "hemorrhage", "inflammation", "apoptosis", "toxicity"]
_MESH_CONDITIONS = ["leukemia", "cancer", "disorder", "disease", "injury", "syndrome", "hemorrhage"]

SOURCES = ("medlineplus", "clinicaltrials", "drugs.com", "openfda", "pubmed", "reddit", "vigiaccess", "webmd")
#: Columns a raw record may have; those that are absent are null.
RAW = {
    "source": "string", "drug_name": "string", "url": "string", "nct_id": "string", "pubmed_id": "string", "report_id": "string", "review_key": "string", "summary": "string", "title": "string",
    "status": "string", "conditions": "array<string>", "content": "string", "symptom": "string", "dosage": "string", "review_text": "string", "condition": "string",
    "reddit_meta": "struct<post_id:string,subreddit:string>", "effects": "array<string>", "soc_rows": "array<struct<soc:string>>", "prescribed_for": "array<string>", "description": "array<string>",
    "side_effects": "struct<mild:array<string>,serious:array<string>>", "review_date": "string", "start_date": "string", "date_range": "string",
}


def _empty() -> Column:
    return F.array().cast("array<string>")


def conform(raw: DataFrame) -> DataFrame:
    """raw with all columns of RAW, source in lower case."""
    cols = [(F.col(c).cast(t) if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in RAW.items()]
    return raw.select(*cols, *[c for c in raw.columns if c not in RAW]).withColumn("source", F.lower(T.strip(F.coalesce("source", F.lit("")))))


def by_source(values: dict[str, Column], otherwise: Column) -> Column:
    """The value of the record's source; only that one is worked out."""
    out = None
    for source, value in values.items():
        is_it = F.col("source") == source
        out = F.when(is_it, value) if out is None else out.when(is_it, value)
    return otherwise if out is None else out.otherwise(otherwise)


#: For each source, what is said in a record before it is cleaned.
TOLD: dict[str, Callable[[], Column]] = {
    "medlineplus": lambda: F.concat(F.array_join(F.coalesce("prescribed_for", _empty()), " "), F.lit(" "), F.array_join(F.coalesce("description", _empty()), " ")),
    "clinicaltrials": lambda: F.col("summary"), "drugs.com": lambda: F.col("review_text"), "openfda": lambda: F.col("symptom"), "pubmed": lambda: F.col("_a.abstract"), "reddit": lambda: F.col("review_text"),
}


@dataclass(frozen=True)
class Handler:
    """How records of a further source are read: what is said in them, their id there (none without it), and whether terms are looked for anywhere in
    it, as in reviews, even if contexts and seeds give some."""

    said: Callable[[], Column]
    source_id: Callable[[], Column] | None = None
    anywhere: bool = False


def _lists(d: DataFrame, split_terms: bool, more: Mapping[str, Handler]) -> DataFrame:
    """d with _given (side effects that the record lists), _mesh, _conds and _said."""
    d = d.withColumn("_a", articles(F.when(F.col("source") == "pubmed", F.col("content"))))
    d = d.withColumn("_said", T.clean_text(by_source({s: f() for s, f in {**TOLD, **{s: h.said for s, h in more.items()}}.items()}, F.lit(None).cast("string"))))
    d = d.withColumn("_title", T.clean_text(by_source({"clinicaltrials": F.col("title"), "pubmed": F.col("_a.title")}, F.lit(None).cast("string"))))
    d = d.withColumn("_mesh", F.when(F.col("source") == "pubmed", F.array_except("_a.mesh", strings(lexicon.MESH_EXCLUDED))).otherwise(_empty()))
    both = F.concat(F.coalesce("side_effects.mild", _empty()), F.coalesce("side_effects.serious", _empty()))
    rows = F.coalesce("soc_rows", F.array().cast("array<struct<soc:string>>"))
    given = {
        "medlineplus": F.transform(both, F.lower), "openfda": F.filter(F.split("_said", ", ") if split_terms else F.array("_said"), lambda x: x != ""),
        "vigiaccess": F.array_sort(F.array_distinct(F.transform(F.filter(rows, lambda r: F.coalesce(r["soc"], F.lit("")) != ""), lambda r: F.lower(r["soc"])))),
    }
    return d.withColumn("_given", by_source(given, _empty()))


def _texts(d: DataFrame) -> DataFrame:
    """d with _text, which terms are looked for in, and _found, the terms in it."""
    drug = F.coalesce("drug_name", F.lit(""))
    made = F.concat(drug, F.lit(" may cause "), F.array_join(F.slice("_given", 1, 10), ", "))
    d = d.withColumn("_said", F.when((F.col("source") == "medlineplus") & (F.col("_said") == "") & (F.size("_given") > 0), made).otherwise(F.col("_said")))
    listed = F.array_join(F.transform(F.coalesce("effects", _empty()), F.lower), ", ")
    told = {
        "openfda": F.when(F.col("_said") != "", F.concat(drug, F.lit(" caused "), F.col("_said"))).otherwise(""),
        "pubmed": F.regexp_replace(F.concat("_title", F.lit(". "), "_said"), r"^[. ]+|[. ]+$", ""),
        "vigiaccess": F.when(F.size("_given") > 0, F.concat(drug, F.lit(" adverse effects: "), F.array_join("_given", "; "))).otherwise(""),
        "webmd": F.when(listed != "", F.concat(drug, F.lit(" may cause the following side effects: "), listed)).otherwise(""),
    }
    d = d.withColumn("_text", by_source(told, F.col("_said")))
    found = {"_found": T.terms_in(F.lower("_text")), "_after_effect": T.context_found(F.col("_text"), T.EFFECT_CONTEXT), "_after_symptom": T.context_found(F.col("_text"), T.SYMPTOM_CONTEXT)}
    return d.withColumns(found)


def classify(d: DataFrame, more: Mapping[str, Handler] | None = None) -> DataFrame:
    """d with se and sym: terms that the record lists or its text names, by announcing contexts and, for some sources or if nothing is
    found, anywhere; stop words out, preferred terms, none within another. The text was searched once (_found)."""
    trial = F.col("source") == "clinicaltrials"
    lowered = lambda a: F.transform(a, lambda t: T.alias(F.lower(t)))
    stop = F.when(trial, strings([*lexicon.STOP_WORDS, *lexicon.TRIAL_STOP_WORDS])).otherwise(strings(lexicon.STOP_WORDS))
    mesh = F.filter("_mesh", lambda m: m.rlike("|".join(_MESH_TERMS)))
    d = d.withColumn("_trial", F.when(trial, T.chosen(F.col("_found"), lexicon.TRIAL_SYMPTOMS)).otherwise(_empty()))
    effects, symptoms = T.seed_terms(F.col("_found"))
    d = d.withColumn("_se", F.array_union(effects, lowered(F.col("_given")))).withColumn("_sy", symptoms)
    d = d.withColumn("_sy", F.array_union("_sy", F.array_except(lowered(F.concat("_trial", mesh)), F.col("_se"))))
    after_effects, after_symptoms = T.context_terms(F.col("_after_effect"), F.col("_after_symptom"))
    d = d.withColumn("_se", F.array_union("_se", after_effects)).withColumn("_sy", F.array_union("_sy", after_symptoms))
    anywhere = F.col("source").isin(*FORCED, *REVIEWS, *[s for s, h in (more or {}).items() if h.anywhere]) | (F.size("_se") + F.size("_sy") == 0)
    effects, symptoms = T.lexical_terms(F.col("_found"), stop)
    d = d.withColumns({"_se": F.when(anywhere, F.array_union("_se", effects)).otherwise(F.col("_se")), "_sy": F.when(anywhere, F.array_union("_sy", symptoms)).otherwise(F.col("_sy"))})
    d = d.withColumns({"_se": T.stop_filtered(F.col("_se"), stop), "_sy": T.stop_filtered(F.col("_sy"), stop)})
    return d.withColumns({"sym": T.longest_terms(F.array_except("_sy", "_se")), "se": T.longest_terms(F.col("_se"))})


def _trials(d: DataFrame) -> DataFrame:
    """Of trials: conditions; more effects by seeds that no symptom of trials overrides; symptoms that are no conditions."""
    trial = F.col("source") == "clinicaltrials"
    d = d.withColumn("_conds", F.when(trial, F.array_distinct(F.filter(F.transform(F.coalesce("conditions", _empty()), T.condition), lambda c: c != ""))).otherwise(_empty()))
    rescue = [s for s in lexicon.SIDE_EFFECTS if s not in lexicon.TRIAL_STOP_WORDS and lexicon.ALIASES.get(s, s) not in lexicon.TRIAL_OVERRIDES]
    d = d.withColumn("_e", F.when(trial, F.array_except(F.array_union("se", F.transform(T.chosen(F.col("_found"), rescue), T.alias)), F.col("_trial"))))
    d = d.withColumn("_s", F.when(trial, T.longest_terms(F.array_union("sym", F.array_except("_trial", "_e")))))
    flat = F.transform("_conds", lambda c: F.replace(c, F.lit("_"), F.lit(" ")))
    named = lambda s: F.array_contains(F.col("_conds"), F.replace(s, F.lit(" "), F.lit("_")))
    d = d.withColumn("_s", F.when(trial, F.filter(F.array_except("_s", flat), lambda s: ~named(s))))
    se, sym = (T.longest_terms(F.transform(c, T.normal_term)) for c in ("_e", "_s"))
    return d.withColumns({"se": F.when(trial, se).otherwise(F.col("se")), "sym": F.when(trial, sym).otherwise(F.col("sym"))})


def _output(d: DataFrame, more: Mapping[str, Handler]) -> DataFrame:
    start = lambda c, n: F.substring(c, 1, n)
    none, filled = F.lit(None).cast("string"), lambda c: F.nullif(F.col(c), F.lit(""))
    dose = F.coalesce("dosage", F.lit(""))
    given = F.when(F.upper(dose).isin("UNK", "UNKNOWN", ""), _empty()).otherwise(F.array(F.lower(dose)))
    conditions = {
        "clinicaltrials": F.col("_conds"), "drugs.com": F.array(T.condition(F.coalesce(filled("condition"), F.lit("unknown")))),
        "pubmed": F.transform(F.filter("_mesh", lambda m: m.rlike("|".join(_MESH_CONDITIONS))), T.condition),
    }
    columns = {
        "text_clean": by_source({"clinicaltrials": start(F.col("_said"), 3000), "openfda": F.col("_said"), "vigiaccess": F.lit(""), "webmd": start(F.col("_text"), 1000)}, start(F.col("_said"), 1000)),
        "conditions": by_source(conditions, _empty()),
        "dosages": by_source({"openfda": given}, T.dosages(F.col("_text"))),
        "source_id": by_source({"clinicaltrials": F.col("nct_id"), "drugs.com": filled("review_key"), "openfda": F.coalesce("report_id", F.lit("")), "pubmed": F.coalesce("pubmed_id", F.lit("")), "reddit": F.col("reddit_meta.post_id"), **{s: h.source_id() for s, h in more.items() if h.source_id}}, none),
        "source_status": by_source({"clinicaltrials": F.nullif(F.lower("status"), F.lit(""))}, none),
        "source_title": by_source({"clinicaltrials": filled("_title"), "pubmed": F.nullif(start(F.col("_title"), 200), F.lit(""))}, none),
        "subreddit": by_source({"reddit": F.nullif(F.lower("reddit_meta.subreddit"), F.lit(""))}, none),
    }
    kept = [c for c in d.columns if c not in RAW and not c.startswith("_") and c not in ("se", "sym")]
    return d.select(*kept, "source", T.drug_name(F.col("drug_name")).alias("drug_name"), "url", F.col("se").alias("side_effects"), F.col("sym").alias("symptoms"), *[v.alias(k) for k, v in columns.items()])


def normalise(raw: DataFrame, drugs: DataFrame | None = None, scores: DataFrame | None = None, keep_empty: bool = True, split_terms: bool = False, more: Mapping[str, Handler] | None = None) -> DataFrame:
    """Normalised records of all known sources, by one pass over them; other sources are dropped.

    What differs between sources is chosen by the source (by_source), so the texts are read, cleaned and searched once. drugs (name,
    synonyms, category, ord) gives drug_class, scores (source, authority_score, source_type) the authority; keep_empty=False leaves
    out records without terms; split_terms takes each reaction of a safety report as a term of its own. more has handlers of further sources by
    their names in lower case; a known source's cannot be replaced. Handlers may read any column of raw.
    """
    more = more or {}
    if taken := sorted(set(more) & set(SOURCES)):
        raise ValueError(f"sources that are handled already: {', '.join(taken)}")
    known = conform(raw).filter(F.col("source").isin(*SOURCES, *more))
    out = _output(_trials(classify(_texts(_lists(known, split_terms, more)), more)), more)
    if drugs is not None:
        out = out.join(drug_classes(drugs).withColumnRenamed("name", "drug_name"), "drug_name", "left")
    if scores is not None:
        out = source_authority(out, scores)
    if keep_empty:
        return out
    # a filter would be pushed below the search for terms, with a search of its own: rows are kept by what was found
    kept = F.filter(F.array(F.struct(*out.columns)), lambda r: (F.size(r["side_effects"]) > 0) | (F.size(r["symptoms"]) > 0))
    return out.select(F.inline(kept))
