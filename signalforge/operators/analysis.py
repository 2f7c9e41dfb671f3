"""Entities, relations and seeds of a text brought together, and the second look at its sentences.

Entities are an array of structs (text, label): those of a model (entities.extract) or, without one, the known terms that the text holds
(known_entities). All of it is column expressions: a text is searched once for all terms, and what depends on the entities works on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon
from ..functions import text as T
from ..functions.hof import let, strings
from ..functions.sentences import LENGTH, sentences

# Labels that a second look at a sentence asks for, and the characters on either side of an entity that tell its relation.
NAMED = ["DISEASE", "SYMPTOM", "CONDITION", "CHEMICAL", "ENTITY"]
AROUND = 200
NO_NAME = r"^[\d\-/]+$"


def known_entities(found: Column) -> Column:
    """What terms_in() found, as entities: the stand-in for a model."""
    return F.transform(found, lambda t: F.struct(t.alias("text"), F.lit("SYMPTOM").alias("label")))


def named(entities: Column, stop: Column) -> Column:
    """The texts, in lower case and trimmed, of entities that name something: a label of NAMED, over three characters, no stop word, and not digits, dashes and slashes alone."""
    plain = F.transform(F.filter(entities, lambda e: e["label"].isin(NAMED)), lambda e: F.trim(F.lower(e["text"])))
    return F.array_distinct(F.filter(F.array_except(plain, stop), lambda t: (F.length(t) > 3) & ~t.rlike(NO_NAME)))


def relation_of(text: Column, entity: Column, drug: Column) -> Column:
    """The relation that the characters around the entity's first place in the lower-case text tell; the drug's name among them speaks for a side effect."""
    at = F.instr(text, F.lower(entity))
    context = F.substring(text, F.greatest(at - AROUND, F.lit(1)), F.length(entity) + AROUND + F.least(at - 1, F.lit(AROUND)))
    return let(context, lambda c: T.relation(c, (F.length(drug) > 0) & F.contains(c, F.lower(drug))))


def judged(text: Column, entities: Column, drug: Column) -> Column:
    """array<struct<token, relation>> of the diseases and symptoms among the entities; unknown ones are what the seeds say, else unknown."""
    of = F.filter(entities, lambda e: e["label"].isin("DISEASE", "SYMPTOM"))

    def one(low: Column, e: Column) -> Column:
        def told(x: Column) -> Column:
            is_in = lambda seeds: F.array_contains(strings(seeds), e["text"]) | F.array_contains(strings(seeds), x["token"])
            seeded = F.when(is_in(lexicon.SIDE_EFFECTS), "side_effect").when(is_in(lexicon.SYMPTOMS_NLP), "symptom").otherwise("unknown")
            return F.struct(x["token"].alias("token"), F.when(x["said"] == "unknown", seeded).otherwise(x["said"]).alias("relation"))

        # term and context are searched once, however often they are named
        return let(F.struct(T.normal_term(e["text"]).alias("token"), relation_of(low, e["text"], drug).alias("said")), told)

    return let(F.lower(text), lambda low: F.transform(of, lambda e: one(low, e)))


def analyse(df: DataFrame, text: str, drug: str, entities: str, found: str) -> DataFrame:
    """df with side_effects, symptoms, dosages and drugs (sorted arrays) of a text.

    entities: (text, label); found: the known terms of the lower-case text (terms_in). Diseases and symptoms are what their contexts tell,
    known terms that are no entities what their seed list tells; a side effect is no symptom. Drugs other than the record's own are listed,
    doses are those of the entities and of the pattern. Null texts have none of it.
    """
    body, own, named_ = F.coalesce(text, F.lit("")), F.coalesce(drug, F.lit("")), F.coalesce(entities, F.array().cast("array<struct<text:string,label:string>>"))
    of_label = lambda label: F.transform(F.filter(named_, lambda e: e["label"] == label), lambda e: T.normal_term(e["text"]))
    d = df.withColumn("_judged", judged(body, named_, own))
    which = lambda kind: F.transform(F.filter("_judged", lambda j: j["relation"] == kind), lambda j: j["token"])
    covered = F.transform("_judged", lambda j: j["token"])
    seeded = lambda seeds: F.array_except(F.transform(T.chosen(F.col(found), seeds), T.alias), covered)
    clean = lambda terms: F.array_sort(F.array_distinct(F.transform(terms, T.normal_term)))
    d = d.withColumn("_effects", F.array_union(which("side_effect"), seeded(lexicon.SIDE_EFFECTS)))
    d = d.withColumn("_symptoms", F.array_except(F.array_union(which("symptom"), seeded(lexicon.SYMPTOMS_NLP)), "_effects"))
    d = d.withColumn("side_effects", clean(F.col("_effects"))).withColumn("symptoms", F.array_except(clean(F.col("_symptoms")), "side_effects"))
    d = d.withColumn("dosages", F.array_sort(F.array_union(T.dosages(body), of_label("DOSAGE"))))
    d = d.withColumn("drugs", F.array_sort(F.array_distinct(F.filter(of_label("DRUG"), lambda t: t != F.lower(own)))))
    return d.drop("_judged", "_effects", "_symptoms")


def sentence_terms(df: DataFrame, text: str, entities: str | None = None, stop: Column | None = None, length: int = LENGTH) -> DataFrame:
    """df with sentences (how many the first `length` characters have), named (how many of these name something) and the side_effects,
    symptoms and dosages (sorted arrays) of those that do.

    Without a column of entities, the known terms of each sentence are its entities. A record's sentences stay in its row: nothing is shuffled.
    """
    stop = strings(lexicon.STOP_WORDS) if stop is None else stop
    whole = named(F.col(entities), stop) if entities else None

    def one(s: Column) -> Column:
        def with_terms(found: Column) -> Column:
            names = F.filter(whole, lambda t: F.contains(F.lower(s), t)) if whole is not None else named(known_entities(found), stop)
            effects, symptoms = T.seed_terms(found)
            return F.struct(F.size(names).alias("names"), effects.alias("e"), symptoms.alias("s"), T.dosages(s).alias("d"))

        return let(T.terms_in(F.lower(s)), with_terms)

    d = df.withColumn("_all", F.transform(sentences(F.col(text), length), one)).withColumn("sentences", F.size("_all"))
    d = d.withColumn("_all", F.filter("_all", lambda x: x["names"] > 0)).withColumn("named", F.size("_all"))
    together = lambda field: F.array_sort(F.array_distinct(F.flatten(F.transform("_all", lambda x: x[field]))))
    d = d.withColumn("side_effects", together("e")).withColumn("symptoms", F.array_except(together("s"), "side_effects")).withColumn("dosages", together("d"))
    return d.drop("_all")
