"""Entities, relations and sentiment: label families, a pluggable entity model, a trained relation classifier, a rule scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..functions.text import relation

# What a model's label holds, in the order tried, and the thresholds of sentiment.
FAMILIES = [("DRUG", ["CHEM", "DRUG", "MED", "COMPOUND", "MOLECULE"]), ("DISEASE", ["DIS", "DISEASE", "CONDITION", "DISORDER", "SYNDROME"]), ("SYMPTOM", ["SYMPTOM", "SIGN", "FINDING", "MANIFESTATION"]), ("DOSAGE", ["DOSE", "DOSAGE", "QUANTITY", "STRENGTH"])]
POSITIVE, NEGATIVE = 0.05, -0.05
ACCEPTED = 0.82
#: Words that move a text's score. A stand-in for a lexicon that is not installed; give score_text another one.
TONES = {
    "good": 1.9, "great": 3.1, "better": 1.9, "best": 3.2, "helped": 1.8, "helpful": 1.8, "relief": 2.1, "effective": 2.1, "happy": 2.7, "love": 3.2, "improved": 2.1, "works": 1.2,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "terrible": -2.1, "horrible": -2.5, "awful": -2.0, "pain": -2.3, "sick": -2.3, "hate": -2.7, "useless": -1.8, "severe": -1.6, "died": -2.6,
}


def label_family(raw: Column) -> Column:
    """DRUG, DISEASE, SYMPTOM, DOSAGE or OTHER by what the label holds."""
    upper, out = F.upper(raw), None
    for family, parts in FAMILIES:
        hit = upper.rlike("|".join(parts))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("OTHER")


def family(label: str) -> str:
    """label_family of a Python string."""
    upper = label.upper()
    return next((name for name, parts in FAMILIES if any(p in upper for p in parts)), "OTHER")


def distinct_entities(entities: Column) -> Column:
    """The different (text, label) of an array of entities, those of over two characters."""
    return F.array_distinct(F.filter(F.transform(entities, lambda e: F.struct(e["text"].alias("text"), label_family(e["label"]).alias("label"))), lambda e: F.length(e["text"]) > 2))


def extract(df: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]] | None = None, words: int = 150) -> DataFrame:
    """df with entities (text, label): a model, loaded once a task, sees pieces of 150 words. Without one there are none."""
    kind = "array<struct<text:string,label:string>>"
    if load is None:
        return df.withColumn("entities", F.array().cast(kind))

    @F.pandas_udf(kind)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in parts:
            pieces = ([" ".join(w[i : i + words]) for i in range(0, len(w), words)] for w in ((t or "").split() for t in texts))
            named = ({(t, family(y)): None for e in model(p) for t, y in e if len(t) > 2} for p in pieces)
            yield pd.Series([[{"text": t, "label": y} for t, y in e] for e in named])

    return df.withColumn("entities", found(F.col(text)))


def silver_examples(spark: SparkSession) -> DataFrame:
    """(context, label): phrases of either kind about known terms; 1 is a side effect."""
    effect = ["{} began after the dose", "treatment caused {}", "{} listed as adverse reaction to the drug", "stopped the drug because of {}", "{} induced by the medication", "side effects included {}"]
    symptom = ["presented with {} from the disease", "{} is a sign of the condition", "diagnosed with {}", "{} before any treatment", "the illness shows as {}", "chronic disorder with {}"]
    rows = [(p.format(t), 1.0) for p in effect for t in lexicon.SIDE_EFFECTS[:18]] + [(p.format(t), 0.0) for p in symptom for t in lexicon.SYMPTOMS[:15]]
    return spark.createDataFrame(rows, "context string, label double")


def relation_model(examples: DataFrame, features: int = 1 << 12):
    """Logistic regression over hashed words and word pairs of contexts."""
    words = RegexTokenizer(inputCol="context", outputCol="_w", pattern=r"\W+")
    pairs = NGram(n=2, inputCol="_w", outputCol="_b")
    hashed = [HashingTF(inputCol=c, outputCol=f"{c}h", numFeatures=features) for c in ("_w", "_b")]
    return Pipeline(stages=[words, pairs, *hashed, VectorAssembler(inputCols=["_wh", "_bh"], outputCol="features"), LogisticRegression(maxIter=50, regParam=0.01)]).fit(examples)


def classify_relations(df: DataFrame, model, context: str, has_drug: Column) -> DataFrame:
    """df with relation: the model's where it is sure, else by patterns."""
    d = model.transform(df.withColumn("context", F.col(context)))
    p = vector_to_array("probability")
    sure = F.when(p[1] >= ACCEPTED, "side_effect").when(p[0] >= ACCEPTED, "symptom")
    return d.withColumn("relation", F.coalesce(sure, relation(F.lower(F.col(context)), has_drug))).select(*df.columns, "relation")


def sentiment(compound: Column) -> Column:
    """(label, score) of a compound score between -1 and 1."""
    label = F.when(compound >= POSITIVE, "positive").when(compound <= NEGATIVE, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.bround(compound, 4).alias("score"))


def score_text(text: Column, tones: dict[str, float] | None = None) -> Column:
    """Compound score: the sum of words' tones (turned and damped after not, no, never) over the root of its square plus 15."""
    weights = F.expr("map(" + ", ".join(f"'{w}', {v}D" for w, v in (tones or TONES).items()) + ")")
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z']+"), lambda w: w != "")

    def total(w: Column) -> Column:
        turned = lambda i: F.when(F.get(w, i - 1).isin("not", "no", "never"), -0.74).otherwise(1.0)
        parts = F.transform(w, lambda x, i: F.coalesce(weights[x], F.lit(0.0)) * turned(i))
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    summed = F.element_at(F.transform(F.array(words), total), 1)
    return F.element_at(F.transform(F.array(summed), lambda s: s / F.sqrt(s * s + 15.0)), 1)
