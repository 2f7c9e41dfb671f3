"""Sentences, entities with their relations, and keyed state and paged searches of incremental runs."""

import re

import pytest
from pyspark.sql import functions as F

from signalforge import lexicon
from signalforge.functions import text as T
from signalforge.functions.sentences import ABBREVIATIONS, sentences
from signalforge.operators import analysis
from signalforge.plans import normalise
from signalforge.sources import paged
from signalforge.streaming import increment

KIND = "array<struct<text:string,label:string>>"


def split_plainly(text):
    """The sentences of a text, place by place."""
    out, start, i = [], 0, 0
    while i < len(text):
        blank = re.compile(r"\n[ \t\n\x0b\f\r]*\n").match(text, i)
        space = re.compile(r"[ \t\n\x0b\f\r]+").match(text, i)
        before = re.search(r"[.!?][\"')\]]{0,2}$", text[:i])
        short = any(re.search(rf"(?:^|[^A-Za-z]){re.escape(w)}\.[\"')\]]{{0,2}}$", text[:i]) for w in ABBREVIATIONS)
        after = text[space.end()] if space and space.end() < len(text) else ""
        if space and before and not short and after and not after.islower():
            out.append(text[start:i])
            start = i = space.end()
        elif blank:
            out.append(text[start:i])
            start = i = blank.end()
        else:
            i += 1
    return [s.strip() for s in [*out, text[start:]] if s.strip()]


def test_sentences(spark):
    texts = [
        "One. Two! Three? four", 'He said "no." Then left.', "Dr. Smith saw it vs. Nothing else. e.g. This stays.", "Dose 1.5 mg. 2 tablets", "a\n\nb\n \nc", "", "   ", "No end", "End.", "A. B. C. . D", "Fig.) X. Y", "ends. été. Été",
    ]
    d = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "k int, t string")
    got = {r.k: r.s for r in d.select("k", sentences(F.col("t")).alias("s")).collect()}
    assert got == {i: split_plainly(t) if t else [] for i, t in enumerate([*texts, None])}
    assert got[2] == ["Dr. Smith saw it vs. Nothing else. e.g. This stays."] and got[0] == ["One.", "Two!", "Three? four"]
    long = spark.createDataFrame([("Ab. " * 1000,)], "t string")
    assert long.select(F.size(sentences(F.col("t"))), F.size(sentences(F.col("t"), None))).first()[:] == (500, 1000)


def test_named(spark):
    rows = [("fatigue", "SYMPTOM"), (" Fatigue ", "SYMPTOM"), ("2021/03-04", "ENTITY"), ("flu", "DISEASE"), ("aspirin", "DRUG"), (lexicon.STOP_WORDS[0], "SYMPTOM"), ("asthma", "DISEASE")]
    d = spark.createDataFrame([(rows,), ([],), (None,)], f"e {KIND}")
    got = [r[0] for r in d.select(analysis.named(F.col("e"), F.expr(f"array('{lexicon.STOP_WORDS[0]}')"))).collect()]
    assert got == [["fatigue", "asthma"], [], None]


def test_analyse(spark):
    rows = [
        # an entity that its context makes a side effect, a drug, the own drug, and a dose
        (1, "Warfarin caused tingles after 5 mg", "Aspirin", [("tingles", "SYMPTOM"), ("Warfarin", "DRUG"), ("ASPIRIN", "DRUG"), ("Two Puffs", "DOSAGE")]),
        # a context that speaks of a disease makes a known side effect a symptom
        (2, "Patients diagnosed with nausea as a sign of the disease", "x", [("nausea", "SYMPTOM")]),
        # no context: the seeds tell, and an unknown entity is nothing
        (3, "nausea and glumness", "x", [("nausea", "SYMPTOM"), ("glumness", "DISEASE")]),
        # no entity: seeds alone
        (4, "nausea", "x", []),
        (5, "", None, []),
        (6, None, None, None),
        # the own drug's name nearby speaks for a side effect
        (7, "aspirin and glumness", "Aspirin", [("glumness", "DISEASE")]),
        # the context ends 200 characters before the entity
        (8, "caused " + "z" * 200 + " glumness", "x", [("glumness", "DISEASE")]),
        (9, "caused " + "z" * 190 + " glumness", "x", [("glumness", "DISEASE")]),
    ]
    d = spark.createDataFrame(rows, f"k int, text string, drug string, entities {KIND}").withColumn("found", T.terms_in(F.lower(F.coalesce("text", F.lit("")))))
    got = {r.k: (r.side_effects, r.symptoms, r.dosages, r.drugs) for r in analysis.analyse(d, "text", "drug", "entities", "found").collect()}
    assert got[1] == (["tingles"], [], ["5 mg", "two puffs"], ["warfarin"])
    assert got[2][:2] == ([], ["nausea"]) and got[3][:2] == (["nausea"], []) and got[4][:2] == (["nausea"], [])
    assert got[5] == got[6] == ([], [], [], [])
    assert got[7][0] == ["glumness"] and got[8][:2] == ([], []) and got[9][0] == ["glumness"]


def test_sentence_terms(spark):
    text = "Nothing here at 5 mg. Headache and nausea came. It was 20 mg with fatigue. Quiet end."
    d = spark.createDataFrame([(1, text, [("headache", "SYMPTOM")]), (2, None, None), (3, "Quiet 5 mg.", [])], f"k int, t string, e {KIND}")
    known = {r.k: r for r in analysis.sentence_terms(d, "t").collect()}
    assert (known[1].sentences, known[1].named, known[1].dosages) == (4, 2, ["20 mg"]) and {"headache", "nausea"} <= {*known[1].side_effects, *known[1].symptoms}
    assert (known[2].sentences, known[2].side_effects, known[3].named, known[3].dosages) == (0, [], 0, [])
    # with a model's entities only the sentence that holds one is looked at again
    model = {r.k: r for r in analysis.sentence_terms(d, "t", "e").collect()}
    assert (model[1].named, model[1].dosages) == (1, []) and "fatigue" not in {*model[1].side_effects, *model[1].symptoms}


def _item(n, day):
    return f'{{"n": {n}, "at": {{"day": "{day}"}}}}'


def test_paged_search(spark, tmp_path):
    rows = [("a/b c", 0, 0, _item(1, "2020-01-01")), ("a/b c", 0, 1, _item(2, "2001-01-01")), ("a/b c", 1, 0, _item(3, "2021")), ("a/b c", 2, 0, _item(4, "2022-03"))]
    rows += [("gap", 0, 0, _item(5, "2020-01-01")), ("gap", 2, 0, _item(6, "2020-01-01")), ("bad", 0, 0, "{"), ("bad", 0, 1, "[1]"), ("bad", 0, 2, _item(7, "2020-01-01")), ("bad", 1, 0, _item(8, "2020")), (None, 0, 0, _item(9, "2020"))]
    path = str(tmp_path / "answers")
    paged.land(spark.createDataFrame(rows, "drug_name string, page int, pos int, item string"), path)

    def numbers(**options):
        return sorted(n for (n,) in paged.search(spark, path, **options).selectExpr("get_json_object(item, '$.n')").collect() if n)

    assert numbers() == ["1", "2", "3", "4", "5", "7", "8"]  # a missing page ends a search; rows without a drug are none
    assert numbers(date_field="at.day") == ["1", "3", "4", "5", "7", "8"]
    assert numbers(date_field="at.day", cap=2) == ["1", "3", "5", "7", "8"]
    assert numbers(cap=1) == ["1", "5", "7"] and numbers(pages=1) == ["1", "2", "5", "7"]
    assert numbers(date_field="at.day", since="2021-01-01", until="2021-12-31") == ["3"] and numbers(date_field="at.none") == []
    corrupt = paged.search(spark, path, cap=1).filter("corrupt is not null").collect()
    assert sorted((r.drug_name, r.pos, r.item, r.corrupt) for r in corrupt) == [("bad", 0, None, "{"), ("bad", 1, None, "[1]")]
    one = paged.search(spark, path).filter("drug_name = 'a/b c'")
    assert one.count() == 4 and one.rdd.getNumPartitions() == 1 and paged.search(spark, path).rdd.getNumPartitions() == 3
    assert paged.search(spark, path).filter("drug_name in ('gap', 'bad') and page = 0").count() == 4
    assert paged.search(spark, path).filter("drug_name = 'none'").count() == 0 and paged.search(spark, str(tmp_path / "nothing")).count() == 0
    # a page that is there but empty ends its search
    (tmp_path / "answers" / "drug_name=gap" / "page=1").mkdir()
    assert "6" not in numbers()


def test_claims_go_on_after_a_restart(spark, tmp_path):
    finds, out, state = (str(tmp_path / n) for n in ("finds", "claims", "state"))
    schema = "article string, drug string, ord int"

    def run(*rows):
        if rows:
            spark.createDataFrame(rows, schema).write.mode("append").parquet(finds)
        stream = increment.claims(increment.read(spark, finds, schema), "article", "drug", "ord")
        increment.append_once(stream, out, state).awaitTermination()
        return sorted((r.article, r.drug, r.ord) for r in spark.read.schema(schema).parquet(out).collect())

    # ties by name; repeated finds and nulls claim nothing more
    first = run(("x", "b", 2), ("x", "c", 1), ("x", "a", 3), ("y", "b", 1), ("y", "a", 1), ("y", "a", 1), (None, "a", 0), ("z", None, 0))
    assert first == [("x", "c", 1), ("y", "a", 1)]
    # a later run finds an earlier place in the order: the article stays where it is
    assert run(("x", "a", 0), ("z", "d", 9)) == [*first, ("z", "d", 9)]
    assert run() == [*first, ("z", "d", 9)]


def test_handlers_of_further_sources(spark):
    rows = [("letters", "A", "nausea came up"), ("LETTERS ", "A", None), ("unknown", "A", "nausea"), ("reddit", "B", "nausea")]
    raw = spark.createDataFrame(rows, "source string, drug_name string, letter string").withColumn("review_text", F.col("letter"))
    handler = normalise.Handler(said=lambda: F.col("letter"))
    got = sorted((r.source, r.text_clean, tuple(r.side_effects), r.source_id) for r in normalise.normalise(raw, more={"letters": handler}).collect())
    assert got == [("letters", "", (), None), ("letters", "nausea came up", ("nausea",), None), ("reddit", "nausea", ("nausea",), None)]
    assert normalise.normalise(raw, keep_empty=False, more={"letters": handler}).count() == 2 and normalise.normalise(raw).count() == 1
    with pytest.raises(ValueError, match="reddit"):
        normalise.normalise(raw, more={"reddit": handler})
