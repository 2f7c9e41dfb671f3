"""Golden cases, properties and odd rows of the analytics engine."""

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalforge import lexicon
from signalforge.functions import dates as D
from signalforge.functions import text as T
from signalforge.operators import alerts, anomaly, cluster, enrich, entities, features, graph, near, quality, stored, upsert
from signalforge.plans import normalise, queries, temporal
from signalforge.sources import html, landed, xml
from signalforge.streaming import increment


def one(spark, values, f, kind="string"):
    d = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.r for r in d.select("k", f(F.col("v")).alias("r")).orderBy("k").collect()]


def test_dates(spark):
    cases = {
        "2020-1-5": "2020-01-05", "2020/07": "2020-07-01", "March 5, 2021": "2021-03-05", "Mar 5, 2021": "2021-03-05", "5 March 2021": "2021-03-05", "1998": "1998-01-01", "2021 Mar-Apr": "2021-01-01",
        "2020-13-40": "2020-01-01", "2024-02-30": "2024-02-01", "2021-03-04T10:00:00": "2021-03-01", "20190101": None, "Winter 1998": None, "": None, None: None, "5 mar 2021": "2021-03-05", " 2020-02-29 ": "2020-02-29",
    }
    got = one(spark, list(cases), D.parse_date)
    assert [None if d is None else d.isoformat() for d in got] == list(cases.values())
    assert [(d := D.parse_date_text(c)) and d.isoformat() for c in cases if c] == [v for c, v in cases.items() if c]


def test_ranges(spark):
    start, end = D.parse_range(F.col("v"))
    d = spark.createDataFrame([("2020-01-02 → 2021-03-04",), ("2020-01-02 to 2021-02-30",), ("2020",), (None,)], "v string").select(start.cast("string").alias("a"), end.cast("string").alias("b"))
    assert [tuple(r) for r in d.collect()] == [("2020-01-02", "2021-03-04"), ("2020-01-02", "2021-02-01"), ("2020-01-01", None), (None, None)]


def test_small_functions(spark):
    assert one(spark, ["20210304", "2021", None], D.compact_date) == ["2021-03-04", "2021", None]
    assert one(spark, [0.0, None, 86400.0], D.epoch_date, "double") == ["", "", "1970-01-02"]
    assert one(spark, ["a&nbsp;&lt;b&gt;x <i>y</i>  z", None, "   q "], T.clean_text) == ["a x y z", "", "q"]
    assert one(spark, ["MDD", "colds, hay fever", "Foo, bar baz", "Foo Bar"], T.condition) == ["major_depressive_disorder", "common_cold", "foo", "foo_bar"]
    assert one(spark, [["back pain", "pain", "rash"], []], T.longest_terms, "array<string>") == [["back pain", "rash"], []]
    assert one(spark, ["20 mg, 5.5MG and 2 tablets; 3 Capsule", "none"], T.dosages) == [["2 tablet", "20 mg", "3 capsule", "5.5 mg"], []]
    assert one(spark, ["Expand Section x® http://a.b y -", None], T.clean_page_text) == ["x y", ""]
    assert one(spark, [" Nausea and Vomiting", "heart palpitations", "other"], T.normal_term) == ["nausea", "palpitations", "other"]
    assert one(spark, ["high", None, "x"], lambda c: features.coerced(c)) == [0.0, 0.0, 0.0]


def test_seed_terms(spark):
    texts = ["Patients may experience nausea, vomiting, dizziness after taking celecoxib. The underlying disease caused postoperative pain and inflammation.", "Took 20 mg, then drowsiness, hives and itching. Shortness of breath and back pain followed.", "éfever"]
    effects, symptoms = T.seed_terms(T.terms_in(F.lower("v")))
    d = spark.createDataFrame([(t,) for t in texts], "v string").select(effects.alias("e"), symptoms.alias("s"), T.dosages(F.col("v")).alias("d")).collect()
    assert (d[0].e, d[0].s, d[0].d) == (["dizziness", "nausea", "vomiting"], ["inflammation", "pain"], [])
    assert (d[1].e, d[1].s, d[1].d) == (["pruritus", "somnolence", "urticaria"], ["back pain", "dyspnea", "pain"], ["20 mg"])
    assert d[2].s == []


def test_terms_in_equals_single_searches(spark):
    """One pass finds what a search for each term finds: within others, at the beginning of others, overlapping, beside any letter."""
    terms = ["pain", "back pain", "pain back", "back", "b", "a b", "b a", "a b a", "back pain killer", "x/y", "é", "pins and needles", "needles"]
    rng = random.Random(2)
    texts = ["", "back pain back", "back pain killers back pain killer", "a b a b a", "pins and needles", "xé é", "pain_ _pain 1pain pain1 pain", "x/y-x/y", "back  pain", "BACK"]
    texts += ["".join(rng.choice(["a", "b", " ", " ", "pain", "back", "-", "é", "needles"]) for _ in range(30)) for _ in range(60)]
    want = [sorted(t for t in terms if re.search(rf"\b{re.escape(t)}\b", text)) for text in texts]
    assert one(spark, texts, lambda c: F.array_sort(T.terms_in(c, terms))) == want
    assert one(spark, texts, lambda c: T.seeds_in(c, terms)) == [[t for t in terms if t in found] for found in want]
    assert one(spark, [None], lambda c: T.terms_in(c, terms)) == [None]


def test_context_terms(spark):
    effects, symptoms = T.context_terms(T.context_found(F.col("v"), T.EFFECT_CONTEXT), T.context_found(F.col("v"), T.SYMPTOM_CONTEXT))
    texts = ["It may cause rash" + " " * 10 + "and hives. Symptoms of fever", "may cause " + "x" * 200 + " rash", ""]
    d = spark.createDataFrame([(t,) for t in texts], "v string").select(effects.alias("e"), symptoms.alias("s")).collect()
    assert (sorted(d[0].e), d[0].s) == (["hives", "rash"], ["fever"])
    assert (d[1].e, d[2].e) == ([], [])


def series(spark, counts, drug="a", effect="e"):
    return spark.createDataFrame([(drug, effect, f"20{k // 12 + 10}-{k % 12 + 1:02d}", c) for k, c in enumerate(counts)], "drug string, side_effect string, period string, mention_count long")


def test_rolling_zscore_goldens(spark):
    r = anomaly.rolling_zscore(series(spark, [1, 2, 3, 2, 1, 2, 3, 2, 1, 2, 3, 20])).orderBy("period").collect()
    assert [x.z_score_rolling for x in r] == [0, 0, 0, 0, -2.3094, 0, 2.3094, 0, -2.3094, 0, 2.3094, 18.0]
    assert [k for k, x in enumerate(r) if x.is_anomaly] == [11] and r[0].window_used == 3 and r[0].rolling_mean is None
    r = anomaly.rolling_zscore(series(spark, [10, 11, 9, 8, 6, 5, 3, 2, 1])).orderBy("period").collect()
    assert [x.z_score_rolling for x in r[3:]] == [-2, -2.1822, -1.7457, -2.1822, -1.7457, -1.5275]
    assert [k for k, x in enumerate(r) if x.is_anomaly] == [0, 1, 2]
    for counts in ([1, 9, 5], [4] * 6, [7], [1, 2]):
        r = anomaly.rolling_zscore(series(spark, counts)).collect()
        assert not any(x.is_anomaly for x in r) and len(r) == len(counts)
        assert len(counts) > 2 or {x.method for x in r} == {"trop_court"}
    assert anomaly.rolling_zscore(series(spark, [1, 2], drug=None)).count() == 0
    assert anomaly.rolling_zscore(series(spark, [1]).filter("false")).count() == 0


def test_couple_stats(spark):
    r = features.couple_stats(series(spark, [2, 6])).first()
    assert (r.mean_count, r.total_mentions, r.num_periods, r.max_count, r.min_count, r.year_last, r.month_last) == (4.0, 8, 2, 6, 2, 2010, 2)
    assert math.isclose(r.cv, r.std_count / 4)
    r = features.couple_stats(series(spark, [3])).first()
    assert (r.std_count, r.cv) == (0.0, 0.0)


def test_quality(spark):
    rows = [("x", "pubmed", "t" * 120, ["nausea"], 1.0), ("a", "webmd", "t" * 60, ["rash"], 0.05), ("", "vigiaccess", "", [], 0.0), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "drug_name string, source string, text_clean string, side_effects array<string>, source_authority double")
    r = quality.flag_records(d).collect()
    assert (r[0].quality_score, r[0].quality_label, r[0].flags) == (100, "good", [])
    assert (r[1].quality_score, r[1].quality_label, r[1].flags) == (90, "good", ["text_short", "low_authority"])
    assert (r[2].quality_score, r[2].quality_label) == (10, "poor")
    assert r[2].flags == ["missing_fields:drug_name,text_clean,side_effects", "text_too_short", "no_side_effects", "no_authority_score", "missing_drug_name", "unknown_source"]
    assert r[3].quality_score == 0 and r[3].flags[0] == "missing_fields:drug_name,source,text_clean,side_effects"


def test_alerts_and_fusion(spark):
    d = spark.createDataFrame([(a, b, c) for a in (True, False) for b in (True, False) for c in (True, None)], "lof_anomaly boolean, iforest_anomaly boolean, zscore_anomaly boolean")
    levels = {r.nb_algos: r.alert_level for r in alerts.alert_levels(d).collect()}
    assert levels == {3: "CRITIQUE", 2: "ELEVEE", 1: "MODEREE", 0: "NORMAL"}
    k = series(spark, [1, 2]).withColumn("kmeans_cluster", F.lit(1))
    none = k.filter("false")
    r = alerts.fuse_clusters(k, none.withColumn("agglo_cluster", F.lit(0)), none.withColumn("hdbscan_cluster", F.lit(0))).collect()
    assert [(x.kmeans_cluster, x.agglo_cluster, x.hdbscan_cluster) for x in r] == [(1, -2, -2)] * 2
    assert alerts.duplicate_keys(k.union(k)).first()[0] == 2


def test_hits(spark):
    scores = graph.hits(graph.citations(spark))
    r = {x.source: (x.authority_score, x.hub_score, x.source_type) for x in scores.collect()}
    assert r["pubmed"] == (1.0, 0.0, "authority") and r["webmd"] == (0.158, 1.0, "hub") and r["openfda"] == (0.8847, 0.5093, "authority") and r["drugscom"] == (0.0164, 0.4431, "hub")
    names = spark.createDataFrame([("drugs.com",), ("clinicaltrials.gov",), ("",), ("unknownsrc",), (None,)], "source string")
    found = {x.source: x.source_authority for x in graph.source_authority(names, scores).collect()}
    assert found == {"drugs.com": 0.0164, "clinicaltrials.gov": 0.7284, "": 0.7284, "unknownsrc": 0.5, None: 0.7284}
    assert graph.hits(graph.citations(spark).filter("false")).count() == 0


def test_graph_tables(spark, tmp_path):
    html = '<a href="/x?q">x</a><A class="k" HREF="https://B.org/y#z">y</A><a name="q">no</a><a href="">e</a><a href="/x">again</a>'
    pages = spark.createDataFrame([("http://A.org/1", html), ("https://b.org", '<a href="/x">x</a>'), (None, html), ("no address", html), ("http://c.org/", None)], "url string, html string")
    edges = graph.links(pages)
    assert sorted(map(tuple, edges.collect())) == [("a.org", "/x"), ("a.org", "b.org"), ("b.org", "/x")]
    for _ in range(2):  # a rerun leaves the same tables
        graph.write_graph(edges, str(tmp_path))
        graph.write_scores(graph.hits(edges), str(tmp_path))
    nodes, read = graph.read_graph(spark, str(tmp_path))
    assert sorted(map(tuple, nodes.collect())) == [("/x", 0, 2), ("a.org", 2, 0), ("b.org", 1, 1)] and read.count() == 3
    assert {r.source for r in spark.read.parquet(f"{tmp_path}/scores").collect()} == {"/x", "a.org", "b.org"}


@pytest.mark.parametrize("values", [[], [1.0], [2.0] * 90 + [5.0, 1.0, 7.0], [3, 1, 2, None, float("nan"), 4], "many"])
def test_exact_quantiles(spark, values):
    values = [random.Random(1).gauss(0, 1) for _ in range(700)] if values == "many" else values
    d = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    own = [v for v in values if v is not None and v == v]
    want = [float(np.percentile(own, 100 * s)) for s in (0, 0.25, 0.5, 0.9, 1)] if own else [None] * 5
    got = features.exact_quantiles(d, "v", [0, 0.25, 0.5, 0.9, 1], parts=5)
    assert got == want if not own else np.allclose(got, want, rtol=1e-12)


def test_best_signal_and_confidence(spark):
    rows = [("2026-12-31", ["clinical_study", "study_end"], 0, "end"), ("2020-01-01", ["clinical_study"], 1, "first"), ("2020-01-01", ["clinical_study"], 2, "second"), (None, None, 3, "none")]
    d = spark.createDataFrame(rows, "event_date string, signal_type array<string>, ord int, year_month string").withColumn("is_range", F.lit(False))
    assert d.agg(enrich.best_signal().alias("b")).first().b.year_month == "first"
    c = spark.createDataFrame([(50, "pharmacy"), (10, "x"), (0, "AskDocs"), (9, "x")], "score int, sub string").select(landed.confidence(F.col("score"), F.col("sub")).alias("c"))
    assert [r.c for r in c.collect()] == ["high", "medium", "medium", "low"]


def test_upserts_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 2)], "k int, v string, w string, ord int")
    new = spark.createDataFrame([(2, "c", None, 3), (3, "d", "z", 4), (3, "e", None, 5)], "k int, v string, w string, ord int")
    once = upsert.last_wins(old, new, ["k"], "ord")
    expected = [(1, "a", "x"), (2, "c", "y"), (3, "e", "z")]
    assert sorted((r.k, r.v, r.w) for r in once.collect()) == expected
    assert sorted((r.k, r.v, r.w) for r in upsert.last_wins(once, new, ["k"], "ord").collect()) == expected
    first = upsert.first_wins(old, new, ["k"], "ord")
    assert sorted((r.k, r.v) for r in first.collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert sorted((r.k, r.v) for r in upsert.first_wins(first, new, ["k"], "ord").collect()) == [(1, "a"), (2, "b"), (3, "d")]


def test_lof_and_neighbours(spark):
    grid = [(f"{x:02d}{y:02d}", float(x), float(y)) for x in range(12) for y in range(12)] + [("far", 40.0, 40.0)]
    d = spark.createDataFrame(grid, "key string, x double, y double")
    found = near.neighbours(d, "key", ["x", "y"], 5, tile=40, cell=20).collect()
    points = {k: np.array([x, y]) for k, x, y in grid}
    for key in ("0000", "0506", "far"):
        got = [(r.neighbour, r.distance) for r in sorted((r for r in found if r.key == key), key=lambda r: r.rank)]
        want = sorted(((float(np.sqrt(((p - points[key]) ** 2).sum())), k) for k, p in points.items() if k != key))[:5]
        assert got == [(k, v) for v, k in want]
    lof = {r.key: r for r in anomaly.local_outlier_factor(d, "key", ["x", "y"], 10).collect()}
    assert lof["far"].is_anomaly and 0.9 < lof["0506"].lof_score < 1.1


def test_neighbours_of_crowds_and_odd_points(spark):
    """Equal points, ties, far points, points without a place; fewer points than neighbours asked for."""
    rng = np.random.default_rng(4)
    rows = [(f"p{k:03d}", *map(float, np.round(rng.normal(size=2) * (1 if k % 5 else 30), 1))) for k in range(260)] + [(f"same{k:03d}", 0.5, 0.5) for k in range(130)]
    rows += [("null", None, 1.0), ("nan", float("nan"), 1.0), ("inf", float("inf"), 1.0)]
    d = spark.createDataFrame(rows, "key string, x double, y double").repartition(5)
    points = {k: np.array([x, y]) for k, x, y in rows[:-3]}
    for k, few in ((7, None), (3, 2)):
        some = d.filter(F.col("key") < "p002") if few else d
        got = {}
        for r in near.neighbours(some, "key", ["x", "y"], k, tile=50, cell=15).collect():
            got.setdefault(r.key, []).append((r.rank, r.distance, r.neighbour))
        own = {n: v for n, v in points.items() if not few or n < "p002"}
        for name, at in own.items():
            want = sorted((float(np.sqrt((v[0] - at[0]) ** 2 + (v[1] - at[1]) ** 2)), n) for n, v in own.items() if n != name)[:k]
            assert sorted(got[name]) == [(j + 1, *w) for j, w in enumerate(want)]
        assert set(got) == set(own)
    assert near.neighbours(d.filter("false"), "key", ["x", "y"], 3).count() == 0


def test_places_sent_grow_with_the_points(spark):
    """Four times the points, four times the rows that are sent to cells: not sixteen times."""
    sent = []
    for n in (2000, 8000):
        x = np.random.default_rng(n).normal(size=(n, 2))
        d = spark.createDataFrame([(f"{k}", [float(a), float(b)]) for k, (a, b) in enumerate(x)], "key string, x array<double>")
        places = stored.stored(near.places_of(d, 6), "test-places")
        centres = near.pivots(places, 64)
        cells = stored.stored(near.in_cells(places, centres), "test-cells")
        sent.append(near.reaching(cells.select("id", "x"), centres, sum(near.bounds(cells, centres, 5))).count())
        stored.discard(places, cells)
    assert sent[0] < 40 * 2000 and sent[1] < 6 * sent[0]


def test_isolation_forest(spark):
    rng = np.random.default_rng(0)
    rows = [(k, *map(float, rng.normal(size=3))) for k in range(600)] + [(9000, 9.0, 9.0, 9.0)]
    d = anomaly.isolation_forest(spark.createDataFrame(rows, "k int, a double, b double, c double"), ["a", "b", "c"])
    r = d.orderBy(F.desc("if_score")).collect()
    assert r[0].k == 9000 and r[0].if_anomaly == 1 and all(0 < x.if_score < 1 for x in r)
    assert anomaly.isolation_forest(d.select("k", "a").filter("false"), ["a"]).count() == 0


def blobs(spark, n=60):
    rng = np.random.default_rng(1)
    rows = [("d", f"{b}{k:03d}", float(x), float(y), b) for b, (cx, cy) in enumerate([(0, 0), (8, 0), (0, 8), (9, 9)]) for k, (x, y) in enumerate(rng.normal((cx, cy), 0.6, (n, 2)))]
    return spark.createDataFrame(rows, "drug string, side_effect string, x double, y double, blob int")


def agrees(rows, label):
    pairs = {(r.blob, r[label]) for r in rows}
    return len(pairs) == 4 and len({p[1] for p in pairs}) == 4


def test_components_and_centres_equal_numpy(spark):
    """The registered queries against eigenvectors and nearest centres worked out by numpy from the same scaled features."""
    folder, columns = "/root/testdata/sf0.001", [f"z_{c}" for c in features.COUPLE_FEATURES]
    stats = features.scaled(features.couple_stats(queries.series(spark, folder)), features.COUPLE_FEATURES).collect()
    at = {(r.drug, r.side_effect): [float(r[c]) for c in columns] for r in stats}
    x = np.array(list(at.values()))
    shares, vectors = np.linalg.eigh(np.cov(x.T))
    shares, vectors = shares[::-1] / shares.sum(), vectors[:, ::-1]
    n = int(np.searchsorted(np.cumsum(shares), 0.95) + 1)
    want = dict(zip(at, x @ vectors[:, :n], strict=True))
    found = queries.principal_components(spark, folder).collect()
    assert len(found) == len(at) and {r.components for r in found} == {n}
    got = np.array([r.pc for r in found])
    assert np.allclose(np.abs(got), np.abs([want[r.drug, r.side_effect] for r in found]), atol=1e-6)
    labels = {(r.drug, r.side_effect): r.kmeans_cluster for r in queries.kmeans_clusters(spark, folder).collect()}
    assert labels.keys() == at.keys()
    own = np.array([labels[k] for k in at])
    centres = np.array([x[own == c].mean(axis=0) for c in range(4)])
    assert [tuple(c) for c in centres] == sorted(tuple(c) for c in centres)
    apart = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (apart.argmin(axis=1) == own).mean() > 0.99  # where the rounds end, all but a few lie nearest their own centre
    cost = apart[np.arange(len(x)), own].sum()
    for seed in range(20):  # no plain start does better by more than a hundredth
        c = x[np.random.default_rng(seed).choice(len(x), 4, replace=False)]
        for _ in range(100):
            mine = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[mine == k].mean(axis=0) if (mine == k).any() else c[k] for k in range(4)])
        assert cost <= 1.01 * ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_clusterers_find_blobs(spark):
    d = blobs(spark)
    assert agrees(cluster.kmeans(d, ["x", "y"], starts=3).collect(), "kmeans_cluster")
    assert agrees(cluster.ward(d, ["x", "y"]).collect(), "agglo_cluster")
    found = cluster.hdbscan(d, ["x", "y"], least=20, samples=5).filter("hdbscan_cluster >= 0").collect()
    assert agrees(found, "hdbscan_cluster") and len(found) > 200
    assert cluster.silhouette(d, ["x", "y"], "blob") > 0.7
    index = cluster.quality(d, ["x", "y"], "blob").first()
    assert index.clusters == 4 and index.davies_bouldin < 0.5 and index.calinski_harabasz > 100
    out, n = cluster.principal(d.withColumn("z", F.col("x") * 2), ["x", "y", "z"])
    assert n == 2 and len(out.first().pc) == 2


def test_monograph_and_effects():
    page = '<h1>Aspirin®</h1><div id="why"><p>Aspirin is in a class of medications called salicylates. It is used for pain and fever.</p></div><div id="side-effects"><ul><li>nausea; heartburn</li></ul><h3>Serious ones</h3><p>hives, rash</p><p>call your doctor</p></div>'
    r = html.drug_record(page)
    assert (r["drug_name"], r["drug_class"]) == ("Aspirin", "salicylates")
    assert r["side_effects"] == {"mild": ["nausea", "heartburn"], "serious": ["hives", "rash"], "total": 4}
    assert html.drug_record("")["side_effects"]["total"] == 0 and html.drug_record("<p><b>odd")["drug_name"] == ""
    page = '<div id="sideEffects"><h2>Side Effects</h2><li>a</li><h3>Severe</h3><li>b</li><li>a</li><h3>Rare</h3><li>c</li><h2>Dose</h2><li>d</li></div>'
    assert html.page_effects(page, "drugscom") == {"common": ["a"], "serious": ["b"], "rare": ["c"]}
    assert html.page_effects("", "webmd") == {"common": [], "serious": [], "rare": []}


def test_article():
    content = "<!DOCTYPE x><r><AbstractText>Some <b>bold</b> tail</AbstractText><DescriptorName> Pain </DescriptorName><PubDate><Year>2020</Year><Month>March</Month><Day>x</Day></PubDate><DateRevised><Year>2019</Year><Month>13</Month></DateRevised></r>"
    assert xml.article(content) == {"abstract": "Some ", "title": "", "mesh": ["pain"]}
    assert xml.article_dates(content) == [dt.date(2020, 3, 1)]
    assert xml.article("<broken") == {"abstract": "", "title": "", "mesh": []} and xml.article_dates(None) == []


def test_normalised_records(spark):
    rows = [
        ("reddit", " Aspirin ", "Took 20 mg and it caused nausea &amp; <b>hives</b>.", None), ("openfda", "Aspirin", None, "rash, pain"), ("clinicaltrials", "x", None, None), ("other", "x", "y", None), (None, None, None, None), ("WebMD", "a", None, None),
    ]
    raw = spark.createDataFrame(rows, "source string, drug_name string, review_text string, symptom string").withColumn("mine", F.lit("kept"))
    out = {r.source: r for r in normalise.normalise(raw).collect()}
    assert set(out) == {"reddit", "openfda", "clinicaltrials", "webmd"}
    r = out["reddit"]
    assert (r.drug_name, r.text_clean, r.side_effects, r.dosages, r.mine) == ("aspirin", "Took 20 mg and it caused nausea & hives .", ["nausea", "urticaria"], ["20 mg"], "kept")
    assert out["openfda"].side_effects == ["rash, pain"]
    split = {r.source: r for r in normalise.normalise(raw, split_terms=True).collect()}
    assert split["openfda"].side_effects == ["pain", "rash"]
    for r in out.values():
        assert not set(r.side_effects) & set(r.symptoms)
        assert not any(a != b and a in b for a in r.side_effects for b in r.side_effects)
    assert normalise.normalise(raw.filter("false")).count() == 0
    assert {r.source for r in normalise.normalise(raw, keep_empty=False).collect()} == {"reddit", "openfda"}


def test_temporal_signals(spark):
    rows = [("reddit", "A", "2021-05-06", None, None), ("reddit", "A", "2017-05-06", None, None), ("clinicaltrials", "B", None, "2020-01", "2019-01-01 → 2022-02-02"), ("clinicaltrials", "C", None, "2022-02-02", "2019-01-01 → 2022-02-02"), ("webmd", "D", "2021-05-06", None, None), ("pubmed", "E", None, None, "2019-01-01 to 2026-12-31")]
    raw = spark.createDataFrame(rows, "source string, drug_name string, review_date string, start_date string, date_range string")
    got = sorted((r.drug_name, r.event_date, r.is_range, "study_end" in r.signal_type) for r in temporal.signals(raw).collect())
    assert got == [("a", "2021-05-06", False, False), ("b", "2020-01-01", True, False), ("b", "2022-02-02", True, True), ("c", "2022-02-02", True, False), ("e", "2019-01-01", False, False)]
    found = temporal.signals(raw)
    assert temporal.new_signals(found.union(found), found.limit(2)).count() == 3


def test_resumable_stream(spark, tmp_path):
    schema = "sig_hash string, ts timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda *keys: spark.createDataFrame([(k, dt.datetime(2024, 1, 1)) for k in keys], schema).coalesce(1)  # noqa: E731, DTZ001
    rows("a", "b", "a").write.parquet(source)
    for more in ((), ("b", "c")):
        if more:
            rows(*more).write.mode("append").parquet(source)
        stream = increment.first_of_key(increment.read(spark, source, schema), "sig_hash", "ts")
        increment.append_once(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(r.sig_hash for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_unique_keys_hold(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string")
    upsert.append_unique(rows((1, "a"), (None, "b"), (None, "b")), path, [["k"], ["k", "v"]])
    for bad in (rows((1, "c")), rows((2, "x"), (2, "y"))):  # one is there, one repeats by itself
        with pytest.raises(Exception, match="repeated key"):
            upsert.append_unique(bad, path, [["k"]])
        assert spark.read.parquet(path).count() == 3
    upsert.append_unique(rows((2, "x"), (None, "b")), path, [["k"]])
    assert spark.read.parquet(path).count() == 5


def test_months_and_upserts_of_streams(spark, tmp_path):
    schema = "drug string, effect string, ts timestamp"
    source, table, done = (str(tmp_path / n) for n in ("in", "days", "upserts"))
    days = ["2024-01-31", "2024-02-01", "2024-02-29", "2024-03-01", "2024-03-01", "2024-06-01"]
    spark.createDataFrame([("d", "e", dt.datetime.fromisoformat(x)) for x in days], schema).coalesce(1).write.parquet(source)
    events = increment.read(spark, source, schema)
    increment.append_once(increment.monthly_mentions(events, "drug", "effect", "ts"), table, str(tmp_path / "c1")).awaitTermination()
    got = {r.period: r.mention_count for r in increment.by_month(spark.read.parquet(table)).collect()}
    assert got == {"2024-01": 1, "2024-02": 2, "2024-03": 2}  # the last day is still open
    for _ in range(2):  # the second run finds nothing new
        increment.upsert_once(events, lambda batch, n: batch.write.mode("append").parquet(done), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(done).count() == 6


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", 2)], "source string, n long")
    upsert.write_json(d, str(tmp_path / "j"))
    upsert.write_csv(d, str(tmp_path / "c"))
    upsert.write_by_source(d, str(tmp_path / "p"))
    upsert.write_by_source(d.filter("source = 'a'").withColumn("n", F.lit(7).cast("long")), str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert sorted((r.source, r.n) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("a", 7), ("b", 2)]


def test_changing_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"n": 1, "s": "x"}, {"n": "no number", "s": "y"}, {"s": "z"}]')
    got = landed.json_array(spark, str(tmp_path / "a.json"), "n int, s string").cache()
    assert sorted((r.n or 0, r.s, r.corrupt is not None) for r in got.collect()) == [(0, "y", True), (0, "z", False), (1, "x", False)]
    d = spark.createDataFrame([('{"a": {"b": 7}}',), ('{"a": [1]}',), ("[1, 2]",), ("{",), (None,), ('{"a": {"b": "7"}}',), ('{"a": {"b": "seven"}}',)], "j string")
    found = [(r.b, r.unreadable) for r in landed.answers(d, "j", {"b": ("$.a.b", "int")}).collect()]
    assert found == [(7, False), (None, False), (None, False), (None, True), (None, False), (7, False), (None, False)]


def test_lexicon_sizes():
    assert [len(x) for x in (lexicon.SIDE_EFFECTS, lexicon.SYMPTOMS_NLP, lexicon.SYMPTOMS, lexicon.ALIASES, lexicon.STOP_WORDS, lexicon.TRIAL_STOP_WORDS)] == [72, 51, 50, 27, 29, 44]


@pytest.mark.parametrize("seed", range(3))
def test_longest_terms_property(spark, seed):
    rng = random.Random(seed)
    sets = [["".join(rng.choice("ab ") for _ in range(rng.randint(1, 4))) for _ in range(6)] for _ in range(20)]
    for terms, got in zip(sets, one(spark, sets, T.longest_terms, "array<string>"), strict=True):
        assert got == sorted({t for t in terms if not any(t != u and t in u for u in terms)})


def test_entities_relations_sentiment(spark):
    d = spark.createDataFrame([("aspirin helped, not good", 1), ("", 2), (None, 3), ("horrible pain", 4)], "text string, k int")
    r = {x.k: x for x in d.select("k", entities.sentiment(entities.score_text(F.col("text"))).alias("s")).collect()}
    assert (r[4].s.label, r[2].s.label, r[3].s.score) == ("negative", "neutral", 0.0) and r[1].s.label == "positive"
    found = entities.extract(d.filter("text is not null"), "text", lambda: lambda chunks: [[(w, "CHEMICAL") for w in c.split()] for c in chunks])
    assert {x.k: [e.text for e in x.entities] for x in found.collect()}[1] == ["aspirin", "helped,", "not", "good"]
    assert entities.extract(d, "text").first().entities == []
    model = entities.relation_model(entities.silver_examples(spark))
    c = spark.createDataFrame([("rash began after the dose of the drug",), ("diagnosed with tremor from the disease",), ("zzz",)], "text string")
    got = [x.relation for x in entities.classify_relations(c, model, "text", F.lit(False)).collect()]
    assert got[:2] == ["side_effect", "symptom"]
