"""What larger tables showed: names that ran together, years of five digits, features without spread, and steps whose work must not grow faster than their input."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from signalforge.plans import queries


def _documents(spark, path, ids):
    rows = [(i, "Text.", "en", "src1", 5) for i in ids]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{path}/documents.parquet")


def _sql(path, table, name):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    found = con.execute(queries.SQL[name])
    return [dict(zip([c[0] for c in found.description], r, strict=True)) for r in found.fetchall()]


def test_signals_of_different_documents_stay_apart(spark, tmp_path):
    # 6X and X, X of five digits: same source and day, and ` Drug1` + `6X` was ` Drug16` + `X`
    pairs = [i for i in range(10_000, 12_000) if i % 17 == 16]
    _documents(spark, tmp_path, [*pairs, *[600_000 + i for i in pairs]])
    got = [r.asDict() for r in queries.QUERIES["signal_counters"](spark, str(tmp_path)).collect()]
    assert got == _sql(tmp_path, "documents", "signal_counters") and got[0]["saved"] == got[0]["extracted"] > 50


def test_years_of_five_digits(spark, tmp_path):
    ids = [0, 1, 2_932_895, 2_932_896, 2_932_897, 5_999_999]
    spark.createDataFrame([(i,) for i in ids], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.day for r in queries.QUERIES["epoch_dates"](spark, str(tmp_path)).collect()}
    assert got == {r["event_id"]: r["day"] for r in _sql(tmp_path, "events", "epoch_dates")} and got[5_999_999] == "18397-07-14"


def _same(a, b):
    return a == b or isinstance(a, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.parametrize("name", ["nearest_neighbours", "local_outliers"])
def test_features_without_spread(spark, tmp_path, name):
    # every couple has two months: num_periods is one number, as on large tables, and 0 / 0 in SQL
    parts = [(p, f"name {p % 8}", f"brand {p // 8}") for p in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = [(p, f"2020-0{month}-01") for p, _, _ in parts for month in (1, 2) for _ in range(1 + p * month % 7)]
    items = spark.createDataFrame(rows, "l_partkey long, day string").select("l_partkey", F.lit("N").alias("l_returnflag"), F.to_timestamp("day").alias("l_shipdate"))
    items.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall())
    have = sorted(tuple(r) for r in got.collect())
    assert len(have) == len(want) == 40 and all(_same(a, b) for x, y in zip(have, want, strict=True) for a, b in zip(x, y, strict=True))


def test_distances_that_are_none_come_last(spark):
    nan = float("nan")
    d = spark.createDataFrame([("a", 0.0), ("b", nan), ("c", 1.0), ("d", nan), ("e", None)], "key string, x double")
    from signalforge.operators import near

    got = {}
    for r in near.neighbours_of_all(d, "key", ["x"], 2).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append((r.neighbour, None if math.isnan(r.distance) else r.distance))
    assert got == {"a": [("c", 1.0), ("b", None)], "c": [("a", 1.0), ("b", None)], "b": [("a", None), ("c", None)], "d": [("a", None), ("b", None)]}


def test_claims_take_no_call_an_item(spark, tmp_path):
    # items were handed to Python one by one, with two calls to the state store each
    from signalforge.streaming import increment

    path, schema = str(tmp_path / "finds"), "article long, drug string, ord long"
    finds = spark.range(60_000).select((F.col("id") % 20_000).alias("article"), F.concat(F.lit("d"), F.col("id") % 7).alias("drug"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 1000).alias("ord"))
    finds.write.parquet(path)
    stream = increment.claims(increment.read(spark, path, schema), "article", "drug", "ord")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Deduplicate" in plan
    increment.append_once(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.article: (r.drug, r.ord) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()}
    first = F.min(F.struct(F.col("ord").isNull(), "ord", "drug")).alias("f")
    assert got == {r.article: (r.f.drug, r.f.ord) for r in finds.groupBy("article").agg(first).collect()} and len(got) == 20_000


def test_pages_lie_together(spark, tmp_path):
    # a folder a page made the driver commit thousands of them one by one
    from signalforge.sources import paged

    path = str(tmp_path / "answers")
    items = spark.range(3000).selectExpr("concat('d', id % 2) AS drug_name", "cast(id DIV 4 AS int) AS page", "id AS pos", """CASE WHEN id = 1600 THEN '[\n{"n": 1}' ELSE '{"n": ' || id || '}' END AS item""")
    paged.land(items, path)
    assert len(list((tmp_path / "answers").glob("*/*/*.txt"))) == 6
    rows = paged.search(spark, path).orderBy("drug_name", "page", "pos").collect()
    assert len(rows) == 3001 and [(r.page, r.pos, r.item, r.corrupt) for r in rows if r.drug_name == "d0" and r.page == 400] == [(400, 0, None, "["), (400, 1, '{"n": 1}', None), (400, 2, '{"n": 1602}', None)]
    assert {r.page for r in paged.search(spark, path, pages=300).collect()} == set(range(300)) and paged.search(spark, path, cap=5).count() == 10
    # pages that others landed, a folder each, are read as before
    (tmp_path / "answers" / "drug_name=x" / "page=0").mkdir(parents=True)
    (tmp_path / "answers" / "drug_name=x" / "page=0" / "a.txt").write_text('{"n": 9}\n')
    assert paged.search(spark, path).filter("drug_name = 'x'").count() == 1


def test_forum_texts_are_judged_once(spark, monkeypatch):
    # posts were searched anew for the comments, for the counts and for the result, and whole texts were ranked in a window a page
    from signalforge.sources import landed

    calls, plain = [], landed.relevant
    monkeypatch.setattr(landed, "relevant", lambda text, drug: calls.append(1) or plain(text, drug))
    text = "Aspirin caused by it: nausea, so " + "x" * 2000
    rows = [("aspirin", 0, page, pos, f"{page}-{pos}", "", text + str(pos), 1, "AskDocs", 0.0, "") for page in (0, 1) for pos in range(5)]
    posts = spark.createDataFrame(rows, "drug_name string, forum int, page int, pos int, id string, title string, selftext string, score int, subreddit string, created_utc double, permalink string")
    said = [(f"0-{k}", k, f"c{k}", f"{k} aspirin gave me a rash, and it made me sick", 5, "other", 86400.0) for k in range(5)]
    comments = spark.createDataFrame(said, "post_id string, pos int, id string, body string, score int, subreddit string, created_utc double")
    out = landed.forum_pages(posts, comments)
    rows = {r.id: r for r in out.collect()}
    assert set(rows) == {"0-0", "c0", "c1", "c2"} and rows["c1"].subreddit == "AskDocs" and rows["c1"].review_date == "1970-01-02" and rows["0-0"].review_text == text[:1000]
    assert len(calls) == 2 and "Contains" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_searched_once(spark):
    # the number of searches in a term's expression was four times that of the patterns, and twice that where nothing is told
    from signalforge import lexicon
    from signalforge.functions import text as T
    from signalforge.operators import analysis

    d = spark.createDataFrame([("may cause nausea", "aspirin")], "text string, drug string")
    once = len(lexicon.SIDE_EFFECT_PATTERNS) + len(lexicon.SYMPTOM_PATTERNS)
    searches = lambda c: str(c).upper().count("RLIKE")
    assert searches(T.relation(F.col("text"), F.lit(True))) == once
    assert searches(analysis.judged(F.col("text"), analysis.known_entities(F.array(F.lit("nausea"))), F.col("drug"))) == once
    assert [r[0] for r in d.select(T.relation(F.col("text"), F.col("drug").isNull())).collect()] == ["side_effect"]


def test_density_clusters_count_items_once(spark, monkeypatch):
    from pyspark.sql import DataFrame

    seen, plain = [], queries.series
    monkeypatch.setattr(queries, "series", lambda *a: plain(*a))
    monkeypatch.setattr(queries.cluster, "to_periods", lambda s, *a: seen.append(s) or s)
    queries.QUERIES["hdbscan_clusters"](spark, "/root/testdata/sf0.001")
    assert isinstance(seen[0], DataFrame) and not any("lineitem" in f for f in seen[0].inputFiles())
