"""The queries op1_ to op13_ over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import infill, langmodel, licenses, linedup, mixing, neardup, packing, passages, periods, pii, quality, urlrules, vecdup, warc
from .shared import WORD, materialise, once, scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["line"].cast("string"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", F.size("_spans").cast("long").alias("n_removed"), spans.alias("spans"), F.col("_clean_text").alias("clean_text"))


OP2_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, text, md5(coalesce(text, '')) AS digest, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, digest, unnest(lines) AS line, unnest(range(len(lines))) AS k FROM d),
u AS (
  SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS unit,
    coalesce(sum(length(line) + 1) OVER (PARTITION BY row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
g AS (SELECT *, unit <> '' AND row_number() OVER (PARTITION BY unit ORDER BY doc_id IS NULL, doc_id, digest, row, k) > 1 AS gone FROM u),
r AS (
  SELECT row, count(*) FILTER (WHERE gone) AS n_removed, string_agg(k || ':' || start || ':' || (start + length(line)), ',' ORDER BY k) FILTER (WHERE gone) AS spans,
    string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone) AS rest FROM g GROUP BY row)
SELECT doc_id, n_removed, coalesce(spans, '') AS spans, CASE WHEN text IS NOT NULL THEN coalesce(rest, '') END AS clean_text FROM d JOIN r USING (row)
"""


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    words = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return found.select("doc_id", F.size("_spans").cast("long").alias("n_removed"), words.alias("words_removed"), spans.alias("spans"), F.col("_clean_text").alias("clean_text"))


OP2_PASSAGES_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id IS NULL, doc_id, md5(coalesce(text, ''))) AS rank, doc_id, text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+') AS p FROM documents),
i AS (SELECT rank, w, unnest(range(len(w) - {passages.SIZE - 1})) AS i FROM d),
x AS (SELECT rank, i, md5(array_to_string(w[i + 1:i + {passages.SIZE}], ' ')) AS h FROM i),
f AS (SELECT h, min(rank) AS first FROM x GROUP BY h),
g AS (SELECT x.rank, i, coalesce(i - lag(i) OVER (PARTITION BY x.rank ORDER BY i) > {passages.SIZE}, true) AS new FROM x JOIN f USING (h) WHERE x.rank > first),
s AS (SELECT rank, i, count(*) FILTER (WHERE new) OVER (PARTITION BY rank ORDER BY i) AS k FROM g),
r AS (SELECT rank, k, min(i) AS a, max(i) + {passages.SIZE} AS b FROM s GROUP BY rank, k),
o AS (
  SELECT rank, text, b - a AS words, CAST(length(array_to_string(p[1:a + 1], '')) - length(w[a + 1]) AS BIGINT) AS start, CAST(length(array_to_string(p[1:b], '')) AS BIGINT) AS stop
  FROM r JOIN d USING (rank)),
c AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY rank ORDER BY start), 0) AS before FROM o),
n AS (
  SELECT rank, count(*) AS n_removed, CAST(sum(words) AS BIGINT) AS words_removed, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans,
    string_agg(substr(text, before + 1, start - before), '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS rest FROM c GROUP BY rank)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(words_removed, 0) AS words_removed, coalesce(spans, '') AS spans, coalesce(rest, text) AS clean_text
FROM d LEFT JOIN n USING (rank)
"""


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vecdup.links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("_id").alias("vec_id"), "n_links", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
f AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, least) AS component_id, vec_id = least(vec_id, least) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = scratch_path(spark, "archives")
    warc.write(table(spark, sf_dir, "pages"), archives)
    captures = warc.index(spark, archives)
    return captures.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, replace(replace(url, chr(13), '%0D'), chr(10), '%0A') AS url, coalesce(html, '') AS body FROM pages),
b AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest, url, regexp_extract(url, '(?s)^.*?://([^#]*)', 1) AS rest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM b WHERE payload_bytes >= 100 GROUP BY payload_digest),
h AS (SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM b LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to,
  CASE WHEN url IS NULL THEN '' WHEN position('://' IN url) = 0 THEN lower(url)
    ELSE lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = host THEN '/' ELSE substr(rest, length(host) + 1) END) END AS url_key,
  strftime(make_timestamp((page_id % 4294967296) * 1000000), '%Y%m%d%H%M%S') AS timestamp
FROM h
"""


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS words, count(*) AS n, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM d GROUP BY source),
w AS (
  SELECT *, CASE pos % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * words AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio, (1.5::DOUBLE * sum(words) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, words, n, CASE WHEN level <= ratio THEN weight * (SELECT min_by(level, struct_pack(ratio, pos)) FROM l WHERE level <= ratio) ELSE cap END AS target,
    CAST('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '' ELSE '=' || source END), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS off FROM l),
k AS (
  SELECT d.*, t.words, t.target, t.off, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0 END AS rate,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % CAST(ceil(sqrt(t.n::DOUBLE)) AS BIGINT) AS stratum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY stratum, CASE WHEN stratum % 2 = 0 THEN size ELSE -size END, h) AS pos FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target, CAST((floor(off + rate * pos) - floor(off + rate * (pos - 1))) * size AS BIGINT) AS taken FROM p
"""

def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of_kind(kind) for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.described(F.col("_base")), 256).alias("base_sha256"), pii.described(F.col("_spans")).alias("spans"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(table(spark, sf_dir, "documents"), copies_once=True)
    return found.select(F.col("_id").alias("doc_id"), "class_id", "n_class", (F.col("_id") == F.col("class_id")).alias("kept"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", *[F.col(f"_{n}").alias(n) for n in names])


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT k, host, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
n AS (
  SELECT k, host, l, list_transform(l, lambda x: trim(regexp_replace(lower(x), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ')) AS m FROM s),
x AS (
  SELECT k, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS five FROM d WHERE len(w) > 5),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS times FROM x),
y AS (SELECT k, least(5, i - lag(i, 1, -5) OVER (PARTITION BY k ORDER BY i)) AS covers FROM g WHERE times > 1),
r AS (SELECT k, CAST(sum(covers) AS BIGINT) AS n_repeat_words FROM y GROUP BY k),
u AS (SELECT DISTINCT host, list_sort(list_distinct(m)) AS m FROM n),
e AS (SELECT host, unnest(m) AS line FROM u),
b AS (
  SELECT host, line FROM (SELECT host, line, count(*) AS docs FROM e GROUP BY host, line) JOIN (SELECT host, count(*) AS docs_all FROM d GROUP BY host) USING (host)
  WHERE docs > 10 AND docs > 0.01 * docs_all),
z AS (SELECT k, host, unnest(l) AS own, unnest(m) AS line FROM n),
o AS (SELECT k, CAST(sum(len(regexp_extract_all(own, '[^\x20\x09-\x0D]+'))) AS BIGINT) AS removed FROM z JOIN b USING (host, line) GROUP BY k),
q AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed, 0) AS removed
  FROM d JOIN s USING (k) LEFT JOIN r USING (k) LEFT JOIN o USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (removed > 0 AND (n_words - removed < 10 OR n_words - removed < 0.3 * n_words)) AS kept
FROM q
"""


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langmodel.train(docs.filter(~langmodel.held_out(F.col("doc_id"))))
    scored = langmodel.score(docs, model)
    names = [F.col(f"_{n}").alias(n) for n in ("n_tokens", "n_known")]
    return scored.select(F.col("_id").alias("doc_id"), langmodel.held_out(F.col("_id")).alias("held_out"), *names, F.lit(model.tokens).cast("long").alias("train_tokens"), F.col("_base_score").alias("base_score"), F.col("_score").alias("score"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlrules.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", *[F.col(f"_{n}").alias(n) for n in ("host", "path", "rule", "verdict")])



def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.transform(table(spark, sf_dir, "documents"))
    names = [F.col(f"_{n}").alias(m) for n, m in (("n_units", "n"), ("form", "form"), ("prefix_units", "prefix_chars"), ("middle_units", "middle_chars"))]
    restored = infill.restore(F.col("_output"), F.col("_form"))
    # the digests are written once, in small batches of texts
    return materialise(cut.select("doc_id", *names, F.sha2("_output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")), "infilled")


OP11_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (
  SELECT doc_id, t, n, least(a, b) AS a, greatest(a, b) AS b, CASE WHEN n = 0 OR regexp_matches(t, '<[PSM]>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    longs = [F.col(f"_{n}").alias(n) for n in ("n_words", "n_base", "first_word", "last_word")]
    labels = [F.array_join(f"_{n}", ",").alias(n) for n in ("base_labels", "labels")]
    return found.select(F.col("_id").alias("doc_id"), *longs, *labels, F.col("_score").alias("score"))


def _license_sql() -> str:
    known = licenses.Templates(licenses.PHRASES, licenses.TEMPLATES)
    listed = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    templates = ", ".join(f"('{label}', {size}, {need}, {listed(words)})" for label, size, need, words in zip(known.labels, known.size, known.need, known.sets, strict=True))
    place = lambda words: " AND ".join(f"w[i + {k + 1}] = '{w.decode()}'" for k, w in enumerate(words))
    phrases = [f"list_transform(list_filter(range(len(w)), lambda i: {place(words)}), lambda i: struct_pack(i, label := '{label}'))" for words, label in known.phrases]
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT k, doc_id, w, {' || '.join(phrases)} AS p FROM d),
t(label, size, need, words) AS (VALUES {templates}),
x AS (SELECT k, s.size, unnest(range(0, len(w), s.size // 2)) AS o, w FROM d, (SELECT DISTINCT size FROM t) s),
y AS (SELECT k, size, list_distinct(w[o + 1:o + size]) AS words FROM x),
f AS (
  SELECT k, list_distinct(list(label)) AS labels, max(share) AS best
  FROM (SELECT k, label, need, len(list_intersect(y.words, t.words)) AS common, len(list_intersect(y.words, t.words)) / len(t.words) AS share FROM y JOIN t USING (size)) WHERE common >= need GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, list_min(list_transform(p, lambda x: x.i)) AS first_word, list_max(list_transform(p, lambda x: x.i)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label) || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN f USING (k)
"""


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the texts, by the id's CRC-32, the words from some place on repeat the first ones there."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.greatest(F.size(words), F.lit(1))
        a = (g % n).cast("int")
        p = lambda a: (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        at = lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"])))
        return F.array_join(once(F.struct(a.alias("a"), p(a).alias("p")), at), " ")

    return docs.select("doc_id", F.when(h % 10 == 0, once(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), repeated)).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(planted_runs(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    first = F.get(F.array_sort(F.transform("_runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))), 0)
    rows = found.select("doc_id", F.size("_runs").cast("long").alias("n_runs"), first.alias("_first"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("_first.less")
    best = [F.col("_first.start").alias("start"), length.alias("length"), F.col("_first.period").alias("period"), F.floor(1000 * length / F.col("_first.period")).alias("exponent_milli")]
    # the digests are written once, in small batches of texts
    return materialise(rows.select("doc_id", "n_runs", *best, "runs_sha256", "collapsed_sha256"), "runs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack, "op2_lines": op2_lines, "op2_passages": op2_passages, "op3_vectors": op3_vectors, "op4_warc": op4_warc, "op5_mix": op5_mix, "op6_pii": op6_pii, "op7_neardup": op7_neardup, "op8_quality": op8_quality, "op9_lm": op9_lm, "op10_urls": op10_urls,
    "op11_infill": op11_infill, "op12_licenses": op12_licenses, "op13_runs": op13_runs,
}
SQL: dict[str, str] = {"op2_lines": OP2_SQL, "op2_passages": OP2_PASSAGES_SQL, "op3_vectors": OP3_SQL, "op4_warc": OP4_SQL, "op5_mix": OP5_SQL, "op8_quality": OP8_SQL, "op11_infill": OP11_SQL, "op12_licenses": _license_sql()}
