"""Quality rules from DataFrame functions alone: text statistics and cross-document line frequency.

Normalised lines (lower case, white space collapsed) are hashed, and the distinct documents that hold a line
are counted per host. A line above the host's limit is boilerplate: it is removed, and a document that is left
with too few of its words is rejected. Copies are no evidence of boilerplate: a document is the digest of its normalised
lines, whichever line is counted, so documents with equal lines count as one and all others by themselves.

Defined cases: null and empty texts have no words (and fail the base rules); a null host is a host of its own;
repeated rows are copies; an empty table gives an empty result; columns are passed through, whatever they are
called (judge()'s own results take the place of columns called like them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, attach, materialise, once, positional, q, restored

SYMBOLS = r"[#*$%&|<>]"
#: A line is boilerplate in a host if more documents than this hold it: at least LEAST, and SHARE of the host's.
LEAST, SHARE = 10, 0.01
#: A document is depleted with fewer words than MIN_WORDS left, or less than MIN_LEFT of its own.
MIN_WORDS, MIN_LEFT = 10, 0.3
#: Boilerplate lines of all hosts that may be broadcast.
BROADCAST_LINES = 200_000


def repeated_words(hashes: Column, width: int = 5) -> Column:
    """Words that lie in windows of `width` words found twice or more, from the array of word hashes."""

    def covered(windows: Column) -> Column:
        def twice(s: Column) -> Column:
            here = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            found = F.filter(s, lambda x, i: F.coalesce(here(x, i), F.lit(False)))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        at = once(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), twice)
        start = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"])

    def windows_of(words: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)])
        return F.transform(F.sequence(F.lit(0), F.size(words) - width), window)

    def count(windows: Column) -> Column:
        repeats = once(F.sort_array(windows), lambda s: F.exists(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i) == F.get(s, i - 1), F.lit(False))))
        return F.when(repeats, covered(windows)).otherwise(0)

    return once(hashes, lambda words: F.when(F.size(words) > width, once(windows_of(words), count)).otherwise(0)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, each prefixed by _."""
    text = F.coalesce(q(text_col), F.lit(""))
    d = docs.withColumn("_wh", F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))
    d = d.withColumn("_n_words", F.size("_wh").cast("long"))
    d = d.withColumn("_n_repeat_words", repeated_words(F.col("_wh"))).drop("_wh")
    d = d.withColumn("_word_chars", F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"))
    d = d.withColumn("_n_symbols", (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
    d = d.withColumn("_n_dup_lines", once(lines_with_words(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return d.withColumn("_base_failed", (F.col("_n_words") < 10) | (100 * F.col("_n_repeat_words") > 20 * F.col("_n_words")))


def normal_line(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(line), r"[\x20\x09\x0B-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def line_hashes(text: Column) -> Column:
    """Hashes of the lines that hold a word, in order."""
    return F.transform(F.filter(F.split(normal_line(F.coalesce(text, F.lit(""))), " ?\n ?", -1), lambda x: x != ""), lambda x: F.xxhash64(x))


def host_key(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), q(host_col)), F.lit(""))


def line_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(line_hashes(text)))


def set_digest(lines: Column) -> Column:
    """What tells documents of a host apart: the digest of their set of lines."""
    return F.md5(F.array_join(lines.cast("array<string>"), " ").cast("binary"))


def different_texts(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """(_host, _doc, _lines): one row a host and set of lines."""
    d = docs.select(host_key(host_col).alias("_host"), line_set(q(text_col)).alias("_lines"))
    return d.groupBy("_host", set_digest(F.col("_lines")).alias("_doc")).agg(F.first("_lines").alias("_lines"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(_host, _line, _docs): lines that more distinct documents of the host hold than its limit."""
    # a set's digest is dealt, then each line counts once a set, partly before it is dealt
    counts = different_texts(docs, host_col, text_col).select("_host", F.explode("_lines").alias("_line")).groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_docs")).filter(F.col("_docs") > least)
    hosts = docs.groupBy(host_key(host_col).alias("_host")).agg(F.count(F.lit(1)).alias("_all"))
    found = attach(counts, hosts, ["_host"], "_line").filter(F.col("_docs") > share * F.col("_all"))
    return found.select("_host", "_line", "_docs")


def hits_of_texts(docs: DataFrame, lines: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """(_host, _doc, _hits): the boilerplate lines of each host's different texts; a hot host's texts are dealt by line and salt."""
    said = different_texts(docs, host_col, text_col).select("_host", "_doc", F.explode("_lines").alias("_line"))
    found = attach(said, lines, ["_host", "_line"], "_doc", max_rows=0).filter(F.col("_docs").isNotNull())
    return found.groupBy("_host", "_doc").agg(F.collect_list("_line").alias("_hits"))


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text", least: int = LEAST, share: float = SHARE, min_words: int = MIN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """docs with the statistics, _removed_words (long), _kept (boolean) and _clean_text (the text without boilerplate lines)."""
    names = docs.columns
    docs, host_col, text_col = positional(docs, host_col, text_col)
    lines = materialise(boilerplate(docs, host_col, text_col, least, share), "boilerplate")
    text = F.coalesce(q(text_col), F.lit(""))
    d = statistics(docs, text_col).withColumn("_host", host_key(host_col))
    if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        sets = lines.groupBy("_host").agg(F.collect_set("_line").alias("_frequent"))
        d = attach(d, sets, ["_host"], text_col, max_rows=BROADCAST_LINES)
        hits = F.when(F.col("_frequent").isNotNull(), F.array_intersect(F.col("_frequent"), line_hashes(text)))
        d = d.withColumn("_hits", hits).drop("_frequent")
    else:  # no host's lines in one row: each document's own hits, found line by line
        d = d.withColumn("_doc", set_digest(line_set(q(text_col)))).withColumn("_row", F.monotonically_increasing_id())
        d = attach(d, hits_of_texts(docs, lines, host_col, text_col), ["_host", "_doc"], "_row", max_rows=0).drop("_doc", "_row")
    d = d.withColumn("_hits", F.coalesce("_hits", F.array().cast("array<bigint>"))).drop("_host")
    words = lambda line: F.regexp_count(line, F.lit(WORD))
    removed = F.aggregate(F.filter(F.split(text, "\n", -1), lambda x: F.array_contains(F.col("_hits"), line_hash(x))), F.lit(0), lambda n, x: n + words(x))
    d = d.withColumn("_removed_words", F.when(F.size("_hits") > 0, removed).otherwise(0).cast("long"))
    left = F.col("_n_words") - F.col("_removed_words")
    depleted = (F.col("_removed_words") > 0) & ((left < min_words) | (left < min_left * F.col("_n_words")))
    clean = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col("_hits"), line_hash(x))), "\n")
    d = d.withColumn("_clean_text", F.when(F.size("_hits") > 0, clean).otherwise(q(text_col)))
    return restored(d.withColumn("_kept", ~F.col("_base_failed") & ~depleted).drop("_hits"), names)


def clean(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents that pass, without their boilerplate lines; docs' columns."""
    names = docs.columns
    docs, host, text = positional(docs, host_col, text_col)
    # an explode of the verdict, not a filter: Catalyst would push a filter below and work the statistics out once more
    kept = judge(docs, host, text, **options).withColumn("_one", F.explode(F.when(F.col("_kept"), F.array(F.lit(1)))))
    new = {text_col: F.col("_clean_text"), "n_chars": F.length("_clean_text").cast("long")}
    return restored(kept, names, **new).select(*names)
