"""URL filters: given rules first, and association rules mined from labelled URLs. DataFrame functions and Spark ML alone.

A given rule (host, path, verdict) fits its host and all subdomains where the path starts with the rule's; the longest wins.
For the URLs that none fits, token combinations that foretell a verdict are mined by FP-growth from labelled URLs
(by default those that a given rule fits), pruned by support, confidence and redundancy, and matched through an inverted
index: a combination is looked up under its rarest token, in the distinct token sets alone. The most
confident match gives the verdict, then the best supported, then the last by text; with no match, `default`.

Tokens that stand in the same labelled URLs, all of them, are one to the miner: a site's long fixed path counts once, not as each of its
2^k parts. Nothing is lost by it. Any token of such a group has the support and confidence of every choice from it, and of two
from one group either makes the other redundant; a combination of groups fits where a token of each is.

Defined cases: null URLs and those without :// have empty host and path, no tokens and the default verdict; repeated rows
are judged alike; with no labelled URL nothing is mined; an empty table gives an empty result; other columns pass through,
whatever they are called (the results take the place of columns called like them).
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, attach, materialise, positional, q, restored

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^.*?://([^/?#]*)([^?#]*)"
SUPPORT, CONFIDENCE = 0.002, 0.8


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)" + URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)" + URL, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """Different tokens of a URL: labels of its host, segments of its path, keys of its query; digits alike."""
    plain = lambda x: F.regexp_replace(F.lower(x), "[0-9]+", "0")
    parts = lambda kind, x, by: F.transform(F.filter(F.split(x, by), lambda p: p != ""), lambda p: F.concat(F.lit(kind + ":"), plain(p)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda p: F.regexp_extract(p, "^([^=]*)", 1))
    keyed = F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.concat(F.lit("q:"), plain(k)))
    found = F.array_sort(F.array_distinct(F.concat(parts("h", host(url), r"\."), parts("p", path(url), "/"), keyed)))
    return F.when(url.contains("://"), found).otherwise(F.array().cast("array<string>"))


def given(hosts: Column, paths: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    text, verdict = [], []
    for name, start, says in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((hosts == name) | hosts.endswith("." + name)) & paths.startswith(start)
        text.append(F.when(fits, F.lit(name + start)))
        verdict.append(F.when(fits, F.lit(says)))
    none = F.lit(None).cast("string")
    return F.coalesce(*text, none), F.coalesce(*verdict, none)


def groups(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(_token, _group) of the tokens that a share `support` of the rows hold: those that stand in the same rows have one group, the least of them.

    There are at most 1 / support times the mean number of tokens a row of them.
    """
    sets = labelled.groupBy("_tokens").agg(F.count(F.lit(1)).alias("_n"))
    # rows of equal tokens are one set: which sets hold a token is told by their number and two 64-bit sums of their names
    held = sets.withColumns({"_a": F.xxhash64("_tokens"), "_b": F.xxhash64("_tokens", F.lit(1))}).select("_n", "_a", "_b", F.explode("_tokens").alias("_token"))
    held = held.groupBy("_token").agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_sets"), F.bit_xor("_a").alias("_a"), F.bit_xor("_b").alias("_b"))
    # the miner's own bound
    total = sets.agg(F.ceil(F.lit(support) * F.sum("_n")).alias("_least"))
    frequent = held.join(F.broadcast(total), F.col("_rows") >= F.col("_least"))
    together = frequent.groupBy("_rows", "_sets", "_a", "_b").agg(F.collect_list("_token").alias("_of"), F.min("_token").alias("_group"))
    return together.select("_group", F.explode("_of").alias("_token"))


def grouped(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """(key, _groups): the sorted groups that the tokens of each row (key, _tokens) stand for; rows without any are left out."""
    told = rows.select(key, F.explode("_tokens").alias("_token"))
    small = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return told.join(F.broadcast(named) if small else named, "_token").groupBy(key).agg(F.array_sort(F.collect_set("_group")).alias("_groups"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(_if array<string>, _then, _confidence, _support) from (_tokens, _label): pruned combinations of tokens that foretell a label.

    Tokens that always come together should be one (groups()) before: each of them doubles the combinations.
    """
    baskets = labelled.select(F.concat("_tokens", F.array(F.concat(F.lit("="), F.col("_label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter(F.element_at("consequent", 1).startswith("=") & ~F.exists("antecedent", lambda x: x.startswith("=")))
    rules = rules.select(F.array_sort("antecedent").alias("_if"), F.substring(F.element_at("consequent", 1), 2, 1000).alias("_then"), F.col("confidence").alias("_confidence"), F.col("support").alias("_support"))
    rules = materialise(rules, "url-rules")
    # redundant: one token fewer foretells the same with no less confidence
    shorter = rules.select(F.col("_if").alias("_less"), "_then", F.col("_confidence").alias("_as_sure"))
    smaller = rules.select("_if", "_then", "_confidence", F.explode("_if").alias("_out")).withColumn("_less", F.filter("_if", lambda x: x != F.col("_out")))
    redundant = smaller.join(shorter, ["_less", "_then"]).filter("_as_sure >= _confidence").select("_if", "_then").distinct()
    return rules.join(redundant, ["_if", "_then"], "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(_key, _mined): the verdict of the best rule for each distinct token set (_key, _tokens)."""
    counts = sets.select(F.explode("_tokens").alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("_sets"))
    index = rules.withColumn("_token", F.explode("_if")).join(counts, "_token")
    index = index.groupBy("_if", "_then", "_confidence", "_support").agg(F.min_by("_token", F.struct("_sets", "_token")).alias("_token"))
    index = materialise(index, "url-index")
    if index.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    hits = sets.select("_key", "_tokens", F.explode("_tokens").alias("_token")).join(index, "_token")
    hits = hits.filter(F.size(F.array_except("_if", "_tokens")) == 0)
    best = F.struct(F.col("_confidence"), F.col("_support"), F.array_join("_if", " "), "_then")
    return hits.groupBy("_key").agg(F.max_by("_then", best).alias("_mined"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, label_col: str | None = None, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = "allow") -> DataFrame:
    """pages with _host, _path, _rule (null: none fits), _mined (null: no combination matched) and _verdict.

    label_col: a column of verdicts to mine from (null: not labelled); without it, the given rules' verdicts.
    """
    names = pages.columns
    pages, url_col, *labels = positional(pages, url_col, *([label_col] if label_col else []))
    url = q(url_col)
    d = pages.withColumn("_host", host(url)).withColumn("_path", path(url))
    rule, says = given(F.col("_host"), F.col("_path"), rules)
    d = d.withColumn("_rule", rule).withColumn("_says", says).withColumn("_key", F.xxhash64(tokens(url)))
    label = q(labels[0]) if labels else F.col("_says")
    labelled = d.select(tokens(url).alias("_tokens"), label.alias("_label")).filter("_label is not null and size(_tokens) > 0")
    labelled = materialise(labelled.withColumns({"_set": F.xxhash64("_tokens"), "_row": F.monotonically_increasing_id()}), "url-labelled")
    named = materialise(groups(labelled, support), "url-groups")
    # rows with no frequent token still count: the miner's support is a share of all of them
    of = materialise(grouped(labelled.dropDuplicates(["_set"]), named, "_set"), "url-grouped")
    baskets = attach(labelled.select("_set", "_row", "_label"), of, ["_set"], "_row")
    mined = mine(baskets.select(F.coalesce("_groups", F.array().cast("array<string>")).alias("_tokens"), "_label"), support, confidence)
    sets = d.filter("_says is null").select("_key", tokens(url).alias("_tokens")).dropDuplicates(["_key"])
    sets = materialise(grouped(sets, named, "_key").withColumnRenamed("_groups", "_tokens"), "url-sets")
    found = materialise(match(sets, mined), "url-verdicts")
    d = attach(d, found, ["_key"], url_col)
    return restored(d.withColumn("_verdict", F.coalesce("_says", "_mined", F.lit(default))).drop("_says", "_key"), names)
