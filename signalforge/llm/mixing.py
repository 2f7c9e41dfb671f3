"""Mixing sources to target weights by systematic sampling.

Sources share a budget of words by weight, none above `cap` times its own words. Each document of a
source then expects target / source words copies of itself; the expected copies are prefix-summed in a
fixed order within the source, one random offset is added, and the document is emitted once for each
integer boundary that its interval crosses.

The order within a source is by stratum (about the square root of the source's documents, by a hash of
the id) and then by size, upwards and downwards in turn, so that a source is dealt over many tasks,
whatever its share, and the words taken stay near the target. The result depends on the rows alone, not on
how they are partitioned: reruns agree.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; null ids are
ordered as the text "null"; repeated rows are documents of their own; an empty table gives an empty
result; other columns pass through untouched, whatever they are called (plan()'s own results take the place of columns
called like them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, attach, materialise, positional, q, restored

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, budget: float = 1.5, weights: tuple[float, ...] = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """Targets of a table (_src, _words): budget x all words by weight, capped, the excess reshared.

    Closed form of the resharing: in ascending order of cap/weight the sources up to some point are
    capped, and the others share what is left by weight. One row a source.
    """
    by_name = Window.orderBy(F.col("_src").isNull(), "_src")
    by_ratio = Window.orderBy("_ratio", "_pos")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    t = totals.withColumn("_pos", F.row_number().over(by_name) - 1).withColumn("_weight", weight)
    t = t.withColumn("_cap", cap * F.col("_words")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    t = t.withColumn("_all", budget * F.sum("_words").over(everything))
    t = t.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    t = t.withColumn("_level", F.col("_left") / F.sum("_weight").over(onward))
    t = t.withColumn("_open", F.col("_level") <= F.col("_ratio"))
    t = t.withColumn("_share", F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.struct("_ratio", "_pos"))).over(everything))
    target = F.when(F.col("_open"), F.col("_share") * F.col("_weight")).otherwise(F.col("_cap"))
    return t.select("_src", "_words", "_n", target.alias("_target"))


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: float = 1.5, weights: tuple[float, ...] = WEIGHTS, cap: float = 2.0, seed: str = "mix") -> DataFrame:
    """docs with _size, _words (its source's), _target (its source's) and _copies."""
    names = docs.columns
    docs, id_col, source_col, text_col = positional(docs, id_col, source_col, text_col)
    rows = docs.withColumn("_src", q(source_col)).withColumn("_key", F.coalesce(F.concat(F.lit("="), q(source_col)), F.lit("")))
    rows = rows.withColumn("_size", word_count(q(text_col)))
    rows = rows.withColumn("_hash", F.md5(F.coalesce(q(id_col).cast("string"), F.lit("null"))))
    totals = rows.groupBy("_key", "_src").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n"))
    targets = source_targets(totals, budget, weights, cap)
    targets = targets.withColumn("_key", F.coalesce(F.concat(F.lit("="), "_src"), F.lit(""))).drop("_src")
    rows = attach(rows.drop("_src"), materialise(targets, "targets"), ["_key"], "_hash")  # written: words are counted once for it
    number = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_stratum", number % F.ceil(F.sqrt(F.col("_n").cast("double"))))
    strata = rows.groupBy("_key", "_stratum").agg(F.count(F.lit(1)).alias("_in"))
    earlier = Window.partitionBy("_key").orderBy("_stratum").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("_key", "_stratum", F.coalesce(F.sum("_in").over(earlier), F.lit(0)).alias("_before"))
    size = F.when(F.col("_stratum") % 2 == 0, F.col("_size")).otherwise(-F.col("_size"))
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_key", "_stratum").orderBy(size, "_hash")))
    rows = attach(rows, materialise(strata, "strata"), ["_key", "_stratum"], "_hash")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("_key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(0.0)
    position = F.col("_before") + F.col("_rank")
    crossed = F.floor(offset + rate * position) - F.floor(offset + rate * (position - 1))
    rows = rows.withColumn("_copies", crossed.cast("int"))
    return restored(rows.drop("_key", "_hash", "_n", "_stratum", "_rank", "_before"), names)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: docs' columns, each document as often as the plan takes it."""
    names = docs.columns
    docs, *columns = positional(docs, *[options.pop(k, v) for k, v in (("id_col", "doc_id"), ("source_col", "source"), ("text_col", "text"))])
    taken = plan(docs, *columns, **options).filter(F.col("_copies") > 0)
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return restored(taken.select(*docs.columns), names)
