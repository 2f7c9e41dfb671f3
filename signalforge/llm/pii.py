"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence. DataFrame functions alone.

Every value that a pattern finds is a protected entity. Over the lines of the corpus, a term t reveals an entity e by
PMI(t; e) = log2(N n(t, e) / (n(t) n(e))); it discloses e when PMI reaches `disclosure` x IC(e), IC(e) = log2(N / n(e)),
and at least `support` different lines hold both. In texts that hold e such terms are spans of kind "term" too. When a text
is sanitised, entities are generalised to their kind and disclosing terms are removed.

Defined cases: null text counts as empty (and stays null when sanitised); spans are code points, end exclusive; the
longest texts are read whole; repeated rows get equal results; an empty table gives an empty result; other
columns pass through, whatever they are called (find()'s own results take the place of columns called like them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, attach, materialise, once, positional, q, restored

# Possessive runs and the guards before them change no match (a start inside a run fails where the run's own start
# failed), and keep matching linear in long runs. \G: an email may begin right where the last one ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: What a text must hold for a kind to be looked for at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}{3,}"
DISCLOSURE, SUPPORT = 0.9, 3


def valid(kind: str, value: Column) -> Column:
    """Whether a match counts: address parts, card length and check digit, phone length."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"))
    if kind == "card":

        def luhn(digits: Column) -> Column:
            def add(total: Column, k: Column) -> Column:
                d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
                twice = d * 2
                return total + F.when(k % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

            checked = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0
            return F.when(F.length(digits).between(14, 19), checked).otherwise(False)

        return once(F.regexp_replace(value, "[ -]", ""), luhn)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def running_sum(steps: Column, block: int = 64) -> Column:
    """Prefix sums of an array<int>, in blocks: linear, not quadratic, work on long arrays."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def by_blocks(s: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int"))
        part = lambda k: F.slice(s, k * block + 1, F.lit(block))

        def joined(sums: Column) -> Column:
            inner = lambda k: once(total(F.slice(sums, F.lit(1), k)), lambda before: once(part(k), lambda p: F.transform(p, lambda _, i: before + total(F.slice(p, F.lit(1), i + 1)))))
            return F.flatten(F.transform(blocks, inner))

        return once(F.transform(blocks, lambda k: total(part(k))), joined)

    return once(steps, by_blocks)


NO_SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def match_spans(text: Column, kind: str, order: int, pattern: Column, keep=None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, order, end, kind, value>>; keep(value) filters them."""

    def placed(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g")), lambda x: F.length(x["m"]) + F.length(x["g"]))
        span = lambda end, i: F.struct((end - F.length(F.get(found, i))).alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(kind).alias("kind"), F.get(found, i).alias("value"))
        spans = F.transform(running_sum(steps), span)
        return F.filter(spans, lambda s: keep(s["value"])) if keep else spans

    return once(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(NO_SPANS)))


def base_spans(text: Column) -> Column:
    """All spans of the patterns, by start and kind."""
    parts = []
    for order, kind in enumerate(KINDS):
        spans = match_spans(text, kind, order, F.lit(PATTERNS[kind]), lambda v, kind=kind: valid(kind, v))
        needed = text.contains(NEEDS[kind]) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            needed = needed & text.rlike("[0-9][^@]{5,}[0-9]")
        parts.append(F.when(needed, spans).otherwise(F.array().cast(NO_SPANS)))
    return F.sort_array(F.concat(*parts))


def described(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def line_words(line: Column) -> Column:
    """Different terms of a line outside its entities' patterns."""
    for kind in KINDS:
        line = F.regexp_replace(line, PATTERNS[kind], " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def disclosing_terms(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(_entity, _term, _pmi, _ic) of the corpus."""
    text = F.coalesce(q(text_col), F.lit(""))
    lines = docs.select(F.explode(F.split(text, "\n", -1)).alias("_line"))
    n_lines = docs.select(F.sum((F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")).alias("_all"))
    some = F.col("_line").contains("@") | F.col("_line").rlike("[0-9][^@]{5,}[0-9]")
    held = lines.filter(some).withColumn("_found", F.array_distinct(F.transform(base_spans(F.col("_line")), lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"])))))
    held = held.filter(F.size("_found") > 0).select(F.xxhash64("_line").alias("_at"), "_found", line_words(F.col("_line")).alias("_words"))
    held = materialise(held, "entity-lines")
    entities = held.select(F.explode("_found").alias("_entity")).groupBy("_entity").agg(F.count(F.lit(1)).alias("_n_e"))
    pairs = held.select("_at", F.explode("_found").alias("_entity"), "_words").select("_at", "_entity", F.explode("_words").alias("_term"))
    pairs = pairs.groupBy("_entity", "_term").agg(F.count(F.lit(1)).alias("_n_te"), F.count_distinct("_at").alias("_support")).filter(F.col("_support") >= support)
    pairs = materialise(pairs, "entity-terms")
    terms = pairs.select("_term").distinct()
    said = docs.select(F.explode(F.flatten(F.transform(F.split(F.lower(text), "\n", -1), lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(TERM), F.lit(0)))))).alias("_term"))
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        said = said.join(F.broadcast(terms), "_term", "left_semi")
        counts = said.groupBy("_term").agg(F.count(F.lit(1)).alias("_n_t"))
    else:
        counts = said.groupBy("_term").agg(F.count(F.lit(1)).alias("_n_t")).join(terms, "_term", "left_semi")
    rated = pairs.join(entities, "_entity").join(counts, "_term").crossJoin(F.broadcast(n_lines))
    pmi = F.log2(F.col("_all") * F.col("_n_te") / (F.col("_n_t") * F.col("_n_e")).cast("double"))
    rated = rated.withColumn("_pmi", pmi).withColumn("_ic", F.log2(F.col("_all") / F.col("_n_e").cast("double")))
    return rated.filter((F.col("_ic") > 0) & (F.col("_pmi") >= disclosure * F.col("_ic"))).select("_entity", "_term", "_pmi", "_ic")


def find(docs: DataFrame, text_col: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """docs with _base (pattern spans) and _spans (these and the disclosing terms)."""
    names = docs.columns
    docs, text_col = positional(docs, text_col)
    text = F.coalesce(q(text_col), F.lit(""))
    revealing = materialise(disclosing_terms(docs, text_col, disclosure, support), "disclosing")
    named = lambda spans: F.array_distinct(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], F.lower(s["value"]))))
    d = docs.withColumn("_base", base_spans(text)).withColumn("_text_key", F.xxhash64(text))
    if revealing.isEmpty():
        return restored(d.withColumn("_spans", F.col("_base")).drop("_text_key"), names)
    holders = docs.filter(text.contains("@") | text.rlike("[0-9][^@]{5,}[0-9]")).select(F.xxhash64(text).alias("_text_key"), F.explode(named(base_spans(text))).alias("_entity")).distinct()
    per_text = holders.join(revealing, "_entity").groupBy("_text_key").agg(F.array_sort(F.collect_set("_term")).alias("_terms"))
    d = attach(d, materialise(per_text, "text-terms"), ["_text_key"], text_col)
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("_terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    terms = match_spans(text, "term", len(KINDS), pattern)
    apart = F.filter(terms, lambda t: ~F.exists(F.col("_base"), lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    d = d.withColumn("_spans", F.when(F.col("_terms").isNotNull(), F.sort_array(F.concat("_base", apart))).otherwise(F.col("_base")))
    return restored(d.drop("_text_key", "_terms"), names)


def sanitise(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with entities generalised to [KIND] and disclosing terms removed from the text."""
    names = docs.columns
    docs, column = positional(docs, text_col)
    found = find(docs, column, **options)
    text = q(column)

    def step(acc: Column, s: Column) -> Column:
        label = F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        clear = s["start"] >= acc["pos"]
        gap = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), label)
        return F.struct(F.when(clear, gap).otherwise(acc["out"]).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    clean = F.aggregate(F.col("_spans"), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    new = F.when(text.isNotNull() & (F.size("_spans") > 0), clean).otherwise(text)
    found = found.withColumn("_clean_text", new)
    return restored(found, names, **{text_col: F.col("_clean_text"), "n_chars": F.length("_clean_text").cast("long")}).select(*names)
