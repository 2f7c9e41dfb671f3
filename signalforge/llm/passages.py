"""Repeated passages by hashing of word windows: what stands in an earlier document in SIZE words or more is removed, wherever lines end.

Words are runs of anything but ASCII white space, ASCII letters in lower case. A window is SIZE consecutive words of a text; texts rank by document
id, digest of the whole text and row. Every window that a text of lower rank holds too is removed; windows that overlap or touch are one
passage. Spans are code points of the original text from a passage's first word to its last, end exclusive; white space around them stays.

Each window names its least SEED-word hash, the leftmost if equal, and consecutive windows that name the same one are a stretch: a row
(seed, digest of the stretch's words). Equal windows name equal seeds, so only stretches whose seed is found twice are looked at. Those that equal a
stretch of a text of lower rank are removed whole; only the first of each are compared window by window, and only where their seed
is found in different stretches. Windows are told apart by 128 bits of two hashes. Firsts come from aggregates and are joined back by digest and
rank, and seeds held too often for one task are broadcast, so frequent passages meet in no task.

Defined cases: texts of fewer than SIZE words stay as they are, copies too; so do passages that only their own text repeats; null and empty
texts have no windows; null ids rank last; of repeated rows one keeps its words; the longest texts are read whole; an empty table gives an
empty result; other columns pass through, whatever they are called (find()'s own results take the place of columns called like them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import WORD, materialise, positional, q, restored

#: Words of a window: shorter repeats stay.
SIZE = 50
#: Words of a seed: the windows of a stretch are at most SIZE - SEED + 1.
SEED = 25
#: Seeds held more often than this share of all are broadcast: fewer than 1 / HOT.
HOT = 0.001
#: Marks of rows are broadcast up to so many blocks of 4 KB, each for 32,768 row numbers.
BLOCKS = 8_192
STRETCHES = "_row long, _at int, _till int, _seed long, _digest long"
WINDOWS = "_row long, _rank long, _at int, _till int, _one long, _two long"


def _table(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=[part.split()[0] for part in schema.split(", ")])


def _sums(words: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * textops._power_tables(len(words))[0][: len(words)], out=sums[1:])
    return sums


def _between(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the words from low up to high, the same wherever they stand."""
    return textops.mix((sums[high] - sums[low]) * textops._power_tables(len(sums))[1][low])


def _others(words: np.ndarray) -> np.ndarray:
    """A second hash of each word."""
    return textops.mix(words ^ np.uint64(0xD1B54A32D192ED03))


def stretches(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, seed, digest of the words) of each stretch of the texts whose words follow one another."""
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(max(0, len(words) - SIZE + 1))
    at = at[at + SIZE <= ends[text[at]]]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    sums, places = _sums(words), np.arange(len(words) - SEED + 1)
    grams = _between(sums, places, places + SEED)
    least, offset = grams[: len(words) - SIZE + 1].copy(), np.zeros(len(words) - SIZE + 1, np.int32)
    for k in range(1, SIZE - SEED + 1):
        gram = grams[k : k + len(least)]
        offset[gram < least] = k
        np.minimum(least, gram, out=least)
    named = at + offset[at]
    new = np.ones(len(at), bool)
    new[1:] = (named[1:] != named[:-1]) | (text[at[1:]] != text[at[:-1]])
    first = np.flatnonzero(new)
    low, high = at[first], at[np.append(first[1:], len(at)) - 1]
    of, begin = text[low], (ends - counts)[text[low]]
    return of, low - begin, high - begin, grams[named[first]].view(np.int64), _between(_sums(_others(words)), low, high + SIZE).view(np.int64)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) -> STRETCHES."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for low, _, words, counts in textops.chunks(batch.column(1)):
            of, at, till, seed, digest = stretches(words, counts)
            if len(of):
                yield _table(STRETCHES, rows[low + of], at.astype(np.int32), till.astype(np.int32), seed, digest)
    textops.release()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, rank, places, text) -> WINDOWS: those from `at` to `till` of each place."""
    for batch in batches:
        rows, ranks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        number = batch.column(2).value_lengths().to_numpy()
        places, upto = batch.column(2).flatten(), np.append(0, np.cumsum(number))
        ats, tills = (places.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        for low, high, words, counts in textops.chunks(batch.column(3)):
            of = np.repeat(np.arange(high - low), number[low:high])
            first, last = ats[upto[low] : upto[high]], tills[upto[low] : upto[high]]
            each = last - first + 1
            at = np.repeat(first - np.cumsum(each) + each, each) + np.arange(each.sum())
            of = np.repeat(of, each)
            place = at + (np.cumsum(counts) - counts)[of]
            one, two = (_between(_sums(w), place, place + SIZE).view(np.int64) for w in (words, _others(words)))
            yield _table(WINDOWS, rows[low + of], ranks[low + of], at.astype(np.int32), at.astype(np.int32), one, two)
    textops.release()


def _parted(base: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of base whose _row is in rows, and the others: by broadcast marks, a bit a row, so that their texts are not shuffled for it."""
    marks = rows.groupBy(F.bitmap_bucket_number("_row").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_row")).alias("_bits"))
    marks = materialise(marks, "marks")
    if marks.count() > BLOCKS:
        return base.join(rows, "_row", "left_semi"), base.join(rows, "_row", "left_anti")
    byte = F.conv(F.hex(F.substring("_bits", (F.bitmap_bit_position("_row") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.bit_get(byte, (F.bitmap_bit_position("_row") % 8).cast("int")) == 1
    marked = base.withColumn("_block", F.bitmap_bucket_number("_row")).join(F.broadcast(marks), "_block", "left")
    marked = marked.withColumn("_marked", F.coalesce(bit, F.lit(False))).drop("_block", "_bits")
    return marked.filter("_marked").drop("_marked"), marked.filter("not _marked").drop("_marked")


def _ranks(base: DataFrame, id_col: str, text: F.Column) -> DataFrame:
    """(_row, _rank): numbers in the order of id, digest of the text and row."""
    keys = materialise(base.select("_row", q(id_col).alias("_id"), F.md5(F.coalesce(text, F.lit(""))).alias("_text")), "ranked-texts")
    # numbers ascend from one sorted partition to the next
    return materialise(keys.orderBy(F.col("_id").isNull(), "_id", "_text", "_row").select("_row", F.monotonically_increasing_id().alias("_rank")), "ranks")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose seed another of them has too."""
    some = materialise(rows.groupBy("_seed").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "repeated-seeds")
    many = max(1, int(HOT * rows.count()))
    hot, usual = some.filter(F.col("_n") > many).select("_seed"), some.filter(F.col("_n") <= many).select("_seed")
    return rows.join(F.broadcast(hot), "_seed", "left_semi").unionByName(rows.join(F.broadcast(hot), "_seed", "left_anti").join(usual, "_seed", "left_semi"))


def _places() -> F.Column:
    return F.sort_array(F.collect_list(F.struct("_at", "_till"))).alias("_places")


def repeats(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _places): the windows of each row of base (with _row) that a text of lower rank holds, as (first, last), in order."""
    text = q(text_col).cast("string")
    found = materialise(base.select("_row", text).mapInArrow(_stretches, STRETCHES), "stretches")
    held = materialise(_repeated(found).join(_ranks(base, id_col, text), "_row"), "repeated-stretches")
    # a stretch is the first of its digest or not: digest and rank tell, and no pair of them is hot here
    firsts = materialise(held.groupBy("_seed", "_digest").agg(F.min("_rank").alias("_rank")), "first-stretches")
    later = held.join(firsts, ["_seed", "_digest", "_rank"], "left_anti").select("_row", "_at", "_till")
    leads = held.join(_repeated(firsts), ["_seed", "_digest", "_rank"], "left_semi")
    leads = materialise(leads.groupBy("_row").agg(F.first("_rank").alias("_rank"), _places()), "compared-stretches")
    texts, _ = _parted(base.select("_row", text.alias("_text")), leads.select("_row"))
    windows = texts.join(leads, "_row").select("_row", "_rank", "_places", "_text").mapInArrow(_windows, WINDOWS)
    windows = materialise(windows, "compared-windows")
    least = windows.groupBy("_one", "_two").agg(F.min("_rank").alias("_rank"))
    gone = windows.join(least, ["_one", "_two", "_rank"], "left_anti").select("_row", "_at", "_till")
    return later.unionByName(gone).groupBy("_row").agg(_places())


def cut(text: str, places: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], str]:
    """((words, start, end) of each passage, the rest) for windows (first, last) in order."""
    words = [m.span() for m in re.finditer(WORD, text)]
    joined: list[list[int]] = []
    for first, last in places:
        if joined and first <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], last + SIZE)
        else:
            joined.append([first, last + SIZE])
    spans = [(high - low, words[low][0], words[high - 1][1]) for low, high in joined]
    kept = zip([0, *[s[2] for s in spans]], [*[s[1] for s in spans], len(text)], strict=True)
    return spans, "".join(text[a:b] for a, b in kept)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _spans (array<struct<words, start, end>>: what is removed, in order) and _clean_text (the rest; null where the text is)."""
    names = docs.columns
    docs, id_col, text_col = positional(docs, id_col, text_col)
    base = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    gone = materialise(repeats(base, id_col, text_col), "repeated-passages")
    some, others = _parted(base, gone.select("_row"))
    joined = some.join(gone, "_row").drop("_row")
    at = joined.columns.index(text_col), joined.columns.index("_places")
    span = pa.struct([("words", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for text, places in zip(batch.column(at[0]), batch.column(at[1]), strict=True):
                found, rest = cut(text.as_py(), [(p["_at"], p["_till"]) for p in places.as_py()])
                spans.append([dict(zip(("words", "start", "end"), s, strict=True)) for s in found])
                texts.append(rest)
            own = [x for k, x in enumerate(batch.columns) if k != at[1]]
            kept = [x for k, x in enumerate(batch.schema.names) if k != at[1]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(spans, pa.list_(span)), pa.array(texts, pa.string())], names=[*kept, "_spans", "_clean_text"])
        textops.release()

    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("words", "start", "end")]))
    schema = T.StructType([*joined.drop("_places").schema.fields, T.StructField("_spans", kind), T.StructField("_clean_text", T.StringType())])
    others = others.drop("_row").withColumn("_spans", F.array().cast(kind)).withColumn("_clean_text", q(text_col).cast("string"))
    return restored(joined.mapInArrow(cleaned, schema).unionByName(others), names)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without their repeated passages; docs' columns and rows."""
    names = docs.columns
    plain, id_col, text_col = positional(docs, id_col, text_col)
    new = {names[int(text_col[1:])]: F.col("_clean_text"), "n_chars": F.length("_clean_text").cast("long")}
    return restored(find(plain, id_col, text_col), names, **new).select(*[q(c) for c in names])
