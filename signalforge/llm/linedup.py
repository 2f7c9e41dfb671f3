"""Repeated passages by line hashing: of all lines that are equal once normalised, the earliest ranked one stays.

Every text is divided at its line feeds. A line is normalised (lower case, ASCII white space collapsed and trimmed) and named by the
MD5 digest of that. Lines rank by document id, digest of the whole text, row and place in the text; of equal lines in the
whole table, within a text or across texts, all but the first in that order are removed with the line feed before or after
them. Spans are code points of the original text, end exclusive, without the line feed.

Digests are counted over all lines. Those held so often that one task would meet them (fewer than a thousand exist) are broadcast, the
others joined by digest; rows come together again by a number that is written once, so repeated rows stay apart.

Defined cases: lines without a word are no units and stay; null and empty texts have no units and stay as they are; null ids rank
last; of repeated rows one keeps its lines; the longest texts are read whole; an empty table gives an empty result;
other columns pass through, whatever they are called (find()'s own results take the place of columns called like them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import materialise, positional, q, restored

#: Characters of text whose lines are handed on together; a longer text is handed on alone.
CHUNK = 1 << 20
#: Lines held more often than this share of all are broadcast: fewer than 1 / HOT digests.
HOT = 0.001
LINES = "_row long, _text binary, _line int, _start int, _end int, _digest binary"


def line_digests(text: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(line, start, end, digest) of each line that holds a word."""
    start = 0
    for k, line in enumerate(text.split("\n")):
        words = line.lower().encode("utf-8", "surrogatepass").split()  # of bytes: ASCII white space
        if words:
            yield k, start, start + len(line), hashlib.md5(b" ".join(words)).digest()
        start += len(line) + 1


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) -> LINES."""
    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    names = [part.split()[0] for part in LINES.split(", ")]

    def together(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        found, size = [], 0
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            whole = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
            found.extend((row, whole, *line) for line in line_digests(text))
            size += len(text)
            if size >= CHUNK and found:
                yield together(found)
                found, size = [], 0
        if found:
            yield together(found)
    textops.release()


def repeats(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_row, _spans): the lines of each row of base (with _row) that an earlier one equals, in order."""
    lines = base.select("_row", q(text_col).cast("string")).mapInArrow(_lines, LINES)
    lines = materialise(lines, "lines")
    # only repeated lines are joined with ids and ranked
    some = lines.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    some = materialise(some, "repeated-lines")
    many = max(1, int(HOT * lines.count()))
    hot, usual = some.filter(F.col("_n") > many).select("_digest"), some.filter(F.col("_n") <= many).select("_digest")
    held = lines.join(F.broadcast(hot), "_digest", "left_semi").unionByName(lines.join(F.broadcast(hot), "_digest", "left_anti").join(usual, "_digest", "left_semi"))
    held = materialise(held.join(base.select("_row", q(id_col).alias("_id")), "_row"), "repeated-places")
    rank = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_text").alias("text"), F.col("_row").alias("row"), F.col("_line").alias("line"))
    firsts = materialise(held.groupBy("_digest").agg(F.min(rank).alias("_first")).select("_first.row", "_first.line"), "first-lines")
    # a line is the first of its digest or of none: its place alone tells, and no digest is hot here
    gone = held.join(firsts.select(F.col("row").alias("_row"), F.col("line").alias("_line")), ["_row", "_line"], "left_anti")
    span = F.struct(F.col("_line").alias("line"), F.col("_start").alias("start"), F.col("_end").alias("end"))
    return gone.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("_spans"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with _spans (array<struct<line, start, end>>: what is removed, in order) and _clean_text (the rest; null where the text is)."""
    names = docs.columns
    docs, id_col, text_col = positional(docs, id_col, text_col)
    base = materialise(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    spans = materialise(repeats(base, id_col, text_col), "repeated-spans")
    joined = base.join(spans, "_row", "left").drop("_row")
    at = joined.columns.index(text_col), joined.columns.index("_spans")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(at[1])
            texts = []
            for text, found in zip(batch.column(at[0]), lines, strict=True):
                text = text.as_py()
                if found.is_valid and text is not None:
                    gone = {s["line"] for s in found.as_py()}
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "_clean_text"])
        textops.release()

    schema = T.StructType([*joined.schema.fields, T.StructField("_clean_text", T.StringType())])
    found = joined.mapInArrow(cleaned, schema)
    none = F.array().cast("array<struct<line:int,start:int,end:int>>")
    return restored(found.withColumn("_spans", F.coalesce("_spans", none)), names)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without their repeated lines; docs' columns and rows."""
    names = docs.columns
    plain, id_col, text_col = positional(docs, id_col, text_col)
    new = {names[int(text_col[1:])]: F.col("_clean_text"), "n_chars": F.length("_clean_text").cast("long")}
    return restored(find(plain, id_col, text_col), names, **new).select(*[q(c) for c in names])
