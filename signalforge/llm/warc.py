"""WARC archives of pages, and their capture index by external merge.

Writing: of the records with equal payloads of at least `least` bytes, the one with the smallest id is a response and the
others revisit it. Records are made and written by Spark's own text writer (the record separator ends each record), so files
commit task by task wherever the shared folder is. Files hold a bounded number of records.

Reading: each file is parsed record by record, payload digests are checked, and its captures are sorted into a run. Runs are
dealt by ranges of (URL key, timestamp, id), and each task merges the runs of its range with a loser tree:
the index is in global order over the partitions, a URL's captures together in time order.

Defined cases: a null payload is empty; a null or odd URL is kept as it is (line breaks escaped) with an empty or plain key; without
a time column the capture time is the id in seconds; records with equal keys, repeated rows included, are all kept; null
ids are never referred to; an empty table gives an empty index; other columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import attach, materialise, q

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
ID = "urn:x-page:"
LEAST = 100
#: Bytes of records that a file holds about.
FILE_BYTES = 16 << 20
#: Captures that one task merges about.
RANGE = 50_000
INDEX = "url_key string, timestamp string, id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long"


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")


def _record_id(key: Column) -> Column:
    return F.concat(F.lit(f"<{ID}"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, least: int = LEAST) -> DataFrame:
    """(value, bytes): a WARC record of each page, without the separator that ends it."""
    payload = F.coalesce(q(payload_col).cast("string"), F.lit(""))
    clean = F.replace(F.replace(q(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    time = F.to_utc_timestamp(q(time_col) if time_col else F.timestamp_seconds(F.pmod(F.coalesce(q(id_col).cast("long"), F.lit(0)), F.lit(1 << 32))), F.current_timezone())
    d = pages.select(q(id_col).cast("long").alias("_id"), clean.alias("_url"), time.alias("_time"), payload.alias("_payload"), F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"))
    equal = d.filter(F.col("_bytes") >= least).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    d = attach(d, materialise(equal, "equal-payloads"), ["_digest"], "_id")
    refers = F.when(F.col("_first").isNotNull() & (F.col("_id").isNull() | (F.col("_id") > F.col("_first"))), F.col("_first"))
    d = d.withColumn("_refers", refers)
    block = F.when(F.col("_refers").isNull(), F.concat(F.lit(HTTP), F.col("_payload"))).otherwise(F.lit(HTTP))
    kind = F.when(F.col("_refers").isNull(), "response").otherwise("revisit")
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _record_id(F.col("_id")),
        F.lit("\r\nWARC-Date: "), F.date_format("_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), _header("WARC-Target-URI", F.col("_url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("_digest"), F.lit("\r\nX-Payload-Length: "), F.col("_bytes").cast("string"),
        F.when(F.col("_refers").isNotNull(), F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _record_id(F.col("_refers")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )
    return d.select(value.alias("value"))


def write(pages: DataFrame, path: str, payload_col: str = "html", compression: str = "gzip", **options) -> None:
    """Archives of pages in the folder."""
    mean = pages.select(F.avg(F.coalesce(F.octet_length(q(payload_col).cast("string")), F.lit(0)))).first()[0] or 0.0
    each = max(1, int(FILE_BYTES / (mean + 500)))
    records(pages, payload_col=payload_col, **options).write.option("lineSep", END).option("maxRecordsPerFile", each).option("compression", compression).text(path)


def url_key(url: str) -> str:
    """Host labels from the top-level one down, then path and query, in lower case."""
    if "://" not in url:
        return url.lower()
    rest = url.split("://", 1)[1].split("#", 1)[0]
    cut = min((k for k in map(rest.find, "/?") if k >= 0), default=len(rest))
    return (",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/")).lower()


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at {at}")
        headers = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end at {stop}")
        yield at, headers, data[end + 4 : stop]
        at = stop + 4


def _page(value: str | None) -> int | None:
    text = value[len(ID) + 1 : -1] if value else ""
    return int(text) if text else None


def captures(file: str, data: bytes) -> list[tuple]:
    """The sorted run of an archive's captures."""
    found = []
    for at, headers, block in parse(data):
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(headers["X-Payload-Length"])
        if headers["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != size:
                raise ValueError(f"payload of the record at {at} of {file} is damaged")
        url = headers.get("WARC-Target-URI")
        stamp = "".join(c for c in headers["WARC-Date"] if c.isdigit())
        found.append((url_key(url or ""), stamp, _page(headers["WARC-Record-ID"]), url, headers["WARC-Type"], size, digest, _page(headers.get("WARC-Refers-To")), file, at))
    found.sort(key=_order)
    return found


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """k-way merge: inner nodes keep the losers, so the next item costs one path of comparisons."""

    def __init__(self, runs: list[list[tuple]], order=_order):
        self.runs, self.order, self.k = runs, order, len(runs)
        self.at = [0] * self.k
        self.heads = [order(r[0]) if r else None for r in runs]
        self.losers = [-1] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.before(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            self.heads[run] = self.order(self.runs[run][self.at[run]]) if self.at[run] < len(self.runs[run]) else None
            node = (run + self.k) // 2
            while node:
                if self.before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[low : low + 4096], strict=True), schema, strict=True)], schema=schema)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sorted runs of captures, one a file, of the archives in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0), batch.column(1), strict=True):
                yield from _batches(captures(file.as_py().rsplit("/", 1)[-1], data.as_py()), _schema())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


def merge(runs: DataFrame) -> DataFrame:
    """The runs' captures in global order of (url_key, timestamp, id) over the partitions."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_file: dict[str, list[list[tuple]]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = by_file.setdefault(row[8], [[]])
                if own[-1] and _order(row) < _order(own[-1][-1]):
                    own.append([])  # a file's rows that came in several parts
                own[-1].append(row)
        held = []
        for row in LoserTree([r for own in by_file.values() for r in own]):
            held.append(row)
            if len(held) == 4096:
                yield from _batches(held, _schema())
                held = []
        yield from _batches(held, _schema())

    parts = max(1, -(-runs.count() // RANGE))
    return runs.repartitionByRange(parts, "url_key", "timestamp", "id").mapInArrow(merged, INDEX)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The capture index of the archives in the folder."""
    return merge(materialise(read(spark, path), "capture-runs"))
