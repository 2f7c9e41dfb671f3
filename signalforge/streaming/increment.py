"""Incremental runs: what is new is taken once, by a checkpointed stream that stops when it has caught up."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructField, StructType


def read(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def first_of_key(events: DataFrame, key: str, time: str, late: str = "7 days") -> DataFrame:
    """The first event of each key; state is dropped once the watermark is past."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def monthly_mentions(events: DataFrame, drug: str, effect: str, time: str, late: str = "7 days") -> DataFrame:
    """(drug, side_effect, period, mention_count) by calendar month; late events count until the watermark has passed their day.

    The state is kept by day, which a watermark can close; a day's count is closed once, so months are sums of closed days (by_month).
    """
    day = F.window(time, "1 day")
    return events.withWatermark(time, late).groupBy(day, F.col(drug).alias("drug"), F.col(effect).alias("side_effect")).agg(F.count(F.lit(1)).alias("mention_count"))


def by_month(days: DataFrame) -> DataFrame:
    """Closed days, as monthly_mentions() gives them, summed by calendar month."""
    return days.groupBy("drug", "side_effect", F.date_format("window.start", "yyyy-MM").alias("period")).agg(F.sum("mention_count").alias("mention_count"))


def append_once(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is new to Parquet files, exactly once across restarts."""
    return events.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_once(events: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """Hands each batch to merge(batch, number), for keyed writes."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Rows that a task gathers before it keeps the first find of each item only.
GATHERED = 200_000


def _firsts(item: str, drug: str, order: str):
    """A function for mapInArrow that keeps of a partition's rows the first of each item, by (order, drug)."""

    def reduced(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, sort_keys=[(order, "ascending"), (drug, "ascending")]))
        codes = t[item].combine_chunks().dictionary_encode().indices.to_numpy()
        return t.take(np.unique(codes, return_index=True)[1]).combine_chunks().to_batches()

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, limit = [], 0, GATHERED
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= limit:
                held = reduced(held)
                rows = sum(b.num_rows for b in held)
                limit = max(GATHERED, 2 * rows)
        if rows:
            yield from reduced(held)

    return firsts


def claims(finds: DataFrame, item: str, drug: str, order: str) -> DataFrame:
    """(item, drug, order) of a stream of finds: each item goes to the drug whose find comes first, once, whatever later runs find.

    A batch's finds are dealt by item and the one with the least (order, drug) of each is kept, in Arrow batches; Spark's keyed deduplication
    then lets pass what was not claimed before. The state is one flag an item, kept by item beside the checkpoint, so a run reads nothing of
    what earlier ones wrote. Null items claim nothing. The session keeps its state in RocksDB.
    """
    spark = finds.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    of = {f.name: f.dataType for f in finds.schema}
    schema = StructType([StructField(c, of[c]) for c in (item, drug, order)])
    rows = finds.select(item, drug, order).filter(F.col(item).isNotNull() & F.col(drug).isNotNull())
    return rows.repartition(item).mapInArrow(_firsts(item, drug, order), schema).dropDuplicates([item])
