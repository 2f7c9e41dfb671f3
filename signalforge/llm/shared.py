"""What the training-data operators share: the scratch folder, table hand-over, bounded broadcasts."""

from __future__ import annotations

import gc
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A table is broadcast only if it has been counted and holds no more rows than this.
BROADCAST_ROWS = 20_000
#: Rows handed to Python together while a table is written: texts and shingle sets can be long.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or one in its warehouse where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started within hand few rows at a time to Python: bounds the memory beside the heap where texts are long."""
    rows = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(rows), BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, rows)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files that nothing refers to any more: it does when the driver's garbage is collected."""
    for _ in range(2):  # what the first one frees may hold more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)  # files are removed in the background


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no DataFrame still in use reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def attach(df: DataFrame, table: DataFrame, on: list[str], by: str, salts: int = 32, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Left join of df with a keyed table (one row a key), safe for hot keys.

    The table is counted first. Up to max_rows it is broadcast; beyond, both sides are dealt by
    key and salt (a hash of column `by`), so that a key with a third of df's rows is spread over `salts` partitions.
    """
    if table.limit(max_rows + 1).count() <= max_rows:
        return df.join(F.broadcast(table), on, "left")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(q(by)), F.lit(salts)).cast("int"))
    spread = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(spread.hint("shuffle_hash"), [*on, "_salt"], "left").drop("_salt")


def once(value: Column, use) -> Column:
    """use(value) with value evaluated once for a row, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def q(name: str) -> Column:
    """The column of that very name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def positional(df: DataFrame, *named: str) -> tuple:
    """df with its columns called c0, c1, ..., and what the named ones are called now: no column can clash with a working one."""
    at = {name: f"c{k}" for k, name in enumerate(df.columns)}
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), *[at[n] for n in named]


def restored(df: DataFrame, names: list[str], **replaced: Column) -> DataFrame:
    """df with c0, c1, ... called by their names again (or replaced), then the result's own columns, which start with _.

    A column of the input that is called like one of these gives way to it.
    """
    own = [c for c in df.columns if c.startswith("_")]
    kept = [replaced.get(n, F.col(f"c{k}")).alias(n) for k, n in enumerate(names) if n not in own]
    return df.select(*kept, *own)
