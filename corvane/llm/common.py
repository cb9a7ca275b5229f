"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text per Arrow batch, so that a batch of long documents stays small in a Python worker.
ARROW_ROWS = 512
#: A key is hot if it holds one in HOT_PARTS of all rows or more, so there are at most HOT_PARTS hot keys.
HOT_PARTS = 2000
#: Parts that a hot key's rows are dealt over.
SALTS = 64


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``. Where that is unset, a session on one machine (tests) gets
    a temporary folder, which is recorded in the session; on a cluster, where executors don't share such a folder, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_salted(rows: DataFrame, values: DataFrame, on: Sequence[str], count: str = "n", how: str = "inner", by: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``values``, which has each key once, with the number of its rows as ``count`` (dropped), unless ``counts`` has that.

    Keys that hold one in HOT_PARTS of all counted rows are dealt over SALTS parts: their list is at most HOT_PARTS long, whatever the size of the
    tables, so it may be broadcast; their values are repeated for each part. Nothing else is repeated, and other keys are joined as ever. A row's part
    hangs on its columns ``by`` (default: all) only, so that a task that runs again deals its rows alike. ``values`` (or ``counts``) is read twice: a written table.
    """
    on = list(on)
    by = list(by) or rows.columns
    if counts is None:
        counts, values = values.select(*on, count), values.drop(count)
    total = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("_total"))  # one row
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col(count) * HOT_PARTS >= F.col("_total")).filter(F.col(count) > SALTS)
    hot = F.broadcast(hot.select(*on, F.lit(True).alias("_hot")))
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS))).otherwise(0).cast("int")
    rows = rows.join(hot, on, "left").withColumn("_salt", spread).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    values = values.join(hot, on, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return rows.join(values.hint("merge"), [*on, "_salt"], how).drop("_salt")


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches of whole texts small (idempotent, never raises the limit); later queries keep it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64).copy()
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
