"""Writing a stream to two tables at once, for moves from one store to another, and holding the two against each other.

Each batch is a folder by its number in both tables, overwritten as a whole, so a batch that is replayed after a failure changes nothing. A
batch is committed, by a small file of its own, once both tables have it; readers see committed batches only. If either table can't be written, the
stream fails, and a restart begins with that batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Writer = Callable[[DataFrame, str], None]


def _parquet(batch: DataFrame, path: str) -> None:
    batch.write.mode("overwrite").parquet(path)


def dual_write(rows: DataFrame, first: str, second: str, state: str, write_first: Writer = _parquet, write_second: Writer = _parquet) -> None:
    """Run the stream ``rows`` into the tables under ``first`` and ``second`` until what is there has been read; ``state`` has its checkpoint and commits."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # both tables get the same rows, read once
        try:
            write_first(batch, f"{first}/batch={number}")
            write_second(batch, f"{second}/batch={number}")
            spark.range(1).select(F.lit(number).cast("bigint").alias("batch")).coalesce(1).write.mode("overwrite").parquet(f"{state}/commits/number={number}")
        finally:
            batch.unpersist()

    rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, table: str, state: str, schema: str) -> DataFrame:
    """The rows of a table with their ``batch``, of committed batches."""
    done = spark.read.schema("batch bigint").parquet(f"{state}/commits").select("batch").distinct()
    return spark.read.schema(f"{schema}, batch bigint").parquet(table).join(done, "batch", "left_semi")


def reconciled(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(batch, n_first, n_second, missing_first, missing_second, different): batch by batch, rows of each table, keys that one lacks, and keys whose rows differ."""
    others = sorted(c for c in first.columns if c not in (key, "batch"))
    a, b = (t.groupBy("batch", key).agg(F.count("*").alias(f"n_{x}"), F.sum(F.xxhash64(*others).cast("decimal(38,0)")).alias(f"h_{x}")) for t, x in ((first, "a"), (second, "b")))
    both = a.join(b, ["batch", key], "full_outer")
    n_a, n_b = (F.coalesce(f"n_{x}", F.lit(0)) for x in "ab")
    return both.groupBy("batch").agg(
        F.sum(n_a).alias("n_first"), F.sum(n_b).alias("n_second"), F.count_if(n_a == 0).alias("missing_first"), F.count_if(n_b == 0).alias("missing_second"),
        F.count_if((n_a > 0) & (n_b > 0) & ((n_a != n_b) | (F.col("h_a") != F.col("h_b")))).alias("different"),
    )
