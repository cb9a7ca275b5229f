"""A stored log of changes with snapshots: the state at any time from the last snapshot before it and the changes since.

Changes are (key, value, at, removed) rows, stored by ``period``, the number of their stretch of ``seconds``. A snapshot of period p is the state before p
begins; there is one every ``every`` periods, each made from the one before and the changes between. Reading a state prunes both tables to one snapshot and the
periods behind it, so what is read doesn't grow with the log's age. Of changes of a key at the same time the one with the largest value counts, a
value before a removal; a null value is a value, the smallest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _period(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at) / (seconds * 1_000_000)).cast("bigint")


def replayed(changes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, at): the last change of each key, without keys whose last change is a removal."""
    last = F.max(F.struct("at", (~F.col("removed")).alias("_there"), F.col(value).alias("_value"))).alias("_last")
    latest = changes.groupBy(key).agg(last)
    return latest.filter("_last._there").select(key, F.col("_last._value").alias(value), F.col("_last.at").alias("at"))


@dataclass(frozen=True)
class DeltaLog:
    """A log under ``path``, a folder that driver and executors share."""

    path: str
    key: str
    value: str
    schema: str
    seconds: int = 86_400
    every: int = 7

    def _changes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{self.schema}, at timestamp, removed boolean, period bigint").parquet(f"{self.path}/changes")

    def _snapshot(self, spark: SparkSession, period: int | None) -> DataFrame:
        schema = f"{self.schema}, at timestamp"
        if period is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(f"{schema}, period bigint").parquet(f"{self.path}/snapshots").filter(F.col("period") == period).drop("period")

    def snapshots(self, spark: SparkSession) -> list[int]:
        """The periods of the snapshots, in order: one number for ``every`` periods of the log's age."""
        try:
            rows = spark.read.schema("period bigint").parquet(f"{self.path}/marks")
            return sorted(r["period"] for r in rows.distinct().collect())
        except Exception as error:  # before the first append there is no folder
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def append(self, changes: DataFrame) -> None:
        """Add (key, value, at, removed) changes, none older than the last snapshot, and make the snapshots that became due.

        A snapshot is due once a later change is there. Its mark is written behind it, so a snapshot that a failure left half
        written isn't read, and is written anew.
        """
        spark, marks = changes.sparkSession, self.snapshots(changes.sparkSession)
        rows = changes.select(self.key, self.value, "at", F.coalesce("removed", F.lit(False)).alias("removed"), _period(F.col("at"), self.seconds).alias("period"))
        first, last = rows.agg(F.min("period"), F.max("period")).first()
        if first is None:
            return
        if marks and first < marks[-1]:
            raise ValueError(f"a change of period {first} is older than the snapshot of period {marks[-1]}")
        rows.repartition("period").write.mode("append").partitionBy("period").parquet(f"{self.path}/changes")
        due = marks[-1] + self.every if marks else first + self.every
        while due <= last:
            state = self._since(spark, marks[-1] if marks else None, due, None)
            state.write.mode("overwrite").parquet(f"{self.path}/snapshots/period={due}")
            spark.range(1).select(F.lit(due).cast("bigint").alias("period")).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
            marks.append(due)
            due += self.every

    def _since(self, spark: SparkSession, snapshot: int | None, before: int | None, until: str | None) -> DataFrame:
        """The state from a snapshot and the changes of its and later periods, up to period ``before`` or the time ``until``, both exclusive."""
        changes = self._changes(spark)
        if snapshot is not None:
            changes = changes.filter(F.col("period") >= snapshot)
        if before is not None:
            changes = changes.filter(F.col("period") < before)
        if until is not None:
            changes = changes.filter(F.col("at") < F.to_timestamp(F.lit(until)))
        base = self._snapshot(spark, snapshot).withColumn("removed", F.lit(False))
        return replayed(base.unionByName(changes.drop("period")), self.key, self.value)

    def state_at(self, spark: SparkSession, until: str) -> DataFrame:
        """(key, value, at) as all changes before the time ``until`` left it."""
        end = spark.range(1).select(_period(F.to_timestamp(F.lit(until)), self.seconds)).first()[0]
        older = [p for p in self.snapshots(spark) if p <= end]
        return self._since(spark, older[-1] if older else None, end + 1, until)
