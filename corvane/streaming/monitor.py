"""Structured Streaming forms of the monitors: windows with watermarks, sessions, and stateful rate limits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def log_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Logs as they arrive as Parquet files of (event_id, ts, user_id, event_type, value, props)."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.select(
        F.col("event_id").alias("log_id"), F.col("ts").alias("created_at"), F.col("user_id").alias("session_id"), F.col("event_type").alias("provider"), F.col("value").alias("duration")
    )


def windowed(logs: DataFrame, width: str = "1 hour", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and failures by window and provider; rows later than ``late`` behind the newest are dropped with their window closed."""
    slot = F.window("created_at", width, step) if step else F.window("created_at", width)
    rows = logs.withWatermark("created_at", late).groupBy(slot.alias("w"), "provider")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("mean"), F.count_if(F.col("provider") == "error").alias("failed")).select(
        F.col("w.start").alias("start"), "provider", "n", "mean", "failed"
    )


def visits(logs: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = logs.withWatermark("created_at", late).groupBy(F.session_window("created_at", gap).alias("w"), "session_id")
    return rows.agg(F.count("*").alias("n")).select("session_id", F.col("w.start").alias("start"), "n")


def rate_limited(logs: DataFrame, per_minute: int, late: str = "10 minutes") -> DataFrame:
    """(session_id, allowed, refused) so far: a token bucket for each session, refilled by event time."""

    def step(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, allowed, refused = state.get if state.exists else (float(per_minute), 0.0, 0, 0)
        for table in tables:
            for at in sorted(table["created_at"].astype("int64") / 1e9):
                tokens = min(float(per_minute), tokens + max(at - last, 0.0) * per_minute / 60) if last else tokens
                last = max(at, last)
                if tokens >= 1:
                    tokens, allowed = tokens - 1, allowed + 1
                else:
                    refused += 1
        state.update((tokens, last, allowed, refused))
        yield pd.DataFrame({"session_id": [key[0]], "allowed": [allowed], "refused": [refused]})

    return logs.withWatermark("created_at", late).groupBy("session_id").applyInPandasWithState(
        step, "session_id bigint, allowed bigint, refused bigint", "tokens double, last double, allowed bigint, refused bigint", "update", GroupStateTimeout.NoTimeout
    )


#: Upper bounds of the latency buckets, and rows of a trailing sample (fixed values).
BUCKETS = (10.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
SAMPLES = 10_000


def bucket_quantile(counts: Column, bounds: Sequence[float], share: float) -> Column:
    """The quantile of cumulative counts of values up to each bound, by a straight line within its bucket; the last bound where it lies beyond, null without values up to it."""
    limits, target = F.array(*[F.lit(float(b)) for b in bounds]), share * F.element_at(counts, -1)
    at = F.array_position(F.transform(counts, lambda c: c >= target), True).cast("int")
    below, under = (F.coalesce(F.get(a, at - 2), F.lit(0.0)).cast("double") for a in (limits, counts))
    inside = below + (F.get(limits, at - 1) - below) * (target - under) / (F.get(counts, at - 1) - under)
    return F.when(F.element_at(counts, -1) > 0, F.when(at > len(bounds), F.lit(float(bounds[-1]))).otherwise(inside))


def rates(logs: DataFrame, width: str = "5 minutes", step: str = "30 seconds", seconds: int = 300, late: str = "10 minutes", bounds: Sequence[float] = BUCKETS) -> DataFrame:
    """(start, provider, n, rate, error_rate, p95) of trailing windows: rows a second, share of failures, and the 95th percentile by buckets.

    The same plan serves streams and tables. A stream in append mode gives a window once the watermark is behind its end.
    """
    rows = logs.withWatermark("created_at", late).groupBy(F.window("created_at", width, step).alias("w"), "provider")
    counts = [F.count_if(F.col("duration") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.col("provider") == "error").alias("failed"), *counts)
    held = F.array(*[F.col(f"b{i}") for i in range(len(bounds))], F.col("n"))
    return sums.select(
        F.col("w.start").alias("start"), "provider", "n", F.round(F.col("n") / seconds, 6).alias("rate"), F.round(F.col("failed") / F.col("n"), 6).alias("error_rate"),
        F.round(bucket_quantile(held, bounds, 0.95), 6).alias("p95"),
    )


def trailing(logs: DataFrame, samples: int = SAMPLES, late: str = "10 minutes") -> DataFrame:
    """(provider, n, p50, p95, p99) after each batch: nearest ranks over a provider's last ``samples`` rows, in the order of time and log_id within a batch.

    A provider's state is its last rows only, whatever it has seen.
    """

    def step(key: tuple, tables: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = state.get if state.exists else (0, [])
        fresh = pd.concat(list(tables)).sort_values(["created_at", "log_id"], kind="stable")
        held = np.concatenate([np.asarray(kept, float), fresh["duration"].to_numpy(float)])[-samples:]
        n += len(fresh)
        state.update((n, held.tolist()))
        line = np.sort(held)
        places = [line[min(int(len(line) * share), len(line) - 1)] for share in (0.5, 0.95, 0.99)]
        yield pd.DataFrame({"provider": [key[0]], "n": [n], **{name: [float(v)] for name, v in zip(("p50", "p95", "p99"), places, strict=True)}})

    return logs.withWatermark("created_at", late).groupBy("provider").applyInPandasWithState(
        step, "provider string, n bigint, p50 double, p95 double, p99 double", "n bigint, kept array<double>", "update", GroupStateTimeout.NoTimeout
    )


def run_to_table(rows: DataFrame, folder: str) -> DataFrame:
    """Run a stream in append mode until what is there has been read, into Parquet files under ``folder``; a restart goes on from there."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def run_latest(rows: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Run a stream in update mode until what is there has been read; the last row of each key. Each batch is a folder of its own, so a batch that is replayed changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = rows.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, batch bigint"
    found = rows.sparkSession.read.schema(schema).parquet(f"{folder}/rows")
    others = [c for c in rows.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_last")).select(*keys, "_last.*")


def start(rows: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run until what is there has been read, into a table in memory (for checks and small summaries)."""
    return rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
