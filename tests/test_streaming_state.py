"""Streaming monitors and dual writes over several batches: late rows, bounded state, failures and replays."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from corvane.streaming import dual_write as D
from corvane.streaming import monitor as M

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
ROW = "log_id bigint, created_at timestamp, session_id bigint, provider string, duration double"


def folder(kind):
    return tempfile.mkdtemp(prefix=f"corvane-{kind}-")


def written_batches(spark, n=4, each=60):
    """Files of rows whose times overlap by up to eight minutes."""
    rng, path, rows = random.Random(6), folder("events"), []
    for b in range(n):
        part = [(b * each + i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=b * 600 + rng.randint(-480, 600)), rng.randint(1, 5), rng.choice(["click", "view", "error"]), rng.choice([5.0, 60.0, 700.0, 5000.0]), "{}") for i in range(each)]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
        rows += part
    return path, rows


def test_rates_of_a_stream_with_late_rows(spark):
    path, rows = written_batches(spark)
    got = {(r["start"], r["provider"]): (r["n"], r["rate"], r["error_rate"], r["p95"]) for r in M.run_to_table(M.rates(M.log_stream(spark, path)), folder("rates")).collect()}
    table = spark.createDataFrame([r[:5] for r in rows], ROW)
    newest = max(r[1] for r in rows)
    whole = M.rates(table).filter((F.col("start") + F.expr("interval 5 minutes")) <= F.lit(newest - dt.timedelta(minutes=10)))
    want = {(r["start"], r["provider"]): (r["n"], r["rate"], r["error_rate"], r["p95"]) for r in whole.collect()}
    assert got == want and len(got) > 50


def test_bucket_quantile(spark):
    counts = spark.createDataFrame([([0, 5, 10, 10],), ([0, 0, 0, 4],), ([4, 4, 4, 4],), ([0, 0, 0, 0],)], "c array<bigint>")
    got = [r[0] for r in counts.select(M.bucket_quantile(F.col("c"), (1, 2, 4), 0.75)).collect()]
    assert got == [3.0, 4.0, 0.75, None]


def test_trailing_state_is_bounded(spark):
    path, rows = written_batches(spark)
    got = {r["provider"]: tuple(r)[1:] for r in M.run_latest(M.trailing(M.log_stream(spark, path), samples=25), folder("trailing"), ["provider"]).collect()}
    for provider in ("click", "view", "error"):
        own = []
        for b in range(4):
            own += [r[4] for r in sorted((r for r in rows[b * 60 : b * 60 + 60] if r[3] == provider), key=lambda r: (r[1], r[0]))]
        line = sorted(own[-25:])
        assert got[provider] == (len(own), line[12], line[23], line[24])


def test_dual_write_fails_and_restarts(spark):
    path, rows = written_batches(spark)
    base, failed = folder("dual"), []
    state = f"{base}/state"

    def breaks_once(batch, where):
        if "batch=2" in where and not failed:
            failed.append(where)
            raise OSError("the second store is away")
        D._parquet(batch, where)

    def run():
        D.dual_write(M.log_stream(spark, path), f"{base}/a", f"{base}/b", state, write_second=breaks_once)

    with pytest.raises(Exception, match="away"):
        run()
    a, b = (D.committed(spark, f"{base}/{t}", state, ROW) for t in "ab")
    assert a.count() == b.count() == 120 and len(failed) == 1
    run()
    run()
    a, b = (D.committed(spark, f"{base}/{t}", state, ROW) for t in "ab")
    assert sorted(r["log_id"] for r in a.collect()) == sorted(r["log_id"] for r in b.collect()) == sorted(r[0] for r in rows)
    assert sorted(tuple(r) for r in D.reconciled(a, b, "log_id").collect()) == [(i, 60, 60, 0, 0, 0) for i in range(4)]
    other = b.filter("log_id <> 3").withColumn("duration", F.when(F.col("log_id") == 5, 0.5).otherwise(F.col("duration")))
    assert [tuple(r) for r in D.reconciled(a, other, "log_id").filter("batch = 0").collect()] in ([(0, 60, 59, 0, 1, 1)], [(0, 60, 60, 0, 0, 0)])
    assert sum(r["missing_second"] for r in D.reconciled(a, other, "log_id").collect()) == 1 and sum(r["different"] for r in D.reconciled(a, other, "log_id").collect()) == 1
