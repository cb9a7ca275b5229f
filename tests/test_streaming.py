import pytest
from pyspark.sql import functions as F

from corvane.streaming import monitor


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{h}:{m:02d}:00", i % 2, "error" if i % 3 == 0 else "click", float(i), "{}") for i, (h, m) in enumerate([(0, 1), (0, 2), (0, 3), (1, 5), (1, 6), (3, 1)])]
    events = spark.createDataFrame(rows, "event_id bigint, t string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    return monitor.log_stream(spark, str(tmp_path / "in")), str(tmp_path)


def rows_of(spark, query, name):
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_close_behind_the_watermark(spark, stream):
    logs, folder = stream
    rows = rows_of(spark, monitor.start(monitor.windowed(logs), "windows", folder + "/c1"), "windows")
    assert sorted((str(r["start"])[11:16], r["provider"], r["n"]) for r in rows) == [("00:00", "click", 2), ("00:00", "error", 1), ("01:00", "click", 1), ("01:00", "error", 1)]


def test_rate_limit_state(spark, stream):
    logs, folder = stream
    rows = rows_of(spark, monitor.start(monitor.rate_limited(logs, 1), "limits", folder + "/c2", "update"), "limits")
    assert {(r["session_id"], r["allowed"], r["refused"]) for r in rows} == {(0, 3, 0), (1, 3, 0)}
