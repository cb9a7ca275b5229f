"""A stored log with snapshots against a replay of all changes."""

import datetime as dt
import random
import tempfile

import pytest

from corvane.operators.delta_log import DeltaLog

CHANGES = "k bigint, v string, at timestamp, removed boolean"


def test_states_at_any_time(spark):
    rng = random.Random(2)
    first = dt.datetime(2024, 1, 1)
    rows = [(rng.randint(1, 12), rng.choice(["a", "b", None]), first + dt.timedelta(hours=2 * i), rng.random() < 0.25) for i in range(300)]
    log = DeltaLog("file://" + tempfile.mkdtemp(prefix="corvane-") + "/log", "k", "v", "k bigint, v string", every=5)
    for part in (rows[:100], rows[100:210], rows[210:]):
        log.append(spark.createDataFrame(part, CHANGES))
    assert len(log.snapshots(spark)) == 4
    for until in ("2024-01-01 00:00:00", "2024-01-05 07:00:00", "2024-01-11 00:00:00", "2024-01-16 13:30:00", "2024-03-01 00:00:00"):
        end, want = dt.datetime.fromisoformat(until), {}
        for k, v, at, removed in rows:
            if at < end:
                want[k] = (v, at) if not removed else None
        got = {r["k"]: (r["v"], r["at"]) for r in log.state_at(spark, until).collect()}
        assert got == {k: x for k, x in want.items() if x}
    # one snapshot and the periods behind it are read
    plan = log.state_at(spark, "2024-01-16 13:30:00")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "period" in plan
    files = log.state_at(spark, "2024-01-16 13:30:00").inputFiles()
    assert 0 < len({f.split("/log/")[1].split("/part-")[0] for f in files if "/changes/" in f}) <= 26
    with pytest.raises(ValueError, match="older"):
        log.append(spark.createDataFrame([(1, "late", first, False)], CHANGES))
    log.append(spark.createDataFrame([], CHANGES))
