"""Queries that run streams over the events until all are read, with the SQL of the same on the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.sources.shared import shared_path
from corvane.streaming import dual_write as D
from corvane.streaming import monitor as M

SCHEMA = "log_id bigint, created_at timestamp, session_id bigint, provider string, duration double"


def _stream(s, d):
    return M.log_stream(s, f"{d}/events*.parquet")


def _dual(s, d):
    folder = shared_path(s, "dual")
    D.dual_write(_stream(s, d), f"{folder}/first", f"{folder}/second", f"{folder}/state")
    tables = [D.committed(s, f"{folder}/{t}", f"{folder}/state", SCHEMA) for t in ("first", "second")]
    return D.reconciled(*tables, "log_id").groupBy().agg(*(F.sum(c).alias(c) for c in ("n_first", "n_second", "missing_first", "missing_second", "different")))


QUERIES = {
    "stream_rates": lambda s, d: M.run_to_table(M.rates(_stream(s, d)), shared_path(s, "rates")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")),
    "stream_trailing": lambda s, d: M.run_latest(M.trailing(_stream(s, d)), shared_path(s, "trailing"), ["provider"]),
    "dual_write": _dual,
}

_B = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(M.BUCKETS))
_LIMITS = [0.0, *M.BUCKETS]
_P95 = "CASE " + " ".join(
    f"WHEN b{i} >= 0.95::DOUBLE * n THEN {_LIMITS[i]}::DOUBLE + {_LIMITS[i + 1] - _LIMITS[i]}::DOUBLE * (0.95::DOUBLE * n - {f'b{i - 1}' if i else 0}) / (b{i} - {f'b{i - 1}' if i else 0})" for i in range(len(M.BUCKETS))
) + f" ELSE {M.BUCKETS[-1]}::DOUBLE END"

SQL = {
    "stream_rates": f"""WITH x AS (SELECT *, unnest(range(10)) AS i FROM events), w AS (SELECT time_bucket(INTERVAL 30 SECONDS, ts) - i * INTERVAL 30 SECONDS AS start, event_type AS provider, value FROM x),
      g AS (SELECT start, provider, count(*) AS n, count(*) FILTER (provider = 'error') AS failed, {_B} FROM w WHERE start + INTERVAL 5 MINUTES <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM events) GROUP BY ALL)
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, provider, n, round(n / 300.0::DOUBLE, 6) AS rate, round(failed::DOUBLE / n, 6) AS error_rate, round({_P95}, 6) AS p95 FROM g""",
    "stream_trailing": f"""WITH r AS (SELECT event_type AS provider, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events),
      k AS (SELECT provider, any_value(n) AS n, list_sort(list(value)) AS l FROM r WHERE back <= {M.SAMPLES} GROUP BY provider)
      SELECT provider, n, l[floor(len(l) * 0.5::DOUBLE)::INT + 1] AS p50, l[floor(len(l) * 0.95::DOUBLE)::INT + 1] AS p95, l[floor(len(l) * 0.99::DOUBLE)::INT + 1] AS p99 FROM k""",
    "dual_write": "SELECT count(*) AS n_first, count(*) AS n_second, 0::BIGINT AS missing_first, 0::BIGINT AS missing_second, 0::BIGINT AS different FROM events",
}
