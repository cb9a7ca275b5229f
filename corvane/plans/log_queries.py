"""Queries over logs, usage and tenants, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import logs as L
from corvane.sources import tables as T

AS_OF = "2024-01-20 00:00:00"
USAGE_AS_OF = "1998-06-01 00:00:00"
LIMITS = {"AUTOMOBILE": 1000, "BUILDING": 2000, "MACHINERY": 5000}
PRICES = (("click", 0.5, 1.5), ("purchase", 3.0, 15.0))

_LOGS = """logs AS (SELECT event_id AS log_id, ts AS created_at, user_id AS session_id, event_type AS provider,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS duration, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""
_USAGE = """usage AS (SELECT o_custkey AS tenant_id, l_returnflag AS resource, l_quantity AS used, l_extendedprice AS cost, o_orderdate AS used_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_HOUR = "strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(date_trunc('day', {}), '%Y-%m-%d %H:%M:%S')"
_ORDER = "ORDER BY created_at, log_id"


def _log(operator, *args, **options):
    return lambda spark, d: operator(T.logs(spark, d), *args, **options)


QUERIES = {
    "call_statistics": _log(L.call_statistics, AS_OF),
    "execution_statistics": _log(L.execution_statistics),
    "usage_summary": lambda s, d: L.usage_summary(T.usage(s, d), T.tenants(s, d), LIMITS, USAGE_AS_OF, "300 days"),
    "daily_cost": lambda s, d: L.daily_cost(T.usage(s, d), USAGE_AS_OF, "300 days"),
    "popular_queries": lambda s, d: L.popular(T.logs(s, d).join(T.tenants(s, d), F.col("session_id") == F.col("tenant_id"), "left"), ["provider", "plan"]),
    "popular_texts": lambda s, d: L.popular(T.table(s, d, "conversations").withColumn("tokens", F.length("text").cast("bigint")), [F.substring("text", 1, 100)]),
    "popular_whole_texts": lambda s, d: L.popular(T.table(s, d, "conversations").withColumn("tokens", F.length("text").cast("bigint")), ["text"]).withColumn("group_0", F.left("group_0", F.lit(100))),
    "statistics_total": _log(L.grouped_statistics, []),
    "statistics_by_provider": _log(L.grouped_statistics, ["provider"]),
    "statistics_by_provider_status": _log(L.grouped_statistics, ["provider", "status"]),
    "statistics_by_day": lambda s, d: L.grouped_statistics(T.logs(s, d).withColumn("day", F.date_format("created_at", "yyyy-MM-dd")), ["day"]),
    "document_statistics": lambda s, d: L.document_statistics(T.corpus(s, d)),
    "embedding_coverage": lambda s, d: L.coverage(T.corpus(s, d).join(T.vectors(s, d), "id", "left"), "embedding"),
    "transition_statistics": _log(L.transitions),
    "last_calls": lambda s, d: L.last_rows(T.logs(s, d), "provider").select("provider", "log_id", "place"),
    "trigger_effectiveness": _log(L.trigger_effectiveness),
    "confidence_histogram": lambda s, d: L.histogram(T.table(s, d, "lineitem"), F.col("l_discount") * 10, 5),
    "session_report": _log(L.dominant),
    "token_cost": lambda s, d: L.token_cost(T.logs(s, d), s.createDataFrame(PRICES, "provider string, price_in double, price_out double")),
    "budget_levels": _log(L.budget, 400),
    "histogram_buckets": _log(L.cumulative_buckets, [1, 5, 10, 50, 100]),
    "latency_percentiles": _log(L.latency_percentiles, AS_OF, "7 days"),
    "throughput": _log(L.throughput),
    "error_rates": lambda s, d: L.rates(T.logs(s, d), F.col("status") == "failed", ["session_id"]),
    "cache_hit_rates": lambda s, d: L.rates(T.logs(s, d), F.col("tokens") % 2 == 0),
    "quality_degradation": _log(L.degradation, AS_OF, "10 days", "2 days"),
    "alerts": _log(L.alerts, 20.0, 0.05),
    "nearest_rank": _log(L.nearest_rank),
    "sessions": _log(L.sessions),
    "sliding_rates": _log(L.sliding_rates),
    "failure_pattern": _log(L.failure_pattern),
    "loop_detector": _log(L.loops, 4, 10),
    "threshold_crossings": _log(L.threshold_crossings, 12.0),
}

_STATS = """count(*) AS n, count(*) FILTER (status = 'success') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  coalesce(sum(tokens), 0)::BIGINT AS tokens, round(avg(duration), 6) AS mean, min(duration) AS least, max(duration) AS most,
  round(stddev_pop(duration), 6) AS deviation, count(DISTINCT session_id) AS sessions"""

SQL = {
    "call_statistics": f"""WITH {_LOGS} SELECT provider, {_HOUR} AS hour, count(*) AS calls, round(avg(duration), 6) AS avg_duration,
      round(quantile_cont(duration, 0.95), 6) AS p95_duration, round(quantile_cont(duration, 0.99), 6) AS p99_duration, sum(tokens)::BIGINT AS tokens,
      count(*) FILTER (status = 'failed') AS failed FROM logs WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND created_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL""",
    "execution_statistics": f"WITH {_LOGS} SELECT provider, {_HOUR} AS period, count(*) AS executions, round(avg(duration), 6) AS avg_duration, max(duration) AS max_duration FROM logs GROUP BY ALL",
    "usage_summary": f"""WITH {_USAGE}, g AS (SELECT c_mktsegment AS plan, resource, {_DAY.format('used_at')} AS day, round(sum(used), 4) AS used, max(used) AS largest, count(DISTINCT tenant_id) AS tenants
      FROM usage JOIN customer ON tenant_id = c_custkey WHERE used_at > TIMESTAMP '{USAGE_AS_OF}' - INTERVAL 300 DAY AND used_at <= TIMESTAMP '{USAGE_AS_OF}' GROUP BY ALL)
      SELECT *, round(used * 100 / CASE plan WHEN 'AUTOMOBILE' THEN 1000.0::DOUBLE WHEN 'BUILDING' THEN 2000.0::DOUBLE WHEN 'MACHINERY' THEN 5000.0::DOUBLE END, 2) AS percent FROM g""",
    "daily_cost": f"""WITH {_USAGE} SELECT {_DAY.format('used_at')} AS day, count(*) AS requests, round(sum(cost), 2) AS cost, round(sum(used), 2) AS used, count(DISTINCT tenant_id) AS tenants
      FROM usage WHERE used_at > TIMESTAMP '{USAGE_AS_OF}' - INTERVAL 300 DAY AND used_at <= TIMESTAMP '{USAGE_AS_OF}' GROUP BY ALL""",
    "popular_queries": f"""WITH {_LOGS} SELECT provider AS group_0, c_mktsegment AS group_1, count(*) AS hits, sum(tokens)::BIGINT AS total FROM logs LEFT JOIN customer ON session_id = c_custkey
      GROUP BY ALL ORDER BY hits DESC, group_0, group_1 NULLS FIRST LIMIT 100""",
    "popular_texts": "SELECT text[:100] AS group_0, count(*) AS hits, sum(length(text))::BIGINT AS total FROM conversations GROUP BY 1 ORDER BY hits DESC, group_0 LIMIT 100",
    "statistics_total": f"WITH {_LOGS} SELECT {_STATS} FROM logs",
    "statistics_by_provider": f"WITH {_LOGS} SELECT provider, {_STATS} FROM logs GROUP BY provider",
    "statistics_by_provider_status": f"WITH {_LOGS} SELECT provider, status, {_STATS} FROM logs GROUP BY provider, status",
    "statistics_by_day": f"WITH {_LOGS} SELECT strftime(created_at, '%Y-%m-%d') AS day, {_STATS} FROM logs GROUP BY day",
    "document_statistics": """WITH g AS (SELECT coalesce(lang, 'unknown') AS language, count(*) AS n, sum(n_chars) AS chars, count(*) FILTER (n_chars > 5000) AS long FROM documents GROUP BY 1)
      SELECT sum(n)::BIGINT AS documents, sum(chars)::BIGINT AS chars, sum(long)::BIGINT AS long_documents, round(sum(chars) / sum(n), 4) AS avg_chars,
      '{' || string_agg('"' || language || '":' || n, ',' ORDER BY '"' || language || '":' || n) || '}' AS languages FROM g""",
    "embedding_coverage": "SELECT count(*) AS n, count(embedding) AS filled, round(avg((embedding IS NOT NULL)::INT::DOUBLE) * 100, 4) AS percent FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "transition_statistics": f"""WITH {_LOGS}, p AS (SELECT provider, lag(provider) OVER (PARTITION BY session_id {_ORDER}) AS previous FROM logs)
      SELECT previous, provider, count(*) AS n FROM p WHERE previous IS NOT NULL GROUP BY ALL ORDER BY n DESC, previous, provider LIMIT 5""",
    "last_calls": f"WITH {_LOGS} SELECT provider, log_id, row_number() OVER (PARTITION BY provider ORDER BY created_at DESC, log_id DESC) AS place FROM logs QUALIFY place <= 10",
    "trigger_effectiveness": f"WITH {_LOGS} SELECT session_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT provider)), ',') AS providers FROM logs GROUP BY session_id ORDER BY n DESC, session_id LIMIT 20",
    "confidence_histogram": "SELECT least(floor(l_discount * 10 * 5), 4)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1",
    "session_report": f"""WITH {_LOGS}, c AS (SELECT session_id, provider, count(*) AS n FROM logs GROUP BY ALL)
      SELECT session_id, arg_min(provider, (-n, provider)) AS dominant, max(n) AS n, sum(n)::BIGINT AS total FROM c GROUP BY session_id""",
    "token_cost": f"""WITH {_LOGS}, p(provider, i, o) AS (VALUES ('click', 0.5::DOUBLE, 1.5::DOUBLE), ('purchase', 3.0::DOUBLE, 15.0::DOUBLE))
      SELECT provider, round(sum((coalesce(tokens, 0) * coalesce(i, 0.01::DOUBLE) + duration * coalesce(o, 0.03::DOUBLE)) / 1e6), 6) AS cost FROM logs LEFT JOIN p USING (provider) GROUP BY provider""",
    "budget_levels": f"""WITH {_LOGS}, r AS (SELECT log_id, session_id, {_DAY.format('created_at')} AS day,
        sum(coalesce(tokens, 0)) OVER (PARTITION BY session_id, date_trunc('day', created_at) {_ORDER} ROWS UNBOUNDED PRECEDING)::BIGINT AS spent FROM logs)
      SELECT *, CASE WHEN spent / 400.0::DOUBLE < 0.2 THEN 'low' WHEN spent / 400.0::DOUBLE < 0.5 THEN 'medium' WHEN spent / 400.0::DOUBLE < 0.8 THEN 'high' ELSE 'critical' END AS level,
        spent / 400.0::DOUBLE > 1 AS over FROM r""",
    "histogram_buckets": f"""WITH {_LOGS} SELECT provider, count(*) FILTER (duration <= 1) AS le_0, count(*) FILTER (duration <= 5) AS le_1, count(*) FILTER (duration <= 10) AS le_2,
      count(*) FILTER (duration <= 50) AS le_3, count(*) FILTER (duration <= 100) AS le_4, count(duration) AS le_inf, round(sum(duration), 4) AS total FROM logs GROUP BY provider""",
    "latency_percentiles": f"""WITH {_LOGS} SELECT count(*) AS n, round(quantile_cont(duration, 0.5), 6) AS p50, round(quantile_cont(duration, 0.95), 6) AS p95, round(quantile_cont(duration, 0.99), 6) AS p99,
      round(avg(duration), 6) AS mean FROM logs WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{AS_OF}'""",
    "throughput": f"WITH {_LOGS} SELECT {_HOUR} AS start, count(*) AS n, round(count(*) / 3600.0::DOUBLE, 8) AS per_second FROM logs GROUP BY 1",
    "error_rates": f"WITH {_LOGS} SELECT session_id, count(*) AS n, count(*) FILTER (status = 'failed') AS hits, round(avg((status = 'failed')::INT::DOUBLE), 6) AS rate FROM logs GROUP BY 1",
    "cache_hit_rates": f"WITH {_LOGS} SELECT provider, count(*) AS n, count(*) FILTER (tokens % 2 = 0) AS hits, round(avg((tokens % 2 = 0)::INT::DOUBLE), 6) AS rate FROM logs GROUP BY 1",
    "quality_degradation": f"""WITH {_LOGS}, w AS (SELECT duration, created_at > TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AS now FROM logs WHERE created_at <= TIMESTAMP '{AS_OF}' AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 10 DAY),
      a AS (SELECT count(*) FILTER (NOT now) AS n_base, count(*) FILTER (now) AS n_now, round(avg(duration) FILTER (NOT now), 6) AS base, round(avg(duration) FILTER (now), 6) AS recent FROM w)
      SELECT *, coalesce(n_base >= 10 AND n_now >= 5 AND (base - recent) / nullif(base, 0) > 0.15, false) AS degraded FROM a""",
    "alerts": f"""WITH {_LOGS}, a AS (SELECT provider, quantile_cont(duration, 0.95) AS p95, avg((status = 'failed')::INT::DOUBLE) AS e FROM logs GROUP BY 1)
      SELECT provider, 'slow' AS alert FROM a WHERE p95 > 20 UNION ALL SELECT provider, 'errors' FROM a WHERE e > 0.05""",
    "nearest_rank": f"""WITH {_LOGS}, r AS (SELECT provider, duration, row_number() OVER (PARTITION BY provider ORDER BY duration, log_id) AS place, count(*) OVER (PARTITION BY provider) AS n FROM logs)
      SELECT provider, n, duration AS value FROM r WHERE place = least(floor(n * 0.99::DOUBLE) + 1, n)""",
    "sessions": f"""WITH {_LOGS}, g AS (SELECT session_id, created_at, log_id, CASE WHEN created_at < lag(created_at) OVER (PARTITION BY session_id {_ORDER}) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM logs),
      i AS (SELECT session_id, sum(new) OVER (PARTITION BY session_id {_ORDER} ROWS UNBOUNDED PRECEDING) AS visit FROM g), c AS (SELECT session_id, visit, count(*) AS n FROM i GROUP BY ALL)
      SELECT session_id, count(*) AS visits, max(n) AS longest FROM c GROUP BY 1""",
    "sliding_rates": f"""WITH {_LOGS}, x AS (SELECT date_trunc('hour', created_at) - to_hours(k) AS start, status FROM logs, (VALUES (0), (1)) v(k))
      SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (status = 'failed') AS failed FROM x GROUP BY 1""",
    "failure_pattern": f"""WITH {_LOGS}, k AS (SELECT session_id, coalesce((tokens // 10)::VARCHAR, 'none') AS kind, count(*) AS n, min((created_at, log_id)) AS first, min(created_at) AS a, max(created_at) AS b, max(tokens) AS tokens FROM logs WHERE status = 'failed' GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS place FROM k)
      SELECT session_id, sum(n)::BIGINT AS failures, (epoch(date_trunc('second', max(b))) - epoch(date_trunc('second', min(a))))::BIGINT AS seconds, max(tokens) AS most_tokens, any_value(kind) FILTER (place = 1) AS pattern,
        any_value(n) FILTER (place = 1) AS frequency, string_agg(kind || ':' || n, ',' ORDER BY kind) AS distribution, sum(n) >= 3 AS escalate FROM o GROUP BY 1""",
    "loop_detector": f"""WITH {_LOGS}, r AS (SELECT log_id, session_id, provider, list(provider) OVER (PARTITION BY session_id {_ORDER} ROWS 9 PRECEDING) AS recent FROM logs)
      SELECT log_id, session_id, len(list_filter(recent, lambda x: x = provider))::BIGINT AS repeats FROM r WHERE len(list_filter(recent, lambda x: x = provider)) > 4""",
    "threshold_crossings": f"""WITH {_LOGS}, o AS (SELECT log_id, session_id, created_at, round(avg(duration) OVER (PARTITION BY session_id {_ORDER} ROWS UNBOUNDED PRECEDING), 6) > 12 AS over FROM logs),
      p AS (SELECT *, coalesce(lag(over) OVER (PARTITION BY session_id {_ORDER}), false) AS before FROM o)
      SELECT log_id, session_id, CASE WHEN over THEN 'raised' ELSE 'cleared' END AS edge FROM p WHERE over <> before""",
}
