"""Queries of optional filters, status machines, SQL functions and failure reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import audit as A
from corvane.operators import control as K
from corvane.plans.search_queries import _RICH, _rich
from corvane.sources import tables as T

AS_OF = "2024-01-20 12:00:00"
ALLOWED = {"new": ("signup", "view"), "signup": ("view", "click"), "view": ("view", "click", "purchase"), "click": ("view", "purchase", "click"), "purchase": ("view",), "error": ("view",)}
STRATEGIES = {"1": "simplify", "2": "change_source"}
WEIGHTS = {"switch": 0.5, "branch": 0.3, "emphasis": 0.4}
#: Parameterised functions over views of the tables; null parameters ask for nothing.
FUNCTIONS = {
    "search_by_flags": """SELECT id, language, CAST(coalesce(:license AND has_license, false) AS INT) + CAST(coalesce(:mention AND has_mention, false) AS INT) AS matches FROM flagged
        WHERE (:license IS NULL AND :mention IS NULL) OR coalesce(:license AND has_license, false) OR coalesce(:mention AND has_mention, false) ORDER BY matches DESC, id LIMIT :most""",
    "document_statistics": "SELECT language, count(*) AS documents, count(embedding) AS embedded, sum(n_chars) AS chars FROM flagged LEFT JOIN vectors USING (id) WHERE :language IS NULL OR language = :language GROUP BY language",
    "unused_documents": "SELECT id FROM flagged d WHERE n_chars >= :least AND NOT EXISTS (SELECT 1 FROM vectors v WHERE v.id = d.id)",
    "deduplicated": "SELECT min(id) AS id, count(*) AS copies FROM flagged GROUP BY md5(content) HAVING count(*) >= :least",
    "labels": "SELECT label, count(*) AS n FROM vectors WHERE :label IS NULL OR label = :label GROUP BY label",
}


def _logs(s, d):
    return T.logs(s, d).select("log_id", "created_at", F.col("session_id").alias("user_id"), F.col("provider").alias("action"), (F.col("tokens") % 3).cast("string").alias("resource_type"), "status", "duration")


def _tagged(s, d):
    tags = F.filter(F.array(F.lit("license"), F.lit("the"), F.lit("que")), lambda t: F.contains(F.lower("content"), t))
    return T.corpus(s, d).withColumn("category", F.col("language")).withColumn("tags", tags)


def _flagged(s, d):
    return T.corpus(s, d).withColumn("has_license", X.has_any(F.col("content"), ["license"])).withColumn("has_mention", F.contains("content", F.lit("@")))


def _failures(s, d):
    return _logs(s, d).filter("status = 'failed'").select(F.col("user_id").alias("agent"), F.col("resource_type").alias("kind"))


#: Parameters and columns of those that are SQL functions of the session; a limit can't be a parameter of one.
TABLE_FUNCTIONS = {
    "document_statistics": ("language STRING", "language STRING, documents BIGINT, embedded BIGINT, chars BIGINT"), "unused_documents": ("least INT", "id BIGINT"),
    "deduplicated": ("least INT", "id BIGINT, copies BIGINT"), "labels": ("label INT", "label INT, n BIGINT"),
}


def _call(name, **values):
    def run(s, d):
        if name in TABLE_FUNCTIONS:
            return K.table_function(s, name, *TABLE_FUNCTIONS[name], FUNCTIONS[name], flagged=_flagged(s, d), vectors=T.vectors(s, d))(**values)
        return K.as_function(s, FUNCTIONS[name], flagged=_flagged(s, d), vectors=T.vectors(s, d))(**values)

    return run


QUERIES = {
    "audit_page": lambda s, d: A.audit_page(_logs(s, d), "log_id", 50, 10, equal={"action": "click", "user_id": None}, start="2024-01-05 00:00:00", end=AS_OF).select("log_id", "user_id"),
    "security_events": lambda s, d: A.matching(_logs(s, d), among={"action": ["error", "signup"]}).select("log_id", "action"),
    "user_activity": lambda s, d: A.audit_page(_logs(s, d), "log_id", equal={"user_id": 7}).select("log_id", "action"),
    "resource_history": lambda s, d: A.audit_page(_logs(s, d), "log_id", equal={"resource_type": "2", "action": "view"}).select("log_id", "user_id"),
    "audit_statistics": lambda s, d: A.audit_statistics(_logs(s, d), ["action", "resource_type"], "user_id", start="2024-01-05 00:00:00"),
    "metadata_filter": lambda s, d: A.with_metadata(_tagged(s, d), "en", None, ["the", "license"]).select("id", "source"),
    "any_flag_filter": lambda s, d: A.any_flag(_flagged(s, d), {"has_license": True, "has_mention": True}).select("id", "matches"),
    "status_machine": lambda s, d: A.statuses(T.logs(s, d), "session_id", "provider", ["created_at", "log_id"], ALLOWED, "new"),
    "updated_at": lambda s, d: A.touched(
        T.tenants(s, d).withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01 00:00:00"))),
        T.tenants(s, d).filter("tenant_id % 3 = 0").withColumn("plan", F.when(F.col("tenant_id") % 2 == 0, F.lit("TRIAL")).otherwise(F.col("plan"))).unionByName(T.tenants(s, d).filter("tenant_id = 1").withColumn("tenant_id", F.lit(-1).cast("bigint"))),
        ["tenant_id"], AS_OF,
    ).select("tenant_id", "plan", F.date_format("updated_at", "yyyy-MM-dd").alias("updated")),
    "timing_report": lambda s, d: A.timing_report(_logs(s, d), "action", "duration"),
    "failure_history": lambda s, d: A.failure_history(T.logs(s, d), AS_OF, 86400).select("log_id", "session_id"),
    "failure_adjustments": lambda s, d: A.adjustments(_failures(s, d), STRATEGIES),
    "negotiation_statistics": lambda s, d: A.negotiation_statistics(_logs(s, d), F.col("action") == "purchase", F.col("created_at") > F.to_timestamp(F.lit(AS_OF))),
    "content_fallback": lambda s, d: A.content_fallback(_rich(s, d).withColumn("a", X.has_any(F.col("content"), ["license"])).withColumn("b", F.contains("content", F.lit("@"))), {"a": "legal", "b": "contact"}),
    "primary_adjustment": lambda s, d: A.primary_adjustment(T.questions(s, d), F.size(F.split("query", r"\.")), F.length("query") / 600.0, F.contains("query", F.lit("the ")), WEIGHTS),
    "function_flags": _call("search_by_flags", license=True, mention=None, most=15),
    "function_statistics": _call("document_statistics", language=None),
    "function_unused": _call("unused_documents", least=1500),
    "function_deduplicated": _call("deduplicated", least=2),
    "function_labels": _call("labels", label=3),
}

_LOGS = """logs AS (SELECT event_id AS log_id, ts AS created_at, user_id, event_type AS action, (CAST(json_extract_string(props, '$.k') AS BIGINT) % 3)::VARCHAR AS resource_type,
CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, value AS duration FROM events)"""
_FLAG = "flagged AS (SELECT doc_id AS id, text AS content, lang AS language, n_chars, contains(lower(text), 'license') AS has_license, contains(text, '@') AS has_mention FROM documents)"

SQL = {
    "audit_page": f"WITH {_LOGS} SELECT log_id, user_id FROM logs WHERE action = 'click' AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '{AS_OF}' ORDER BY created_at DESC, log_id LIMIT 50 OFFSET 10",
    "security_events": f"WITH {_LOGS} SELECT log_id, action FROM logs WHERE action IN ('error', 'signup')",
    "user_activity": f"WITH {_LOGS} SELECT log_id, action FROM logs WHERE user_id = 7 ORDER BY created_at DESC, log_id LIMIT 100",
    "resource_history": f"WITH {_LOGS} SELECT log_id, user_id FROM logs WHERE resource_type = '2' AND action = 'view' ORDER BY created_at DESC, log_id LIMIT 100",
    "audit_statistics": f"WITH {_LOGS} SELECT action, resource_type, count(*) AS n, count(DISTINCT user_id) AS users FROM logs WHERE created_at >= TIMESTAMP '2024-01-05' GROUP BY ALL",
    "metadata_filter": "SELECT doc_id AS id, source FROM documents WHERE lang = 'en' AND contains(lower(text), 'the') AND contains(lower(text), 'license')",
    "any_flag_filter": f"WITH {_FLAG} SELECT id, has_license::INT + has_mention::INT AS matches FROM flagged WHERE has_license OR has_mention",
    "status_machine": f"""WITH a(x, y) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, bs in ALLOWED.items() for b in bs)}), s AS (SELECT user_id AS session_id, event_type AS y, ts, event_id,
      coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'new') AS x FROM events)
      SELECT session_id, arg_max(y, (ts, event_id)) AS status, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a WHERE a.x = s.x AND a.y = s.y)) AS rejected FROM s GROUP BY 1""",
    "updated_at": """SELECT c_custkey AS tenant_id, CASE WHEN c_custkey % 6 = 0 THEN 'TRIAL' ELSE c_mktsegment END AS plan, CASE WHEN c_custkey % 6 = 0 AND c_mktsegment <> 'TRIAL' THEN '2024-01-20' ELSE '2024-01-01' END AS updated FROM customer
      UNION ALL SELECT -1, c_mktsegment, '2024-01-20' FROM customer WHERE c_custkey = 1""",
    "timing_report": f"WITH {_LOGS} SELECT action, count(*) AS n, round(avg(duration), 6) AS mean, max(duration) AS longest, min(duration) AS shortest FROM logs GROUP BY 1",
    "failure_history": f"WITH {_LOGS} SELECT log_id, user_id AS session_id FROM logs WHERE status = 'failed' AND created_at <= TIMESTAMP '{AS_OF}' AND created_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY",
    "failure_adjustments": f"""WITH {_LOGS}, f AS (SELECT user_id AS agent, resource_type AS kind, count(*) AS n FROM logs WHERE status = 'failed' GROUP BY ALL)
      SELECT *, CASE WHEN n >= 3 THEN 'escalate' WHEN kind = '1' THEN 'simplify' WHEN kind = '2' THEN 'change_source' ELSE 'retry' END AS strategy FROM f""",
    "negotiation_statistics": f"""WITH {_LOGS} SELECT count(*) AS n, count(*) FILTER (created_at > TIMESTAMP '{AS_OF}') AS recent, count(*) FILTER (action = 'purchase') AS resolved, round(count(*) FILTER (action = 'purchase')::DOUBLE / count(*), 6) AS rate FROM logs""",
    "content_fallback": f"""WITH {_RICH} SELECT query_id, concat_ws(',', CASE WHEN bool_or(contains(lower(content), 'license')) THEN 'legal' END, CASE WHEN bool_or(contains(content, '@')) THEN 'contact' END) AS types,
      round(least(0.5::DOUBLE + arg_max(length(content), rank) / 1e4, 0.9), 6) AS difficulty FROM h GROUP BY 1""",
    "primary_adjustment": """WITH o AS (SELECT item_id AS query_id, contains(text, 'the ') AS sw, len(string_split(text, '.')) > 3 AS br, length(text) / 600.0::DOUBLE < 0.3 OR length(text) / 600.0::DOUBLE > 0.7 AS em FROM benchmark)
      SELECT query_id, CASE WHEN sw THEN 'switch' WHEN em THEN 'emphasis' WHEN br THEN 'branch' ELSE 'none' END AS adjustment, CASE WHEN sw THEN 0.5::DOUBLE WHEN em THEN 0.4::DOUBLE WHEN br THEN 0.3::DOUBLE ELSE 0 END AS weight FROM o""",
    "function_flags": f"WITH {_FLAG} SELECT id, language, 1 AS matches FROM flagged WHERE has_license ORDER BY id LIMIT 15",
    "function_statistics": f"WITH {_FLAG} SELECT language, count(*) AS documents, count(embedding) AS embedded, sum(n_chars)::BIGINT AS chars FROM flagged LEFT JOIN embeddings ON id = vec_id GROUP BY 1",
    "function_unused": f"WITH {_FLAG} SELECT id FROM flagged WHERE n_chars >= 1500 AND id NOT IN (SELECT vec_id FROM embeddings)",
    "function_deduplicated": f"WITH {_FLAG} SELECT min(id) AS id, count(*) AS copies FROM flagged GROUP BY md5(content) HAVING count(*) >= 2",
    "function_labels": "SELECT label, count(*) AS n FROM embeddings WHERE label = 3 GROUP BY 1",
}
