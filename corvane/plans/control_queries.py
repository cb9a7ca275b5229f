"""Queries of the control loop, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import control as K
from corvane.operators import ordering as O
from corvane.plans.graph_queries import SKILLS, _skills
from corvane.plans.search_queries import _QUEST, _RICH, _rich
from corvane.sources import tables as T

AGENTS = {"director": (3, 120), "writer": (8, 40), "checker": (1, 500)}
RIGHTS = {"writer": {"id": "r", "content": "rw", "language": "r"}, "director": {"id": "r"}}
LEVELS = {"content": "internal", "source": "public", "embedding": "internal", "api_key": "secret", "language": "public"}
LIMITS = {"AUTOMOBILE": 60, "BUILDING": 100}
CAPACITIES = (10, 50, 100)
TRIGGERS = (("tutorial", "the ", 5), ("warning", "of ", 1), ("analogy", "que ", 3), ("research", "and ", 4), ("code", "der ", 2))
MARKERS_SQL = """SELECT id, language, n_chars FROM corpus WHERE (:language IS NULL OR language = :language) AND n_chars >= :least AND contains(lower(content), :word)"""


STYLES = ("detailed_explainer", "concise_summary", "standard_explainer", "practical_guide", "quick_reference", "other")


def _styles():
    return F.array(*[F.lit(n) for n in STYLES])


def _level(size):
    return F.when(size > 3000, "high").when(size > 1000, "medium").when(size > 100, "low").otherwise("none")


def _wishes(s, d):
    names = F.array(*[F.lit(n) for n in ("warning_mode", "meme_style", "code_example", "security_audit", "research_mode")])
    rows = T.corpus(s, d).select("id")
    return rows.select("id", F.get(names, F.col("id") % 5).alias("current"), F.get(names, (F.col("id") * 3 + 1) % 5).alias("desired"))


def _outline(s, d):
    return T.messages(s, d).filter("role = 'user'").select(F.col("conv_id").alias("doc"), F.col("turn").alias("step"), F.when(F.col("turn") % 3 > 0, F.left("content", F.lit(20))).alias("title"))


def _fragments(s, d):
    return T.messages(s, d).filter("role = 'assistant'").select(F.col("conv_id").alias("doc"), (F.col("turn") - 1).alias("step"), "content")


QUERIES = {
    "agent_contexts": lambda s, d: K.minimized(_rich(s, d), AGENTS),
    "field_access": lambda s, d: K.readable(T.corpus(s, d), RIGHTS, "writer"),
    "sensitivity_report": lambda s, d: K.sensitivity(T.corpus(s, d), LEVELS),
    "recent_history": lambda s, d: K.recent_history(T.messages(s, d), 3),
    "quota_check": lambda s, d: K.quota_check(T.usage(s, d), T.tenants(s, d), LIMITS, "month", "1997-03-28 00:00:00"),
    "skill_routing": lambda s, d: K.route(T.questions(s, d), TRIGGERS, "summary"),
    "skill_switch": lambda s, d: K.switched(_wishes(s, d), _skills(s, d), _skills(s, d).groupBy("source").agg(F.min("target").alias("target"))),
    "cache_simulation": lambda s, d: K.cache_hits(T.logs(s, d), F.concat_ws(":", "provider", (F.col("session_id") % 20).cast("string")), 3600).groupBy("hit").agg(F.count("*").alias("n")),
    "cache_capacities": lambda s, d: O.lru_hits(O.reuse_distances(T.logs(s, d).select("log_id", "created_at", "session_id"), "session_id", ["created_at", "log_id"]), CAPACITIES),
    "reuse_distances": lambda s, d: O.reuse_distances(T.logs(s, d).select("log_id", "created_at", "session_id"), "session_id", ["created_at", "log_id"]).select("log_id", "distance"),
    "retry_cap": lambda s, d: K.retries(T.logs(s, d), 3),
    "compiled_scripts": lambda s, d: K.compiled(_outline(s, d), _fragments(s, d)),
    "mediation": lambda s, d: K.mediate(T.corpus(s, d), F.col("id") % 5, _level(F.col("n_chars")), F.get(_styles(), F.col("id") % 6), F.get(_styles(), (F.col("id") * 5 + 2) % 6)),
    "storage_ratio": lambda s, d: K.storage(T.corpus(s, d), F.col("n_chars"), F.size(F.array_distinct(F.split("content", ""))).cast("bigint")),
    "sql_function": lambda s, d: K.table_function(s, "by_marker", "language STRING, least INT, word STRING", "id BIGINT, language STRING, n_chars BIGINT", MARKERS_SQL, corpus=T.corpus(s, d))(language="en", least=500, word="with"),
    "decision_patterns": lambda s, d: T.logs(s, d).groupBy("provider", (F.col("tokens") % 10).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "provider", "reason").limit(10),
    "documents_by_category": lambda s, d: T.corpus(s, d).groupBy("source", "language").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
    "node_quality": lambda s, d: _rich(s, d).groupBy("query_id").agg(F.round(0.3 * F.least(F.count("*") / 5.0, F.lit(1.0)) + 0.7 * F.avg("similarity"), 6).alias("quality")),
}

_LOGS = "logs AS (SELECT event_id AS log_id, ts AS created_at, user_id AS session_id, event_type AS provider, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"
_SK = "e(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in SKILLS.items() for b in bs) + ")"
_NAMES = "['warning_mode', 'meme_style', 'code_example', 'security_audit', 'research_mode']"

_REUSE = """a AS (SELECT event_id AS log_id, user_id AS k, row_number() OVER w AS pos FROM events WINDOW w AS (ORDER BY ts, event_id)), b AS (SELECT *, lag(pos) OVER (PARTITION BY k ORDER BY pos) AS prev FROM a),
dist AS (SELECT x.log_id, CASE WHEN any_value(x.prev) IS NOT NULL THEN count(DISTINCT y.k) END AS distance FROM b x LEFT JOIN b y ON y.pos > x.prev AND y.pos < x.pos GROUP BY x.log_id)"""

SQL = {
    "agent_contexts": f"WITH {_RICH}, a(agent, docs, chars) AS (VALUES ('director', 3, 120), ('writer', 8, 40), ('checker', 1, 500)) SELECT agent, query_id, id, rank, left(content, chars) AS fragment FROM h, a WHERE rank <= docs",
    "field_access": "SELECT doc_id AS id, text AS content, lang AS language FROM documents",
    "sensitivity_report": """WITH t(level, n, fields, filled) AS (SELECT 'internal', 2, 'content,embedding', count(text) FROM documents UNION ALL SELECT 'public', 2, 'language,source', count(lang) + count(source) FROM documents
      UNION ALL SELECT 'secret', 1, 'api_key', 0) SELECT * FROM t""",
    "recent_history": "WITH r AS (SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3) SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS history FROM r GROUP BY 1",
    "quota_check": """WITH u AS (SELECT o_custkey AS tenant_id, round(sum(l_quantity), 4) AS used FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1997-03-28' GROUP BY 1),
      m AS (SELECT tenant_id, used, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 60.0::DOUBLE WHEN 'BUILDING' THEN 100.0::DOUBLE END AS most FROM u JOIN customer ON tenant_id = c_custkey)
      SELECT *, CASE WHEN most IS NULL THEN 'unlimited' WHEN used > most THEN 'exceeded' WHEN used > most * 0.8::DOUBLE THEN 'alert' ELSE 'ok' END AS state FROM m""",
    "skill_routing": f"""WITH {_QUEST}, l AS (SELECT query_id, lower(query) AS q FROM asked) SELECT query_id, CASE WHEN contains(q, 'of ') THEN 'warning' WHEN contains(q, 'der ') THEN 'code' WHEN contains(q, 'que ') THEN 'analogy' WHEN contains(q, 'and ') THEN 'research'
      WHEN contains(q, 'the ') THEN 'tutorial' ELSE 'summary' END AS skill, CASE WHEN contains(q, 'of ') THEN 1 WHEN contains(q, 'der ') THEN 2 WHEN contains(q, 'que ') THEN 3 WHEN contains(q, 'and ') THEN 4 WHEN contains(q, 'the ') THEN 5 ELSE 10 END AS priority FROM l""",
    "skill_switch": f"""WITH {_SK}, n AS (SELECT source, min(target) AS near FROM e GROUP BY 1), w AS (SELECT doc_id AS id, {_NAMES}[doc_id % 5 + 1] AS current, {_NAMES}[(doc_id * 3 + 1) % 5 + 1] AS desired FROM documents)
      SELECT id, CASE WHEN current = desired OR EXISTS (SELECT 1 FROM e WHERE source = current AND target = desired) THEN desired ELSE coalesce(near, current) END AS skill FROM w LEFT JOIN n ON source = current""",
    "cache_simulation": f"""WITH {_LOGS}, g AS (SELECT created_at - lag(created_at) OVER (PARTITION BY provider, session_id % 20 ORDER BY created_at, log_id) AS gap FROM logs) SELECT coalesce(gap <= INTERVAL 3600 SECOND, false) AS hit, count(*) AS n FROM g GROUP BY 1""",
    "cache_capacities": f"""WITH {_REUSE}, c(capacity) AS (VALUES {', '.join(f'({c}::BIGINT)' for c in CAPACITIES)}), n AS (SELECT count(*) AS requests, count(DISTINCT k) AS keys FROM a)
      SELECT capacity, any_value(requests) AS requests, count(*) FILTER (distance < capacity) AS hits, any_value(requests) - count(*) FILTER (distance < capacity) - least(any_value(keys), capacity) AS evictions,
        least(any_value(keys), capacity) AS size FROM dist, c, n GROUP BY capacity""",
    "reuse_distances": f"WITH {_REUSE} SELECT log_id, distance FROM dist",
    "retry_cap": f"""WITH {_LOGS}, r AS (SELECT *, sum((provider <> 'error')::INT) OVER (PARTITION BY session_id ORDER BY created_at, log_id ROWS UNBOUNDED PRECEDING) AS run FROM logs),
      a AS (SELECT session_id, log_id, row_number() OVER (PARTITION BY session_id, run ORDER BY created_at, log_id) AS attempt FROM r WHERE provider = 'error') SELECT *, CASE WHEN attempt >= 3 THEN 'skip' ELSE 'retry' END AS action FROM a""",
    "compiled_scripts": """WITH o AS (SELECT conv_id AS doc, turn AS step, CASE WHEN turn % 3 > 0 THEN left(text, 20) END AS title FROM conversations WHERE role = 'user'), f AS (SELECT conv_id AS doc, turn - 1 AS step, text AS content FROM conversations WHERE role = 'assistant')
      SELECT doc, string_agg('## ' || coalesce(title, 'Untitled') || chr(10) || coalesce(content, '[missing]'), chr(10) || chr(10) ORDER BY step) AS script, count(content) AS filled FROM o LEFT JOIN f USING (doc, step) GROUP BY 1""",
    "mediation": f"""WITH t(level, style, score) AS (VALUES {', '.join(f"('{a}', '{b}', {x}::DOUBLE)" for a, xs in K.STYLE_SCORES.items() for b, x in xs.items())}),
      r AS (SELECT doc_id AS id, doc_id % 5 AS n, CASE WHEN n_chars > 3000 THEN 'high' WHEN n_chars > 1000 THEN 'medium' WHEN n_chars > 100 THEN 'low' ELSE 'none' END AS c, {list(STYLES)}[doc_id % 6 + 1] AS a, {list(STYLES)}[(doc_id * 5 + 2) % 6 + 1] AS b FROM documents),
      v AS (SELECT r.*, coalesce(x.score, 0.5::DOUBLE) AS va, coalesce(y.score, 0.5::DOUBLE) AS vb FROM r LEFT JOIN t x ON x.level = CASE c WHEN 'none' THEN 'medium' ELSE c END AND x.style = a LEFT JOIN t y ON y.level = CASE c WHEN 'none' THEN 'medium' ELSE c END AND y.style = b),
      w AS (SELECT *, CASE WHEN n >= 3 THEN 'writer' WHEN va > vb THEN 'director' WHEN vb > va THEN 'writer' WHEN c = 'high' THEN 'director' ELSE 'writer' END AS winner FROM v) SELECT id, winner, CASE winner WHEN 'director' THEN a ELSE b END AS style FROM w""",
    "storage_ratio": "WITH x AS (SELECT n_chars, len(list_distinct(string_split(text, ''))) AS kept FROM documents) SELECT count(*) AS n, sum(n_chars)::BIGINT AS before, sum(kept)::BIGINT AS after, round(sum(kept) / sum(n_chars), 6) AS ratio FROM x",
    "sql_function": "SELECT doc_id AS id, lang AS language, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 500 AND contains(lower(text), 'with')",
    "decision_patterns": f"WITH {_LOGS} SELECT provider, tokens % 10 AS reason, count(*) AS n FROM logs GROUP BY ALL ORDER BY n DESC, provider, reason NULLS FIRST LIMIT 10",
    "documents_by_category": "SELECT source, lang AS language, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY ALL",
    "node_quality": f"WITH {_RICH} SELECT query_id, round(0.3::DOUBLE * least(count(*) / 5.0::DOUBLE, 1) + 0.7::DOUBLE * avg(similarity), 6) AS quality FROM h GROUP BY 1",
}
