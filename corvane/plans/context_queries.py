"""Queries of chunks and context, conversations, and table maintenance, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import budget as B
from corvane.operators import context as C
from corvane.operators import tables as M
from corvane.plans.search_queries import _LAB, _QUEST, _label_list, _vector_list
from corvane.operators.delta_log import DeltaLog
from corvane.sources import tables as T
from corvane.sources.shared import shared_path

AS_OF = "2024-01-25 00:00:00"


def _chunks(s, d):
    return C.line_chunks(T.corpus(s, d))


def _hits(s, d):
    """Chunks with a rare word, their share of tokens with it as similarity."""
    n = F.size(F.split("content", " "))
    rows = _chunks(s, d).filter(F.contains(F.lower("content"), F.lit("thth")))
    return rows.withColumn("similarity", F.round(1.0 / n, 6))


def _contents(s, d):
    return _hits(s, d).groupBy("parent_id").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def _sessions(s, d):
    rows = T.logs(s, d).groupBy("session_id")
    return rows.agg(F.min("created_at").alias("created_at"), F.max("created_at").alias("last_at"), F.count("*").alias("uses"))


def _usage_delta(s, d):
    logs = T.logs(s, d)
    half = lambda cond: logs.filter(cond).groupBy("session_id").agg(F.max("provider").alias("v"))
    return half("day(created_at) <= 10"), half("day(created_at) > 20")


def _chain(s, d):
    """Each session's last provider, an error ending the session, through a stored log with weekly snapshots."""
    log = DeltaLog(shared_path(s, "delta-log"), "session_id", "provider", "session_id bigint, provider string")
    log.append(T.logs(s, d).select("session_id", "provider", F.col("created_at").alias("at"), (F.col("provider") == "error").alias("removed")))
    return log.state_at(s, "2024-01-20 12:00:00").withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


QUERIES = {
    "line_chunks": lambda s, d: _chunks(s, d).select("chunk_id", "parent_id", "idx", "start_line", "end_line", F.length("content").cast("bigint").alias("chars")),
    "matching_parents": lambda s, d: C.matching_parents(_chunks(s, d), _hits(s, d), T.corpus(s, d)),
    "parent_statistics": lambda s, d: C.parent_statistics(_chunks(s, d)),
    "contiguous_islands": lambda s, d: C.islands(_hits(s, d)),
    "merge_strategy": lambda s, d: C.strategy(_hits(s, d)),
    "semantic_runs": lambda s, d: C.runs_of(_hits(s, d), F.when(F.contains("content", F.lit("with")), "with").when(F.contains("content", F.lit("that")), "that")),
    "merged_files": lambda s, d: C.merged_files(_hits(s, d)),
    "smart_truncate": lambda s, d: C.truncated(T.corpus(s, d), _contents(s, d)),
    "fixed_windows": lambda s, d: C.fixed_windows(_hits(s, d)),
    "context_budget": lambda s, d: C.within_budget(_hits(s, d), "parent_id", ["start_line", "chunk_id"], F.length("content"), 3000).select("chunk_id", "parent_id", F.col("used").cast("bigint").alias("used")),
    "context_assembly": lambda s, d: C.assembled(_hits(s, d), "parent_id", "start_line", F.concat(F.lit("## lines "), F.col("start_line").cast("string")), F.col("content")),
    "message_priority": lambda s, d: B.prioritized(T.messages(s, d)).select("conv_id", "turn", "role", "tokens", "priority"),
    "middle_removal": lambda s, d: B.middle_removal(T.messages(s, d), 120),
    "oldest_removal": lambda s, d: B.oldest_removal(T.messages(s, d), 100),
    "compression_need": lambda s, d: B.compression_need(T.messages(s, d), 300),
    "answer_pairs": lambda s, d: B.paired(T.messages(s, d), "user", "assistant"),
    "history_queries": lambda s, d: B.last_questions(T.messages(s, d)),
    "reference_targets": lambda s, d: B.references(T.messages(s, d), ("it", "this", "that")),
    "compressed_documents": lambda s, d: T.corpus(s, d).select("id", F.length(B.compressed_text(F.col("content"))).cast("bigint").alias("chars"), F.md5(B.compressed_text(F.col("content")).cast("binary")).alias("digest")),
    "token_estimates": lambda s, d: T.corpus(s, d).agg(F.sum(X.tokens_estimate(F.col("content"))).alias("tokens"), F.floor(F.sum(F.length("content")) / 4).cast("bigint").alias("together")),
    "upsert_latest": lambda s, d: M.latest(T.logs(s, d), ["session_id", "provider"], F.desc("created_at"), F.desc("log_id")).select("session_id", "provider", "log_id"),
    "upsert_table": lambda s, d: M.upsert(T.tenants(s, d), T.tenants(s, d).filter("tenant_id % 7 = 0").withColumn("plan", F.lit("TRIAL")), ["tenant_id"]),
    "delete_by_keys": lambda s, d: M.delete(T.tenants(s, d), T.usage(s, d).filter("used >= 49").select("tenant_id").distinct(), ["tenant_id"]),
    "replace_by_prefix": lambda s, d: M.replace_prefix(T.corpus(s, d).select("id", "file_path", "n_chars"), T.corpus(s, d).filter("source = 'src1'").select((F.col("id") + 1000000).alias("id"), "file_path", "n_chars"), "file_path", "src1/"),
    "ingest_decisions": lambda s, d: M.ingest(T.corpus(s, d).filter("id % 3 = 0"), T.corpus(s, d).filter("id % 3 <> 0")),
    "paged_documents": lambda s, d: M.page(T.corpus(s, d).select("id", "n_chars"), 2, 25, F.desc("n_chars"), F.col("id")),
    "json_updates": lambda s, d: M.update_from_json(T.tenants(s, d).select(F.col("tenant_id").alias("id"), "plan"), s.createDataFrame([('[{"id": 1, "value": "A"}, {"id": 5, "value": "B"}, {"id": -1, "value": "C"}]',)], "body string"), "plan", "string"),
    "reconciliation": lambda s, d: M.reconcile(T.corpus(s, d).select("id", F.ceil(F.size(F.split("content", "\n")) / 4).alias("expected")), _chunks(s, d).filter("parent_id % 10 <> 0 and not (parent_id % 7 = 0 and idx = 0)").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("actual"))),
    "unused_documents": lambda s, d: M.unused(T.corpus(s, d), T.vectors(s, d).filter("label < 5"), ["id"], F.col("n_chars") > 1500).select("id", "n_chars"),
    "session_cleanup": lambda s, d: M.cleanup(_sessions(s, d), AS_OF, 100, 30, 2, 60),
    "retention": lambda s, d: T.logs(s, d).withColumn("expired", F.col("created_at") < F.to_timestamp(F.lit(AS_OF)) - F.expr("INTERVAL '15' DAY")).groupBy("provider", "expired").agg(F.count("*").alias("n")),
    "state_diff": lambda s, d: M.diff(*_usage_delta(s, d), "session_id", "v"),
    "state_chain": _chain,
    "state_as_of": lambda s, d: M.as_of(T.logs(s, d).withColumn("o", F.struct("created_at", "log_id")), "session_id", "provider", "o", F.col("created_at") < F.to_timestamp(F.lit("2024-01-15 00:00:00"))),
    "state_append": lambda s, d: M.appended(T.logs(s, d).filter("provider = 'error'"), "session_id", "log_id", "log_id"),
    "stack_depth": lambda s, d: M.stack_depth(T.logs(s, d), "session_id", ["created_at", "log_id"], F.col("provider") == "view", F.col("provider") == "click"),
    "traffic_split": lambda s, d: T.corpus(s, d).select("id", M.same_bucket(F.col("id").cast("string"), 30, ["5", "7"]).alias("chosen")),
    "result_comparison": lambda s, d: M.compare_results(_vector_list(s, d), _label_list(s, d)),
    "union_distinct": lambda s, d: T.messages(s, d).select(F.md5(F.col("content").cast("binary")).alias("digest")).union(T.corpus(s, d).select(F.md5(F.col("content").cast("binary")))).distinct(),
    "token_jaccard": lambda s, d: M.alike(T.questions(s, d).select(F.col("query_id").alias("id"), X.keywords(F.col("query")).alias("tokens"))),
}

_CH = r"""ch AS (SELECT doc_id || '_' || left(md5(content), 8) || '_' || idx AS chunk_id, doc_id AS parent_id, idx, start_line, end_line, content FROM
  (SELECT doc_id, k // 4 AS idx, min(k) + 1 AS start_line, max(k) + 1 AS end_line, string_agg(line, chr(10) ORDER BY k) AS content
   FROM (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS k, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) GROUP BY doc_id, k // 4))"""
_HIT = f"{_CH}, h AS (SELECT *, round(1.0::DOUBLE / len(string_split(content, ' ')), 6) AS similarity FROM ch WHERE contains(lower(content), 'thth'))"
_W = "OVER (PARTITION BY parent_id ORDER BY start_line, chunk_id"
_MSG = """m AS (SELECT conv_id, turn, role, text AS content, length(text) // 4 AS tokens, CASE WHEN role = 'system' THEN 0 WHEN role = 'tool' THEN 1
  WHEN row_number() OVER w <= 3 OR row_number() OVER w > count(*) OVER (PARTITION BY conv_id) - 3 THEN 1 WHEN length(text) > 800 THEN 1 WHEN length(text) < 20 AND NOT contains(text, '?') THEN 3 ELSE 2 END AS priority
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
_LOGS = "logs AS (SELECT event_id AS log_id, ts AS created_at, user_id AS session_id, event_type AS provider FROM events)"
_CT = r"left(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT (starts_with(trim(s), '#') AND length(trim(s)) < 10)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), 2000)"
_KW = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= {}))"

SQL = {
    "line_chunks": f"WITH {_CH} SELECT chunk_id, parent_id, idx, start_line, end_line, length(content) AS chars FROM ch",
    "matching_parents": f"WITH {_HIT} SELECT doc_id AS id, n_chars FROM documents WHERE doc_id IN (SELECT parent_id FROM h) ORDER BY n_chars DESC, doc_id LIMIT 5",
    "parent_statistics": f"WITH {_CH}, p AS (SELECT parent_id, count(*) AS n, sum(length(content)) AS chars FROM ch GROUP BY 1) SELECT count(*) AS parents, sum(n)::BIGINT AS children, round(avg(n), 6) AS mean_children, max(n) AS most, sum(chars)::BIGINT AS chars FROM p",
    "contiguous_islands": f"""WITH {_HIT}, r AS (SELECT *, CASE WHEN start_line - max(end_line) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 3 THEN 0 ELSE 1 END AS new FROM h),
      i AS (SELECT *, sum(new) {_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM r) SELECT parent_id, island, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS n, max(similarity) AS similarity FROM i GROUP BY 1, 2""",
    "merge_strategy": f"""WITH {_HIT}, g AS (SELECT parent_id, start_line - lag(start_line) {_W}) AS gap FROM h), a AS (SELECT parent_id, count(*) AS n, max(gap) AS widest FROM g GROUP BY 1)
      SELECT *, CASE WHEN n < 2 OR widest <= 3 THEN 'contiguous' WHEN n >= 3 THEN 'semantic' ELSE 'file' END AS strategy FROM a""",
    "semantic_runs": f"""WITH {_HIT}, l AS (SELECT *, last_value(CASE WHEN contains(content, 'with') THEN 'with' WHEN contains(content, 'that') THEN 'that' END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS label FROM h),
      c AS (SELECT *, CASE WHEN row_number() {_W}) > 1 AND label IS NOT DISTINCT FROM lag(label) {_W}) THEN 0 WHEN row_number() {_W}) = 1 AND label IS NULL THEN 0 ELSE 1 END AS new FROM l), r AS (SELECT *, sum(new) {_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c)
      SELECT parent_id, run, any_value(label) AS label, count(*) AS n FROM r GROUP BY 1, 2""",
    "merged_files": f"WITH {_HIT} SELECT parent_id, min(start_line) AS start_line, max(end_line) AS end_line, max(similarity) AS similarity, string_agg(chunk_id, ',' ORDER BY start_line, chunk_id) AS chunk_ids FROM h GROUP BY 1",
    "smart_truncate": f"""WITH {_HIT}, s AS (SELECT parent_id, min(start_line) AS start_line, max(end_line) AS end_line FROM h GROUP BY 1), l AS (SELECT doc_id, generate_subscripts(lines, 1) AS k, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)),
      n AS (SELECT parent_id, start_line, sum(length(line) + 1) OVER (PARTITION BY parent_id, start_line ORDER BY k ROWS UNBOUNDED PRECEDING) AS chars FROM l JOIN s ON doc_id = parent_id AND k BETWEEN start_line - 5 AND end_line + 10)
      SELECT parent_id, start_line, count(*) AS n_lines, max(chars)::BIGINT AS n_chars FROM n WHERE chars <= 2000 GROUP BY 1, 2""",
    "fixed_windows": f"WITH {_HIT} SELECT chunk_id, left(content, 200) AS window FROM h QUALIFY row_number() OVER (PARTITION BY md5(content) ORDER BY similarity DESC, chunk_id) = 1",
    "context_budget": f"WITH {_HIT} SELECT chunk_id, parent_id, sum(length(content)) {_W} ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM h QUALIFY used <= 3000",
    "context_assembly": f"WITH {_HIT} SELECT parent_id, string_agg('## lines ' || start_line || chr(10) || content, chr(10) || chr(10) ORDER BY start_line) AS context FROM h GROUP BY 1",
    "message_priority": f"WITH {_MSG} SELECT conv_id, turn, role, tokens, priority FROM m",
    "middle_removal": f"""WITH {_MSG}, x AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - 120 AS excess, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY CASE WHEN priority >= 2 THEN 0 ELSE 1 END, priority DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM m)
      SELECT conv_id, turn, role, tokens, priority FROM x WHERE NOT (priority >= 2 AND gone < excess)""",
    "oldest_removal": f"""WITH {_MSG}, x AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - 100 AS excess, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, row_number() OVER w AS k
        FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY CASE WHEN priority > 0 THEN 0 ELSE 1 END, priority DESC, turn)) SELECT conv_id, turn, role, tokens, priority FROM x WHERE NOT (priority > 0 AND gone < excess AND k <= n - 2)""",
    "compression_need": """WITH a AS (SELECT conv_id, count(*) AS messages, sum(length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY 1) SELECT *, round(tokens / 300.0::DOUBLE, 6) AS utilisation, round(tokens / 300.0::DOUBLE, 6) >= 0.8 AS compress,
      CASE WHEN round(tokens / 300.0::DOUBLE, 6) >= 0.95 THEN 'critical' WHEN round(tokens / 300.0::DOUBLE, 6) >= 0.8 THEN 'warning' ELSE 'ok' END AS status FROM a""",
    "answer_pairs": "SELECT u.conv_id, u.turn, (SELECT min(a.turn) FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn AND a.turn <= u.turn + 9) AS answer FROM conversations u WHERE role = 'user'",
    "history_queries": "SELECT conv_id, turn, concat_ws(' | ', lag(text, 2) OVER w, lag(text, 1) OVER w, text) AS query FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "reference_targets": f"""WITH l AS (SELECT conv_id, turn, {_KW.format('text', 4)} AS w, length(text) AS n FROM conversations WHERE contains(' ' || lower(text) || ' ', ' it ') OR contains(' ' || lower(text) || ' ', ' this ') OR contains(' ' || lower(text) || ' ', ' that ')),
      e AS (SELECT conv_id, turn AS target, {_KW.format('text', 4)} AS v, length(text) AS m FROM conversations)
      SELECT conv_id, turn, target, round(0.5::DOUBLE * coalesce(len(list_intersect(w, v))::DOUBLE / nullif(len(w), 0), 0) + 0.2::DOUBLE * coalesce(least(n, m)::DOUBLE / nullif(greatest(n, m), 0), 0), 6) AS score
      FROM l JOIN e USING (conv_id) WHERE target < turn QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, target DESC) <= 5""",
    "compressed_documents": f"SELECT doc_id AS id, length({_CT}) AS chars, md5({_CT}) AS digest FROM documents",
    "token_estimates": "SELECT sum(length(text) // 4)::BIGINT AS tokens, (sum(length(text)) // 4)::BIGINT AS together FROM documents",
    "upsert_latest": f"WITH {_LOGS} SELECT session_id, provider, log_id FROM logs QUALIFY row_number() OVER (PARTITION BY session_id, provider ORDER BY created_at DESC, log_id DESC) = 1",
    "upsert_table": "SELECT c_custkey AS tenant_id, c_name AS name, CASE WHEN c_custkey % 7 = 0 THEN 'TRIAL' ELSE c_mktsegment END AS plan, c_nationkey AS nation FROM customer",
    "delete_by_keys": "SELECT c_custkey AS tenant_id, c_name AS name, c_mktsegment AS plan, c_nationkey AS nation FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 49)",
    "replace_by_prefix": "SELECT CASE WHEN source = 'src1' THEN doc_id + 1000000 ELSE doc_id END AS id, source || '/' || doc_id AS file_path, n_chars FROM documents",
    "ingest_decisions": """WITH n AS (SELECT doc_id AS id, sha256(text) AS hash FROM documents WHERE doc_id % 3 <> 0)
      SELECT id, hash, CASE WHEN hash IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) OR id <> min(id) OVER (PARTITION BY hash) THEN 'skip' ELSE 'index' END AS action FROM n""",
    "paged_documents": "SELECT doc_id AS id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50",
    "json_updates": "SELECT c_custkey AS id, CASE c_custkey WHEN 1 THEN 'A' WHEN 5 THEN 'B' ELSE c_mktsegment END AS plan, c_custkey IN (1, 5) AS updated FROM customer",
    "reconciliation": """WITH f AS (SELECT doc_id AS id, ceil(len(string_split(text, chr(10))) / 4.0)::BIGINT AS expected FROM documents), a AS (SELECT *, CASE WHEN id % 10 = 0 THEN 0 WHEN id % 7 = 0 THEN expected - 1 ELSE expected END AS actual FROM f)
      SELECT *, CASE WHEN actual = 0 THEN 'missing' WHEN actual <> expected THEN 'orphaned' ELSE 'ok' END AS state FROM a""",
    "unused_documents": "SELECT doc_id AS id, n_chars FROM documents WHERE n_chars > 1500 AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5)",
    "session_cleanup": f"""WITH {_LOGS}, s AS (SELECT session_id, min(created_at) AS c, max(created_at) AS l, count(*) AS uses FROM logs GROUP BY 1),
      r AS (SELECT session_id, l, CASE WHEN date_diff('day', c::DATE, DATE '2024-01-25') > 30 THEN 'old' WHEN uses < 60 AND date_diff('day', l::DATE, DATE '2024-01-25') > 2 THEN 'idle' END AS reason FROM s),
      x AS (SELECT session_id, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason ORDER BY l DESC, session_id) > 100 THEN 'surplus' ELSE reason END AS reason FROM r) SELECT * FROM x WHERE reason IS NOT NULL""",
    "retention": f"WITH {_LOGS} SELECT provider, created_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY AS expired, count(*) AS n FROM logs GROUP BY ALL",
    "state_diff": f"""WITH {_LOGS}, a AS (SELECT session_id, max(provider) AS old FROM logs WHERE day(created_at) <= 10 GROUP BY 1), b AS (SELECT session_id, max(provider) AS new FROM logs WHERE day(created_at) > 20 GROUP BY 1)
      SELECT coalesce(a.session_id, b.session_id) AS session_id, CASE WHEN a.session_id IS NULL THEN 'added' WHEN b.session_id IS NULL THEN 'removed' WHEN old IS DISTINCT FROM new THEN 'changed' ELSE 'unchanged' END AS state, old, new FROM a FULL JOIN b ON a.session_id = b.session_id""",
    "state_chain": """WITH l AS (SELECT user_id AS session_id, arg_max(event_type, (ts, event_type <> 'error', event_type)) AS provider, max(ts) AS last_at FROM events WHERE ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1)
      SELECT session_id, provider, strftime(last_at, '%Y-%m-%d %H:%M:%S.%f') AS "at" FROM l WHERE provider <> 'error'""",
    "state_as_of": f"WITH {_LOGS} SELECT session_id, arg_max(provider, (created_at, log_id)) AS provider, count(*) AS changes FROM logs WHERE created_at < TIMESTAMP '2024-01-15' GROUP BY 1",
    "state_append": f"""WITH {_LOGS} SELECT session_id, string_agg(log_id::VARCHAR, ',' ORDER BY log_id) AS "values" FROM logs WHERE provider = 'error' GROUP BY 1""",
    "stack_depth": f"""WITH {_LOGS}, x AS (SELECT *, sum(CASE provider WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, log_id ROWS UNBOUNDED PRECEDING)::BIGINT AS d FROM logs)
      SELECT session_id, count(*) AS moves, arg_max(d, (created_at, log_id)) AS "end", max(d) AS highest FROM x GROUP BY 1""",
    "traffic_split": "SELECT doc_id AS id, doc_id IN (5, 7) OR ('0x' || left(md5(doc_id::VARCHAR), 8))::BIGINT % 100 < 30 AS chosen FROM documents",
    "result_comparison": f"""WITH {_LAB} SELECT coalesce(v.query_id, l.query_id) AS query_id, round(count(*) FILTER (v.id IS NOT NULL AND l.id IS NOT NULL)::DOUBLE / count(*), 6) AS overlap,
      round(avg(abs(v.similarity - l.similarity)), 6) AS difference FROM v FULL JOIN l ON v.query_id = l.query_id AND v.id = l.id GROUP BY 1""",
    "union_distinct": "SELECT md5(text) AS digest FROM conversations UNION SELECT md5(text) FROM documents",
    "token_jaccard": f"""WITH {_QUEST}, k AS (SELECT query_id, {_KW.format('query', 3)} AS w FROM asked), j AS (SELECT a.query_id AS a, b.query_id AS b, round(coalesce(len(list_intersect(a.w, b.w))::DOUBLE / nullif(len(list_distinct(a.w || b.w)), 0), 0), 6) AS jaccard FROM k a JOIN k b ON a.query_id < b.query_id)
      SELECT * FROM j WHERE jaccard > 0""",
}
