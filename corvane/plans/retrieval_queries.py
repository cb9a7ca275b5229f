"""Queries of whole retrievals, message compression and document graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import budget as B
from corvane.operators import fusion
from corvane.operators import graph as G
from corvane.operators import graph_walks as W
from corvane.operators import retrieval as R
from corvane.plans import context_queries
from corvane.plans.chunk_queries import _CODE, _code
from corvane.plans.graph_queries import _LINKS, _PARTNERS, _links, _partners, _rank_sql, _two_hosts
from corvane.plans.search_queries import _CAND, _NEAR, _RICH, _TRI, AS_OF, TEMPLATES, _asked, _candidates, _rich
from corvane.sources import tables as T

WEIGHTS = {"bm25": 0.5, "trigram": 0.2, "vector": 0.3}
BOOSTS = {"has_license": 1.5, "has_mention": 1.3}


def _flags(s, d):
    return T.corpus(s, d).select("id", X.has_any(F.col("content"), ["license"]).alias("has_license"), F.contains("content", F.lit("@")).alias("has_mention"))


def _question_vectors(s, d):
    """The vector of a question's id, as its own."""
    return T.questions(s, d).select("query_id").join(T.vectors(s, d).select(F.col("id").alias("query_id"), "embedding"), "query_id")


def _kept(s, d):
    return B.middle_removal(T.messages(s, d), 120).select("conv_id", "turn")


def _entities(s, d):
    return G.entities(T.corpus(s, d).select("id", "content").unionByName(_code(s, d).select((-F.col("id")).alias("id"), "content")))


QUERIES = {
    "base_search": lambda s, d: R.base_search(T.corpus(s, d), ["src1", "the", "en"]),
    "flagged_vector_search": lambda s, d: R.flagged_vector_search(T.vectors(s, d), _asked(s, d), _flags(s, d), BOOSTS, 10, 0.1),
    "vector_with_trigrams": lambda s, d: R.vector_with_trigrams(T.vectors(s, d), T.questions(s, d).join(_question_vectors(s, d), "query_id"), T.corpus(s, d), 10, 0.15, 0.15),
    "pipeline_statistics": lambda s, d: R.pipeline_statistics(fusion.reciprocal(_candidates(s, d), scaled=True), 10),
    "full_retrieval": lambda s, d: R.hybrid(T.corpus(s, d), T.questions(s, d), T.vectors(s, d), _question_vectors(s, d), TEMPLATES, WEIGHTS, AS_OF),
    "advanced_retrieval": lambda s, d: R.advanced(
        T.corpus(s, d), T.questions(s, d), T.vectors(s, d), _question_vectors(s, d), TEMPLATES, WEIGHTS, T.corpus(s, d).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target")), AS_OF
    ),
    "smart_search": lambda s, d: R.smart_search(_rich(s, d), T.questions(s, d).select("query_id"), F.col("query_id") % 10, 7, 0.0002),
    "broken_pairs": lambda s, d: B.broken_pairs(T.messages(s, d), _kept(s, d), "user", "assistant"),
    "protected_messages": lambda s, d: B.protected(T.messages(s, d), "user", "assistant"),
    "compression_safety": lambda s, d: B.compression_safety(T.messages(s, d), _kept(s, d), "user", "assistant", ("it", "this", "that")),
    "safe_removals": lambda s, d: B.safe_removals(T.messages(s, d), _kept(s, d), "system", "assistant", ("it", "this", "that")),
    "compression_report": lambda s, d: B.compression_report(T.messages(s, d), _kept(s, d), 300, 0.5),
    "entity_extract": lambda s, d: _entities(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names")),
    "entity_calls": lambda s, d: G.calls(_code(s, d)),
    "document_graph": lambda s, d: G.document_graph(_entities(s, d))[1],
    "graph_nodes": lambda s, d: G.nodes_like(G.document_graph(_entities(s, d))[0], "document"),
    "related_documents": lambda s, d: G.related_documents(_partners(s, d), "NATION_3", G.pagerank(_partners(s, d), s.createDataFrame([("NATION_3",)], "node string"), tolerance=1e-8, digits=5)),
    "steps_between": lambda s, d: G.steps_between(W.undirected(_links(s, d)), *_two_hosts(s, d)),
    "document_lookup": lambda s, d: T.corpus(s, d).filter("id in (3, 17, 99999999)").select("id", "file_path", "n_chars"),
    "retrieval_statistics": lambda s, d: T.logs(s, d).groupBy("provider").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 2).alias("duration"), F.round(F.avg(F.col("tokens") / 100), 6).alias("similarity")),
    "skill_statistics": lambda s, d: T.logs(s, d).groupBy("provider").agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"), F.round(F.avg("tokens"), 6).alias("mean")).orderBy(F.desc("n"), "provider").limit(5),
    "quality_over_window": lambda s, d: T.logs(s, d).filter("created_at > timestamp '2024-01-20 00:00:00' - interval 5 days and created_at <= timestamp '2024-01-20 00:00:00'").groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg("duration"), 6).alias("mean"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.round(F.count_distinct("provider") / F.count("*"), 6).alias("diversity")
    ),
}

_MSG = """m0 AS (SELECT conv_id, turn, role, text, length(text) // 4 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
m AS (SELECT *, CASE WHEN role = 'system' THEN 0 WHEN role = 'tool' THEN 1 WHEN place <= 3 OR place > n - 3 THEN 1 WHEN length(text) > 800 THEN 1 WHEN length(text) < 20 AND NOT contains(text, '?') THEN 3 ELSE 2 END AS priority FROM m0),
g AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id) - 120 AS excess, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY CASE WHEN priority >= 2 THEN 0 ELSE 1 END, priority DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM m),
kept AS (SELECT conv_id, turn FROM g WHERE NOT (priority >= 2 AND gone < excess)),
pr AS (SELECT a.conv_id, a.turn, min(b.turn) AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'assistant' AND b.turn BETWEEN a.turn + 1 AND a.turn + 9 WHERE a.role = 'user' GROUP BY ALL)"""
_ENT = _CODE + r""", d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -id, content FROM code), x AS (SELECT doc_id, 'section' AS kind, unnest(list_distinct(regexp_extract_all(text, '(?m)^#{1,6} +([^\r\n]+)', 1))) AS name FROM d
  UNION ALL SELECT doc_id, 'function', unnest(list_distinct(regexp_extract_all(text, '(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)', 1))) FROM d
  UNION ALL SELECT doc_id, 'class', unnest(list_distinct(regexp_extract_all(text, '(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)', 1))) FROM d
  UNION ALL SELECT doc_id, 'import', unnest(list_distinct(regexp_extract_all(text, '(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)', 1))) FROM d
  UNION ALL SELECT doc_id, 'link', unnest(list_distinct(regexp_extract_all(text, '\[[^\]]*\]\(([^)\s]+)\)', 1))) FROM d)"""
_LOW = "lower(text)"
_WORD = " + ".join(
    f"CASE WHEN contains(lower(source || '/' || doc_id), '{w}') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains({_LOW}, '{w}') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(source), '{w}') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(lang), '{w}') THEN 1.5::DOUBLE ELSE 0 END"
    for w in ("src1", "the", "en")
)
_PPR = _rank_sql(_PARTNERS, "CASE WHEN node = 'NATION_3' THEN 1.0::DOUBLE ELSE 0 END", 100)

SQL = {
    "base_search": f"SELECT * FROM (SELECT doc_id AS id, round({_WORD}, 6) + CASE WHEN contains({_LOW}, 'src1') OR contains({_LOW}, 'the') OR contains({_LOW}, 'en') THEN 0.5::DOUBLE ELSE 0 END AS score FROM documents) WHERE score > 0.5",
    "flagged_vector_search": f"""WITH {_NEAR}, f AS (SELECT p.*, contains(lower(text), 'license') AS a, contains(text, '@') AS b FROM p JOIN documents ON doc_id = id WHERE similarity >= 0.1),
      g AS (SELECT query_id, id, similarity, a::INT + b::INT AS matches, CASE WHEN a THEN 1.5::DOUBLE WHEN b THEN 1.3::DOUBLE ELSE 1 END AS boost FROM f),
      s AS (SELECT *, round((similarity * 0.6::DOUBLE + least(matches / 4.0::DOUBLE, 1) * 0.4::DOUBLE) * boost, 6) AS score FROM g) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10""",
    "vector_with_trigrams": f"""WITH q AS (SELECT item_id AS query_id, text AS query, embedding AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
      p AS (SELECT query_id, query, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity FROM q, embeddings),
      t AS (SELECT query_id, id, similarity, {_TRI.format('query')} AS qg, {_TRI.format('text')} AS cg FROM p JOIN documents ON doc_id = id WHERE similarity >= 0.15),
      k AS (SELECT query_id, id, similarity, round(len(list_intersect(qg, cg))::DOUBLE / (len(qg) + len(cg) - len(list_intersect(qg, cg))), 6) AS keyword FROM t),
      s AS (SELECT *, round(similarity * 0.7::DOUBLE + keyword * 0.3::DOUBLE, 6) AS score FROM k) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0.15 QUALIFY rank <= 10""",
    "pipeline_statistics": f"""WITH {_CAND}, s AS (SELECT query_id, id, round(sum(60.0::DOUBLE / (rank + 60)), 8) AS score FROM c GROUP BY ALL), r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)
      SELECT query_id, count(*) AS n, round(avg(score), 8) AS mean, max(score) AS best FROM r GROUP BY 1""",
    "smart_search": rf"""WITH {_RICH}, t AS (SELECT query_id, count(*) AS n, sum(length(left(regexp_replace(array_to_string(list_filter(string_split(content, chr(10)), lambda s: NOT (starts_with(trim(s, ' '), '#') AND length(trim(s, ' ')) < 10)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), 2000)) // 4) AS tokens FROM h GROUP BY 1),
      r AS (SELECT item_id AS query_id, item_id % 10 < 7 AS allowed, CASE WHEN item_id % 10 < 7 THEN coalesce(n, 0) ELSE 0 END AS n, CASE WHEN item_id % 10 < 7 THEN coalesce(tokens, 0) ELSE 0 END::BIGINT AS tokens FROM benchmark LEFT JOIN t ON query_id = item_id)
      SELECT *, round(tokens * 0.0002::DOUBLE, 6) AS cost FROM r""",
    "broken_pairs": f"""WITH {_MSG}, j AS (SELECT pr.*, (conv_id, turn) IN (SELECT (conv_id, turn) FROM kept) AS a, (conv_id, answer) IN (SELECT (conv_id, turn) FROM kept) AS b FROM pr)
      SELECT conv_id, turn, answer, CASE WHEN NOT a AND b THEN 'question removed' WHEN a AND NOT b THEN 'answer removed' ELSE 'pair removed' END AS problem FROM j WHERE NOT (a AND b)""",
    "protected_messages": f"WITH {_MSG} SELECT conv_id, turn FROM pr UNION SELECT conv_id, answer FROM pr",
    "safe_removals": f"""WITH {_MSG}, rf AS ({context_queries.SQL["reference_targets"]}), sp AS (SELECT a.conv_id, a.turn, min(b.turn) AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.role = 'assistant' AND b.turn BETWEEN a.turn + 1 AND a.turn + 9 WHERE a.role = 'system' GROUP BY ALL)
      SELECT conv_id, turn FROM conversations EXCEPT SELECT conv_id, turn FROM kept EXCEPT SELECT conv_id, target FROM rf EXCEPT SELECT conv_id, turn FROM sp EXCEPT SELECT conv_id, answer FROM sp""",
    "compression_safety": f"""WITH {_MSG}, rf AS ({context_queries.SQL["reference_targets"]}), j AS (SELECT pr.*, (conv_id, turn) IN (SELECT (conv_id, turn) FROM kept) AS a, (conv_id, answer) IN (SELECT (conv_id, turn) FROM kept) AS b FROM pr),
      p AS (SELECT conv_id, count(*) AS pairs, count(*) FILTER (a <> b) AS broken, count(*) FILTER (NOT a AND NOT b) AS removed FROM j GROUP BY 1),
      k AS (SELECT conv_id, count(DISTINCT turn) AS at_risk FROM rf WHERE (conv_id, target) NOT IN (SELECT (conv_id, turn) FROM kept) GROUP BY 1)
      SELECT conv_id, coalesce(pairs, 0) AS pairs, coalesce(broken, 0) AS broken, coalesce(removed, 0) AS removed, coalesce(at_risk, 0) AS at_risk, coalesce(broken, 0) = 0 AS safe
      FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id) LEFT JOIN k USING (conv_id)""",
    "compression_report": f"""WITH {_MSG}, w AS (SELECT *, round(sum(tokens) OVER (PARTITION BY conv_id) / 300.0::DOUBLE, 6) >= 0.5 AS compress, (conv_id, turn) IN (SELECT (conv_id, turn) FROM kept) AS kp FROM m), s AS (SELECT *, NOT compress OR kp AS stays FROM w)
      SELECT conv_id, count(*) AS before, count(*) FILTER (stays) AS after, sum(tokens)::BIGINT AS tokens_before, coalesce(sum(tokens) FILTER (stays), 0)::BIGINT AS tokens_after,
        round(coalesce(coalesce(sum(tokens) FILTER (stays), 0)::DOUBLE / nullif(sum(tokens), 0), 1), 6) AS ratio, bool_and(stays OR role <> 'system') AND arg_max(stays, turn) AS safe FROM s GROUP BY 1""",
    "entity_extract": f"WITH {_ENT} SELECT kind, count(*) AS n, count(DISTINCT name) AS names FROM x GROUP BY 1",
    "entity_calls": rf"""WITH {_CODE} SELECT id, 'doc:' || id AS caller, unnest(list_distinct(list_intersect(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)', 1),
      regexp_extract_all(regexp_replace(content, 'def [A-Za-z_0-9]*', '', 'g'), '([A-Za-z_][A-Za-z0-9_]*)\s*\(', 1)))) AS callee FROM code""",
    "document_graph": f"WITH {_ENT} SELECT DISTINCT 'doc:' || doc_id AS source, left(md5(kind || ':' || doc_id || ':' || name), 16) AS target, 'contains' AS relation, 0.6::DOUBLE AS strength FROM x",
    "graph_nodes": f"WITH {_ENT} SELECT DISTINCT 'doc:' || doc_id AS node_id, 'document' AS kind, doc_id::VARCHAR AS name FROM x",
    "related_documents": f"""WITH rk AS ({_PPR}), {_PARTNERS}, dn AS (SELECT CASE WHEN source = 'NATION_3' THEN target ELSE source END AS node, round(sum(strength), 6) AS strength FROM e WHERE source = 'NATION_3' OR target = 'NATION_3' GROUP BY 1)
      SELECT node, 'direct' AS how, strength FROM dn UNION ALL SELECT node, 'indirect', round(rank, 5) FROM rk WHERE round(rank, 5) > 0 AND node <> 'NATION_3' AND node NOT IN (SELECT node FROM dn)""",
    "steps_between": f"""WITH RECURSIVE {_LINKS}, u AS (SELECT source, target FROM e UNION SELECT target, source FROM e), z AS (SELECT min(source) AS a, max(source) AS b FROM e),
      w(node, depth) AS (SELECT a, 0 FROM z UNION SELECT u.target, depth + 1 FROM w JOIN u ON node = u.source WHERE depth < 16) SELECT min(depth) AS depth FROM w, z WHERE node = b HAVING min(depth) IS NOT NULL""",
    "document_lookup": "SELECT doc_id AS id, source || '/' || doc_id AS file_path, n_chars FROM documents WHERE doc_id IN (3, 17, 99999999)",
    "retrieval_statistics": "SELECT event_type AS provider, count(*) AS n, round(avg(value), 2) AS duration, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0::DOUBLE), 6) AS similarity FROM events GROUP BY 1",
    "skill_statistics": "SELECT event_type AS provider, count(*) AS n, count(DISTINCT user_id) AS sessions, round(avg(CAST(json_extract_string(props, '$.k') AS BIGINT)), 6) AS mean FROM events GROUP BY 1 ORDER BY n DESC, provider LIMIT 5",
    "quality_over_window": """SELECT ts::DATE AS day, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(count(DISTINCT event_type)::DOUBLE / count(*), 6) AS diversity FROM events
      WHERE ts > TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1""",
}
