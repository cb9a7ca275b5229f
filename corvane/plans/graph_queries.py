"""Queries over graphs, with their SQL: links of pages, trade between nations, and each nation's main partners."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators import graph_walks as W
from corvane.sources import tables as T

#: Skills and the ones that each may be followed by (fixed values).
SKILLS = {
    "standard_tutorial": ("visualization_analogy", "warning_mode", "research_mode", "fallback_summary"),
    "warning_mode": ("standard_tutorial", "research_mode", "fallback_summary"),
    "visualization_analogy": ("standard_tutorial", "meme_style", "research_mode"),
    "research_mode": ("standard_tutorial", "warning_mode", "visualization_analogy", "fallback_summary"),
    "meme_style": ("visualization_analogy", "fallback_summary", "standard_tutorial"),
    "fallback_summary": ("standard_tutorial", "research_mode", "warning_mode", "meme_style"),
    "code_example": ("standard_tutorial", "visualization_analogy", "api_documentation"),
    "api_documentation": ("standard_tutorial", "code_example", "warning_mode"),
    "security_audit": ("warning_mode", "api_documentation", "standard_tutorial"),
}


def _links(s, d):
    return G.links(T.table(s, d, "pages"))


def _trade(s, d):
    """(source, target, relation, strength): from suppliers' to customers' nations, by ten thousandths of the lines."""
    lines, orders, customers, suppliers, nations = (T.table(s, d, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy("s_nationkey", "c_nationkey").agg((F.count("*") / 10000.0).alias("strength"))
    a, b = nations.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("source")), nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("target"))
    return rows.join(a, "s_nationkey").join(b, "c_nationkey").select("source", "target", F.lit("ships").alias("relation"), "strength")


def _partners(s, d):
    """The three strongest edges from each nation."""
    line = Window.partitionBy("source").orderBy(F.desc("strength"), "target")
    return _trade(s, d).withColumn("_at", F.row_number().over(line)).filter("_at <= 3").drop("_at")


def _two_hosts(s, d):
    """First and last host in order."""
    return _links(s, d).agg(F.min("source"), F.max("source")).first()


def _returned(s, d, returned):
    """The trade edges of lines that were, or weren't, returned."""
    rows = T.table(s, d, "lineitem").filter(F.col("l_returnflag").isin("R") == returned)
    orders, customers, suppliers = (T.table(s, d, t) for t in ("orders", "customer", "supplier"))
    rows = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy(F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")).agg((F.count("*") / 1000.0).alias("strength"))
    return rows.select("source", "target", F.lit("ships").alias("relation"), "strength")


def _skills(s, d):
    rows = [(a, b) for a, bs in SKILLS.items() for b in bs]
    return s.createDataFrame(rows, "source string, target string").select("source", "target", F.lit("compatible").alias("relation"), F.lit(0.5).alias("strength"))


def _nodes(s, *names):
    return s.createDataFrame([(n,) for n in names], "node string")


def _tree(s, d):
    nations, regions = T.table(s, d, "nation"), T.table(s, d, "region")
    return nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("task"), F.col("r_name").alias("needs"))


QUERIES = {
    "page_links": _links,
    "graph_neighbours": lambda s, d: G.neighbours(_trade(s, d), "NATION_3").withColumn("strength", F.round("strength", 6)),
    "graph_degrees": lambda s, d: G.degrees(_links(s, d)),
    "graph_relation_counts": lambda s, d: G.relation_counts(_links(s, d)),
    "graph_reach": lambda s, d: G.reach(_links(s, d), _links(s, d).agg(F.min("source").alias("node")), 3, directed=False),
    "graph_reach_directed": lambda s, d: G.reach(_partners(s, d), _nodes(s, "NATION_3"), None),
    "graph_simple_paths": lambda s, d: G.simple_paths(_partners(s, d), "NATION_5", 3),
    "graph_shortest_paths": lambda s, d: W.shortest_paths(W.undirected(_links(s, d)), *_two_hosts(s, d)),
    "graph_components": lambda s, d: G.components(_links(s, d)),
    "graph_pagerank": lambda s, d: G.pagerank(_trade(s, d), tolerance=1e-8, digits=6),
    "graph_personal_pagerank": lambda s, d: G.pagerank(_partners(s, d), _nodes(s, "NATION_3", "NATION_8"), tolerance=1e-8, digits=6),
    "graph_multi_hop": lambda s, d: G.multi_hop(_partners(s, d), _nodes(s, "NATION_5"), 3, 2),
    "graph_walk_ranks": lambda s, d: W.walk_ranks(W.undirected(_links(s, d)), _links(s, d).select(F.col("source").alias("walk"), F.col("source").alias("node")), bound=1e-5).select("walk", "node", F.round("rank", 3).alias("rank")),
    "graph_walk_hops": lambda s, d: W.hops(W.undirected(_links(s, d)), _links(s, d).select(F.col("source").alias("query_id"), F.col("source").alias("node")).distinct(), 2, 5, bound=1e-4, digits=3),
    "graph_related": lambda s, d: G.related(_links(s, d), "www.cheap-pills.example.com"),
    "graph_upsert": lambda s, d: G.upsert(_returned(s, d, False), _returned(s, d, True), F.col("strength")).withColumn("strength", F.round("strength", 6)),
    "skill_paths_two_hops": lambda s, d: G.simple_paths(_partners(s, d), "NATION_7", 2),
    "topological_levels": lambda s, d: G.topological_levels(_tree(s, d).select("task").unionByName(_tree(s, d).select(F.col("needs").alias("task"))).distinct(), _tree(s, d)),
}

_LINKS = """links AS (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
e AS (SELECT source, target, 'contains' AS relation, 0.6::DOUBLE AS strength FROM links WHERE source <> '' AND target <> '')"""
_TRADE = """e AS (SELECT a.n_name AS source, b.n_name AS target, 'ships' AS relation, count(*) / 10000.0::DOUBLE AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey GROUP BY ALL)"""
_PARTNERS = _TRADE.replace("e AS (", "t AS (", 1) + ", e AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY strength DESC, target) <= 3)"
_SKILLS = "e(source, target, relation, strength) AS (VALUES " + ", ".join(f"('{a}', '{b}', 'compatible', 0.5::DOUBLE)" for a, bs in SKILLS.items() for b in bs) + ")"
_PATHS = """p AS (SELECT [source, target] AS p, target, strength AS s FROM e WHERE source = '{0}' AND target <> '{0}'
  UNION ALL SELECT list_append(p, e.target), e.target, s * e.strength FROM p JOIN e ON p.target = e.source WHERE NOT list_contains(p, e.target) AND len(p) <= {1})"""


def _rank_sql(edges, origin, rounds=40):
    """Unrolled rounds, more than convergence needs."""
    ctes = [edges, "st AS MATERIALIZED (SELECT source, target, sum(strength) / sum(sum(strength)) OVER (PARTITION BY source) AS share FROM e GROUP BY source, target)"]
    ctes += ["nd AS (SELECT source AS node FROM e UNION SELECT target FROM e)", f"og AS MATERIALIZED (SELECT node, {origin} AS origin, node NOT IN (SELECT source FROM st) AS loose FROM nd)"]
    ctes += ["r0 AS (SELECT node, loose, origin AS rank FROM og)"]
    for i in range(rounds):
        ctes.append(f"m{i} AS MATERIALIZED (SELECT target AS node, sum(rank * share) AS got FROM r{i} JOIN st ON node = source GROUP BY 1)")
        lost = f"coalesce((SELECT sum(rank) FROM r{i} WHERE loose), 0)"
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT node, loose, 0.15::DOUBLE * origin + 0.85::DOUBLE * (coalesce(got, 0) + {lost} * origin) AS rank FROM og LEFT JOIN m{i} USING (node))")
    return f"WITH {', '.join(ctes)} SELECT node, round(rank, 6) AS rank FROM r{rounds}"



SQL = {
    "page_links": f"WITH {_LINKS} SELECT * FROM e",
    "graph_neighbours": f"WITH {_TRADE} SELECT target AS node, relation, round(strength, 6) AS strength, 'out' AS direction FROM e WHERE source = 'NATION_3' UNION ALL SELECT source, relation, round(strength, 6), 'in' FROM e WHERE target = 'NATION_3'",
    "graph_degrees": f"WITH {_LINKS} SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, round(sum(strength), 6) AS strength FROM (SELECT source AS node, 1 AS o, 0 AS i, strength FROM e UNION ALL SELECT target, 0, 1, strength FROM e) GROUP BY 1",
    "graph_relation_counts": f"WITH {_LINKS} SELECT relation, count(*) AS n, round(avg(strength), 6) AS mean_strength FROM e GROUP BY 1",
    "graph_reach": f"""WITH RECURSIVE {_LINKS}, u AS (SELECT source, target FROM e UNION SELECT target, source FROM e),
      w(node, depth) AS (SELECT min(source), 0 FROM e UNION SELECT u.target, depth + 1 FROM w JOIN u ON node = u.source WHERE depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY 1""",
    "graph_reach_directed": f"""WITH RECURSIVE {_PARTNERS}, w(node, depth) AS (SELECT 'NATION_3', 0 UNION SELECT e.target, depth + 1 FROM w JOIN e ON node = e.source WHERE depth < 25) SELECT node, min(depth) AS depth FROM w GROUP BY 1""",
    "graph_simple_paths": f"WITH RECURSIVE {_PARTNERS}, {_PATHS.format('NATION_5', 3)} SELECT array_to_string(p, '>') AS path, len(p) - 1 AS length, round(s, 6) AS strength FROM p",
    "graph_shortest_paths": f"""WITH RECURSIVE {_LINKS}, u AS (SELECT source, target, strength FROM e UNION SELECT target, source, strength FROM e), z AS (SELECT min(source) AS a, max(source) AS b FROM e),
      w(node, depth) AS (SELECT a, 0 FROM z UNION SELECT u.target, depth + 1 FROM w JOIN u ON node = u.source WHERE depth < 12), dist AS (SELECT node, min(depth) AS d FROM w GROUP BY 1),
      p AS (SELECT [a] AS p, a AS node, 1.0::DOUBLE AS s, 0 AS n FROM z UNION ALL SELECT list_append(p, u.target), u.target, s * u.strength, n + 1 FROM p JOIN u ON p.node = u.source JOIN dist ON dist.node = u.target AND dist.d = n + 1
        WHERE n < (SELECT d FROM dist, z WHERE dist.node = z.b))
      SELECT array_to_string(p, '>') AS path, n::BIGINT AS length, round(s, 6) AS strength FROM p, z WHERE p.node = z.b ORDER BY s DESC, 1 LIMIT 5""",
    "graph_components": f"""WITH RECURSIVE {_LINKS}, u AS (SELECT source, target FROM e UNION SELECT target, source FROM e), w(node, root) AS (SELECT source, source FROM u UNION SELECT u.target, root FROM w JOIN u ON node = u.source)
      SELECT node, min(root) AS component FROM w GROUP BY 1""",
    "graph_pagerank": _rank_sql(_TRADE, "1.0::DOUBLE / (SELECT count(*) FROM nd)"),
    "graph_personal_pagerank": _rank_sql(_PARTNERS, "CASE WHEN node IN ('NATION_3', 'NATION_8') THEN 0.5::DOUBLE ELSE 0 END", 100),
    "graph_related": f"""WITH {_LINKS}, o AS (SELECT target, strength AS s FROM e WHERE source = 'www.cheap-pills.example.com')
      SELECT source AS other, round(sum(strength * s), 6) AS strength, count(DISTINCT e.target) AS shared FROM e JOIN o USING (target) WHERE source <> 'www.cheap-pills.example.com' GROUP BY 1""",
    "graph_upsert": """WITH e AS (SELECT s_nationkey AS source, c_nationkey AS target, 'ships' AS relation, l_returnflag = 'R' AS r, count(*) / 1000.0::DOUBLE AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) SELECT source, target, relation, round(strength, 6) AS strength FROM e QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY r DESC) = 1""",
    "skill_paths_two_hops": f"WITH RECURSIVE {_PARTNERS}, {_PATHS.format('NATION_7', 2)} SELECT array_to_string(p, '>') AS path, len(p) - 1 AS length, round(s, 6) AS strength FROM p",
    "topological_levels": "SELECT n_name AS task, 1 AS level FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) UNION ALL SELECT DISTINCT r_name, 0 FROM region JOIN nation ON n_regionkey = r_regionkey",
}
