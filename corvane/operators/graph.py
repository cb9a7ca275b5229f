"""Property-graph operators over (source, target, relation, strength) edges.

Iterations are joins on a narrow frontier; each round's table goes to the shared checkpoint folder, so that
lineage stays short and a lost executor costs a round. Frontiers are grouped before they are joined: a node with
many edges is expanded once, however many paths lead to it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.shared import materialised, written


def links(pages: DataFrame) -> DataFrame:
    """Edges host -> path of the links in (url, html) pages, each once, strength 0.6."""
    host = F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))
    rows = pages.select(host.alias("source"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("target"))
    return rows.filter("source <> '' and target <> ''").distinct().select("source", "target", F.lit("contains").alias("relation"), F.lit(0.6).alias("strength"))


def entities(corpus: DataFrame) -> DataFrame:
    """(node_id, kind, name, id): functions, classes, imports, sections and links that the content names, once a document."""
    patterns = {
        "function": r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)",
        "class": r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)",
        "import": r"(?m)^\s*(?:from|import)\s+([A-Za-z_][A-Za-z0-9_.]*)",
        "section": r"(?m)^#{1,6} +([^\r\n]+)",
        "link": r"\[[^\]]*\]\(([^)\s]+)\)",
    }
    found = F.flatten(
        F.array(*[F.transform(F.regexp_extract_all("content", F.lit(p), 1), _entity(kind)) for kind, p in patterns.items()])
    )
    rows = corpus.select("id", F.explode(F.array_distinct(found)).alias("e"))
    node = F.left(F.md5(F.concat_ws(":", F.col("e.kind"), F.col("id").cast("string"), F.col("e.name"))), F.lit(16))
    return rows.select(node.alias("node_id"), F.col("e.kind").alias("kind"), F.col("e.name").alias("name"), "id")


def _entity(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def calls(corpus: DataFrame) -> DataFrame:
    """(id, caller, callee): functions of a document that it calls, strength 0.8; ``caller`` is the document's node."""
    defined = F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)"), 1)
    called = F.regexp_extract_all("content", F.lit(r"(?<!def )\b([A-Za-z_][A-Za-z0-9_]*)\s*\("), 1)
    caller = F.concat(F.lit("doc:"), F.col("id").cast("string"))
    return corpus.select("id", caller.alias("caller"), F.explode(F.array_intersect(defined, called)).alias("callee"))


def neighbours(edges: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """(node, relation, strength, direction) around one node."""
    out = edges.filter(F.col("source") == node).select(F.col("target").alias("node"), "relation", "strength", F.lit("out").alias("direction"))
    into = edges.filter(F.col("target") == node).select(F.col("source").alias("node"), "relation", "strength", F.lit("in").alias("direction"))
    return {"out": out, "in": into, "both": out.unionByName(into)}[direction]


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, strength)."""
    ends = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), "strength").unionByName(
        edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), "strength")
    )
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.round(F.sum("strength"), 6).alias("strength"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("strength"), 6).alias("mean_strength"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def reach(edges: DataFrame, start: DataFrame, depth: int | None, directed: bool = True, stop: str | None = None) -> DataFrame:
    """(node, depth): least number of steps from any of (node,) ``start``, up to ``depth`` (None: any), or until ``stop`` or nothing new is found."""
    steps = edges.select("source", "target") if directed else _both_ways(edges)
    levels = [start.select("node").distinct().withColumn("depth", F.lit(0))]
    while depth is None or len(levels) <= depth:
        ahead = levels[-1].join(steps, F.col("node") == F.col("source")).select(F.col("target").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, levels).select("node")
        new = materialised(ahead.join(seen, "node", "left_anti").withColumn("depth", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
        if stop is not None and not new.filter(F.col("node") == stop).isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def simple_paths(edges: DataFrame, start: str, length: int) -> DataFrame:
    """(path, length, strength) of all paths without repeated nodes; strength is the product of the steps'."""
    paths = edges.filter(F.col("source") == start).select(F.array("source", "target").alias("p"), "target", F.col("strength").alias("s"))
    paths = paths.filter(F.col("target") != start)
    found = paths
    steps = edges.select("source", F.col("target").alias("next"), "strength")
    for _ in range(length - 1):
        longer = paths.join(steps, F.col("target") == F.col("source")).filter(~F.array_contains("p", F.col("next")))
        paths = longer.select(F.concat("p", F.array("next")).alias("p"), F.col("next").alias("target"), (F.col("s") * F.col("strength")).alias("s"))
        found = found.unionByName(paths)
    return found.select(F.array_join("p", ">").alias("path"), (F.size("p") - 1).cast("bigint").alias("length"), F.round("s", 6).alias("strength"))


def pagerank(
    edges: DataFrame, restart: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6, digits: int = 10
) -> DataFrame:
    """(node, rank) once the ranks change by less than ``tolerance`` in all; if they don't within ``rounds``, this raises. Steps are weighted by strength, and walks restart at (node,)
    ``restart`` (default: anywhere), as they do from nodes without steps, so that all ranks add up to one."""
    total = edges.groupBy("source").agg(F.sum("strength").alias("_total"))
    steps = edges.groupBy("source", "target").agg(F.sum("strength").alias("strength")).join(total, "source")
    steps = materialised(steps.select("source", "target", (F.col("strength") / F.col("_total")).alias("share")))
    nodes = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node"))).distinct()
    if restart is None:
        origin = nodes.crossJoin(F.broadcast(nodes.agg((1.0 / F.count("*")).alias("origin"))))  # one row
    else:
        n = restart.distinct().agg((1.0 / F.count("*")).alias("_share"))
        marked = restart.select("node").distinct().crossJoin(F.broadcast(n))  # one row
        origin = nodes.join(marked, "node", "left").select("node", F.coalesce("_share", F.lit(0.0)).alias("origin"))
    leads = steps.select(F.col("source").alias("node"), F.lit(True).alias("leads")).distinct()
    origin = materialised(origin.join(leads, "node", "left").withColumn("leads", F.coalesce("leads", F.lit(False))))
    ranks = origin.withColumn("rank", F.col("origin"))
    for _ in range(rounds):
        moved = ranks.join(steps, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        loose = ranks.agg(F.coalesce(F.sum(F.when(~F.col("leads"), F.col("rank"))), F.lit(0.0)).alias("loose"))  # one row
        new = ranks.withColumnRenamed("rank", "old").join(moved, "node", "left").crossJoin(F.broadcast(loose))
        rank = (1 - damping) * F.col("origin") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") * F.col("origin"))
        new = materialised(new.select("node", "origin", "leads", rank.alias("rank"), F.abs(rank - F.col("old")).alias("change")))
        ranks = new.drop("change")
        if (new.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            break
    else:
        raise RuntimeError(f"ranks still change by more than {tolerance} after {rounds} rounds")
    return ranks.select("node", F.round("rank", digits).alias("rank"))


def multi_hop(edges: DataFrame, start: DataFrame, hops: int, per_hop: int, decay: float = 0.8) -> DataFrame:
    """(node, hop, score): at each hop the best ``per_hop`` unseen nodes by summed strength from the last hop's, decayed."""
    seen = start.select("node").distinct().select("node", F.lit(0).alias("hop"), F.lit(1.0).alias("score"))
    frontier = seen
    for at in range(1, hops + 1):
        ahead = frontier.join(edges, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node"))
        ahead = ahead.agg(F.round(F.sum(F.col("score") * F.col("strength")) * decay, 6).alias("score")).join(seen.select("node"), "node", "left_anti")
        frontier = materialised(ahead.orderBy(F.desc("score"), "node").limit(per_hop).select("node", F.lit(at).alias("hop"), "score"))
        seen = materialised(seen.unionByName(frontier))
    return seen


def related(edges: DataFrame, node: str) -> DataFrame:
    """(other, strength, shared): nodes that share targets with ``node``, by summed strength."""
    own = edges.filter(F.col("source") == node).select("target", F.col("strength").alias("_s"))
    rows = edges.filter(F.col("source") != node).join(own, "target").groupBy(F.col("source").alias("other"))
    return rows.agg(F.round(F.sum(F.col("strength") * F.col("_s")), 6).alias("strength"), F.count_distinct("target").alias("shared"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components, named by their smallest node; labels jump to labels, so few rounds are needed until none changes."""
    steps = materialised(_both_ways(edges))
    labels = materialised(steps.groupBy(F.col("source").alias("node")).agg(F.min(F.least("source", "target")).alias("component")))
    while True:
        near = steps.join(labels, F.col("target") == F.col("node")).groupBy("source").agg(F.min("component").alias("_near"))
        ahead = labels.select(F.col("node").alias("_n"), F.col("component").alias("_ahead"))
        new = labels.join(near, F.col("node") == F.col("source")).join(ahead, F.col("component") == F.col("_n"))
        new = materialised(new.select("node", F.least("component", "_near", "_ahead").alias("component"), F.col("component").alias("_old")))
        changed = not new.filter("component <> _old").isEmpty()
        labels = new.drop("_old")
        if not changed:
            return labels


def topological_levels(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, level): a task's level is one above the highest of what it needs; tasks in a cycle, or behind one, get none. ``needs`` is (task, needs).

    Each round, what is ready lowers the counts of open needs of its own successors; tasks whose count is 0 then are ready, and leave the table of the others.
    """
    tasks, needs = tasks.select("task").distinct(), written(needs.select("task", "needs").distinct(), "needs")
    left = written(needs.groupBy("task").agg(F.count("*").alias("open")), "open")
    levels = [tasks.join(left, "task", "left_anti").select("task", F.lit(0).alias("level"))]
    while not levels[-1].isEmpty():
        met = needs.join(levels[-1].select(F.col("task").alias("needs")), "needs").groupBy("task").agg(F.count("*").alias("met"))
        left = written(left.filter("open > 0").join(met, "task", "left").select("task", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "open")
        levels.append(left.filter("open = 0").join(tasks, "task", "left_semi").select("task", F.lit(len(levels)).alias("level")))
    return reduce(DataFrame.unionByName, levels)


def upsert(edges: DataFrame, new: DataFrame, order: Column, keys: Sequence[str] = ("source", "target", "relation")) -> DataFrame:
    """The edges after ``new`` ones replaced those with their keys; of several, the last by ``order``."""
    best = new.groupBy(*keys).agg(F.max_by("strength", order).alias("strength"))
    return edges.select(*keys, "strength").join(best, list(keys), "left_anti").unionByName(best.select(*keys, "strength"))


def document_graph(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of (node_id, kind, name, id) entities: a node for each document and entity, and an edge from each document to what it names."""
    documents = found.select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("node_id"), F.lit("document").alias("kind"), F.col("id").cast("string").alias("name")).distinct()
    nodes = documents.unionByName(found.select("node_id", "kind", "name").distinct())
    edges = found.select(F.concat(F.lit("doc:"), F.col("id").cast("string")).alias("source"), F.col("node_id").alias("target"), F.lit("contains").alias("relation"), F.lit(0.6).alias("strength"))
    return nodes, edges.distinct()


def nodes_like(nodes: DataFrame, kind: str | None = None, name: str | None = None) -> DataFrame:
    """Nodes of a kind, of a name, or of both."""
    rows = nodes if kind is None else nodes.filter(F.col("kind") == kind)
    return rows if name is None else rows.filter(F.col("name") == name)


def related_documents(edges: DataFrame, node: str, ranks: DataFrame) -> DataFrame:
    """(node, how, strength): neighbours with their summed strength ("direct"), and all others with their (node, rank) in walks from the node ("indirect")."""
    direct = edges.filter((F.col("source") == node) | (F.col("target") == node))
    direct = direct.select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("node"), "strength")
    direct = direct.groupBy("node").agg(F.lit("direct").alias("how"), F.round(F.sum("strength"), 6).alias("strength"))
    others = ranks.filter((F.col("rank") > 0) & (F.col("node") != node)).join(direct.select("node"), "node", "left_anti")
    return direct.unionByName(others.select("node", F.lit("indirect").alias("how"), F.col("rank").alias("strength")))


def steps_between(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(depth,): least number of steps along the edges from one node to another, however many; empty if there is no way."""
    found = reach(edges, edges.sparkSession.createDataFrame([(start,)], "node string"), None, stop=end)
    return found.filter(F.col("node") == end).select("depth")
