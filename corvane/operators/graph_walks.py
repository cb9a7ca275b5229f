"""Walks and ways on large property graphs: ranks of many walks at once, retrieval by hops, and all shortest paths between two nodes.

Edges are (source, target, strength). Rounds are joins of a narrow frontier with the steps, and each is a written table. Nothing is limited by a number of
rounds: loops end when nothing is left to do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import written


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge both ways; of edges between the same nodes the strongest."""
    rows = edges.select("source", "target", "strength")
    both = rows.unionByName(rows.select(F.col("target").alias("source"), F.col("source").alias("target"), "strength"))
    return both.groupBy("source", "target").agg(F.max("strength").alias("strength"))


def walk_ranks(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, bound: float = 1e-7) -> DataFrame:
    """(walk, node, rank, residual): ranks of the nodes for each walk of (walk, node) ``seeds``, all walks at once, by forward push.

    A walk restarts at its seeds, as it does from nodes without steps; steps are weighted by strength. What a node has received and not yet passed on is its
    residual. A node with a residual over ``bound`` keeps 1 - damping of it as rank and passes the rest on, until no residual is over the bound.
    Ranks are too low by no more than the walk's residuals add up to; ranks and residuals of a walk add up to one. Only nodes that a walk
    reaches have rows, so a walk's cost hangs on its bound, not on the graph. A walk without a seed in the graph stays at its seeds.
    """
    total = edges.groupBy("source").agg(F.sum("strength").alias("_total"))
    steps = edges.groupBy("source", "target").agg(F.sum("strength").alias("strength")).join(total, "source")
    steps = written(steps.select(F.col("source").alias("node"), "target", (F.col("strength") / F.col("_total")).alias("share")), "steps")
    starts = seeds.select("walk", "node").distinct()
    starts = starts.join(starts.groupBy("walk").agg((1.0 / F.count("*")).alias("origin")), "walk")
    leads = steps.select("node").distinct().withColumn("leads", F.lit(True))
    starts = written(starts.join(leads, "node", "left").select("walk", "node", "origin", F.coalesce("leads", F.lit(False)).alias("leads")), "starts")
    ends = steps.select(F.col("target").alias("node")).distinct().join(leads, "node", "left").withColumn("leads", F.coalesce("leads", F.lit(False)))
    steps = written(steps.join(ends.select(F.col("node").alias("target"), F.col("leads").alias("target_leads")), "target"), "steps")

    def pushed(state: DataFrame) -> DataFrame:
        hot = state.filter(F.col("residual") > bound)
        moved = hot.filter("leads").join(steps, "node").select("walk", F.col("target").alias("node"), F.col("target_leads").alias("leads"), F.lit(0.0).alias("rank"), (damping * F.col("residual") * F.col("share")).alias("residual"))
        loose = hot.filter("not leads").groupBy("walk").agg(F.sum("residual").alias("_loose"))
        back = loose.join(starts, "walk").select("walk", "node", "leads", F.lit(0.0).alias("rank"), (damping * F.col("_loose") * F.col("origin")).alias("residual"))
        is_hot = F.col("residual") > bound
        kept = state.select("walk", "node", "leads", F.when(is_hot, F.col("rank") + (1 - damping) * F.col("residual")).otherwise(F.col("rank")).alias("rank"), F.when(is_hot, 0.0).otherwise(F.col("residual")).alias("residual"))
        return reduce(DataFrame.unionByName, [kept, moved, back]).groupBy("walk", "node", "leads").agg(F.sum("rank").alias("rank"), F.sum("residual").alias("residual"))

    state = starts.select("walk", "node", "leads", F.lit(0.0).alias("rank"), F.col("origin").alias("residual"))
    while not state.filter(F.col("residual") > bound).isEmpty():
        state = written(pushed(state), "walks")  # each round reads the last one three times
    return state.select("walk", "node", "rank", "residual")


def hops(edges: DataFrame, seeds: DataFrame, depth: int = 2, per_hop: int = 5, damping: float = 0.85, bound: float = 1e-7, digits: int = 6) -> DataFrame:
    """(query_id, node, hop, score) of (query_id, node) ``seeds``: hop by hop, those of the ``per_hop`` best nodes of walks from the last hop's that are new.

    Seeds are hop 0 with score 1. Ties go to the smaller node. A query whose hop has nothing new ends there; the others go on.
    """
    found = [written(seeds.select("query_id", "node").distinct().select("query_id", "node", F.lit(0).alias("hop"), F.lit(1.0).alias("score")), "hops")]
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    for hop in range(1, depth + 1):
        ranks = walk_ranks(edges, found[-1].select(F.col("query_id").alias("walk"), "node"), damping, bound)
        best = ranks.select(F.col("walk").alias("query_id"), "node", F.round("rank", digits).alias("score")).filter("score > 0")
        best = best.withColumn("_at", F.row_number().over(line)).filter(F.col("_at") <= per_hop).drop("_at")
        seen = reduce(DataFrame.unionByName, found).select("query_id", "node")
        new = written(best.join(seen, ["query_id", "node"], "left_anti").select("query_id", "node", F.lit(hop).alias("hop"), "score"), "hops")
        if new.isEmpty():
            break
        found.append(new)
    return reduce(DataFrame.unionByName, found)


def shortest_paths(edges: DataFrame, start: str, end: str, most: int = 5, digits: int = 6) -> DataFrame:
    """(path, length, strength) of the ``most`` strongest of all shortest paths between two nodes, of any length; strength is the product of the steps'.

    The nodes around ``start`` and ``end`` are found level by level, on the side with fewer of them, until both meet. Steps from level to level that
    lead to a meeting node are the graph of all shortest paths; along it each node keeps its ``most`` best ways from the start. Ties go to the
    first path in order. Without a way the result is empty; from a node of the graph to itself it is the node.
    """
    spark = edges.sparkSession
    steps = written(edges.groupBy("source", "target").agg(F.max("strength").alias("strength")), "steps")
    nothing = "path string, length bigint, strength double"
    if start == end:
        there = steps.filter((F.col("source") == start) | (F.col("target") == start)).limit(1)
        return there.select(F.lit(start).alias("path"), F.lit(0).cast("bigint").alias("length"), F.lit(1.0).alias("strength"))
    ahead, back = ([spark.createDataFrame([(node,)], "node string")] for node in (start, end))
    sizes = [1, 1]
    while True:
        forward = sizes[0] <= sizes[1]
        levels, near, far = (ahead, "source", "target") if forward else (back, "target", "source")
        reached = steps.join(levels[-1], F.col(near) == F.col("node")).select(F.col(far).alias("node")).distinct()
        new = written(reached.join(reduce(DataFrame.unionByName, levels), "node", "left_anti"), "level")
        sizes[0 if forward else 1] = count = new.count()
        if not count:
            return spark.createDataFrame([], nothing)
        levels.append(new)
        meeting = written(ahead[-1].join(back[-1], "node"), "meeting")
        if not meeting.isEmpty():
            break
    # the steps of all shortest paths, from the start on
    dag: list[DataFrame] = []
    at = meeting
    for level in reversed(ahead[:-1]):
        own = steps.join(at, F.col("target") == F.col("node")).drop("node").join(level, F.col("source") == F.col("node")).drop("node")
        dag.insert(0, written(own, "ways"))
        at = dag[0].select(F.col("source").alias("node")).distinct()
    at = meeting
    for level in reversed(back[:-1]):
        own = steps.join(at, F.col("source") == F.col("node")).drop("node").join(level, F.col("target") == F.col("node")).drop("node")
        dag.append(written(own, "ways"))
        at = dag[-1].select(F.col("target").alias("node")).distinct()
    line = Window.partitionBy("node").orderBy(F.desc("s"), "path")
    best = spark.createDataFrame([(start, start, 1.0)], "node string, path string, s double")
    for ways in dag:
        longer = best.join(ways, F.col("node") == F.col("source")).select(F.col("target").alias("node"), F.concat("path", F.lit(">"), "target").alias("path"), (F.col("s") * F.col("strength")).alias("s"))
        best = written(longer.withColumn("_at", F.row_number().over(line)).filter(F.col("_at") <= most).drop("_at"), "best")
    return best.select("path", F.lit(len(dag)).cast("bigint").alias("length"), F.round("s", digits).alias("strength"))
