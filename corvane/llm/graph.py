"""Connected components by repeated contraction, for links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the (a, b) links reaches.

    Every round, each node points at its smallest neighbour (or itself), pointers are followed twice, and links are redrawn between
    the nodes pointed at. Rounds end when no link is left; each is cut by a written table, so a lost
    executor costs a round at most. Minima are pre-aggregated, so a node with many links is no hot spot there. Pointers are followed between written
    tables only: both sides of these joins are plain shuffles, of which Spark's skew join splits the part of a node that many point at.
    """
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    none = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    steps = []
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to")).select("id", F.least("id", "to").alias("to"))
        for _ in range(2):
            step = written(step, "pointers")
            step = _followed(step, step)
        step = written(step, "pointers")
        steps.append(step)
        ends_a = step.select(F.col("id").alias("a"), F.col("to").alias("_a"))
        ends_b = step.select(F.col("id").alias("b"), F.col("to").alias("_b"))
        links = links.join(ends_a, "a").join(ends_b, "b").filter("_a <> _b")
        links = written(links.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "links")
    if not steps:
        return none
    labels = steps[0]
    for step in steps[1:]:
        labels = _followed(labels, step)
    return (labels if len(steps) == 1 else written(labels, "labels")).select("id", F.col("to").alias("component"))


def _followed(labels: DataFrame, step: DataFrame) -> DataFrame:
    """Each label replaced by what ``step`` has for it, if anything."""
    ahead = step.select(F.col("id").alias("to"), F.col("to").alias("_ahead"))
    return labels.join(ahead, "to", "left").select("id", F.coalesce("_ahead", "to").alias("to"))
