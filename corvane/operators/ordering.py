"""Global orders without a single task: numbers of rows in an order, the row before, and counts of earlier smaller rows.

Rows are dealt by ranges of the order, numbered where they are, and a range starts at the sum of the ranges before it. The ordered rows are a
written table, so a task that runs again numbers alike.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources.shared import written

#: Rows of a block of the two-way count, and the blocks along one side: with more rows than both allow, blocks grow.
BLOCK, BLOCKS = 1 << 16, 2048


def numbered(rows: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """``rows`` with their numbers, from 1, in the order of the columns ``order``, which should tell all rows apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered").withColumn("_part", F.shiftright("_at", 33))  # Spark's number of the partition
    starts = ranged.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return ranged.join(F.broadcast(starts), "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def previous(rows: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``rows`` with ``prev``: the ``pos`` of the row before with the same key, else 0. A key with very many rows is dealt over tasks as others are."""
    lined = written(numbered(rows, [key, pos], "_line"), "lines")
    above = lined.select((F.col("_line") + 1).alias("_line"), F.struct(key).alias("_key"), F.col(pos).alias("_pos"))
    met = lined.join(above, "_line", "left")
    return met.withColumn("prev", F.when(F.struct(key) == F.col("_key"), F.col("_pos")).otherwise(F.lit(0)).cast("bigint")).drop("_line", "_key", "_pos")


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each entry, how many earlier ones are smaller: blocks are merged pairwise, and those on the right look up their places on the left."""
    n = len(values)
    ranks = np.unique(values, return_inverse=True)[1].astype(np.int64)
    counts, at, width = np.zeros(n, np.int64), np.arange(n), 1
    while width < n:
        block, right = at // (2 * width), (at // width) % 2 == 1
        keys = block * (n + 1) + ranks
        left = np.sort(keys[~right])
        # of the left half's rows, those before the block don't count
        counts[right] += np.searchsorted(left, keys[right], "left") - np.searchsorted(left, block[right] * (n + 1), "left")
        width *= 2
    return counts


def _counted(column: str):
    def count(table: pa.Table) -> pa.Table:
        pos, prev, other = (table.column(c).to_numpy() for c in ("pos", "prev", "_tb"))
        order = np.argsort(pos if column == "_tb" else prev)
        values = (prev if column == "_tb" else other)[order]
        return pa.table({"pos": pos[order], "n": smaller_before(values)})

    return count


def earlier_smaller(rows: DataFrame, total: int) -> DataFrame:
    """(pos, n): for each of (pos, prev), numbers from 1 to ``total`` and the numbers of other rows (each once) or 0, how many earlier rows have a smaller ``prev``.

    Both sides are cut into blocks of the same numbers. Blocks below on both sides are counted from a table of sums; what shares a block of ``pos``, or one
    of ``prev``, is counted in a group of a block's size. No group is larger, whatever the values.
    """
    spark = rows.sparkSession
    size = max(BLOCK, -(-total // BLOCKS))
    blocks = max(1, -(-total // size))
    tb = F.floor((F.col("pos") - 1) / size).cast("bigint")
    vb = F.when(F.col("prev") > 0, F.floor((F.col("prev") - 1) / size) + 1).otherwise(0).cast("bigint")  # 0: no row before
    placed = written(rows.select("pos", "prev", tb.alias("_tb"), vb.alias("_vb")), "placed")
    grid = spark.range(blocks).select(F.col("id").alias("_tb"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks).cast("bigint"))).alias("_vb"))
    grid = grid.join(placed.groupBy("_tb", "_vb").agg(F.count("*").alias("_n")), ["_tb", "_vb"], "left")
    along = Window.partitionBy("_tb").orderBy("_vb").rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.select("_tb", "_vb", F.sum(F.coalesce("_n", F.lit(0))).over(along).alias("_n"))
    grid = grid.select("_tb", "_vb", F.coalesce(F.sum(F.coalesce("_n", F.lit(0))).over(up), F.lit(0)).alias("_grid"))
    in_time = placed.groupBy("_tb").applyInArrow(_counted("_tb"), "pos bigint, n bigint")
    in_value = placed.filter("_vb > 0").groupBy("_vb").applyInArrow(_counted("_vb"), "pos bigint, n bigint")
    sums = placed.join(grid, ["_tb", "_vb"]).select("pos", F.col("_grid").alias("n"))
    return sums.unionByName(in_time).unionByName(in_value).groupBy("pos").agg(F.sum("n").alias("n"))


def reuse_distances(log: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The log's rows with ``pos``, ``prev`` and ``distance``: how many other keys were used since the key's last use; null at its first.

    Between two uses of a key stand as many keys as rows whose own last use lies before: these are the earlier rows with a smaller ``prev``, less those
    up to the last use, which all are. Null keys are a key. Rows that are equal in ``order`` come in any order, but always the same.
    """
    placed = written(previous(numbered(log, [*order, key]), key), "uses")
    total = placed.count()
    counts = earlier_smaller(placed.select("pos", "prev"), total)
    return placed.join(counts, "pos").withColumn("distance", F.when(F.col("prev") > 0, F.col("n") - F.col("prev"))).drop("n")


def lru_hits(distances: DataFrame, capacities: Sequence[int]) -> DataFrame:
    """(capacity, requests, hits, evictions, size): what caches of each capacity that drop the least recently used key do with the log, from one pass."""
    sums = [F.count_if(F.col("distance") < c).alias(f"h{c}") for c in capacities]
    one = distances.agg(F.count("*").alias("requests"), F.count_if(F.col("distance").isNull()).alias("keys"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(c).cast("bigint").alias("capacity"), F.col(f"h{c}").alias("hits")) for c in capacities]))
    one = one.select("requests", "keys", rows.alias("r")).select("r.capacity", "requests", "r.hits", F.least("keys", "r.capacity").alias("size"))
    return one.select("capacity", "requests", "hits", (F.col("requests") - F.col("hits") - F.col("size")).alias("evictions"), "size")
