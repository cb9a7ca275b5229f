"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's words are dealt into shards by a seeded hash (so many that each holds about
``shard_words`` words, but ``MAX_SHARDS`` at most: a source with a third of all rows only has more and larger shards), and each shard's
words, in seeded order, are cut into equal blocks of about ``block_words`` words, or of less where it has fewer than ``LEAST_BLOCKS`` of these. Blocks are
seats: sources get integer numbers of them by the highest quotients of the blocks that their targets make, each source's by its own block size, and shards
of a source by the highest quotients of their sizes. A shard with ``n`` blocks and ``q`` seats repeats every
block ``q div n`` times, and ``q mod n`` blocks, picked by a seeded hash, once more.

Targets share the total by weight; a source takes ``max_repeats`` times its size at most, and
the excess is shared again by weight until none is above. If all sources are at that limit, the
mix is smaller than the total.

Edge cases: null and empty texts have size 0 and take 0 words; texts are counted whole, however long; null sources are one source, last
in order; a source without words has target 0. Rows that repeat a document id are documents of
their own (each is in the mix with its own size). Other columns, whatever their names, aren't read. An empty table gives an empty result.

Tables by source (a row each, made by a pre-aggregated sum) are ranked in one window: they have as many rows as there are names of sources. The seats of a
source's shards are dealt in one group, of MAX_SHARDS rows at most. Everything by document or block is dealt by shard.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 20
#: Shards of a source; in larger sources shards grow (at 10 ** 13 words, a third of them in one source, to 2 * 10 ** 8 words).
MAX_SHARDS = 1 << 14
#: Rows of a shard at most on average, whatever their sizes: rows without words need no room in blocks, but they are sorted too.
SHARD_ROWS = 100_000
#: Blocks of a shard (as far as it has so many words), so that a source of few words comes near its target too.
LEAST_BLOCKS = 16
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    With sources in order of limit / weight, the first k are held at their limits for the smallest k
    at which the rest, shared by weight, leaves the next source under its own.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_at", F.row_number().over(in_order) - 1)
    rows = rows.withColumn("_w", F.element_at(ladder, (F.col("_at") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("_limit", F.col("source_size") * float(max_repeats))
    by_ratio = Window.orderBy(F.col("_limit") / F.col("_w"), "_at")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("_share", (F.col("_total") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_w").over(from_here))
    # words a unit of weight gets where the first source stays under its limit
    free = F.when(F.col("_share") * F.col("_w") <= F.col("_limit"), F.col("_share"))
    rows = rows.withColumn("_free", free)
    level = F.min_by("_free", F.when(F.col("_free").isNotNull(), F.struct(F.col("_limit") / F.col("_w"), F.col("_at")))).over(everything)
    target = F.least(F.col("_limit"), F.coalesce(level * F.col("_w"), F.col("_limit")))
    return rows.select("source", "source_size", target.alias("target"))


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients votes / 1, 3, 5, ...; none gets more than ``most``, ties go to earlier parties.

    A divisor just too large is found by bisection; the few seats that it leaves go to the next quotients.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    seats = min(int(seats), int(most.sum()))
    if seats <= 0:
        return np.zeros(votes.size, np.int64)

    def rounded(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(votes / divisor + 0.5), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (2 * most.max() + 2), 2 * votes.max() + 1
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if rounded(middle).sum() > seats:
            low = middle
        else:
            high = middle
    quota = rounded(high)
    heap = [(-votes[i] / (2 * quota[i] + 1), i) for i in np.flatnonzero(quota < most)]
    heapq.heapify(heap)
    for _ in range(seats - int(quota.sum())):
        _, i = heap[0]
        quota[i] += 1
        if quota[i] < most[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * quota[i] + 1), i))
        else:
            heapq.heappop(heap)
    return quota


def apportion(parties: DataFrame, group: str, party: str, votes: str, seats: str, most: str) -> DataFrame:
    """Adds ``quota`` to ``parties``: Sainte-Laguë within each group. Parties are sums (of a source or a shard), not documents."""
    schema = T.StructType([*parties.schema.fields, T.StructField("quota", T.LongType())])

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(party, ignore_index=True)
        return rows.assign(quota=sainte_lague(rows[votes].to_numpy(), rows[seats].iloc[0], rows[most].to_numpy()))

    return parties.groupBy(group).applyInPandas(deal, schema)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(key, size, source_size, target, taken, source) of every document."""
    sized = written(docs.select(F.col(key).alias("_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "mix-sizes")
    by_source = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")), "mix-sources")
    targets = source_targets(by_source, weights, max_repeats)
    # equal but for null, which join as one
    counts = by_source.select(F.struct("source").alias("_k"), F.ceil(F.col("_n") / SHARD_ROWS).alias("_by_rows"))
    targets = targets.withColumn("_k", F.struct("source")).join(counts, "_k").drop("_k")
    targets = targets.withColumn("_source", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int"))
    n_shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), "_by_rows"), F.lit(MAX_SHARDS))
    targets = written(targets.withColumn("_n_shards", n_shards).drop("_by_rows"), "mix-targets")

    rows = sized.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"), F.col("size")))
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_order")), F.col("_n_shards")))
    line = Window.partitionBy("_source", "_shard").orderBy("_order", "_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumn("_end", F.sum("size").over(line)).drop("_order", "_n_shards"), "mix-rows")

    shards = rows.groupBy("_source", "_shard").agg(F.max("_end").alias("shard_size"), F.first("target").alias("target"))
    n_blocks = F.greatest(F.round(F.col("shard_size") / block_words), F.least(F.col("shard_size"), F.lit(LEAST_BLOCKS))).cast("bigint")
    shards = shards.filter("shard_size > 0").withColumn("n_blocks", n_blocks).withColumn("most", F.col("n_blocks") * max_repeats)
    sums = (F.sum(c).alias(c) for c in ("most", "n_blocks", "shard_size"))
    sources = shards.groupBy("_source").agg(F.first("target").alias("target"), *sums).withColumn("_all", F.lit(0))
    # a source's target in blocks of its own size
    sources = sources.withColumn("wanted", F.col("target") * F.col("n_blocks") / F.col("shard_size"))
    sources = sources.withColumn("seats", F.round(F.sum("wanted").over(Window.partitionBy())).cast("bigint"))
    sources = apportion(sources, "_all", "_source", "wanted", "seats", "most").select("_source", F.col("quota").alias("seats"))
    shards = written(apportion(shards.join(sources, "_source"), "_source", "_shard", "shard_size", "seats", "most"), "mix-quotas")

    # block i of a shard has its words from floor(i * size / n) on
    picked = shards.withColumn("_extra", F.col("quota") % F.col("n_blocks")).filter("_extra > 0")
    blocks = picked.select("_source", "_shard", "_extra", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)).alias("_block"))
    pick = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "_source", "_shard", "_block"), "_block")
    extra = blocks.withColumn("_rank", F.row_number().over(pick)).filter("_rank <= _extra").select("_source", "_shard", "_block")

    known = rows.join(shards.select("_source", "_shard", "shard_size", "n_blocks", "quota"), ["_source", "_shard"], "left")
    first = F.expr("((_end - size + 1) * n_blocks - 1) div shard_size")
    last = F.expr("(_end * n_blocks - 1) div shard_size")
    parts = known.filter("size > 0").withColumn("_block", F.explode(F.sequence(first, last)))
    # blocks are exploded behind the shuffle that sizes them, so Spark would take them for small and broadcast them; they grow with the words
    hit = parts.join(extra.hint("merge"), ["_source", "_shard", "_block"], "left_semi")
    overlap = F.expr("least(_end, (_block + 1) * shard_size div n_blocks) - greatest(_end - size, _block * shard_size div n_blocks)")
    # in a shard, rows with words end at different places
    more = hit.groupBy("_source", "_shard", "_end").agg(F.sum(overlap).alias("_more"))
    taken = F.expr("CASE WHEN size > 0 THEN (quota div n_blocks) * size + coalesce(_more, 0) ELSE 0 END")
    out = known.join(more, ["_source", "_shard", "_end"], "left")
    return out.select(F.col("_id").alias(key), "size", "source_size", "target", taken.cast("bigint").alias("taken"), "source")
