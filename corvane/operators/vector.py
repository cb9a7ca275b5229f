"""Exact vector search: cosine top-k of many queries over a table of embeddings.

``search`` is one scan of the vectors for all queries. Queries are a bounded batch, whose size is checked: up to ``QUERY_BATCH``
vectors are sent to every task, which keeps the k best of each query as it goes, so only k rows for each query and task are
shuffled. An Arrow batch is taken in strips, a matrix product each, of so many rows that ``SCORES`` similarities are held at
once: a task's memory depends on neither the number of vectors nor that of queries. Larger sets of queries run batch by batch
by the same way.

``all_pairs`` is the self-join over all vectors: blocks of vectors meet in tasks, and nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import numbered

QUERY_BATCH = 4096
#: Similarities that a task holds at once.
SCORES = 1 << 20
#: Vectors in a block of the self-join; a task holds two blocks and the similarities between them.
PAIR_BLOCK = 2048


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in doubles."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _parts(asked: DataFrame, n: int) -> list[DataFrame]:
    """A stated set of ``n`` queries in batches: they are numbered once, by ranges, and written."""
    rows = numbered(asked, ["query_id"], "_at")
    return [rows.filter((F.col("_at") > at) & (F.col("_at") <= at + QUERY_BATCH)).drop("_at") for at in range(0, n, QUERY_BATCH)]


def _wanted(asked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of a batch of queries."""
    rows = asked.orderBy("query_id").toPandas()
    points = np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), -1 if len(rows) else 0)
    return rows["query_id"].to_numpy(), points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)


def _scores(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of a strip of (id, embedding), and their cosines with all queries (columns): ``SCORES`` at most, or one row; what is no number is minus infinity."""
    step = max(1, SCORES // max(1, len(wanted)))
    for batch in batches if len(wanted) else ():
        for at in range(0, batch.num_rows, step):
            strip = batch.slice(at, step)
            found = strip.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(strip.num_rows, -1)
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)
            scores = found @ wanted.T
            np.round(scores, digits, out=scores)
            scores[np.isnan(scores)] = -np.inf
            yield strip.column(0).to_numpy(zero_copy_only=False), scores


def search(
    vectors: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, strict: bool = False, digits: int = 6, same: bool = True
) -> DataFrame:
    """(query_id, id, rank, similarity): the k nearest of (id, embedding) for each of (query_id, embedding).

    ``threshold`` bounds the similarity from below (strictly or not); ``same`` keeps a vector whose id is the query's.
    Null embeddings are never found. Ties go to the smaller id.
    """
    asked = queries.filter("embedding is not null").select("query_id", "embedding")
    n = asked.count()  # a stated set
    if n > QUERY_BATCH:
        return reduce(DataFrame.unionByName, [search(vectors, part, k, threshold, strict, digits, same) for part in _parts(asked, n)])
    ids, wanted = _wanted(asked)
    least = -np.finfo(np.float64).max if threshold is None else np.nextafter(threshold, np.inf) if strict else threshold

    def nearest(batches):
        # the best so far, and what may be among them, as (place of the query, id, similarity); the least similarity that may be among a query's
        kept, floor = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))], np.full(len(ids), least)

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, who, scores = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = np.lexsort((who, -scores, q))
            q = q[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            order, q = order[place < k], q[place < k]
            last = np.flatnonzero(place[place < k] == k - 1)
            floor[q[last]] = scores[order[last]]
            return q, who[order], scores[order]

        for own, scores in _scores(batches, wanted, digits):
            if not same:
                scores[own[:, None] == ids[None, :]] = -np.inf
            among = scores >= floor
            if len(own) > k and np.count_nonzero(among) > k * len(ids):
                np.maximum(floor, np.partition(scores, len(own) - k, axis=0)[len(own) - k], out=floor)
                among = scores >= floor
            row, q = np.nonzero(among)
            kept.append((q, own[row], scores[row, q]))
            if sum(len(part[0]) for part in kept[1:]) > max(SCORES // 8, len(kept[0][0])):
                kept[:] = [best()]
        q, who, top = best()
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(who), pa.array(top)], ["query_id", "id", "similarity"])

    found = vectors.filter("embedding is not null").select("id", "embedding").mapInArrow(nearest, "query_id bigint, id bigint, similarity double")
    line = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")


def within(vectors: DataFrame, queries: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """(query_id, id, similarity) of all (id, embedding) at ``threshold`` or more of a stated set of queries, checked to be QUERY_BATCH at most a pass."""
    asked = queries.filter("embedding is not null").select("query_id", "embedding")
    n = asked.count()
    if n > QUERY_BATCH:
        return reduce(DataFrame.unionByName, [within(vectors, part, threshold, digits) for part in _parts(asked, n)])
    ids, wanted = _wanted(asked)

    def near(batches):
        for own, scores in _scores(batches, wanted, digits):
            i, j = np.nonzero(scores >= threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(own[i]), pa.array(scores[i, j])], ["query_id", "id", "similarity"])

    return vectors.filter("embedding is not null").select("id", "embedding").mapInArrow(near, "query_id bigint, id bigint, similarity double")


def all_pairs(vectors: DataFrame, threshold: float, digits: int = 6) -> DataFrame:
    """(a, b, similarity) of all pairs of (id, embedding), a < b, at ``threshold`` or more.

    Null embeddings have no pairs. Each pair of blocks is one task's matrix product; the vectors are shuffled once for each block.
    """
    rows = vectors.filter("embedding is not null").select("id", "embedding")
    blocks = max(1, -(-rows.count() // PAIR_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def near(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        points = np.array(table.column("embedding").to_pylist(), np.float64).reshape(len(ids), -1)
        points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)
        in_low = table.column("block").to_numpy() == table.column("low").to_numpy()
        in_high = table.column("block").to_numpy() == table.column("high").to_numpy()
        left, right = np.flatnonzero(in_low), np.flatnonzero(in_high)
        scores = np.round(points[left] @ points[right].T, digits)
        kept = scores >= threshold
        if in_low.all() and in_high.all():
            # a block with itself: each pair stands there twice
            kept &= ids[left][:, None] < ids[right][None, :]
        else:
            kept &= ids[left][:, None] != ids[right][None, :]
        i, j = np.nonzero(kept)
        a, b = ids[left][i], ids[right][j]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": scores[i, j]})

    return rows.groupBy("low", "high").applyInArrow(near, "a bigint, b bigint, similarity double")


def to_text(embedding: Column) -> Column:
    """``[a, b]`` form of a vector."""
    return F.to_json(embedding)


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")
