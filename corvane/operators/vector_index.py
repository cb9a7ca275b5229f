"""Approximate vector search: inverted lists with residual codes, for tables that a scan per batch of queries is too much for.

``build`` learns centroids on a bounded sample, assigns every vector to the list of its nearest centroid, and writes two tables by list:
``codes`` (blocks of ids and of the coded differences to the centroid, a byte for ``PART`` dimensions) and ``vectors`` (the vectors as they are). ``search``
joins queries to the lists that they probe, reads the codes of these lists only (partition pruning), keeps the ``KEEP`` * k best of each query by its codes, and
scores those again exactly by a join with their lists' vectors. Queries are a table of any size.

How many lists a query probes is measured when the index is built: ``CALIBRATION`` of the vectors are searched exactly, and ``probes`` is the least number of lists
that hold ``recall`` of their neighbours. On vectors without clusters that is most lists; the codes still spare the scan.

What is bounded: the sample (``SAMPLE_ROWS``, those with the smallest hashes), the lists (``MOST_LISTS``, about the root of the rows), and with them what the driver
and the broadcast model hold. What isn't: rows of a list. A list with very many rows is many blocks, which are joined apart. Every row is indexed; null vectors
are none. A vector of length 0 has similarity 0 with all others. Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.operators import vector

SAMPLE_ROWS = 32_768
MOST_LISTS = 4096
#: Vectors of a block of codes, and queries that meet it together, on average.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 256
#: Dimensions that share a byte of code.
PART = 2
#: Candidates by code for each result.
KEEP = 10
CALIBRATION = 256
ROUNDS = 8


def unit(points: np.ndarray) -> np.ndarray:
    return points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-300)


def nearest(points: np.ndarray, centres: np.ndarray, n: int = 1, step: int = 4096) -> np.ndarray:
    """The ``n`` centres nearest to each point, nearest first."""
    half = 0.5 * (centres * centres).sum(axis=1)
    out = np.empty((len(points), n), np.int64)
    for at in range(0, len(points), step):
        far = half[None, :] - points[at : at + step] @ centres.T
        best = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(len(centres)), far.shape)
        out[at : at + step] = np.take_along_axis(best, np.argsort(np.take_along_axis(far, best, 1), axis=1, kind="stable"), 1)
    return out


def means(points: np.ndarray, n: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """``n`` centres of the points by Lloyd's rounds; a centre without points takes one of the points."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), n, replace=False)].copy()
    for _ in range(rounds):
        at = nearest(points, centres)[:, 0]
        sums, count = np.zeros_like(centres), np.bincount(at, minlength=n)
        np.add.at(sums, at, points)
        alone = np.flatnonzero(count == 0)
        sums[alone], count[alone] = points[rng.choice(len(points), len(alone))], 1
        centres = sums / count[:, None]
    return centres


@dataclass(frozen=True)
class Index:
    """A written index: its folder, centroids, codewords by part of the dimensions, and the number of lists that a query probes."""

    path: str
    centres: np.ndarray
    words: np.ndarray
    probes: int

    def codes(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("block int, ids array<bigint>, codes binary, list int").parquet(f"{self.path}/codes")

    def vectors(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("id bigint, embedding array<float>, list int").parquet(f"{self.path}/vectors")


def _padded(points: np.ndarray) -> np.ndarray:
    """Parts of the dimensions, the last filled up with zeros: (points, parts, PART)."""
    short = -points.shape[1] % PART
    return np.pad(points, ((0, 0), (0, short))).reshape(len(points), -1, PART)


def encoded(rest: np.ndarray, words: np.ndarray) -> np.ndarray:
    parts = _padded(rest)
    return np.stack([nearest(parts[:, p], words[p])[:, 0] for p in range(len(words))], axis=1).astype(np.uint8)


def decoded(codes: np.ndarray, words: np.ndarray, dimensions: int) -> np.ndarray:
    parts = np.stack([words[p][codes[:, p]] for p in range(len(words))], axis=1)
    return parts.reshape(len(codes), -1)[:, :dimensions]


def _points(column: pa.ListArray | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def build(vectors: DataFrame, path: str, lists: int | None = None, recall: float = 0.95, k: int = 10, seed: int = 11) -> Index:
    """Index (id, embedding) rows under ``path``, a folder that driver and executors share and that doesn't exist yet."""
    spark = vectors.sparkSession
    rows = vectors.filter("embedding is not null").select("id", "embedding")
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), MOST_LISTS, n))
    # of hashes under a bound that about twice as many rows pass, the smallest: the same rows whatever the partitions
    order = F.xxhash64(F.lit(seed), "id", "embedding")
    low = rows.withColumn("_order", order).filter(F.col("_order") / 2.0**64 + 0.5 <= 2.0 * SAMPLE_ROWS / max(n, 1))
    sample = low.orderBy("_order", "id").limit(SAMPLE_ROWS).select("id", "embedding").toPandas()
    points = unit(np.array(sample["embedding"].tolist(), np.float64).reshape(len(sample), -1)) if len(sample) else np.zeros((1, PART))
    lists = min(lists, len(points))
    centres = means(points, lists, seed)
    dimensions = points.shape[1]
    rest = _padded(points - centres[nearest(points, centres)[:, 0]])
    words = np.stack([means(rest[:, p], min(256, len(rest)), seed + p) for p in range(rest.shape[1])])
    shared = spark.sparkContext.broadcast((centres, words))

    def assign(batches):
        centres, words = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = unit(_points(batch.column(1), batch.num_rows))
            at = nearest(found, centres)[:, 0]
            codes = encoded(found - centres[at], words)
            columns = [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1), pa.array(at.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "code", "embedding", "list"])

    # rows are dealt by list and a hash of the id, so that a list with very many rows is written by many tasks
    sizes = rows.mapInArrow(assign, "id bigint, code binary, embedding array<float>, list int")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n // (BLOCK_ROWS * lists)))
    dealt = sizes.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(parts, "list", "block")
    dealt.sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/vectors")
    written = spark.read.schema("id bigint, code binary, block int, list int").parquet(f"{path}/vectors")
    # a list of many rows has as many blocks as it needs
    counts = written.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_n"))  # a row a list
    own = written.join(F.broadcast(counts), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    held = own.groupBy("list", "block").agg(F.array_sort(F.collect_list(F.struct("id", "code"))).alias("_rows"))
    held = held.select("block", F.col("_rows.id").alias("ids"), F.array_join(F.transform("_rows.code", F.hex), "").alias("_codes"), "list")
    held.select("block", "ids", F.unhex("_codes").alias("codes"), "list").repartition(parts, "list", "block").sortWithinPartitions("list").write.partitionBy("list").parquet(f"{path}/codes")
    index = Index(path, centres, words, lists)
    if lists > 1:
        index = Index(path, centres, words, _probes(rows, index, sample, recall, k, dimensions))
    return index


def _probes(rows: DataFrame, index: Index, sample, recall: float, k: int, dimensions: int) -> int:
    """The least number of lists that hold ``recall`` of the exact neighbours of a part of the sample."""
    spark, asked = rows.sparkSession, sample.head(CALIBRATION)
    queries = spark.createDataFrame([(int(i), [float(x) for x in e]) for i, e in zip(asked["id"], asked["embedding"], strict=True)], "query_id bigint, embedding array<float>")
    true = vector.search(rows, queries, k, same=False).select("query_id", "id")
    placed = true.join(index.vectors(spark).select("id", "list"), "id").select("query_id", "list").toPandas()  # CALIBRATION * k rows
    if not len(placed):
        return len(index.centres)
    points = unit(np.array(asked["embedding"].tolist(), np.float64).reshape(-1, dimensions))
    place = np.argsort(nearest(points, index.centres, len(index.centres)), axis=1)  # of each list, for each query
    row_of = {int(q): at for at, q in enumerate(asked["id"])}
    ranks = np.sort([place[row_of[int(q)], at] for q, at in zip(placed["query_id"], placed["list"], strict=True)])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, digits: int = 6, same: bool = True, threshold: float | None = None) -> DataFrame:
    """(query_id, id, rank, similarity): about the k nearest of the indexed vectors for each of (query_id, embedding), with exact similarities.

    ``probes``: lists that a query reads (default: as measured); ``same`` keeps a vector whose id is the query's.
    """
    spark = queries.sparkSession
    probes = min(probes or index.probes, len(index.centres))
    keep = KEEP * k
    shared = spark.sparkContext.broadcast((index.centres, index.words))

    def probe(batches):
        centres, _ = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found = unit(_points(batch.column(1), batch.num_rows))
            near = nearest(found, centres, probes)
            rows = np.repeat(np.arange(batch.num_rows), probes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(near.ravel().astype(np.int32))], ["query_id", "embedding", "list"])

    asked = queries.filter("embedding is not null").select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    probed = asked.mapInArrow(probe, "query_id bigint, embedding array<float>, list int")
    sizes = probed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("_n"))
    wanted = sorted(r["list"] for r in sizes.select("list").collect())  # MOST_LISTS at most
    together = probed.join(F.broadcast(sizes), "list").withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_n")))
    together = together.groupBy("list", "_part").agg(F.collect_list("query_id").alias("queries"), F.flatten(F.collect_list("embedding")).alias("wanted"))
    met = index.codes(spark).filter(F.col("list").isin(wanted)).hint("merge").join(together, "list").select("list", "ids", "codes", "queries", "wanted")

    def score(batches):
        centres, words = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                at, ids = batch.column(0)[row].as_py(), batch.column(1)[row].values.to_numpy()
                codes = np.frombuffer(batch.column(2)[row].as_py(), np.uint8).reshape(len(ids), len(words))
                asked = batch.column(3)[row].values.to_numpy()
                points = unit(batch.column(4)[row].values.to_numpy().astype(np.float64).reshape(len(asked), -1))
                scores = points @ (decoded(codes, words, points.shape[1]) + centres[at]).T
                best = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.broadcast_to(np.arange(len(ids)), scores.shape)
                columns = [np.repeat(asked, best.shape[1]), ids[best.ravel()], np.full(best.size, at, np.int32), np.take_along_axis(scores, best, 1).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "id", "list", "guess"])

    guesses = met.mapInArrow(score, "query_id bigint, id bigint, list int, guess double")
    if not same:
        guesses = guesses.filter("id <> query_id")
    line = Window.partitionBy("query_id").orderBy(F.desc("guess"), "id")
    kept = guesses.withColumn("_at", F.row_number().over(line)).filter(F.col("_at") <= keep).select("query_id", "id", "list")
    exact = kept.join(index.vectors(spark).filter(F.col("list").isin(wanted)), ["list", "id"]).join(asked.withColumnRenamed("embedding", "_asked"), "query_id")
    scored = exact.select("query_id", "id", F.round(F.coalesce(vector.cosine(F.col("embedding"), F.col("_asked")), F.lit(0.0)), digits).alias("similarity")).distinct()
    if threshold is not None:
        scored = scored.filter(F.col("similarity") >= threshold)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "rank", "similarity")
