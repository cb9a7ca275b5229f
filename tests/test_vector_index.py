"""The inverted-file index against exact search."""

import random
import tempfile

import numpy as np
import pytest

from corvane.operators import vector, vector_index as V

SCHEMA = "id bigint, embedding array<float>"


def folder():
    return "file://" + tempfile.mkdtemp(prefix="corvane-") + "/index"


def recall(index, table, queries, k=10):
    found = {(r["query_id"], r["id"]): r["similarity"] for r in V.search(index, queries, k, same=False).collect()}
    exact = {(r["query_id"], r["id"]): r["similarity"] for r in vector.search(table, queries, k, same=False).collect()}
    shared = found.keys() & exact.keys()
    assert all(abs(found[p] - exact[p]) < 2e-6 for p in shared)
    return len(shared) / max(len(exact), 1)


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    index = V.build(table, folder())
    assert index.vectors(spark).count() == table.count() == sum(len(r["ids"]) for r in index.codes(spark).select("ids").collect())
    assert recall(index, table, table.filter("id % 50 = 0").selectExpr("id as query_id", "embedding")) >= 0.9


def test_clusters_need_few_lists_and_prune(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    points = np.concatenate([c + 0.1 * rng.normal(size=(60, 16)) for c in centres])
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], SCHEMA)
    index = V.build(table, folder(), lists=25)
    assert index.probes <= 6
    queries = table.filter("id = 5").selectExpr("id as query_id", "embedding")
    found = V.search(index, queries, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    assert recall(index, table, table.filter("id % 40 = 0").selectExpr("id as query_id", "embedding")) >= 0.9


def test_a_third_of_equal_vectors_nulls_and_zeros(spark):
    rng = random.Random(1)
    rows = [(i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(100)] + [(100 + i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)] + [(300, None), (301, [0.0] * 5)]
    table = spark.createDataFrame(rows, SCHEMA)
    index = V.build(table, folder(), lists=8)
    queries = spark.createDataFrame([(1, [1.0, 0.1, 0.0, 0.0, 0.0]), (2, None)], "query_id bigint, embedding array<float>")
    got = V.search(index, queries, 7, probes=8).collect()
    assert sorted(r["id"] for r in got) == list(range(7)) or {r["similarity"] for r in got if r["id"] < 100} and min(r["similarity"] for r in got) >= 0.99
    assert len(got) == 7 and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 8))
    assert index.vectors(spark).count() == 301


def test_empty_table_and_one_row(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    index = V.build(spark.createDataFrame([], SCHEMA), folder())
    assert V.search(index, queries, 3).collect() == []
    index = V.build(spark.createDataFrame([(7, [2.0, 0.0])], SCHEMA), folder())
    assert [tuple(r) for r in V.search(index, queries, 3).collect()] == [(1, 7, 1, 1.0)]


@pytest.mark.parametrize("n", [1, 3, 10])
def test_nearest(n):
    rng = np.random.default_rng(0)
    points, centres = rng.normal(size=(50, 4)), rng.normal(size=(10, 4))
    far = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (V.nearest(points, centres, n) == np.argsort(far, axis=1)[:, :n]).all()
