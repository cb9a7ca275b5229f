"""Vector search: the memory of a task, and the k best across strips and batches."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from corvane.operators import vector


def _table(spark, name, points):
    return spark.createDataFrame([(int(i), p) for i, p in points.items()], f"{name} bigint, embedding array<float>")


def _brute(points, asked, k, least, strict, same):
    """(query, rank, id, similarity) of the k best at ``least``, ties to the smaller id."""
    with np.errstate(invalid="ignore"):
        unit = lambda p: np.array(p, np.float64) / max(np.linalg.norm(np.array(p, np.float64)), 1e-300)
        out = []
        for q, e in asked.items():
            scores = sorted((-round(float(unit(p) @ unit(e)), 4), i) for i, p in points.items() if p is not None and not np.isnan(p).any() and (same or i != q))
            kept = [(-s, i) for s, i in scores if least is None or (-s > least if strict else -s >= least)][:k]
            out += [(q, rank, i, s) for rank, (s, i) in enumerate(kept, 1)]
    return sorted(out)


@pytest.mark.parametrize(("scores", "k", "least", "strict", "same"), [(40, 3, None, False, False), (700, 7, None, False, True), (1, 5, 0.25, True, False), (1 << 20, 4, 0.25, False, True), (90, 500, None, False, True)])
def test_best_of_strips_against_brute_force(spark, monkeypatch, scores, k, least, strict, same):
    monkeypatch.setattr(vector, "SCORES", scores)
    rng = np.random.default_rng(7)
    # few directions: many ties, within a strip and across tasks
    points = {int(i): rng.integers(-1, 2, 4).astype(np.float32).tolist() for i in rng.permutation(300)}
    points[17], points[40], points[80] = None, [0.0] * 4, [float("nan")] * 4
    asked = {i: points[i] for i in range(0, 300, 20) if i not in (40, 80)}
    rows = vector.search(_table(spark, "id", points).repartition(3), _table(spark, "query_id", asked), k, least, strict, 4, same).collect()
    got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in rows)
    want = _brute(points, asked, k, least, strict, same)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True))


def test_search_without_queries(spark):
    table = _table(spark, "id", {1: [1.0, 2.0]})
    asked = _table(spark, "query_id", {1: [1.0, 2.0]}).limit(0)
    assert vector.search(table, asked, 3).count() == 0 and vector.within(table, asked, 0.5).count() == 0


@pytest.mark.parametrize("of", ["search", "within"])
def test_memory_of_a_task(spark, monkeypatch, of):
    """2000 queries over Arrow batches of 10,000 vectors: 160 MB of similarities a batch, of which a task never holds more than a small part."""
    rng = np.random.default_rng(3)
    asked = _table(spark, "query_id", dict(enumerate(rng.normal(size=(2000, 8)).tolist())))
    vectors, taken = _table(spark, "id", {0: [1.0] * 8}), []
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, f, schema: taken.append(f) or self.selectExpr("id AS query_id", "id", "0D AS similarity"))
    _ = vector.search(vectors, asked, 20) if of == "search" else vector.within(vectors, asked, 0.9)
    points = rng.normal(size=(2, 10_000, 8)).astype(np.float32)
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) + 10_000 * n), pa.FixedSizeListArray.from_arrays(p.ravel(), 8).cast(pa.list_(pa.float32()))], ["id", "embedding"]) for n, p in enumerate(points)]
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in taken[-1](iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6, f"{peak / 1e6:.0f} MB"
    assert rows == 40_000 if of == "search" else rows > 0
