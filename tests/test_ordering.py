"""Numbers, reuse distances and caches against plain lists."""

import random
from collections import OrderedDict

import numpy as np
import pytest

from corvane.operators import ordering as O


def lru(keys, capacity):
    cache, hits, evictions = OrderedDict(), 0, 0
    for k in keys:
        if k in cache:
            hits += 1
            cache.move_to_end(k)
        else:
            if len(cache) >= capacity:
                cache.popitem(last=False)
                evictions += 1
            cache[k] = True
    return hits, evictions, len(cache)


def test_smaller_before():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        values = rng.integers(0, 20, n)
        assert O.smaller_before(values).tolist() == [int((values[:i] < values[i]).sum()) for i in range(n)]


@pytest.mark.parametrize(("block", "blocks"), [(1 << 16, 2048), (16, 64), (7, 5)])
def test_reuse_distances_and_caches(spark, monkeypatch, block, blocks):
    monkeypatch.setattr(O, "BLOCK", block)
    monkeypatch.setattr(O, "BLOCKS", blocks)
    rng = random.Random(3)
    keys = [rng.choice([0, 0, 0, None, *range(1, 25)]) for _ in range(400)]
    log = spark.createDataFrame([(i, i // 3, k) for i, k in enumerate(keys)], "id bigint, at bigint, k bigint")
    found = O.reuse_distances(log, "k", ["at", "id"])
    rows = {r["id"]: (r["pos"], r["distance"]) for r in found.collect()}
    last, want = {}, {}
    for i, k in enumerate(keys):
        want[i] = (i + 1, len({*keys[last[k] + 1 : i]}) if k in last else None)
        last[k] = i
    assert rows == want
    capacities = (1, 3, 10, 100)
    got = {r["capacity"]: (r["hits"], r["evictions"], r["size"]) for r in O.lru_hits(found, capacities).collect()}
    assert got == {c: lru(keys, c) for c in capacities}


def test_empty_log(spark):
    log = spark.createDataFrame([], "id bigint, at bigint, k bigint")
    found = O.reuse_distances(log, "k", ["at", "id"])
    assert found.collect() == [] and [tuple(r) for r in O.lru_hits(found, (2,)).collect()] == [(2, 0, 0, 0, 0)]
