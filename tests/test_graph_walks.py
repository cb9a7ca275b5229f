"""Walks and ways against plain versions; loops that end by themselves."""

import random
from itertools import pairwise

import numpy as np
import pytest

from corvane.operators import graph as G
from corvane.operators import graph_walks as W



@pytest.fixture(autouse=True)
def one_partition(spark):
    """Rounds over small tables."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


EDGES = "source string, target string, strength double"


def power(edges, seeds, damping=0.85, rounds=300):
    nodes = sorted({n for a, b, _ in edges for n in (a, b)} | {*seeds})
    at = {n: i for i, n in enumerate(nodes)}
    step = np.zeros((len(nodes), len(nodes)))
    for a, b, s in edges:
        step[at[b], at[a]] += s
    total = step.sum(axis=0)
    step = step / np.where(total > 0, total, 1)
    origin = np.zeros(len(nodes))
    origin[[at[s] for s in seeds]] = 1 / len(seeds)
    rank = origin
    for _ in range(rounds):
        rank = (1 - damping) * origin + damping * (step @ rank + rank[total == 0].sum() * origin)
    return dict(zip(nodes, rank, strict=True))


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", rng.choice([0.2, 0.5, 0.9])) for _ in range(m)]


def test_walk_ranks_against_power_iteration(spark):
    edges = random_edges(20, 40, 1)
    walks = {"one": ["n1"], "two": ["n2", "n3"], "away": ["nowhere"]}
    seeds = spark.createDataFrame([(w, n) for w, ns in walks.items() for n in ns], "walk string, node string")
    got = {}
    for r in W.walk_ranks(spark.createDataFrame(edges, EDGES), seeds, bound=1e-4).collect():
        got.setdefault(r["walk"], {})[r["node"]] = (r["rank"], r["residual"])
    for walk, nodes in walks.items():
        want = power(edges, nodes)
        left = sum(residual for _, residual in got[walk].values())
        assert abs(sum(rank for rank, _ in got[walk].values()) + left - 1) < 1e-9 and left < 1e-2
        assert all(-1e-9 <= want[n] - got[walk].get(n, (0, 0))[0] <= left + 1e-9 for n in want)


def test_hops(spark):
    edges = [("a", "b", 0.9), ("a", "c", 0.1), ("b", "d", 1.0), ("d", "e", 1.0), ("x", "y", 1.0)]
    seeds = spark.createDataFrame([(1, "a"), (2, "x")], "query_id bigint, node string")
    rows = {(r["query_id"], r["node"]): r["hop"] for r in W.hops(spark.createDataFrame(edges, EDGES), seeds, 2, 3, bound=1e-3).collect()}
    # the seed itself takes one of the places of a hop
    assert rows == {(1, "a"): 0, (1, "b"): 1, (1, "d"): 1, (1, "e"): 2, (2, "x"): 0, (2, "y"): 1}


def paths_between(edges, start, end):
    best = {}
    for a, b, s in edges:
        best[a, b] = max(s, best.get((a, b), 0))
    level, seen = [[start]], {start}
    while level and not any(p[-1] == end for p in level):
        level = [[*p, b] for p in level for (a, b) in best if a == p[-1] and b not in seen]
        seen |= {p[-1] for p in level}
    return sorted(((">".join(p), len(p) - 1, round(float(np.prod([best[e] for e in pairwise(p)])), 6)) for p in level if p[-1] == end), key=lambda p: (-p[2], p[0]))


def test_shortest_paths_against_every_path(spark):
    for seed, n, m in ((2, 25, 45),):
        edges = random_edges(n, m, seed)
        table = spark.createDataFrame(edges, EDGES)
        for end in ("n5",):
            want = paths_between(edges, "n0", end)
            got = [tuple(r) for r in W.shortest_paths(table, "n0", end, 1000).collect()]
            assert sorted(got, key=lambda p: (-p[2], p[0])) == want
            few = [tuple(r) for r in W.shortest_paths(table, "n0", end, 2).collect()]
            assert [p[2] for p in sorted(few, key=lambda p: -p[2])] == [p[2] for p in want[:2]]
    assert [tuple(r) for r in W.shortest_paths(table, "n0", "n0").collect()] == [("n0", 0, 1.0)]
    assert W.shortest_paths(table, "n0", "nowhere").collect() == []


def test_long_chains_are_not_cut(spark):
    n = 52
    needs = spark.createDataFrame([(f"t{i + 1}", f"t{i}") for i in range(n)] + [("x", "y"), ("y", "x")], "task string, needs string")
    tasks = spark.createDataFrame([(f"t{i}",) for i in range(n + 1)] + [("x",), ("y",), ("alone",)], "task string")
    assert {r["task"]: r["level"] for r in G.topological_levels(tasks, needs).collect()} == {f"t{i}": i for i in range(n + 1)} | {"alone": 0}


def test_components_and_steps_of_a_chain(spark):
    chain = spark.createDataFrame([(f"c{i:03d}", f"c{i + 1:03d}", 1.0) for i in range(60)], EDGES)
    assert {r["component"] for r in G.components(chain).collect()} == {"c000"}
    assert [r["depth"] for r in G.steps_between(chain, "c000", "c005").collect()] == [5]
