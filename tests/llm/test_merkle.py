"""The manifest against a plain tree, in blocks of every size."""

import hashlib
import random
from zlib import crc32

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, the siblings of each node and on which side they stand)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p // 3 * 3
            run = nodes[first : first + 3]
            proofs[i].append((run[: p - first], run[p - first + 1 :]))
        nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [p // 3 for p in at]
    return nodes[0], proofs


def fold(node, proof):
    for left, right in proof:
        node = h(*left, node, *right)
    return node


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for source in sources:
        own = sorted((r for r in rows if r[1] == source), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, outer = tree([t[1] for t in trees]) if trees else (None, [])
    found = []
    for (own, subroot, proofs), above in zip(trees, outer, strict=True):
        for row, proof in zip(own, proofs, strict=True):
            tampered = list(row)
            if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                tampered[4] = row[4].replace("\n", "")
            folded = fold(leaf(tampered), proof + above)
            found.append((row[0], leaf(row), subroot, root, h(*(s for left, right in proof + above for s in left + right)), folded, folded == root))
    return sorted(found, key=str)


def got(spark, rows, **clash):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "pos", "hash"):
        docs = docs.withColumn(name, F.lit("clash"))
    return sorted((tuple(r) for r in merkle.verified_rows(docs, merkle.tampered_text()).collect()), key=str)


def rows_of(sizes, seed=1):
    rng, rows = random.Random(seed), []
    for source, n in sizes:
        rows += [(rng.randint(-50, 10_000), source, rng.choice(["en", None, ""]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "c", "ü\n\n", "x" * 1000])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


def test_sources_of_every_size(spark):
    rows = rows_of([(None, 5), ("", 1), ("a", 3), ("b", 4), ("é", 30), ("z", 9), ("Z", 10)])
    rows += [(None, "a", None, None, None), (None, "a", "de", 1, "x\n"), (7, "one", "en", 1, "t\n"), (7, "one", "en", 1, "t\n"), (7, "one", "en", 1, "other")]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("levels", [1, 2])
def test_layers_of_small_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rows = rows_of([("hot", 100), *((f"s{i}", i % 4 + 1) for i in range(12))], levels)
    assert got(spark, rows) == plain(rows)


def test_starts_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 1)
    rows = rows_of([("a", 20), ("b", 7)], 4)
    assert got(spark, rows) == plain(rows)


def test_one_row_and_no_row(spark):
    assert got(spark, []) == []
    rows = [(1, "a", "en", 3, "a\nb")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows)[0][4] == h()


def test_chunks_hold_whole_blocks(monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 10)
    table = pa.table({"tree": ["a"] * 7 + ["b"] * 40 + ["c"] * 3, "block": [0] * 7 + [i // 9 for i in range(40)] + [0] * 3, "pos": range(50)})
    chunks = list(merkle._chunks(iter(table.to_batches(max_chunksize=4))))
    assert [p for c in chunks for p in c.column("pos").to_pylist()] == list(range(50)) and len(chunks) > 3
    seen = [set(zip(c.column("tree").to_pylist(), c.column("block").to_pylist(), strict=True)) for c in chunks]
    assert sum(map(len, seen)) == len(set().union(*seen)) and max(c.num_rows for c in chunks) <= 10 + 9 + 4


def test_a_changed_row_is_found(spark):
    rows = [(i, "s", "en", 1, f"text {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    changed = F.when(F.col("doc_id") == 11, F.lit("text 12")).otherwise(F.col("text"))
    assert [r["doc_id"] for r in merkle.verified_rows(docs, changed).filter("NOT verified").collect()] == [11]
