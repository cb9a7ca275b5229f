"""Merkle dataset manifest: a digest of every row, of every source and of the whole table, and a proof for every row.

Leaves are digests of rows. In each source they ascend by key, and every ``RUN`` consecutive nodes become one until one is left, the source's subroot;
subroots, ordered by source, give the root in the same way.

A tree is cut into aligned blocks of ``BLOCK`` = RUN ** BLOCK_LEVELS nodes, so that no run crosses a block and a block's own tree is a part of
the whole one. Executors hash whole blocks: a task reads its blocks in order as Arrow batches, ``CHUNK`` rows at a time, and DuckDB runs one
query of ordered ``string_agg`` and ``sha256`` for each level. Spark numbers the leaves, combines block roots (they
are the nodes of the next layer, cut into blocks again, until each tree has one node), and joins each block with the proof of its root. A table of any
size has a layer for each factor of ``BLOCK`` only, and no task, group or driver holds more than a chunk.

Leaves are numbered by a range partitioning: a partition's rows are numbered where they are, and each partition's start is the sum of those before it. The
ordered leaves are a written table, so a task that runs again numbers alike.

Edge cases: null columns, key included, are ``-`` in the leaf; a null source is a source of its own, the first, and differs from an empty one. A null key comes
first. Rows that repeat a key are leaves of their own, ordered by their digests; equal rows are equal leaves. Texts are taken whole, however
long. A source of one row has that leaf as its subroot, and one source its subroot as the root. Columns of other names, whatever they are, aren't read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import written

RUN = 3
BLOCK_LEVELS = 8
BLOCK = RUN**BLOCK_LEVELS
#: Rows that DuckDB gets at once, and up to one block more.
CHUNK = 4 * BLOCK
#: Memory of a task's DuckDB.
MEMORY = "400MB"
#: Starts of partitions are broadcast if they are so many at most; otherwise they are joined by a shuffle.
BROADCAST_ROWS = 100_000

NODE = T.StructType([T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("total", T.LongType())])


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row: ``-`` for null, else the byte count, ``:`` and the value, of each column."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def _tree(source: Column) -> Column:
    """A name that is never null and keeps the order of bytes, null first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos`` and ``total`` in their tree, ordered by ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered").withColumn("_part", F.shiftright("_at", 33))  # Spark's number of the partition
    starts = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    tree = Window.partitionBy("tree")  # a row a partition of the tree at most
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(starts.select("tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("total")), "starts")
    small = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return ranged.join(F.broadcast(starts) if small else starts.hint("merge"), ["tree", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _levels(total: Column) -> Column:
    """Levels of a tree of ``total`` nodes inside one block."""
    counted = [F.when(total > RUN**level, 1).otherwise(0) for level in range(BLOCK_LEVELS)]
    return sum(counted[1:], counted[0])


def _in_blocks(nodes: DataFrame) -> DataFrame:
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint")).withColumn("levels", _levels(F.col("total")).cast("int"))
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole blocks together, CHUNK rows or the first number above that; ``g`` numbers a chunk's blocks."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= CHUNK:
            table, ids = _with_blocks(kept)
            last = int(np.searchsorted(ids, ids[-1]))
            if last:
                yield table.slice(0, last)
                kept = table.slice(last).drop_columns("g").combine_chunks().to_batches()
    if kept and sum(b.num_rows for b in kept):
        yield _with_blocks(kept)[0]


def _with_blocks(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches)
    trees = table.column("tree").combine_chunks().dictionary_encode().indices.to_numpy()
    blocks = table.column("block").to_numpy()
    ids = np.concatenate([[0], np.cumsum((trees[1:] != trees[:-1]) | (blocks[1:] != blocks[:-1]))]).astype(np.int64)
    return table.append_column("g", pa.array(ids)), ids


def _engine():
    import duckdb

    engine = duckdb.connect()
    engine.execute("SET threads = 1")
    engine.execute(f"SET memory_limit = '{MEMORY}'")
    return engine


def _hash_levels(engine, chunk: pa.Table) -> int:
    """Tables n0 to nK of a chunk's nodes, level by level; K."""
    engine.register("chunk", chunk)
    engine.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT g, pos, levels, hash FROM chunk")
    top = int(max(chunk.column("levels").to_numpy(), default=0))
    for level in range(1, top + 1):
        engine.execute(
            f"CREATE OR REPLACE TEMP TABLE n{level} AS SELECT g, pos // {RUN} AS pos, min(levels) AS levels, sha256(string_agg(hash, '' ORDER BY pos)) AS hash "
            f"FROM n{level - 1} WHERE levels >= {level} GROUP BY g, pos // {RUN}"
        )
    return top


def _siblings(engine, level: int) -> None:
    """Table s<level>: what stands left and right of each node in its run."""
    engine.execute(
        f"CREATE OR REPLACE TEMP TABLE s{level} AS SELECT a.g, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, "
        f"coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r "
        f"FROM n{level - 1} a JOIN n{level - 1} b ON a.g = b.g AND a.pos // {RUN} = b.pos // {RUN} WHERE a.levels >= {level} GROUP BY a.g, a.pos"
    )


def _arrow(engine, sql: str) -> pa.Table:
    return engine.sql(sql).to_arrow_table()


def _by_chunk(rows: DataFrame, work: Callable[[object, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for chunk in _chunks(batches):
            engine = engine or _engine()
            yield from work(engine, chunk).select(target.names).cast(target).to_batches()

    return rows.mapInArrow(run, schema)


def block_roots(nodes: DataFrame) -> DataFrame:
    """The next layer: (tree, pos, hash, total) of the roots of the blocks of (tree, pos, hash, total)."""

    def work(engine, chunk: pa.Table) -> pa.Table:
        top = _hash_levels(engine, chunk)
        roots = " UNION ALL ".join(f"SELECT g, hash FROM n{level} WHERE levels = {level}" for level in range(top + 1))
        return _arrow(
            engine,
            f"WITH b AS (SELECT g, min(tree) AS tree, min(block) AS pos, min(total) AS total FROM chunk GROUP BY g), r AS ({roots}) "
            f"SELECT tree, pos, hash, (total + {BLOCK - 1}) // {BLOCK} AS total FROM b JOIN r ON b.g = r.g",
        )

    return _by_chunk(_in_blocks(nodes.select("tree", "pos", "hash", "total")), work, NODE)


def block_siblings(nodes: DataFrame) -> DataFrame:
    """(tree, pos, block, lefts, rights): for each node, what stands beside it and its parents up to the root of its block, level by level."""

    def work(engine, chunk: pa.Table) -> pa.Table:
        top = _hash_levels(engine, chunk)
        engine.execute("CREATE OR REPLACE TEMP TABLE f0 AS SELECT g, tree, pos, block, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights FROM chunk")
        for level in range(1, top + 1):
            _siblings(engine, level)
            engine.execute(
                f"CREATE OR REPLACE TEMP TABLE f{level} AS SELECT f.g, tree, f.pos, block, CASE WHEN s.g IS NULL THEN lefts ELSE list_append(lefts, s.l) END AS lefts, "
                f"CASE WHEN s.g IS NULL THEN rights ELSE list_append(rights, s.r) END AS rights "
                f"FROM f{level - 1} f LEFT JOIN s{level} s ON s.g = f.g AND s.pos = f.pos // {RUN ** (level - 1)}"
            )
        return _arrow(engine, f"SELECT tree, pos, block, lefts, rights FROM f{top}")

    lists = [T.StructField(n, T.ArrayType(T.StringType())) for n in ("lefts", "rights")]
    return _by_chunk(_in_blocks(nodes.select("tree", "pos", "hash", "total")), work, T.StructType([*NODE.fields[:2], T.StructField("block", T.LongType()), *lists]))


def _layers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the layers above, the last of one node for each tree."""
    layers = [nodes]
    while not layers[-1].filter("total > 1").isEmpty():
        layers.append(written(block_roots(layers[-1]), "blocks"))
    return layers


def _outer(layers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """(tree, pos, lefts, rights, subroot, root) of the nodes of ``layers[0]``, from those of the last layer."""
    for layer in reversed(layers[:-1]):
        above = outer.select("tree", F.col("pos").alias("block"), F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights"), "subroot", "root")
        own = block_siblings(layer).join(above.hint("merge"), ["tree", "block"])
        outer = written(own.select("tree", "pos", F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights"), "subroot", "root"), "proofs")
    return outer


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (tree, key, hash, ...) leaves: (the leaves with pos and total, and (tree, pos, lefts, rights, subroot, root) of their blocks).

    ``lefts`` and ``rights`` of a block are what stands beside its root and the nodes above it up to the root of the table.
    """
    kept = [c for c in leaves.columns if c != "tree"]
    numbered = _numbered(leaves, kept)
    layers = [written(block_roots(numbered), "blocks")]
    layers = _layers(layers[0])
    # the subroots are the nodes of one more tree
    names = written(layers[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_source"), "hash"), "subroots")
    top = written(_numbered(names, ["_source"]), "subroots")
    tops = _layers(top)
    none = F.array().cast("array<string>")
    root = tops[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    found = _outer(tops, root).drop("tree", "subroot")
    subroots = top.select(F.col("_source").alias("tree"), "pos", F.col("hash").alias("subroot")).join(found, "pos").withColumn("pos", F.lit(0).cast("bigint"))
    return numbered, _outer(layers, written(subroots.select("tree", "pos", "lefts", "rights", "subroot", "root"), "proofs"))


def prove(numbered: DataFrame, blocks: DataFrame, key: str, other: str) -> DataFrame:
    """(key, hash, other, subroot, root, proof_sha256, folded_root): each leaf's proof, and the root that ``other`` gives with it in the leaf's place."""

    def work(engine, chunk: pa.Table) -> pa.Table:
        top = _hash_levels(engine, chunk)
        engine.execute("CREATE OR REPLACE TEMP TABLE f0 AS SELECT g, pos, _other AS fold, '' AS proof, row_number() OVER () AS i FROM chunk")
        engine.execute("CREATE OR REPLACE TEMP TABLE b AS SELECT g, min(lefts) AS lefts, min(rights) AS rights, min(subroot) AS subroot, min(root) AS root FROM chunk GROUP BY g")
        for level in range(1, top + 1):
            _siblings(engine, level)
            engine.execute(
                f"CREATE OR REPLACE TEMP TABLE f{level} AS SELECT f.g, f.pos, CASE WHEN s.g IS NULL THEN fold ELSE sha256(s.l || fold || s.r) END AS fold, "
                f"proof || coalesce(s.l || s.r, '') AS proof FROM f{level - 1} f LEFT JOIN s{level} s ON s.g = f.g AND s.pos = f.pos // {RUN ** (level - 1)}"
            )
        above = _arrow(engine, "SELECT coalesce(max(len(lefts)), 0) AS n FROM b").column("n")[0].as_py()
        engine.execute(
            f"CREATE OR REPLACE TEMP TABLE o0 AS SELECT f.g, pos, fold, sha256(f.proof || coalesce(p.proof, '')) AS proof FROM f{top} f LEFT JOIN "
            "(SELECT g, string_agg(l || r, '' ORDER BY i) AS proof FROM (SELECT g, unnest(lefts) AS l, unnest(rights) AS r, generate_subscripts(lefts, 1) AS i FROM b) GROUP BY g) p ON p.g = f.g"
        )
        for level in range(1, above + 1):
            engine.execute(
                f"CREATE OR REPLACE TEMP TABLE o{level} AS SELECT o.g, pos, CASE WHEN len(lefts) >= {level} THEN sha256(lefts[{level}] || fold || rights[{level}]) ELSE fold END AS fold, proof "
                f"FROM o{level - 1} o JOIN b ON b.g = o.g"
            )
        return _arrow(
            engine,
            f"SELECT c._key, c.hash, c._other, b.subroot, b.root, o.proof AS proof_sha256, o.fold AS folded_root FROM o{above} o JOIN chunk c ON c.g = o.g AND c.pos = o.pos JOIN b ON b.g = o.g",
        )

    above = blocks.select("tree", F.col("pos").alias("block"), "lefts", "rights", "subroot", "root")
    rows = numbered.select("tree", "pos", "hash", "total", F.col(key).alias("_key"), F.col(other).alias("_other"))
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint")).withColumn("levels", _levels(F.col("total")).cast("int"))
    joined = rows.join(above.hint("merge"), ["tree", "block"]).sortWithinPartitions("tree", "block", "pos")
    texts = ("hash", "_other", "subroot", "root", "proof_sha256", "folded_root")
    schema = T.StructType([T.StructField("_key", numbered.schema[key].dataType), *(T.StructField(n, T.StringType()) for n in texts)])
    return _by_chunk(joined, work, schema).withColumnsRenamed({"_key": key, "_other": other})


def verified_rows(docs: DataFrame, changed: Column, key: str = "doc_id", source: str = "source", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text") -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): rows, with ``changed`` in place of ``text``, held against the manifest of the rows as they are."""
    other = leaf([changed if c == text else F.col(c) for c in columns])
    leaves = docs.select(_tree(F.col(source)).alias("tree"), F.col(key).alias("_id"), leaf([F.col(c) for c in columns]).alias("hash"), other.alias("_changed"))
    found = prove(*manifest(leaves), "_id", "_changed")
    return found.select(F.col("_id").alias(key), F.col("hash").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_text(key: str = "doc_id", text: str = "text") -> Column:
    """The text, without line feeds where the key's CRC-32 is even."""
    return F.when(F.crc32(F.col(key).cast("string").cast("binary")) % 2 == 0, F.translate(F.col(text), "\n", "")).otherwise(F.col(text))


def manifest_sql(levels: int = 12) -> str:
    """The manifest level by level, for sources and tables of up to RUN ** levels rows; the CRC-32 of a key is bit arithmetic on its digits."""

    def field(c: str) -> str:
        return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def tree(n: str, f: str) -> str:
        """Levels of nodes n (tree, pos, hash, total), and of f (tree, pos, i, fold, proof) folded through them."""
        parts = []
        for level in range(1, levels + 1):
            parts.append(
                f"{n}{level} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, sha256(string_agg(hash, '' ORDER BY pos)) AS hash, (min(total) + 2) // 3 AS total FROM {n}{level - 1} WHERE total > 1 GROUP BY tree, pos // 3)"
            )
            parts.append(
                f"{n}s{level} AS MATERIALIZED (SELECT a.tree, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r "
                f"FROM {n}{level - 1} a JOIN {n}{level - 1} b ON a.tree = b.tree AND a.pos // 3 = b.pos // 3 WHERE a.total > 1 GROUP BY a.tree, a.pos)"
            )
            parts.append(
                f"{f}{level} AS MATERIALIZED (SELECT f.tree, f.pos // 3 AS pos, i, CASE WHEN s.tree IS NULL THEN fold ELSE sha256(s.l || fold || s.r) END AS fold, proof || coalesce(s.l || s.r, '') AS proof "
                f"FROM {f}{level - 1} f LEFT JOIN {n}s{level} s ON s.tree = f.tree AND s.pos = f.pos)"
            )
        roots = " UNION ALL ".join(f"SELECT tree, hash FROM {n}{level} WHERE total = 1" for level in range(levels + 1))
        return ",\n".join([*parts, f"{n}roots AS MATERIALIZED ({roots})"])

    fields, changed = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "text"))), " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", "other")))
    return f"""
WITH RECURSIVE crc(doc_id, digits, k, c) AS (
  SELECT doc_id, doc_id::VARCHAR, 0, 4294967295::BIGINT FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL
  SELECT doc_id, digits, k + 1, CASE WHEN k % 9 = 0 THEN xor(c, ascii(substr(digits, k // 9 + 1, 1))::BIGINT) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END
  FROM crc WHERE k < 9 * length(digits)),
even AS (SELECT doc_id FROM crc WHERE k = 9 * length(digits) AND xor(c, 4294967295) % 2 = 0),
docs AS (SELECT d.*, CASE WHEN e.doc_id IS NULL THEN d.text ELSE replace(d.text, chr(10), '') END AS other FROM documents d LEFT JOIN even e ON e.doc_id = d.doc_id),
leaves AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({fields}) AS hash, sha256({changed}) AS other FROM docs),
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, hash) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total,
  row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, hash) AS i FROM leaves),
n0 AS MATERIALIZED (SELECT tree, pos, hash, total FROM rows),
f0 AS MATERIALIZED (SELECT tree, pos, i, other AS fold, '' AS proof FROM rows),
{tree("n", "f")},
m0 AS MATERIALIZED (SELECT 0 AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, hash, count(*) OVER () AS total, tree AS source FROM nroots),
g0 AS MATERIALIZED (SELECT m0.tree, m0.pos, i, fold, proof FROM f{levels} f JOIN m0 ON m0.source = f.tree),
{tree("m", "g")}
SELECT r.doc_id, r.hash AS leaf, s.hash AS subroot, t.hash AS root, sha256(g.proof) AS proof_sha256, g.fold AS folded_root, g.fold = t.hash AS verified
FROM rows r JOIN nroots s ON s.tree = r.tree JOIN g{levels} g ON g.i = r.i CROSS JOIN mroots t"""
