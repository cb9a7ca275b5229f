"""Small-to-big retrieval: chunks, their parents, and the context made of them.

Chunks are rows (chunk_id, parent_id, idx, start_line, end_line, content). Groups are those of one file or parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def line_chunks(corpus: DataFrame, lines: int = 4) -> DataFrame:
    """(chunk_id, parent_id, idx, start_line, end_line, content): every ``lines`` lines of a text; lines count from 1."""
    rows = corpus.select("id", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    rows = rows.groupBy("id", F.floor(F.col("at") / lines).alias("idx")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts")
    )
    content = F.array_join(F.col("parts.line"), "\n")
    return rows.select(
        chunk_id(F.col("id").cast("string"), content, F.col("idx")).alias("chunk_id"), F.col("id").alias("parent_id"), "idx",
        (F.col("first") + 1).cast("bigint").alias("start_line"), (F.col("last") + 1).cast("bigint").alias("end_line"), content.alias("content"),
    )


def chunk_id(stem: Column, content: Column, idx: Column) -> Column:
    return F.concat_ws("_", stem, F.left(F.md5(content.cast("binary")), F.lit(8)), idx.cast("string"))


def matching_parents(chunks: DataFrame, hits: DataFrame, parents: DataFrame, n: int = 5) -> DataFrame:
    """The largest ``n`` parents that have a hit chunk."""
    owners = chunks.join(hits.select("chunk_id"), "chunk_id", "left_semi").select(F.col("parent_id").alias("id")).distinct()
    return parents.join(owners, "id", "left_semi").select("id", "n_chars").orderBy(F.desc("n_chars"), "id").limit(n)


def parent_statistics(chunks: DataFrame) -> DataFrame:
    per = chunks.groupBy("parent_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))
    return per.agg(
        F.count("*").alias("parents"), F.sum("n").alias("children"), F.round(F.avg("n"), 6).alias("mean_children"), F.max("n").alias("most"), F.sum("chars").alias("chars")
    )


def islands(hits: DataFrame, gap: int = 3) -> DataFrame:
    """(parent_id, island, start_line, end_line, n, similarity): hits of a parent whose lines lie at most ``gap`` apart."""
    line = Window.partitionBy("parent_id").orderBy("start_line", "chunk_id")
    reach = F.max("end_line").over(line.rowsBetween(Window.unboundedPreceding, -1))
    rows = hits.withColumn("_new", F.when(F.col("start_line") - reach <= gap, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("parent_id", "island").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count("*").alias("n"), F.max("similarity").alias("similarity")
    )


def strategy(hits: DataFrame, gap: int = 3) -> DataFrame:
    """(parent_id, n, widest, strategy): "contiguous" for one hit or none farther than ``gap``, "semantic" from three hits on, else "file"."""
    line = Window.partitionBy("parent_id").orderBy("start_line", "chunk_id")
    rows = hits.withColumn("_gap", F.col("start_line") - F.lag("start_line").over(line))
    rows = rows.groupBy("parent_id").agg(F.count("*").alias("n"), F.max("_gap").alias("widest"))
    kind = F.when((F.col("n") < 2) | (F.col("widest") <= gap), "contiguous").when(F.col("n") >= 3, "semantic").otherwise("file")
    return rows.withColumn("strategy", kind)


def runs_of(hits: DataFrame, label: Column) -> DataFrame:
    """(parent_id, run, label, n): stretches of hits with one label; a hit without a label carries the last one on."""
    line = Window.partitionBy("parent_id").orderBy("start_line", "chunk_id")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    rows = hits.withColumn("_label", F.last(label, ignorenulls=True).over(so_far))
    rows = rows.withColumn("_new", (~F.col("_label").eqNullSafe(F.lag("_label").over(line))).cast("int"))
    rows = rows.withColumn("run", F.sum("_new").over(so_far))
    return rows.groupBy("parent_id", "run").agg(F.first("_label").alias("label"), F.count("*").alias("n"))


def merged_files(hits: DataFrame) -> DataFrame:
    return hits.groupBy("parent_id").agg(
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("similarity").alias("similarity"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_line", "chunk_id"))), lambda c: c["chunk_id"]), ",").alias("chunk_ids"),
    )


def truncated(corpus: DataFrame, spans: DataFrame, before: int = 5, after: int = 10, most_chars: int = 2000) -> DataFrame:
    """(parent_id, n_lines, n_chars): lines around each (parent_id, start_line, end_line) span, up to ``most_chars``.

    Lines meet spans by parent; the range is a filter on that join.
    """
    lines = corpus.select(F.col("id").alias("parent_id"), F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("at", F.col("at") + 1)
    near = lines.join(spans, "parent_id").filter((F.col("at") >= F.col("start_line") - before) & (F.col("at") <= F.col("end_line") + after))
    line = Window.partitionBy("parent_id", "start_line").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_chars", F.sum(F.length("line") + 1).over(line)).filter(F.col("_chars") <= most_chars)
    return near.groupBy("parent_id", "start_line").agg(F.count("*").alias("n_lines"), F.max("_chars").alias("n_chars"))


def fixed_windows(hits: DataFrame, n: int = 200) -> DataFrame:
    """The best hit of each distinct content, cut to ``n`` characters."""
    # a partial aggregation: copies of a hot content are reduced before they are shuffled
    best = hits.groupBy(F.md5(F.col("content").cast("binary")).alias("_digest"))
    rows = best.agg(F.min_by(F.struct("chunk_id", F.left("content", F.lit(n)).alias("window")), F.struct(-F.col("similarity"), "chunk_id")).alias("b"))
    return rows.select("b.chunk_id", "b.window")


def within_budget(rows: DataFrame, by: str, order: list[str], size: Column, most: int) -> DataFrame:
    """Rows of each group, in order, while their sizes add up to ``most`` at the most; adds ``used``."""
    line = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(line)).filter(F.col("used") <= most)


def assembled(rows: DataFrame, by: str, order: str, header: Column, body: Column, separator: str = "\n\n") -> DataFrame:
    """One text a group: headers and bodies in order."""
    part = F.concat(header, F.lit("\n"), body)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p"))))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), separator).alias("context"))
