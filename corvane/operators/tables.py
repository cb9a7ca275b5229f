"""Table maintenance: new versions of tables instead of updates in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``: upserts, status machines, last state."""
    line = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(line)).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The table with the rows of ``new`` in place of those with their keys; of new rows with the same key the first in ``order`` (default: by all columns, largest first). Null keys are equal."""
    chosen = latest(new.select(table.columns), keys, *(order or [F.desc(c) for c in table.columns]))
    key = F.struct(*keys)
    return table.join(chosen.select(key.alias("_new_key")), key == F.col("_new_key"), "left_anti").unionByName(chosen)


def delete(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return table.join(keys, list(on), "left_anti")


def replace_prefix(table: DataFrame, new: DataFrame, column: str, prefix: str) -> DataFrame:
    """The table without rows whose ``column`` begins with ``prefix``, and the new ones."""
    return table.filter(~F.col(column).startswith(prefix)).unionByName(new.select(table.columns))


def ingest(known: DataFrame, new: DataFrame) -> DataFrame:
    """(id, hash, action): "skip" where the content's hash is indexed already, else "index"; of equal contents, the smallest id is indexed."""
    hashed = new.select("id", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))
    first = hashed.groupBy("hash").agg(F.min("id").alias("_first"))
    seen = known.select(F.sha2(F.col("content").cast("binary"), 256).alias("hash")).distinct().withColumn("_seen", F.lit(True))
    rows = hashed.join(first, "hash").join(seen, "hash", "left")
    return rows.select("id", "hash", F.when(F.col("_seen").isNotNull() | (F.col("id") != F.col("_first")), "skip").otherwise("index").alias("action"))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).offset(number * size).limit(size)


def update_from_json(table: DataFrame, updates: DataFrame, column: str, kind: str) -> DataFrame:
    """Values of ``column`` replaced from a JSON array of {id, value} in (body,) rows; adds ``updated``."""
    rows = updates.select(F.explode(F.from_json("body", f"array<struct<id: bigint, value: {kind}>>")).alias("u")).select(F.col("u.id").alias("id"), F.col("u.value").alias("_v"))
    out = table.join(rows, "id", "left")
    return out.withColumn(column, F.coalesce("_v", column)).withColumn("updated", F.col("_v").isNotNull()).drop("_v")


def reconcile(files: DataFrame, found: DataFrame) -> DataFrame:
    """(id, expected, actual, state) of (id, expected) and (id, actual): "missing", "orphaned" or "ok"."""
    rows = files.join(found, "id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    state = F.when(F.col("actual") == 0, "missing").when(F.col("actual") != F.col("expected"), "orphaned").otherwise("ok")
    return rows.select("id", "expected", "actual", state.alias("state"))


def unused(rows: DataFrame, used: DataFrame, on: Sequence[str], condition: Column) -> DataFrame:
    """Rows that nothing refers to and that ``condition`` holds for."""
    return rows.filter(condition).join(used, list(on), "left_anti")


def cleanup(sessions: DataFrame, as_of: str, most: int, old_days: int = 30, idle_days: int = 7, few: int = 3) -> DataFrame:
    """(session_id, reason) of sessions to drop: too old, little used and idle, or beyond the ``most`` last used."""
    at = F.to_timestamp(F.lit(as_of))
    age, idle = F.datediff(at, F.col("created_at")), F.datediff(at, F.col("last_at"))
    reason = F.when(age > old_days, "old").when((F.col("uses") < few) & (idle > idle_days), "idle")
    rows = sessions.withColumn("reason", reason)
    # the sessions to keep are the last used of those without a reason: ``most`` rows, a number that the caller sets
    kept = rows.filter("reason is null").orderBy(F.desc("last_at"), "session_id").limit(most).select("session_id", F.lit(True).alias("_kept"))
    rows = rows.join(kept, "session_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_kept").isNull(), "surplus").otherwise(F.col("reason")))
    return rows.filter("reason is not null").select("session_id", "reason")


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state, old, new): added, removed, changed or unchanged."""
    a, b = old.select(F.col(key).alias("_k"), F.col(value).alias("old")), new.select(F.col(key).alias("_j"), F.col(value).alias("new"))
    rows = a.join(b, F.col("_k") == F.col("_j"), "full_outer")
    state = F.when(F.col("_k").isNull(), "added").when(F.col("_j").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed").otherwise("unchanged")
    return rows.select(F.coalesce("_k", "_j").alias(key), state.alias("state"), "old", "new")


def as_of(changes: DataFrame, key: str, value: str, order: str, until: Column) -> DataFrame:
    """The last value of each key among the changes for which ``until`` holds."""
    return changes.filter(until).groupBy(key).agg(F.max_by(value, order).alias(value), F.count("*").alias("changes"))


def appended(changes: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, values): all values of a key in order, comma-joined. For keys whose log fits a cell (2 GB), such as one session's; longer logs stay rows."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).cast("string").alias("v"))))
    return changes.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["v"]), ",").alias("values"))


def stack_depth(moves: DataFrame, key: str, order: Sequence[str], push: Column, pop: Column) -> DataFrame:
    """(key, moves, end, highest) of running sums of pushes and pops."""
    line = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = moves.withColumn("_d", F.sum(F.when(push, 1).when(pop, -1).otherwise(0)).over(line))
    return rows.groupBy(key).agg(F.count("*").alias("moves"), F.max_by("_d", F.struct(*order)).alias("end"), F.max("_d").alias("highest"))


def same_bucket(key: Column, percent: int, allowed: Sequence[str] = ()) -> Column:
    """Whether a key is in the share of traffic: listed, or by its md5 digest modulo 100."""
    bucket = F.conv(F.left(F.md5(key.cast("binary")), F.lit(8)), 16, 10).cast("bigint") % 100
    return key.isin(*allowed) | (bucket < percent) if allowed else bucket < percent


def compare_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, overlap, difference): shared ids over all ids, and the mean difference of their similarities."""
    rows = a.select("query_id", "id", F.col("similarity").alias("x")).join(b.select("query_id", "id", F.col("similarity").alias("y")), ["query_id", "id"], "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return rows.groupBy("query_id").agg(
        F.round(F.count_if(both) / F.count("*"), 6).alias("overlap"), F.round(F.avg(F.when(both, F.abs(F.col("x") - F.col("y")))), 6).alias("difference")
    )


def alike(sets: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the pairs of (id, tokens) that share a token, a < b; ``tokens`` are distinct. Only sharing pairs are formed, by a join on tokens."""
    rows = sets.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    a, b = (rows.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), "token") for x in ("a", "b"))
    both = a.join(b, "token").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("both"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    return both.select("a", "b", F.round(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 6).alias("jaccard"))
