"""Filters with optional parts over logs and documents, status machines, and reports of failures and negotiations.

An optional part that isn't given adds nothing to the plan; those given are one conjunction that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matching(rows: DataFrame, equal: Mapping[str, object] | None = None, among: Mapping[str, Sequence] | None = None, at: str = "created_at", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows for which all given parts hold: equal values and listed values (None: any), and times from ``start`` to ``end``."""
    parts = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    parts += [F.col(c).isin(*v) for c, v in (among or {}).items() if v is not None]
    parts += [F.col(at) >= F.to_timestamp(F.lit(start))] if start is not None else []
    parts += [F.col(at) <= F.to_timestamp(F.lit(end))] if end is not None else []
    return rows.filter(reduce(lambda a, b: a & b, parts)) if parts else rows


def audit_page(rows: DataFrame, key: str, limit: int = 100, offset: int = 0, at: str = "created_at", **filters) -> DataFrame:
    """A page of the matching rows, newest first."""
    return matching(rows, at=at, **filters).orderBy(F.desc(at), key).offset(offset).limit(limit)


def audit_statistics(rows: DataFrame, by: Sequence[str], user: str, **filters) -> DataFrame:
    """(by.., n, users): rows and distinct users."""
    return matching(rows, **filters).groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(user).alias("users"))


def with_metadata(rows: DataFrame, category: str | None = None, source: str | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """Rows with the category, the source and all of the tags, as far as they are given."""
    rows = matching(rows, {"category": category, "source": source})
    return rows.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in tags]), F.col("tags"))) == 0) if tags else rows


def any_flag(rows: DataFrame, wanted: Mapping[str, bool | None]) -> DataFrame:
    """Rows with one of the wanted flags at least, and ``matches``, their number; None asks for nothing, and with no flag asked for all rows pass."""
    asked = [name for name, want in wanted.items() if want]
    if not asked:
        return rows.withColumn("matches", F.lit(0))
    return rows.withColumn("matches", sum((F.coalesce(F.col(a), F.lit(False)).cast("int") for a in asked), F.lit(0))).filter("matches > 0")


def statuses(events: DataFrame, key: str, status: str, order: Sequence[str], allowed: Mapping[str, Sequence[str]], initial: str) -> DataFrame:
    """(key, status, rejected): the last status of each key and the number of steps that its last reported status doesn't allow.

    A step is judged against the one reported before it, so that it is one window, without a loop.
    """
    line = Window.partitionBy(key).orderBy(*order)
    before = F.coalesce(F.lag(status).over(line), F.lit(initial))
    pairs = F.lit(False)
    for a, bs in allowed.items():
        pairs = pairs | ((before == a) & F.col(status).isin(*bs))
    rows = events.withColumn("_ok", pairs)
    return rows.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count_if(~F.col("_ok")).alias("rejected"))


def touched(table: DataFrame, new: DataFrame, keys: Sequence[str], as_of: str) -> DataFrame:
    """``table`` after an upsert of ``new``, with ``updated_at``: ``as_of`` where a row is new or changed, else what it was."""
    columns = [c for c in table.columns if c not in (*keys, "updated_at")]
    newer = new.select(*keys, F.struct(*columns).alias("_new"))
    rows = table.select(*keys, F.struct(*columns).alias("_old"), "updated_at").join(newer, list(keys), "full_outer")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    value = F.coalesce("_new", "_old")
    return rows.select(*keys, *[value[c].alias(c) for c in columns], F.when(changed, F.to_timestamp(F.lit(as_of))).otherwise(F.col("updated_at")).alias("updated_at"))


def timing_report(rows: DataFrame, agent: str, duration: str) -> DataFrame:
    return rows.groupBy(agent).agg(
        F.count("*").alias("n"), F.round(F.avg(duration), 6).alias("mean"), F.max(duration).alias("longest"), F.min(duration).alias("shortest")
    )


def failure_history(rows: DataFrame, as_of: str, seconds: int = 3600) -> DataFrame:
    """Failures in the last ``seconds`` before ``as_of``."""
    end = F.to_timestamp(F.lit(as_of))
    return rows.filter((F.col("status") == "failed") & (F.col("created_at") <= end) & (F.col("created_at") > end - F.expr(f"INTERVAL '{seconds}' SECOND")))


def adjustments(failures: DataFrame, strategies: Mapping[str, str], escalate: int = 3) -> DataFrame:
    """(agent, kind, n, strategy): what to do about each kind of failure; from ``escalate`` failures on it goes up."""
    rows = failures.groupBy("agent", "kind").agg(F.count("*").alias("n"))
    strategy = F.lit("retry")
    for kind, value in strategies.items():
        strategy = F.when(F.col("kind") == kind, value).otherwise(strategy)
    return rows.withColumn("strategy", F.when(F.col("n") >= escalate, "escalate").otherwise(strategy))


def negotiation_statistics(rows: DataFrame, resolved: Column, recent: Column) -> DataFrame:
    """One row: (n, recent, resolved, rate)."""
    return rows.agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"), F.count_if(resolved).alias("resolved"), F.round(F.count_if(resolved) / F.count("*"), 6).alias("rate"))


def content_fallback(results: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """(query_id, types, difficulty): content types of the flags that some result has, and 0.5 and a ten-thousandth of the last result's length, 0.9 at most."""
    types = F.array_compact(F.array(*[F.when(F.bool_or(flag), kind) for flag, kind in flags.items()]))
    difficulty = F.least(0.5 + F.max_by(F.length("content"), F.col("rank")) / 1e4, F.lit(0.9))
    return results.groupBy("query_id").agg(F.array_join(types, ",").alias("types"), F.round(difficulty, 6).alias("difficulty"))


def primary_adjustment(rows: DataFrame, topics: Column, difficulty: Column, wants_switch: Column, weights: Mapping[str, float]) -> DataFrame:
    """(query_id, adjustment, weight): of a skill switch, a branch (more than three topics) and an emphasis (easy or hard), the one of most weight, else "none"."""
    options = {"switch": wants_switch, "branch": topics > 3, "emphasis": (difficulty < 0.3) | (difficulty > 0.7)}
    structs = [F.when(options[k], F.struct(F.lit(float(w)).alias("weight"), F.lit(k).alias("name"))) for k, w in weights.items()]
    best = F.array_max(F.array_compact(F.array(*structs)))
    return rows.select("query_id", F.coalesce(best["name"], F.lit("none")).alias("adjustment"), F.coalesce(best["weight"], F.lit(0.0)).alias("weight"))
