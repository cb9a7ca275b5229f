"""Aggregations over call, execution, usage and audit logs.

Every operator takes an ``as_of`` timestamp where a view looks back from the present, so results are
reproducible. All are single partial aggregations: a hot provider, session or tenant is summed before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import numbered


def since(logs: DataFrame, as_of: str, span: str, at: str = "created_at") -> DataFrame:
    """Rows of the ``span`` (an interval, like "24 hours") up to ``as_of``."""
    end = F.to_timestamp(F.lit(as_of))
    return logs.filter((F.col(at) > end - F.expr(f"INTERVAL '{span.split()[0]}' {span.split()[1].rstrip('s').upper()}")) & (F.col(at) <= end))


def _stamp(unit: str, at: str = "created_at") -> Column:
    return F.date_format(F.date_trunc(unit, F.col(at)), "yyyy-MM-dd HH:mm:ss")


def call_statistics(logs: DataFrame, as_of: str, span: str = "24 hours") -> DataFrame:
    """Hourly calls by provider: count, mean, interpolated 95th and 99th percentiles, tokens and failures."""
    rows = since(logs, as_of, span)
    return rows.groupBy("provider", _stamp("hour").alias("hour")).agg(
        F.count("*").alias("calls"),
        F.round(F.avg("duration"), 6).alias("avg_duration"),
        F.round(F.percentile("duration", F.lit(0.95)), 6).alias("p95_duration"),
        F.round(F.percentile("duration", F.lit(0.99)), 6).alias("p99_duration"),
        F.sum("tokens").alias("tokens"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def execution_statistics(logs: DataFrame, unit: str = "hour") -> DataFrame:
    return logs.groupBy("provider", _stamp(unit).alias("period")).agg(
        F.count("*").alias("executions"), F.round(F.avg("duration"), 6).alias("avg_duration"), F.max("duration").alias("max_duration")
    )


def usage_summary(usage: DataFrame, tenants: DataFrame, limits: Mapping[str, float], as_of: str, span: str = "30 days") -> DataFrame:
    """Daily usage by plan and resource with the share of the plan's limit; tenants unknown to ``tenants`` don't count."""
    rows = since(usage, as_of, span, "used_at").join(tenants, "tenant_id")
    limit = F.lit(None).cast("double")
    for plan, most in limits.items():
        limit = F.when(F.col("plan") == plan, F.lit(float(most))).otherwise(limit)
    grouped = rows.groupBy("plan", "resource", _stamp("day", "used_at").alias("day")).agg(
        F.round(F.sum("used"), 4).alias("used"), F.max("used").alias("largest"), F.count_distinct("tenant_id").alias("tenants")
    )
    return grouped.withColumn("percent", F.round(F.try_divide(F.col("used") * 100, limit), 2))


def daily_cost(usage: DataFrame, as_of: str, span: str = "30 days") -> DataFrame:
    rows = since(usage, as_of, span, "used_at")
    return rows.groupBy(_stamp("day", "used_at").alias("day")).agg(
        F.count("*").alias("requests"), F.round(F.sum("cost"), 2).alias("cost"), F.round(F.sum("used"), 2).alias("used"), F.count_distinct("tenant_id").alias("tenants")
    )


def popular(logs: DataFrame, by: Sequence[str | Column], n: int = 100, value: str = "tokens") -> DataFrame:
    """The ``n`` most frequent groups: a top-k report."""
    names = [f"group_{i}" for i in range(len(by))]
    keys = [(F.col(b) if isinstance(b, str) else b).alias(name) for b, name in zip(by, names, strict=True)]
    rows = logs.groupBy(*keys).agg(F.count("*").alias("hits"), F.sum(value).alias("total"))
    return rows.orderBy(F.desc("hits"), *names).limit(n)


def grouped_statistics(logs: DataFrame, by: Sequence[str], value: str = "duration", digits: int = 6) -> DataFrame:
    """Counts, conditional counts, mean, extremes, population deviation and distinct sessions of each group (or of all rows)."""
    measures = [
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.round(F.avg(value), digits).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        F.round(F.stddev_pop(value), digits).alias("deviation"),
        F.count_distinct("session_id").alias("sessions"),
    ]
    return logs.groupBy(*by).agg(*measures) if by else logs.agg(*measures)


def document_statistics(corpus: DataFrame) -> DataFrame:
    """One row: documents, conditional counts, sizes, and the number of documents by language as JSON."""
    by_language = corpus.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.count_if(F.col("n_chars") > 5000).alias("long")
    )
    entry = F.concat(F.lit('"'), F.col("language"), F.lit('":'), F.col("n").cast("string"))
    return by_language.agg(
        F.sum("n").alias("documents"),
        F.sum("chars").alias("chars"),
        F.sum("long").alias("long_documents"),
        F.round(F.sum("chars") / F.sum("n"), 4).alias("avg_chars"),
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("languages"),
    )


def coverage(rows: DataFrame, column: str) -> DataFrame:
    """Share of rows with a value in ``column``, in percent."""
    return rows.agg(F.count("*").alias("n"), F.count(column).alias("filled"), F.round(F.avg(F.col(column).isNotNull().cast("double")) * 100, 4).alias("percent"))


def transitions(logs: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent consecutive pairs of providers within a session."""
    line = Window.partitionBy("session_id").orderBy("created_at", "log_id")
    rows = logs.withColumn("previous", F.lag("provider").over(line)).filter("previous is not null")
    return rows.groupBy("previous", "provider").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "previous", "provider").limit(n)


def last_rows(logs: DataFrame, by: str, n: int = 10) -> DataFrame:
    line = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("log_id"))
    return logs.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= n)


def trigger_effectiveness(logs: DataFrame, n: int = 20) -> DataFrame:
    """Sessions with most calls and the providers that they used."""
    rows = logs.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    return rows.orderBy(F.desc("n"), "session_id").limit(n)


def histogram(rows: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts of ``value`` in [0, 1] by equal bins; the last bin has 1."""
    at = F.least(F.floor(value * bins), F.lit(bins - 1)).cast("bigint")
    return rows.select(at.alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


def dominant(logs: DataFrame, by: str = "session_id", value: str = "provider") -> DataFrame:
    """The most frequent value of each group (ties: the smaller)."""
    counts = logs.groupBy(by, value).agg(F.count("*").alias("n"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(by).agg(best.alias("dominant"), F.max("n").alias("n"), F.sum("n").alias("total"))


def token_cost(logs: DataFrame, prices: DataFrame, default_in: float = 0.01, default_out: float = 0.03) -> DataFrame:
    """Cost by provider from (provider, price_in, price_out) per million tokens; input and output tokens as (tokens, duration)."""
    rows = logs.join(prices, "provider", "left")
    cost = (F.coalesce("tokens", F.lit(0)) * F.coalesce("price_in", F.lit(default_in)) + F.col("duration") * F.coalesce("price_out", F.lit(default_out))) / 1e6
    return rows.groupBy("provider").agg(F.round(F.sum(cost), 6).alias("cost"))


def budget(logs: DataFrame, daily_tokens: float) -> DataFrame:
    """Tokens spent so far on each session's day, and how tight the budget is."""
    line = Window.partitionBy("session_id", "day").orderBy("created_at", "log_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = logs.withColumn("day", _stamp("day")).withColumn("spent", F.sum(F.coalesce("tokens", F.lit(0))).over(line))
    share = F.col("spent") / F.lit(float(daily_tokens))
    level = F.when(share < 0.2, "low").when(share < 0.5, "medium").when(share < 0.8, "high").otherwise("critical")
    return rows.select("log_id", "session_id", "day", "spent", level.alias("level"), (share > 1).alias("over"))


def cumulative_buckets(logs: DataFrame, bounds: Sequence[float], value: str = "duration") -> DataFrame:
    """Counts of values up to each bound, as in a monitoring histogram, in one pass."""
    counts = [F.count_if(F.col(value) <= float(b)).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return logs.groupBy("provider").agg(*counts, F.count(value).alias("le_inf"), F.round(F.sum(value), 4).alias("total"))


def latency_percentiles(logs: DataFrame, as_of: str, span: str) -> DataFrame:
    rows = since(logs, as_of, span)
    return rows.agg(
        F.count("*").alias("n"),
        F.round(F.percentile("duration", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("duration", F.lit(0.95)), 6).alias("p95"),
        F.round(F.percentile("duration", F.lit(0.99)), 6).alias("p99"),
        F.round(F.avg("duration"), 6).alias("mean"),
    )


def throughput(logs: DataFrame, seconds: int = 3600) -> DataFrame:
    """Rows a second in tumbling windows."""
    slot = F.date_format(F.window("created_at", f"{seconds} seconds")["start"], "yyyy-MM-dd HH:mm:ss")
    return logs.groupBy(slot.alias("start")).agg(F.count("*").alias("n"), F.round(F.count("*") / F.lit(float(seconds)), 8).alias("per_second"))


def rates(logs: DataFrame, hit: Column, by: Sequence[str] = ("provider",)) -> DataFrame:
    """Share of rows for which ``hit`` holds: error rates, cache hit rates."""
    return logs.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(hit.cast("double")), 6).alias("rate"))


def degradation(logs: DataFrame, as_of: str, base_span: str, now_span: str, drop: float = 0.15, least: tuple[int, int] = (10, 5)) -> DataFrame:
    """Mean of the recent span against the base span before it, from one scan."""
    end = F.to_timestamp(F.lit(as_of))
    unit = lambda s: F.expr(f"INTERVAL '{s.split()[0]}' {s.split()[1].rstrip('s').upper()}")
    rows = logs.filter((F.col("created_at") <= end) & (F.col("created_at") > end - unit(base_span)))
    now = F.col("created_at") > end - unit(now_span)
    sums = rows.agg(
        F.count_if(~now).alias("n_base"), F.count_if(now).alias("n_now"),
        F.round(F.avg(F.when(~now, F.col("duration"))), 6).alias("base"), F.round(F.avg(F.when(now, F.col("duration"))), 6).alias("recent"),
    )
    enough = (F.col("n_base") >= least[0]) & (F.col("n_now") >= least[1])
    worse = enough & (F.try_divide(F.col("base") - F.col("recent"), F.col("base")) > drop)
    return sums.withColumn("degraded", F.coalesce(worse, F.lit(False)))


def alerts(logs: DataFrame, p95: float, errors: float) -> DataFrame:
    """One row for each alert that a provider raises."""
    sums = logs.groupBy("provider").agg(F.percentile("duration", F.lit(0.95)).alias("p95"), F.avg((F.col("status") == "failed").cast("double")).alias("error_rate"))
    raised = F.array_compact(F.array(F.when(F.col("p95") > p95, "slow"), F.when(F.col("error_rate") > errors, "errors")))
    return sums.select("provider", F.explode(raised).alias("alert"))


def nearest_rank(logs: DataFrame, share: float = 0.99, by: str = "provider") -> DataFrame:
    """The value at place floor(n * share) (from 0) of each sorted group. All rows are numbered in one order dealt by ranges, so a group is no task of its own."""
    rows = numbered(logs.select(by, "duration", "log_id"), [by, "duration", "log_id"])
    groups = rows.groupBy(F.struct(by).alias("_g")).agg(F.min("pos").alias("_first"), F.count("*").alias("n"))  # a row a group
    at = F.col("_first") + F.least(F.floor(F.col("n") * share), F.col("n") - 1)
    return rows.join(groups.select("n", at.alias("pos")), "pos").select(by, "n", F.col("duration").alias("value"))


def sessions(logs: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Activity sessions: rows of one user with no gap longer than ``gap``."""
    slot = F.session_window("created_at", gap)
    return logs.groupBy("session_id", slot.alias("w")).agg(F.count("*").alias("n")).groupBy("session_id").agg(F.count("*").alias("visits"), F.max("n").alias("longest"))


def sliding_rates(logs: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    slot = F.date_format(F.window("created_at", width, step)["start"], "yyyy-MM-dd HH:mm:ss")
    return logs.groupBy(slot.alias("start")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))


def failure_pattern(logs: DataFrame, kind: Column | None = None) -> DataFrame:
    """Of each session's failed calls: how many, over how many whole seconds, the most tokens, and by ``kind`` (default: the tokens' size in tens) the most frequent
    (the first to occur of several) with its count, and all counts as text."""
    kind = F.floor(F.col("tokens") / 10).cast("string") if kind is None else kind
    kinds = logs.filter(F.col("status") == "failed").groupBy("session_id", F.coalesce(kind, F.lit("none")).alias("kind")).agg(
        F.count("*").alias("n"), F.min(F.struct("created_at", "log_id")).alias("first"), F.max("created_at").alias("last"), F.max("tokens").alias("tokens")
    )
    seconds = F.unix_timestamp(F.max("last")) - F.unix_timestamp(F.min("first.created_at"))
    counts = F.array_sort(F.collect_list(F.struct("kind", "n")))  # a kind each
    rows = kinds.groupBy("session_id").agg(
        F.sum("n").alias("failures"), seconds.alias("seconds"), F.max("tokens").alias("most_tokens"),
        F.min_by(F.struct("kind", "n"), F.struct(-F.col("n"), "first")).alias("top"),
        F.array_join(F.transform(counts, lambda c: F.concat_ws(":", c["kind"], c["n"].cast("string"))), ",").alias("distribution"),
    )
    return rows.select("session_id", "failures", "seconds", "most_tokens", F.col("top.kind").alias("pattern"), F.col("top.n").alias("frequency"), "distribution", (F.col("failures") >= 3).alias("escalate"))


def loops(logs: DataFrame, repeats: int = 7, last: int = 10) -> DataFrame:
    """Calls at which one provider makes more than ``repeats`` of a session's last ``last`` calls."""
    line = Window.partitionBy("session_id").orderBy("created_at", "log_id").rowsBetween(1 - last, 0)
    rows = logs.withColumn("recent", F.collect_list("provider").over(line))
    same = F.size(F.filter("recent", lambda p: p == F.col("provider")))
    return rows.select("log_id", "session_id", same.cast("bigint").alias("repeats")).filter(F.col("repeats") > repeats)


def threshold_crossings(logs: DataFrame, limit: float) -> DataFrame:
    """Calls at which a session's running mean duration goes over or back under ``limit``: edges, not levels."""
    so_far = Window.partitionBy("session_id").orderBy("created_at", "log_id").rowsBetween(Window.unboundedPreceding, 0)
    line = Window.partitionBy("session_id").orderBy("created_at", "log_id")
    rows = logs.withColumn("_over", F.round(F.avg("duration").over(so_far), 6) > limit)
    rows = rows.withColumn("_before", F.coalesce(F.lag("_over").over(line), F.lit(False)))
    return rows.filter("_over <> _before").select("log_id", "session_id", F.when(F.col("_over"), "raised").otherwise("cleared").alias("edge"))
