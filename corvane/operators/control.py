"""Control-loop operators: context limits, access rules, quotas, skill routing, caches, retries and reports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def minimized(results: DataFrame, limits: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(agent, query_id, id, rank, fragment): for each agent its number of documents a query, cut to its number of characters."""
    table = F.array(*[F.struct(F.lit(a).alias("agent"), F.lit(n).alias("docs"), F.lit(c).alias("chars")) for a, (n, c) in limits.items()])
    rows = results.withColumn("l", F.explode(table)).filter(F.col("rank") <= F.col("l.docs"))
    return rows.select(F.col("l.agent").alias("agent"), "query_id", "id", F.col("rank").cast("bigint").alias("rank"), F.left("content", F.col("l.chars")).alias("fragment"))


def readable(rows: DataFrame, rights: Mapping[str, Mapping[str, str]], agent: str, mode: str = "r") -> DataFrame:
    """The columns that an agent may read (or write): pruned in the plan, so others aren't even scanned."""
    allowed = rights.get(agent, {})
    return rows.select(*[c for c in rows.columns if mode in allowed.get(c, "")])


def sensitivity(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """(level, n, fields, filled): fields by their level, and how many of their values the rows have; a field that the rows lack has none."""
    held = [F.count(f) if f in rows.columns else F.lit(0).cast("bigint") for f in fields]
    found = rows.agg(F.array(*held).alias("_held"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(level).alias("level"), F.get("_held", i).alias("filled")) for i, (f, level) in enumerate(fields.items())]))
    return found.select(each.alias("e")).groupBy("e.level").agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("e.field")), ",").alias("fields"), F.sum("e.filled").alias("filled")
    )


def recent_history(messages: DataFrame, n: int) -> DataFrame:
    """(conv_id, history): turns of the last ``n`` messages of each conversation, in order."""
    turns = F.array_sort(F.collect_list("turn"))
    last = F.slice(turns, F.greatest(F.size(turns) - n + 1, F.lit(1)), n)
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(last, lambda t: t.cast("string")), ",").alias("history"))


def quota_check(usage: DataFrame, tenants: DataFrame, limits: Mapping[str, float], unit: str, as_of: str, alert: float = 0.8) -> DataFrame:
    """(tenant_id, used, most, state): usage since the period of ``as_of`` began, against the plan's limit; plans without one are "unlimited"."""
    begin = F.date_trunc(unit, F.to_timestamp(F.lit(as_of)))
    rows = usage.filter((F.col("used_at") >= begin) & (F.col("used_at") <= F.to_timestamp(F.lit(as_of)))).groupBy("tenant_id").agg(F.round(F.sum("used"), 4).alias("used"))
    most = F.lit(None).cast("double")
    for plan, value in limits.items():
        most = F.when(F.col("plan") == plan, F.lit(float(value))).otherwise(most)
    rows = rows.join(tenants, "tenant_id").withColumn("most", most)
    state = F.when(F.col("most").isNull(), "unlimited").when(F.col("used") > F.col("most"), "exceeded").when(F.col("used") > F.col("most") * alert, "alert").otherwise("ok")
    return rows.select("tenant_id", "used", "most", state.alias("state"))


def route(queries: DataFrame, triggers: Sequence[tuple[str, str, int]], default: str) -> DataFrame:
    """(query_id, skill, priority): the skill of the best (lowest) trigger word in the query; ties by name."""
    low = F.lower("query")
    options = [F.when(F.contains(low, F.lit(word)), F.struct(F.lit(p).alias("priority"), F.lit(skill).alias("skill"))) for skill, word, p in triggers]
    best = F.array_min(F.array_compact(F.array(*options)))
    return queries.select("query_id", F.coalesce(best["skill"], F.lit(default)).alias("skill"), F.coalesce(best["priority"], F.lit(10)).alias("priority"))


def switched(wishes: DataFrame, compatible: DataFrame, closest: DataFrame) -> DataFrame:
    """(id, skill): the desired skill if (current, desired) is compatible or the same, else the closest compatible one, else the current."""
    ok = compatible.select(F.col("source").alias("current"), F.col("target").alias("desired")).withColumn("_ok", F.lit(True))
    near = closest.select(F.col("source").alias("current"), F.col("target").alias("_near"))
    rows = wishes.join(ok, ["current", "desired"], "left").join(near, "current", "left")
    chosen = F.when(F.col("_ok") | (F.col("current") == F.col("desired")), F.col("desired")).otherwise(F.coalesce("_near", "current"))
    return rows.select("id", chosen.alias("skill"))


def cache_hits(logs: DataFrame, key: Column, ttl: int) -> DataFrame:
    """(log_id, hit): whether the key was asked for in the last ``ttl`` seconds."""
    line = Window.partitionBy(key).orderBy("created_at", "log_id")
    gap = F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(line))
    return logs.select("log_id", F.coalesce(gap <= ttl * 1_000_000, F.lit(False)).alias("hit"))


def retries(logs: DataFrame, most: int) -> DataFrame:
    """(session_id, log_id, attempt, action): failures in a row; from ``most`` on they are skipped."""
    line = Window.partitionBy("session_id").orderBy("created_at", "log_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = logs.withColumn("_run", F.sum((F.col("status") == "success").cast("int")).over(line)).filter(F.col("status") == "failed")
    again = Window.partitionBy("session_id", "_run").orderBy("created_at", "log_id")
    rows = rows.withColumn("attempt", F.row_number().over(again))
    return rows.select("session_id", "log_id", F.col("attempt").cast("bigint").alias("attempt"), F.when(F.col("attempt") >= most, "skip").otherwise("retry").alias("action"))


def compiled(outline: DataFrame, fragments: DataFrame) -> DataFrame:
    """(doc, script, filled): a document's outline steps in order, each with its fragment or a placeholder."""
    rows = outline.join(fragments, ["doc", "step"], "left")
    part = F.concat(F.lit("## "), F.coalesce("title", F.lit("Untitled")), F.lit("\n"), F.coalesce("content", F.lit("[missing]")))
    ordered = F.array_sort(F.collect_list(F.struct("step", part.alias("p"))))
    return rows.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias("script"), F.count("content").alias("filled"))


#: What each style is worth by the complexity of the content (fixed values); others count as 0.5, other complexities as medium.
STYLE_SCORES = {
    "high": {"detailed_explainer": 1.0, "concise_summary": 0.3}, "medium": {"standard_explainer": 0.8, "practical_guide": 0.7}, "low": {"quick_reference": 0.9, "concise_summary": 0.8},
}


def mediate(rows: DataFrame, successes: Column, complexity: Column, director: Column, writer: Column, successes_needed: int = 3) -> DataFrame:
    """(id, winner, style): the writer's style after three successes, else the one that is worth more; of equals the director's for high complexity, else the writer's."""
    table = F.create_map(*[F.lit(x) for level, styles in STYLE_SCORES.items() for style, score in styles.items() for x in (f"{level}/{style}", score)])
    known = F.when(complexity.isin(*STYLE_SCORES), complexity).otherwise("medium")

    def worth(style: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.concat_ws("/", known, style)), F.lit(0.5))

    winner = F.when(successes >= successes_needed, "writer").when(worth(director) > worth(writer), "director").when(worth(writer) > worth(director), "writer")
    winner = winner.otherwise(F.when(complexity == "high", "director").otherwise("writer"))
    return rows.select("id", winner.alias("winner"), F.when(winner == "director", director).otherwise(writer).alias("style"))


def storage(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """One row: sizes before and after, and their ratio."""
    return rows.agg(F.count("*").alias("n"), F.sum(before).alias("before"), F.sum(after).alias("after"), F.round(F.sum(after) / F.sum(before), 6).alias("ratio"))


def as_function(spark: SparkSession, sql: str, **tables: DataFrame):
    """A query text over views of ``tables``, as a function of its named parameters."""

    def call(**values) -> DataFrame:
        for name, table in tables.items():
            table.createOrReplaceTempView(name)
        return spark.sql(sql, args=values)

    return call


def table_function(spark: SparkSession, name: str, parameters: str, returns: str, sql: str, **tables: DataFrame):
    """A SQL function of the session that returns a table, over views of ``tables``, and a callable of its named parameters.

    ``sql`` names a parameter as ``:parameter``; the function stands for ``SELECT * FROM name(...)`` in any later SQL, and filters on it reach its scans.
    """
    for view, table in tables.items():
        table.createOrReplaceTempView(view)
    body = re.sub(r"(?<!:):([A-Za-z_]\w*)", rf"{name}.\1", sql)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({returns}) RETURN {body}")

    def call(**values) -> DataFrame:
        return spark.sql(f"SELECT * FROM {name}({', '.join(f'{k} => :{k}' for k in values)})", args=values)

    return call
