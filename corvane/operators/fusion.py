"""Rank fusion: candidate lists of several strategies become one ranking for each query.

Candidates are rows (query_id, strategy, rank, id, similarity). Everything is one grouped sum or a full outer join on
(query_id, id), then a ranking within a query; a hot document only adds rows to its own sum.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 8


def _weight(weights: Mapping[str, float], default: Column) -> Column:
    out = default
    for name, value in weights.items():
        out = F.when(F.col("strategy") == name, float(value)).otherwise(out)
    return out


def ranked(rows: DataFrame, score: str, k: int | None = None, *ties: str) -> DataFrame:
    line = Window.partitionBy("query_id").orderBy(F.desc(score), *(ties or ("id",)))
    out = rows.withColumn("rank", F.row_number().over(line))
    return out if k is None else out.filter(F.col("rank") <= k)


def weighted(candidates: DataFrame, weights: Mapping[str, float] | None = None, unknown: float = 0.5, k: int | None = None) -> DataFrame:
    """Sum of similarity times weight; without weights, one over the number of strategies of the query."""
    if weights:
        rows = candidates.withColumn("_w", _weight(weights, F.lit(float(unknown))))
    else:
        strategies = F.size(F.collect_set("strategy").over(Window.partitionBy("query_id")))
        rows = candidates.withColumn("_w", 1.0 / strategies)
    rows = rows.groupBy("query_id", "id").agg(
        F.round(F.sum(F.col("similarity") * F.col("_w")), DIGITS).alias("score"), F.array_join(F.array_sort(F.collect_set("strategy")), ",").alias("strategies")
    )
    return ranked(rows, "score", k)


def reciprocal(candidates: DataFrame, weights: Mapping[str, float] | None = None, constant: int = 60, scaled: bool = False, k: int | None = None) -> DataFrame:
    """Sum of weight / (constant + rank); ``scaled`` multiplies by the constant."""
    part = _weight(weights or {}, F.lit(1.0)) * (float(constant) if scaled else 1.0) / (F.col("rank") + constant)
    rows = candidates.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score"), F.min("rank").alias("best_rank"))
    return ranked(rows, "score", k)


def component_ranks(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """(query_id, id, sim_v, sim_k, rank_v, rank_k, is_vector, is_keyword): a missing rank is that list's length plus one."""
    v = vector.select("query_id", "id", F.col("similarity").alias("sim_v"), F.col("rank").alias("_rv"))
    w = keyword.select("query_id", "id", F.col("similarity").alias("sim_k"), F.col("rank").alias("_rk"))
    n_v, n_k = v.groupBy("query_id").agg(F.count("*").alias("_nv")), w.groupBy("query_id").agg(F.count("*").alias("_nk"))
    rows = v.join(w, ["query_id", "id"], "full_outer").join(n_v, "query_id", "left").join(n_k, "query_id", "left")
    return rows.select(
        "query_id", "id", F.coalesce("sim_v", F.lit(0.0)).alias("sim_v"), F.coalesce("sim_k", F.lit(0.0)).alias("sim_k"),
        F.coalesce("_rv", F.coalesce("_nv", F.lit(0)) + 1).cast("bigint").alias("rank_v"), F.coalesce("_rk", F.coalesce("_nk", F.lit(0)) + 1).cast("bigint").alias("rank_k"),
        F.col("_rv").isNotNull().alias("is_vector"), F.col("_rk").isNotNull().alias("is_keyword"),
    )


def reciprocal_with_components(vector: DataFrame, keyword: DataFrame, w_v: float = 0.6, w_k: float = 0.4, constant: int = 60) -> DataFrame:
    rows = component_ranks(vector, keyword)
    score = F.when(F.col("is_vector"), w_v / (F.col("rank_v") + constant)).otherwise(0.0) + F.when(F.col("is_keyword"), w_k / (F.col("rank_k") + constant)).otherwise(0.0)
    return ranked(rows.withColumn("score", F.round(score, DIGITS)), "score")


def hybrid_service(vector: DataFrame, keyword: DataFrame, k: int = 10, least: float = 0.3, constant: int = 60) -> DataFrame:
    """The top k by reciprocal ranks, then 0.3 similarity + 0.5 reciprocal + 0.2 / (1 + ln(rank sum)), kept at ``least``."""
    rows = component_ranks(vector, keyword)
    rrf = 0.6 / (F.col("rank_v") + constant) + 0.4 / (F.col("rank_k") + constant)
    rows = ranked(rows.withColumn("rrf", F.round(rrf, DIGITS)), "rrf", k).drop("rank")
    fused = 0.3 * F.greatest("sim_v", "sim_k") + 0.5 * F.col("rrf") + 0.2 / (1 + F.log((F.col("rank_v") + F.col("rank_k")).cast("double")))
    rows = rows.withColumn("fused", F.round(fused, DIGITS)).filter(F.col("fused") >= least)
    return ranked(rows.select("query_id", "id", "rrf", "fused"), "fused")


def merge_two(vector: DataFrame, keyword: DataFrame, w_v: float = 0.6, w_k: float = 0.4, k: int = 10) -> DataFrame:
    rows = component_ranks(vector, keyword)
    rows = rows.withColumn("score", F.round(F.col("sim_v") * w_v + F.col("sim_k") * w_k, DIGITS))
    return ranked(rows.select("query_id", "id", "score", "is_vector", "is_keyword"), "score", k)


def fusion(candidates: DataFrame, alpha: float = 0.5, k: int = 10) -> DataFrame:
    """alpha of the weighted score and the rest of the reciprocal one, each over its best, from the top 2k of each."""
    candidates = candidates.repartition("query_id", "id")  # one exchange for both sums
    w = weighted(candidates, None, k=2 * k).select("query_id", "id", F.col("score").alias("w"))
    r = reciprocal(candidates, scaled=True, k=2 * k).select("query_id", "id", F.col("score").alias("r"))
    best_w, best_r = (t.groupBy("query_id").agg(F.max(c).alias(f"best_{c}")) for t, c in ((w, "w"), (r, "r")))
    rows = w.join(r, ["query_id", "id"], "full_outer").join(best_w, "query_id", "left").join(best_r, "query_id", "left")
    score = alpha * F.coalesce(F.try_divide("w", "best_w"), F.lit(0.0)) + (1 - alpha) * F.coalesce(F.try_divide("r", "best_r"), F.lit(0.0))
    return ranked(rows.select("query_id", "id", F.round(score, DIGITS).alias("score")), "score", k)


def navigator(primary: DataFrame, secondary: DataFrame, w_1: float = 0.7, w_2: float = 0.3, k: int = 10) -> DataFrame:
    """(query_id, source, id, confidence): weighted union, the best of each source. A query with one list only keeps its confidences."""
    a = primary.select("query_id", "id", "source", F.col("similarity").alias("_c"), F.lit(1).alias("_side"))
    b = secondary.select("query_id", "id", "source", F.col("similarity").alias("_c"), F.lit(2).alias("_side"))
    # one exchange of the union serves all windows of a query; the union is never joined with itself
    rows = a.unionByName(b).repartition("query_id")
    sides = F.size(F.collect_set("_side").over(Window.partitionBy("query_id")))
    rows = rows.withColumn("_sides", sides)
    weight = F.when(F.col("_sides") < 2, 1.0).when(F.col("_side") == 1, w_1).otherwise(w_2)
    rows = rows.withColumn("confidence", F.round(F.col("_c") * weight, DIGITS))
    best = Window.partitionBy("query_id", "source").orderBy(F.desc("confidence"), "id", "_side")
    rows = rows.withColumn("_n", F.row_number().over(best)).filter("_n = 1")
    return ranked(rows.select("query_id", "source", "id", "confidence"), "confidence", k, "id", "source")


def round_robin(candidates: DataFrame, k: int, order: list[str]) -> DataFrame:
    """(query_id, id, rank): strategies take turns with their first unused id; the k taken are ranked by similarity.

    Each query's lists are ranked top-k lists, so a group is small.
    """

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [rows[rows["strategy"] == s].sort_values(["rank", "id"])[["id", "similarity"]].values.tolist() for s in order]
        taken: dict[int, float] = {}
        for _ in range(3 * k):
            for one in lists:
                while one and int(one[0][0]) in taken:
                    one.pop(0)
                if one and len(taken) < k:
                    found, similarity = one.pop(0)
                    taken[int(found)] = similarity
        final = sorted(taken.items(), key=lambda p: (-p[1], p[0]))
        return pd.DataFrame([(rows["query_id"].iloc[0], i, s, n + 1) for n, (i, s) in enumerate(final)], columns=["query_id", "id", "similarity", "rank"])

    return candidates.groupBy("query_id").applyInPandas(deal, "query_id bigint, id bigint, similarity double, rank bigint")


#: Strategies and mergers by name: functions from DataFrames to DataFrames.
STRATEGIES: dict[str, Callable[..., DataFrame]] = {}
MERGERS: dict[str, Callable[..., DataFrame]] = {}


def register(registry: dict[str, Callable[..., DataFrame]], name: str, function: Callable[..., DataFrame] | None) -> None:
    """Adds a function under a name, or with None takes it away."""
    if function is None:
        registry.pop(name, None)
    else:
        registry[name] = function


def searched(strategies: Sequence[str], *tables: DataFrame, k: int) -> DataFrame:
    """(query_id, strategy, rank, id, similarity) of the named strategies, in one union."""
    columns = ["query_id", "strategy", "rank", "id", "similarity"]
    parts = [STRATEGIES[name](*tables, k=k).withColumn("strategy", F.lit(name)).select(columns) for name in strategies]
    return reduce(DataFrame.unionByName, parts)


def first_by(rows: DataFrame, by: str, *order: str | Column) -> DataFrame:
    """The first row of each query and ``by``: dedupe by path, source or content hash."""
    line = Window.partitionBy("query_id", by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(line)).filter("_n = 1").drop("_n")


def multi_query(candidates: DataFrame, weights: Mapping[str, float], k: int = 10) -> DataFrame:
    """The first variant's similarity, or a later one's times its weight if that is more."""
    value = F.col("similarity") * _weight(weights, F.lit(1.0))
    first = F.min_by("similarity", F.struct("strategy", "rank"))
    rows = candidates.groupBy("query_id", "id").agg(F.round(F.greatest(first, F.max(value)), DIGITS).alias("score"))
    return ranked(rows, "score", k)


def variant_merge(candidates: DataFrame, k: int = 10) -> DataFrame:
    """The best similarity, times 1 + 0.1 for each variant that found the id."""
    rows = candidates.groupBy("query_id", "id").agg(F.round(F.max("similarity") * (1 + 0.1 * F.count_distinct("strategy")), DIGITS).alias("score"))
    return ranked(rows, "score", k)


def variants(queries: DataFrame, templates: Mapping[str, float]) -> DataFrame:
    """(query_id, variant, query, weight): each query in each template (with ``{}`` for it)."""
    options = [
        F.struct(F.lit(i).alias("variant"), F.replace(F.lit(t), F.lit("{}"), F.col("query")).alias("query"), F.lit(float(w)).alias("weight"))
        for i, (t, w) in enumerate(templates.items())
    ]
    return queries.select("query_id", F.explode(F.array(*options)).alias("v")).select("query_id", "v.variant", "v.query", "v.weight")


#: The mergers of this module that take candidates and ``k``.
MERGERS |= {"weighted": weighted, "rrf": reciprocal, "fusion": fusion, "variants": variant_merge}
