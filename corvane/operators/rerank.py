"""Reranking, diversity and cutoffs over the ranked candidates of each query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.fusion import DIGITS, ranked

#: Stop words of the keyword factor (fixed values).
STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was",
    "are", "的", "了", "在", "是", "我", "有", "和", "就", "不",
)


def keyword_factor(query: Column, content: Column) -> Column:
    """Share of the query's keywords that the content has; 0.5 without keywords."""
    words = X.keywords(query, STOPWORDS, 3)
    low = F.lower(content)
    hits = F.size(F.filter(words, lambda w: F.contains(low, w)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(words).cast("double")), F.lit(0.5))


def recency_factor(at: Column, as_of: str) -> Column:
    days = F.datediff(F.to_date(F.lit(as_of)), at)
    return F.coalesce(F.least(F.exp(-days / 30.0), F.lit(1.0)), F.lit(0.5))


def popularity_factor(count: Column) -> Column:
    return F.least(F.log1p(F.coalesce(count, F.lit(0)).cast("double")) / F.log(F.lit(101.0)), F.lit(1.0))


def multi_factor(rows: DataFrame, as_of: str, weights: Sequence[float] = (0.4, 0.3, 0.2, 0.1), boosts: Mapping[str, float] | None = None) -> DataFrame:
    """Ranks all (query_id, query, id, content, similarity, at, uses, <flags>) rows by a weighted sum of four factors and the boosts of flags."""
    w_sim, w_key, w_new, w_use = weights
    score = (
        w_sim * F.col("similarity")
        + w_key * keyword_factor(F.col("query"), F.col("content"))
        + w_new * recency_factor(F.col("at"), as_of)
        + w_use * popularity_factor(F.col("uses"))
    )
    for flag, boost in (boosts or {}).items():
        score = score * F.when(F.col(flag), float(boost)).otherwise(1.0)
    return ranked(rows.select("query_id", "id", F.round(score, 6).alias("score")), "score")


def fallback(rows: DataFrame) -> DataFrame:
    """0.6 similarity, 0.3 keyword share, 0.1 length score."""
    score = 0.6 * F.col("similarity") + 0.3 * keyword_factor(F.col("query"), F.col("content")) + 0.1 * X.length_score(F.col("content"))
    return ranked(rows.select("query_id", "id", F.round(score, 6).alias("score")), "score")


def cross_scores(rows: DataFrame, score: str, batch: int = 32, w_sim: float = 0.6, w_cross: float = 0.4, least: float = 0.0) -> DataFrame:
    """Model scores, scaled to 0..1 within each batch of ranks (0.5 where all are equal), mixed with the similarity."""
    part = Window.partitionBy("query_id", F.floor((F.col("rank") - 1) / batch))
    low, high = F.min(score).over(part), F.max(score).over(part)
    scaled = F.coalesce(F.try_divide(F.col(score) - low, high - low), F.lit(0.5))
    rows = rows.withColumn("cross_score", F.round(scaled, 6))
    rows = rows.withColumn("score", F.round(F.col("similarity") * w_sim + F.col("cross_score") * w_cross, 6)).filter(F.col("score") >= least)
    return ranked(rows.select("query_id", "id", "cross_score", "score"), "score")


def diverse(rows: DataFrame, k: int, most: float = 0.85) -> DataFrame:
    """Greedy in rank order: drops what shares more than ``most`` of its tokens with something kept; k or fewer rows pass.

    A query's candidates are a top-k list, so a group is small.
    """

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["rank", "id"])
        sets = [set((c or "").lower().split()) for c in table["content"]]
        kept: list[int] = []
        for i, tokens in enumerate(sets):
            if len(table) <= k or all(len(tokens & sets[j]) <= most * len(tokens | sets[j]) for j in kept):
                kept.append(i)
            if len(kept) == k and len(table) > k:
                break
        return table.iloc[kept].assign(place=range(1, len(kept) + 1))[["query_id", "id", "place"]]

    return rows.select("query_id", "rank", "id", "content").groupBy("query_id").applyInPandas(choose, "query_id bigint, id bigint, place bigint")


def marginal_relevance(rows: DataFrame, k: int, weight: float = 0.5, same_source: float = 0.9) -> DataFrame:
    """Greedy: the most of weight * similarity less the rest of the largest likeness to what was taken (one source: ``same_source``)."""

    def choose(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(["rank", "id"], ignore_index=True)
        sets, left, taken = [set((c or "").lower().split()) for c in table["content"]], list(range(len(table))), []

        def alike(i: int, j: int) -> float:
            if table["source"][i] == table["source"][j]:
                return same_source
            return len(sets[i] & sets[j]) / max(len(sets[i] | sets[j]), 1)

        while left and len(taken) < k:
            value = {i: round(weight * table["similarity"][i] - (1 - weight) * max((alike(i, j) for j in taken), default=0.0), 9) for i in left}
            best = left[0] if not taken else max(left, key=lambda i: (value[i], -i))
            taken.append(best)
            left.remove(best)
        return table.iloc[taken].assign(place=range(1, len(taken) + 1))[["query_id", "id", "place"]]

    return rows.select("query_id", "rank", "id", "content", "source", "similarity").groupBy("query_id").applyInPandas(choose, "query_id bigint, id bigint, place bigint")


def with_drops(rows: DataFrame, score: str = "similarity") -> DataFrame:
    """Adds ``drop``: the relative fall from the score one rank above (null at the first, or below a score of 0)."""
    line = Window.partitionBy("query_id").orderBy("rank")
    above = F.lag(score).over(line)
    return rows.withColumn("drop", F.when(above > 0, (above - F.col(score)) / above))


def adaptive_cutoff(rows: DataFrame, complexity: Column, base: float = 0.65, factor: float = 0.2, floor: float = 0.55, cliff: float = 0.2, cap: int = 20) -> DataFrame:
    """Rows before the first cliff, if the best score reaches the threshold, else before the first score under it; ``cap`` at most.

    The threshold is base + (0.5 - complexity) * factor, at least ``floor``.
    """
    every = Window.partitionBy("query_id")
    rows = with_drops(rows).withColumn("threshold", F.round(F.greatest(base + (0.5 - complexity) * factor, F.lit(floor)), 6))
    first_cliff = F.min(F.when(F.col("drop") > cliff, F.col("rank"))).over(every)
    first_low = F.min(F.when(F.col("similarity") < F.col("threshold"), F.col("rank"))).over(every)
    top = F.max("similarity").over(every)
    rows = rows.withColumn("_cut", F.coalesce(F.when(top >= F.col("threshold"), first_cliff), first_low))
    return rows.filter((F.col("rank") < F.coalesce("_cut", F.lit(1 << 30))) & (F.col("rank") <= cap)).select("query_id", "id", "rank", "similarity", "threshold")


def cliff_cutoff(rows: DataFrame, cliff: float = 0.2, cap: int = 10) -> DataFrame:
    """The first ``cap`` rows, up to the first cliff among them."""
    every = Window.partitionBy("query_id")
    rows = with_drops(rows.filter(F.col("rank") <= cap)).withColumn("_cut", F.min(F.when(F.col("drop") > cliff, F.col("rank"))).over(every))
    return rows.filter(F.col("rank") < F.coalesce("_cut", F.lit(1 << 30))).select("query_id", "id", "rank", "similarity")


def hybrid_cutoff(rows: DataFrame, least: float = 0.6, cliff: float = 0.2, cap: int = 15) -> DataFrame:
    """Up to the first cliff, if there is one, else all rows with ``least``; ``cap`` at most."""
    every = Window.partitionBy("query_id")
    rows = with_drops(rows).withColumn("_cut", F.min(F.when(F.col("drop") > cliff, F.col("rank"))).over(every))
    kept = rows.filter(F.when(F.col("_cut").isNotNull(), F.col("rank") < F.col("_cut")).otherwise(F.col("similarity") >= least))
    line = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= cap).select("query_id", "id", "rank", "similarity")


def per_group(rows: DataFrame, by: str, n: int) -> DataFrame:
    """At most ``n`` rows of a query for each value of ``by``, in rank order."""
    line = Window.partitionBy("query_id", by).orderBy("rank", "id")
    return rows.withColumn("place", F.row_number().over(line)).filter(F.col("place") <= n)


def result_metrics(rows: DataFrame) -> DataFrame:
    """Per query: count, mean, extremes and population deviation of the similarity, the share of different sources, strategies by number."""
    return rows.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg("similarity"), DIGITS).alias("mean"),
        F.min("similarity").alias("least"),
        F.max("similarity").alias("most"),
        F.round(F.stddev_pop("similarity"), DIGITS).alias("deviation"),
        F.round(F.count_distinct("source") / F.count("*"), 6).alias("diversity"),
    )


def rerank_metadata(rows: DataFrame) -> DataFrame:
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), DIGITS).alias("mean"), F.max_by("id", F.struct("score", -F.col("id"))).alias("top_id"))
