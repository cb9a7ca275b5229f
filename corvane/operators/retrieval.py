"""Whole retrievals: flagged vector search, vector with trigrams, the full hybrid pipeline, the advanced one, and a budgeted one.

Each is a composition of the search, fusion, rerank and cutoff operators; candidates are top-k lists from the first step on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import budget, fusion, lexical, rerank, vector
from corvane.sources.shared import materialised, written


def flagged_vector_search(
    vectors: DataFrame, queries: DataFrame, flags: DataFrame, boosts: Mapping[str, float], k: int = 5, threshold: float = 0.7, w_v: float = 0.6, w_k: float = 0.4
) -> DataFrame:
    """(query_id, id, rank, similarity, matches, boost, score): (similarity w_v + min(matches / 4, 1) w_k) boost, of vectors at ``threshold``.

    ``flags`` has a boolean column for each of ``boosts``; the boost is that of the first set flag, in their order.
    """
    found = vector.within(vectors, queries, threshold)
    rows = found.join(flags.select("id", *boosts), "id")
    matches = sum((F.coalesce(F.col(f), F.lit(False)).cast("int") for f in boosts), F.lit(0))
    boost = F.lit(1.0)
    for flag, value in reversed(boosts.items()):
        boost = F.when(F.col(flag), float(value)).otherwise(boost)
    score = F.round((F.col("similarity") * w_v + F.least(matches / 4, F.lit(1.0)) * w_k) * boost, 6)
    rows = rows.select("query_id", "id", "similarity", matches.alias("matches"), boost.alias("boost"), score.alias("score"))
    return fusion.ranked(rows, "score", k)


def vector_with_trigrams(vectors: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.7, least: float = 0.0, w_v: float = 0.7, w_k: float = 0.3) -> DataFrame:
    """(query_id, id, rank, similarity, keyword, score): 0.7 of the cosine and 0.3 of the trigram likeness of the content, of vectors at ``threshold``; kept at ``least``.

    ``queries`` are (query_id, query, embedding). Trigrams are compared for what the vectors leave only.
    """
    found = vector.within(vectors, queries.select("query_id", "embedding"), threshold)
    rows = lexical.trigram_shares(corpus, found, queries)
    rows = rows.withColumn("score", F.round(F.col("similarity") * w_v + F.col("keyword") * w_k, 6)).filter(F.col("score") >= least)
    return fusion.ranked(rows, "score", k)


def optimised(queries: DataFrame) -> DataFrame:
    return queries.withColumn("query", X.optimized_query(F.col("query")))


def expanded(queries: DataFrame, templates: Mapping[str, float]) -> DataFrame:
    """(query_id, query): each query and its forms in one text, so that the words of all forms count; the query's own most."""
    forms = fusion.variants(queries, templates)
    return forms.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "query"))), lambda v: v["query"]), " ").alias("query"))


def pipeline_statistics(fused: DataFrame, k: int) -> DataFrame:
    """(query_id, n, mean, best) of the fused scores of the k first."""
    rows = fused.filter(F.col("rank") <= k)
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 8).alias("mean"), F.max("score").alias("best"))


def hybrid(corpus: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, templates: Mapping[str, float], weights: Mapping[str, float], as_of: str, k: int = 10) -> DataFrame:
    """(query_id, id, place): optimise, expand, search by all strategies (2k each), merge, rerank, drop what is too alike, and cap at k.

    ``query_vectors`` are (query_id, embedding); the strategies are BM25 on the expanded queries, trigrams and vectors.
    """
    asked = optimised(queries)
    parts = {
        "bm25": lexical.bm25(corpus, expanded(asked, templates), 2 * k).select("query_id", "id", "rank", F.col("normalized").alias("similarity")),
        "trigram": lexical.trigram_search(corpus, asked, 2 * k, 0.1),
        "vector": vector.search(vectors, query_vectors, 2 * k, 0.0, strict=True),
    }
    candidates = None
    for name, part in parts.items():
        part = part.select("query_id", F.lit(name).alias("strategy"), "rank", "id", "similarity")
        candidates = part if candidates is None else candidates.unionByName(part)
    merged = materialised(fusion.weighted(candidates.repartition("query_id"), weights, k=2 * k).select("query_id", "id", F.col("score").alias("similarity")))
    # texts are read once, for the 2k of each query
    texts = written(corpus.select("id", "content").join(lexical.broadcast_small(merged.select("id").distinct()), "id", "left_semi"), "texts")
    rows = merged.join(texts, "id").join(asked, "query_id").withColumn("at", F.lit(as_of).cast("date")).withColumn("uses", F.lit(0))
    ranked = materialised(rerank.multi_factor(rows, as_of).select("query_id", "id", "rank", "score"))
    final = ranked.join(texts, "id")
    return rerank.diverse(final.withColumn("similarity", F.col("score")), k).filter(F.col("place") <= k)


def advanced(
    corpus: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, templates: Mapping[str, float], weights: Mapping[str, float], edges: DataFrame, as_of: str,
    k: int = 10, least: float = 0.0, decay: float = 0.8,
) -> DataFrame:
    """(query_id, id, score, hop): hybrid retrieval, then marginal relevance, a threshold, and neighbours in (source, target) ``edges`` at ``decay`` of the score; the best k."""
    found = hybrid(corpus, queries, vectors, query_vectors, templates, weights, as_of, 2 * k)
    rows = found.withColumn("similarity", F.round(1.0 / F.col("place"), 6)).withColumn("rank", F.col("place")).join(corpus.select("id", "content", "source"), "id")
    chosen = rerank.marginal_relevance(rows, k)
    chosen = chosen.join(rows.select("query_id", "id", "similarity"), ["query_id", "id"]).filter(F.col("similarity") >= least)
    own = chosen.select("query_id", "id", F.col("similarity").alias("score"), F.lit(0).alias("hop"))
    near = own.join(edges.select(F.col("source").alias("id"), F.col("target").alias("_to")), "id").select("query_id", F.col("_to").alias("id"), F.round(F.col("score") * decay, 6).alias("score"), F.lit(1).alias("hop"))
    both = own.unionByName(near).groupBy("query_id", "id").agg(F.max("score").alias("score"), F.min("hop").alias("hop"))
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "hop", "id")
    return both.withColumn("_n", F.row_number().over(line)).filter(F.col("_n") <= k).drop("_n")


def smart_search(results: DataFrame, tenants: DataFrame, spent: Column, most: float, price: float) -> DataFrame:
    """(query_id, allowed, n, tokens, cost): a result set is given to a query whose budget allows it, its contents compressed, and its cost is recorded.

    ``results`` are (query_id, id, content), ``tenants`` (query_id, ...) with what was ``spent``.
    """
    sizes = results.select("query_id", X.tokens_estimate(budget.compressed_text(F.col("content"))).alias("t"))
    sizes = sizes.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("t").alias("tokens"))
    rows = tenants.withColumn("allowed", spent < most).join(sizes, "query_id", "left")
    given = [F.when(F.col("allowed"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c) for c in ("n", "tokens")]
    rows = rows.select("query_id", "allowed", *given)
    return rows.withColumn("cost", F.round(F.col("tokens") * price, 6))


def base_search(corpus: DataFrame, words: Sequence[str], bonus: float = 0.5) -> DataFrame:
    """Knowledge scores by keyword, and ``bonus`` if the content has any keyword."""
    low, hit = F.lower("content"), F.lit(False)
    for word in words:
        hit = hit | F.contains(low, F.lit(word.lower()))
    rows = lexical.knowledge_scores(corpus, words).join(corpus.select("id", hit.alias("_hit")), "id")
    return rows.select("id", F.round(F.col("score") + F.when(F.col("_hit"), bonus).otherwise(0.0), 6).alias("score"))
