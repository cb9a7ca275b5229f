"""Retrieval quality, fact checks and hallucination checks over result sets and generated texts.

Results are rows (query_id, query, id, rank, similarity, content, <flags>). Result sets are top-k lists, so joins of a set with itself are small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.sources.shared import materialised


def coverage(results: DataFrame, aspects: Mapping[str, Sequence[str]]) -> DataFrame:
    """(query_id, asked, covered, score): aspects of the query that some result has; 0.8 (three results or more) or 0.5 if the query names none, 0.3 if
    none is covered; less than three results: 0.8 of it."""
    rows = results.select("query_id", X.matched(F.col("query"), aspects).alias("asked"), F.explode_outer(X.matched(F.col("content"), aspects)).alias("has"), "id")
    rows = rows.groupBy("query_id").agg(F.first("asked").alias("asked"), F.collect_set("has").alias("has"), F.count_distinct("id").alias("n"))
    asked, covered = F.size("asked"), F.size(F.array_intersect("asked", "has"))
    score = F.when(asked == 0, F.when(F.col("n") >= 3, 0.8).otherwise(0.5)).when(covered == 0, 0.3).otherwise(covered / asked)
    score = F.when((F.col("n") < 3) & (asked > 0), score * 0.8).otherwise(score)
    return rows.select("query_id", asked.cast("bigint").alias("asked"), covered.cast("bigint").alias("covered"), F.round(score, 6).alias("score"))


def key_values(results: DataFrame, most: int = 100) -> DataFrame:
    """(query_id, id, key, value): ``key: value`` and ``key = value`` notes in the contents; of one key in a document, the last."""
    pattern = F.lit(r"([A-Za-z0-9_]+)\s*[:=]\s*([^,\n]+)")
    keys, values = F.regexp_extract_all("content", pattern, 1), F.regexp_extract_all("content", pattern, 2)
    rows = results.select("query_id", "id", F.posexplode(F.arrays_zip(keys.alias("k"), values.alias("v"))).alias("at", "kv"))
    rows = rows.select("query_id", "id", "at", F.lower("kv.k").alias("key"), F.trim("kv.v").alias("value")).filter(F.length("value") < most)
    return rows.groupBy("query_id", "id", "key").agg(F.max_by("value", "at").alias("value"))


def consistency(results: DataFrame) -> DataFrame:
    """(query_id, jaccard, conflicts, score): mean token Jaccard of the pairs of results, times 0.7 (over two conflicting keys) or 0.9 (any), at least 0.3."""
    tokens = results.select("query_id", "id", F.array_distinct(F.split(F.lower("content"), r"\s+")).alias("t"))
    a, b = tokens.alias("a"), tokens.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.id") < F.col("b.id")))
    alike = pairs.groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg(X.jaccard(F.col("a.t"), F.col("b.t"))).alias("jaccard"))
    notes = key_values(results).groupBy("query_id", "key").agg(F.count_distinct("value").alias("n")).filter("n > 1")
    conflicts = notes.groupBy("query_id").agg(F.count("*").alias("conflicts"))
    rows = results.select("query_id").distinct().join(alike, "query_id", "left").join(conflicts, "query_id", "left")
    rows = rows.select("query_id", F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
    factor = F.when(F.col("conflicts") > 2, 0.7).when(F.col("conflicts") > 0, 0.9).otherwise(1.0)
    return rows.select("query_id", F.round("jaccard", 6).alias("jaccard"), "conflicts", F.round(F.greatest(F.col("jaccard") * factor, F.lit(0.3)), 6).alias("score"))


def freshness(results: DataFrame, old: Sequence[str]) -> DataFrame:
    share = F.avg(X.has_any(F.col("content"), old).cast("double"))
    return results.groupBy("query_id").agg(F.round(F.greatest(1 - 0.5 * share, F.lit(0.5)), 6).alias("score"))


def relevance(results: DataFrame) -> DataFrame:
    """0.6 of the mean positive similarity and 0.4 of the share above 0.5."""
    mean = F.coalesce(F.avg(F.when(F.col("similarity") > 0, F.col("similarity"))), F.lit(0.0))
    share = F.avg((F.col("similarity") > 0.5).cast("double"))
    return results.groupBy("query_id").agg(F.round(0.6 * mean + 0.4 * share, 6).alias("score"))


def completeness(results: DataFrame) -> DataFrame:
    """0.5, plus 0.2 for three results, 0.2 for a long one, 0.1 for several sources."""
    parts = F.lit(0.5) + F.when(F.count("*") >= 3, 0.2).otherwise(0.0) + F.when(F.max(F.length("content")) > 1000, 0.2).otherwise(0.0)
    parts = parts + F.when(F.count_distinct("source") > 1, 0.1).otherwise(0.0)
    return results.groupBy("query_id").agg(F.round(parts, 6).alias("score"))


#: What a supplemental query is made of, and the words that call for it (fixed values).
SUPPLEMENTS = {"few": "扩展检索: {} 官方文档", "gap": "{} 相关内容 {}", "part": "扩展检索: {}", "configuration": "{} 配置最佳实践", "error": "{} 常见问题和解决方案"}
CONJUNCTIONS, CONJUNCTION = ("和", "与", "以及", " or ", " and ", "区别"), r"\s+(?:和|与|以及|and|or|区别)\s+"
SUPPLEMENT_WORDS = {"configuration": ("配置", "config", "设置"), "error": ("错误", "error", "问题", "debug")}


def _made(name: str, *values: Column) -> Column:
    first, *rest = SUPPLEMENTS[name].split("{}")
    parts = [F.lit(first)]
    for value, text in zip(values, rest, strict=True):
        parts += [value, F.lit(text)]
    return F.concat(*parts)


def supplements(results: DataFrame, aspects: Mapping[str, Sequence[str]], least: int = 3) -> DataFrame:
    """(query_id, needed, queries): whether a query's results call for more, and what to ask then: for few results, for the first two aspects that none has, for
    the second part of a query with a conjunction, and for configurations and errors."""
    rows = results.select("query_id", "query", X.matched(F.col("query"), aspects).alias("asked"), F.explode_outer(X.matched(F.col("content"), aspects)).alias("has"), "id")
    rows = rows.groupBy("query_id").agg(F.first("query").alias("query"), F.first("asked").alias("asked"), F.collect_set("has").alias("has"), F.count_distinct("id").alias("n"))
    rows = rows.withColumn("gaps", F.array_except("asked", "has")).join(coverage(results, aspects).select("query_id", "score"), "query_id")
    low, query = F.lower("query"), F.col("query")

    def any_of(words: Sequence[str]) -> Column:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(low, F.lit(word))
        return hit

    nothing = F.array().cast("array<string>")
    gaps = F.when(F.col("score") < 0.5, F.transform(F.slice("gaps", 1, 2), lambda g: _made("gap", g, query))).otherwise(nothing)
    second = F.get(F.split(query, CONJUNCTION, 2), 1)
    one = [F.when(F.col("n") < least, _made("few", query))], [F.when(any_of(CONJUNCTIONS) & second.isNotNull(), _made("part", F.trim(second)))]
    more = [F.when(any_of(words), _made(name, query)) for name, words in SUPPLEMENT_WORDS.items()]
    queries = F.concat(F.array_compact(F.array(*one[0])), gaps, F.array_compact(F.array(*one[1], *more)))
    return rows.select("query_id", ((F.col("n") < least) | (F.col("score") < 0.5) | (F.size("gaps") > 0)).alias("needed"), queries.alias("queries"))


def level(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").when(score >= 0.2, "poor").otherwise("very_poor")


def assessment(results: DataFrame, aspects: Mapping[str, Sequence[str]], old: Sequence[str], weights: Sequence[float] = (0.25, 0.2, 0.15, 0.2, 0.2)) -> DataFrame:
    """(query_id, overall, level) from coverage, consistency, freshness, completeness and relevance."""
    results = materialised(results)
    parts = (coverage(results, aspects), consistency(results), freshness(results, old), completeness(results), relevance(results))
    rows, total = None, F.lit(0.0)
    for i, (part, weight) in enumerate(zip(parts, weights, strict=True)):
        part = part.select("query_id", F.col("score").alias(f"s{i}"))
        rows = part if rows is None else rows.join(part, "query_id")
        total = total + F.col(f"s{i}") * weight
    overall = F.round(total, 6)
    return rows.select("query_id", overall.alias("overall"), level(overall).alias("level"))


def irrelevant(content: Column) -> Column:
    """Texts of signs or blanks only, very short ones, and short ones that are mostly line breaks."""
    stripped = F.trim(content)
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    share = F.coalesce(F.try_divide(breaks.cast("double"), F.length(content).cast("double")), F.lit(0.0))
    return stripped.rlike(r"^[^\p{L}\p{N}]*$") | (F.length(stripped) < 10) | ((share > 0.5) & (F.length(content) < 50))


def negatives(results: DataFrame, threshold: float) -> DataFrame:
    """(query_id, id, reason): why a result is dropped, or null if it stays."""
    words = X.keywords(F.col("query"), (), 3)
    hit = F.exists(words, lambda w: F.contains(F.lower("content"), w))
    reason = (
        F.when(F.col("similarity") < threshold, "low_similarity")
        .when(irrelevant(F.col("content")), "irrelevant_content")
        .when(~hit & (F.col("similarity") < threshold + 0.1), "no_keyword_match")
    )
    return results.select("query_id", "id", reason.alias("reason"))


def conflicts(results: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(query_id, kind, sources): the first flag in order that some result has, and which have it."""
    kind = F.lit(None).cast("string")
    for flag in reversed(flags):
        kind = F.when(F.bool_or(flag), flag).otherwise(kind)
    each = [F.array_join(F.array_sort(F.collect_set(F.when(F.col(f), F.col("source")))), ",").alias(f"_{f}") for f in flags]
    rows = results.groupBy("query_id").agg(kind.alias("kind"), *each).filter("kind is not null")
    sources = F.lit("")
    for flag in flags:
        sources = F.when(F.col("kind") == flag, F.col(f"_{flag}")).otherwise(sources)
    return rows.select("query_id", "kind", sources.alias("sources"))


def heuristic_complexity(results: DataFrame, flag: str) -> DataFrame:
    score = F.least(F.count("*") / 10.0, F.lit(0.3)) + F.least(F.avg(F.length("content")) / 1e4, F.lit(0.3)) + F.least(F.count_if(F.col(flag)) / F.count("*"), F.lit(0.4))
    return results.groupBy("query_id").agg(F.round(score, 6).alias("complexity"))


def evaluation(results: DataFrame) -> DataFrame:
    """(query_id, score, status): 0.7 of the mean similarity and 0.3 of the number of results, up to five."""
    rows = results.groupBy("query_id").agg(F.round(0.7 * F.avg("similarity") + 0.3 * F.least(F.lit(1.0), F.count("*") / 5.0), 6).alias("score"))
    status = F.when(F.col("score") >= 0.7, "sufficient").when(F.col("score") >= 0.5, "partial").when(F.col("score") >= 0.3, "weak").otherwise("insufficient")
    return rows.withColumn("status", status)


def sentence_support(texts: DataFrame, sources: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, sentences, supported): sentences whose words (four letters or more) are mostly found in the source texts of the same ``id``."""
    rows = texts.select("id", F.posexplode(X.sentences(F.col("content"))).alias("at", "sentence"))
    rows = rows.select("id", "at", X.keywords(F.col("sentence"), (), 4).alias("words"))
    known = sources.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list(X.keywords(F.col("content"), (), 4)))).alias("known"))
    rows = rows.join(known, "id", "left")
    share = F.coalesce(F.try_divide(F.size(F.array_intersect("words", F.coalesce("known", F.array().cast("array<string>")))).cast("double"), F.size("words").cast("double")), F.lit(1.0))
    return rows.groupBy("id").agg(F.count("*").alias("sentences"), F.count_if(share >= least).alias("supported"))


def unsupported_names(texts: DataFrame, sources: DataFrame, pattern: str) -> DataFrame:
    """(id, name): names that ``pattern`` finds in a text, but that no source of its ``id`` has as a whole word."""
    names = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), 1))).alias("name"))
    words = sources.select("id", F.explode(F.array_distinct(F.split("content", r"[^\p{L}\p{N}_]+"))).alias("name")).distinct()
    return names.join(words, ["id", "name"], "left_anti")


def content_quality(corpus: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(id, score): length, code fences, headings or lists, and special terms."""
    low = F.lower("content")
    hits = sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))
    score = 0.2 * F.least(F.length("content") / 5000.0, F.lit(1.0)) + F.when(F.contains("content", F.lit("```")), 0.2).otherwise(0.0)
    score = score + F.when(F.col("content").rlike(r"(?m)^(#{1,6} |[-*] |\d+\. )"), 0.15).otherwise(0.0) + 0.2 * F.least(hits / 10.0, F.lit(1.0))
    return corpus.select("id", F.round(score, 6).alias("score"))
