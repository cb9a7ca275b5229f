"""Queries of vector and keyword search, fusion, reranking and cutoffs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import fusion, lexical, rerank, vector, vector_index
from corvane.sources import tables as T
from corvane.sources.shared import shared_path

MARKERS = {"license": ["license", "licence"], "mention": ["@"], "heading": ["# "]}
BOOSTS = {"license": 1.5, "heading": 1.3, "mention": 1.2}
THEMES = {"legal": (["license", "copyright"], 1), "article": (["the ", "and "], 5), "romance": (["les ", "que "], 3)}
TEMPLATES = {"{}": 1.0, "what is {}": 0.9, "{} example": 0.85, "{} usage": 0.85, "about {}": 0.8}
SIMPLE = ("how to use", "what is", "function", "class")
COMPLEX = ("explain", "difference between", "performance", "the ")
AS_OF = "2024-02-01"


def _asked(s, d):
    v = T.vectors(s, d)
    return v.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")


def _vector_list(s, d, k=20):
    return vector.search(T.vectors(s, d), _asked(s, d), k, same=False)


def _label_list(s, d, k=20):
    """A second ranking of the same queries: by cosine, ids of the query's label first."""
    v, q = T.vectors(s, d), T.vectors(s, d).filter("id % 50 = 0")
    found = vector.search(v, _asked(s, d), 60, same=False)
    rows = found.join(v.select("id", "label"), "id").join(q.select(F.col("id").alias("query_id"), F.col("label").alias("_l")), "query_id")
    rows = rows.withColumn("similarity", F.round(F.greatest(F.col("similarity"), F.lit(0.0)) * F.when(F.col("label") == F.col("_l"), 1.0).otherwise(0.5), 8))
    return fusion.ranked(rows.drop("rank", "label", "_l"), "similarity", k)


def _candidates(s, d):
    a = _vector_list(s, d).withColumn("strategy", F.lit("vector"))
    b = _label_list(s, d).withColumn("strategy", F.lit("label"))
    columns = ["query_id", "strategy", "rank", "id", "similarity"]
    return a.select(columns).unionByName(b.select(columns))


def _with_source(rows, s, d):
    return rows.join(T.corpus(s, d).select("id", "source"), "id")


def _rich(s, d):
    """BM25 hits with texts: the reranking operators' input."""
    hits = lexical.bm25(T.corpus(s, d), T.questions(s, d), 20)
    hits = hits.select("query_id", "id", "rank", F.col("normalized").alias("similarity"))
    return hits.join(T.corpus(s, d), "id").join(T.questions(s, d), "query_id")


def _factors(s, d):
    at = F.date_add(F.lit("2023-12-01").cast("date"), (F.col("id") % 60).cast("int"))
    return _rich(s, d).withColumn("at", at).withColumn("uses", F.col("id") % 150).withColumn("has_license", X.has_any(F.col("content"), ["license"]))


def _score(rows, *columns):
    return rows.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), *columns)


def _flagship(s, d):
    """Hybrid retrieval: BM25 and trigram candidates, reciprocal ranks, reranking by several factors, adaptive cutoff."""
    corpus, asked = T.corpus(s, d), T.questions(s, d)
    a = lexical.bm25(corpus, asked, 20).select("query_id", "id", "rank", F.col("normalized").alias("similarity"))
    b = lexical.trigram_search(corpus, asked, 20, 0.1)
    union = a.withColumn("strategy", F.lit("bm25")).unionByName(b.select(a.columns).withColumn("strategy", F.lit("trigram")))
    fused = fusion.reciprocal(union, k=20)
    best = fused.groupBy("query_id").agg(F.max("score").alias("_best"))
    rows = fused.join(best, "query_id").select("query_id", "id", (F.col("score") / F.col("_best")).alias("similarity"))
    rows = corpus.join(lexical.broadcast_small(rows), "id").join(asked, "query_id").withColumn("at", F.lit(AS_OF).cast("date")).withColumn("uses", F.col("n_chars"))
    top = rerank.multi_factor(rows, AS_OF).withColumnRenamed("score", "similarity").join(asked, "query_id")
    return rerank.adaptive_cutoff(top, X.query_complexity(F.col("query"), SIMPLE, COMPLEX))


QUERIES = {
    "hybrid_retrieval": _flagship,
    "vector_top_k": lambda s, d: _score(vector.search(T.vectors(s, d), _asked(s, d), 10), "similarity"),
    "vector_threshold_strict": lambda s, d: _score(vector.search(T.vectors(s, d), _asked(s, d), 10, 0.2, strict=True), "similarity"),
    "vector_threshold": lambda s, d: _score(vector.search(T.vectors(s, d), _asked(s, d), 10, 0.25), "similarity"),
    "vector_top_k_others": lambda s, d: _score(_vector_list(s, d), "similarity"),
    "vector_pairs": lambda s, d: vector.all_pairs(T.vectors(s, d), 0.25),
    "vector_ann": lambda s, d: _score(vector_index.search(vector_index.build(T.vectors(s, d), shared_path(s, "vector-index")), _asked(s, d), 10), "similarity"),
    "vector_text_round_trip": lambda s, d: T.vectors(s, d).select("id", F.round(F.aggregate(vector.from_text(vector.to_text("embedding")), F.lit(0.0), lambda a, x: a + x), 4).alias("total")),
    "vector_marker_filter": lambda s, d: _score(
        vector.search(T.vectors(s, d).join(T.corpus(s, d).filter(X.has_any(F.col("content"), ["the "])), "id", "left_semi"), _asked(s, d), 5), "similarity"
    ),
    "bm25_postings": lambda s, d: lexical.postings(T.corpus(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")),
    "bm25_search": lambda s, d: _score(lexical.bm25(T.corpus(s, d), T.questions(s, d), 10), "score", "normalized"),
    "trigram_search": lambda s, d: _score(lexical.trigram_search(T.corpus(s, d), T.questions(s, d), 5, 0.12), "similarity"),
    "substring_search": lambda s, d: lexical.substring_search(T.corpus(s, d), "License"),
    "marker_search": lambda s, d: lexical.marker_scores(T.corpus(s, d), MARKERS, BOOSTS),
    "knowledge_keyword": lambda s, d: lexical.knowledge_scores(T.corpus(s, d), ["src1", "the", "en"]),
    "knowledge_semantic": lambda s, d: lexical.knowledge_scores(T.corpus(s, d), ["with", "que"], "semantic"),
    "knowledge_hybrid": lambda s, d: lexical.knowledge_scores(T.corpus(s, d), ["license", "with"], "hybrid"),
    "keyword_split": lambda s, d: T.questions(s, d).select("query_id", F.array_join(lexical.split_keywords(F.col("query")), "|").alias("words"), F.array_join(lexical.split_keywords(F.element_at(F.split("query", r"\s+"), 1)), "|").alias("halves")),
    "theme_detect": lambda s, d: lexical.theme(T.corpus(s, d).select(F.col("id").alias("query_id"), F.col("content").alias("query")), THEMES, "other"),
    "weighted_merge": lambda s, d: _score(fusion.weighted(_candidates(s, d), {"vector": 0.7}), "score", "strategies"),
    "weighted_merge_default": lambda s, d: _score(fusion.weighted(_candidates(s, d)), "score", "strategies"),
    "rrf_scaled": lambda s, d: _score(fusion.reciprocal(_candidates(s, d), {"vector": 0.7, "label": 0.3}, scaled=True), "score", F.col("best_rank").cast("bigint").alias("best_rank")),
    "rrf_classic": lambda s, d: _score(fusion.reciprocal(_candidates(s, d)), "score", F.col("best_rank").cast("bigint").alias("best_rank")),
    "rrf_components": lambda s, d: _score(fusion.reciprocal_with_components(_vector_list(s, d), _label_list(s, d)), "rank_v", "rank_k", "is_vector", "is_keyword", "score"),
    "hybrid_service": lambda s, d: _score(fusion.hybrid_service(_vector_list(s, d), _label_list(s, d), least=0.1), "rrf", "fused"),
    "hybrid_merge": lambda s, d: _score(fusion.merge_two(_vector_list(s, d), _label_list(s, d)), "score", "is_vector", "is_keyword"),
    "fusion_merge": lambda s, d: _score(fusion.fusion(_candidates(s, d)), "score"),
    "navigator_merge": lambda s, d: _score(fusion.navigator(_with_source(_vector_list(s, d), s, d), _with_source(_label_list(s, d), s, d)), "source", "confidence"),
    "round_robin_merge": lambda s, d: fusion.round_robin(_candidates(s, d), 10, ["vector", "label"]),
    "dedupe_by_source": lambda s, d: _score(fusion.first_by(_with_source(_vector_list(s, d), s, d), "source", "rank"), "source"),
    "multi_query_merge": lambda s, d: _score(fusion.multi_query(_candidates(s, d), {"vector": 0.9}), "score"),
    "variant_merge": lambda s, d: _score(fusion.variant_merge(_candidates(s, d)), "score"),
    "query_variants": lambda s, d: fusion.variants(T.questions(s, d), TEMPLATES),
    "rerank_multi_factor": lambda s, d: _score(rerank.multi_factor(_factors(s, d), AS_OF, boosts={"has_license": 1.2}), "score"),
    "rerank_fallback": lambda s, d: _score(rerank.fallback(_rich(s, d)), "score"),
    "rerank_cross_scores": lambda s, d: _score(rerank.cross_scores(_rich(s, d), "n_chars", 8), "cross_score", "score"),
    "diversity_filter": lambda s, d: rerank.diverse(_rich(s, d), 10),
    "marginal_relevance": lambda s, d: rerank.marginal_relevance(_rich(s, d), 10),
    "rerank_metadata": lambda s, d: rerank.rerank_metadata(rerank.fallback(_rich(s, d))),
    "query_complexity": lambda s, d: T.questions(s, d).select("query_id", X.query_complexity(F.col("query"), SIMPLE, COMPLEX).alias("complexity")),
    "adaptive_cutoff": lambda s, d: _score(rerank.adaptive_cutoff(_rich(s, d), X.query_complexity(F.col("query"), SIMPLE, COMPLEX)), "similarity", "threshold"),
    "cliff_cutoff": lambda s, d: _score(rerank.cliff_cutoff(_rich(s, d), 0.1), "similarity"),
    "hybrid_cutoff": lambda s, d: _score(rerank.hybrid_cutoff(_rich(s, d), 0.6, 0.3), "similarity"),
    "per_source_limit": lambda s, d: _score(rerank.per_group(_rich(s, d), "source", 2), "source", F.col("place").cast("bigint").alias("place")),
    "result_metrics": lambda s, d: rerank.result_metrics(_rich(s, d)),
}

_TOK = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z_]{{3,}}'))"
_NEAR = """q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0),
p AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], qe::DOUBLE[]), 6) AS similarity FROM q, embeddings)"""


def _top(k, condition="true"):
    return f"SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, similarity FROM p WHERE {condition} QUALIFY rank <= {k}"


_VEC = f"{_NEAR}, v AS ({_top(20, 'query_id <> id')})"
_LAB = f"""{_VEC}, l60 AS ({_top(60, 'query_id <> id')}),
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, similarity FROM
  (SELECT query_id, id, round(greatest(similarity, 0.0) * CASE WHEN e.label = f.label THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 8) AS similarity
   FROM l60 JOIN embeddings e ON e.vec_id = id JOIN embeddings f ON f.vec_id = query_id) QUALIFY rank <= 20)"""
_CAND = f"{_LAB}, c AS (SELECT query_id, 'vector' AS strategy, rank, id, similarity FROM v UNION ALL SELECT query_id, 'label', rank, id, similarity FROM l)"
_COMP = f"""{_LAB}, nv AS (SELECT query_id, count(*) AS n FROM v GROUP BY 1), nl AS (SELECT query_id, count(*) AS n FROM l GROUP BY 1),
m AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id, coalesce(v.similarity, 0) AS sim_v, coalesce(l.similarity, 0) AS sim_k,
  v.rank AS rv0, l.rank AS rk0 FROM v FULL JOIN l ON v.query_id = l.query_id AND v.id = l.id),
r AS (SELECT m.*, coalesce(rv0, nv.n + 1)::BIGINT AS rank_v, coalesce(rk0, nl.n + 1)::BIGINT AS rank_k, rv0 IS NOT NULL AS is_vector, rk0 IS NOT NULL AS is_keyword
  FROM m LEFT JOIN nv USING (query_id) LEFT JOIN nl USING (query_id))"""
_QUEST = "asked AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_BM25 = f"""{_QUEST}, terms AS (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM asked), qt AS (SELECT query_id, term, count(*) AS times FROM terms GROUP BY ALL),
tok AS (SELECT doc_id AS id, {_TOK.format('text')} AS tokens FROM documents), tot AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avg_terms FROM tok),
post AS (SELECT id, n_terms, term, count(*) AS tf FROM (SELECT id, len(tokens) AS n_terms, unnest(tokens) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
sc AS (SELECT query_id, id, round(sum(times * ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms / avg_terms))), 6) AS score
  FROM qt JOIN post USING (term) JOIN df USING (term), tot GROUP BY ALL),
bm AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, score, round(score / max(score) OVER (PARTITION BY query_id), 6) AS normalized FROM sc WHERE score > 0)"""
_RICH = f"{_BM25}, h AS (SELECT query_id, id, rank, normalized AS similarity, query, text AS content, source, n_chars FROM bm JOIN documents ON doc_id = id JOIN asked USING (query_id) WHERE rank <= 20)"
_STOP = ", ".join(f"'{w}'" for w in rerank.STOPWORDS)
_KW = rf"list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}_]+'), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t)))"
_KF = f"coalesce(len(list_filter({_KW}, lambda w: contains(lower(content), w)))::DOUBLE / nullif(len({_KW}), 0), 0.5::DOUBLE)"
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank"
_CPX = f"""round(greatest(0.0, least(1.0, CASE WHEN len(regexp_split_to_array(trim(query), '\\s+')) <= 3 THEN 0.2::DOUBLE WHEN len(regexp_split_to_array(trim(query), '\\s+')) <= 8 THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END
  {''.join(f" - CASE WHEN contains(lower(query), '{w}') THEN 0.1::DOUBLE ELSE 0 END" for w in SIMPLE)} {''.join(f" + CASE WHEN contains(lower(query), '{w}') THEN 0.1::DOUBLE ELSE 0 END" for w in COMPLEX)})), 6)"""
_DROP = "CASE WHEN lag(similarity) OVER (PARTITION BY query_id ORDER BY rank) > 0 THEN (lag(similarity) OVER (PARTITION BY query_id ORDER BY rank) - similarity) / lag(similarity) OVER (PARTITION BY query_id ORDER BY rank) END AS fall"


def _wordscore(words, mode):
    low = "lower(text)"
    if mode == "semantic":
        return " + ".join(f"CASE WHEN contains(lower(text)[1:500], '{w}') THEN 2.0::DOUBLE ELSE 0 END" for w in words)
    return " + ".join(
        f"CASE WHEN contains(lower(source || '/' || doc_id), '{w}') THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN contains({low}, '{w}') THEN 1.0::DOUBLE ELSE 0 END"
        f" + CASE WHEN contains(lower(source), '{w}') THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN contains(lower(lang), '{w}') THEN 1.5::DOUBLE ELSE 0 END"
        for w in words
    )


_TRI = r"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"

SQL = {
    "vector_top_k": f"WITH {_NEAR} {_top(10)}",
    "vector_threshold_strict": f"WITH {_NEAR} {_top(10, 'similarity > 0.2')}",
    "vector_threshold": f"WITH {_NEAR} {_top(10, 'similarity >= 0.25')}",
    "vector_top_k_others": f"WITH {_NEAR} {_top(20, 'query_id <> id')}",
    "vector_pairs": """SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity
      FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE similarity >= 0.25""",
    "vector_text_round_trip": "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "vector_marker_filter": f"WITH {_NEAR} {_top(5, '''id IN (SELECT doc_id FROM documents WHERE contains(lower(text), 'the '))''')}",
    "bm25_postings": f"SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY term",
    "bm25_search": f"WITH {_BM25} SELECT * FROM bm WHERE rank <= 10",
    "trigram_search": f"""WITH {_QUEST}, q AS (SELECT query_id, query, {_TRI.format('query')} AS qg FROM asked), c AS (SELECT doc_id AS id, text, {_TRI.format('text')} AS cg FROM documents),
      p AS (SELECT query_id, id, contains(lower(text), lower(query)) AS anycase, CASE WHEN contains(text, query) THEN 1.0::DOUBLE
        ELSE round(len(list_intersect(qg, cg))::DOUBLE / (len(qg) + len(cg) - len(list_intersect(qg, cg))), 6) END AS similarity FROM q, c)
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank, similarity FROM p WHERE similarity >= 0.12 OR anycase QUALIFY rank <= 5""",
    "substring_search": "SELECT doc_id AS id, source || '/' || doc_id AS file_path, CASE WHEN length(text) > 200 THEN text[:200] || '...' ELSE text END AS preview FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 20",
    "marker_search": """WITH m AS (SELECT doc_id AS id, list_filter([CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'licence') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'mention' END,
      CASE WHEN contains(text, '# ') THEN 'heading' END], lambda x: x IS NOT NULL) AS f FROM documents)
      SELECT id, array_to_string(f, ',') AS matched, len(f) AS n_matched, CASE WHEN list_contains(f, 'license') THEN 1.5 WHEN list_contains(f, 'heading') THEN 1.3 ELSE 1.2 END::DOUBLE AS boost FROM m WHERE len(f) > 0""",
    "knowledge_keyword": f"SELECT * FROM (SELECT doc_id AS id, round({_wordscore(['src1', 'the', 'en'], 'keyword')}, 6) AS score FROM documents) WHERE score > 0",
    "knowledge_semantic": f"SELECT * FROM (SELECT doc_id AS id, round({_wordscore(['with', 'que'], 'semantic')}, 6) AS score FROM documents) WHERE score > 0",
    "knowledge_hybrid": f"SELECT * FROM (SELECT doc_id AS id, round(({_wordscore(['license', 'with'], 'keyword')}) * 0.7::DOUBLE + 0.06::DOUBLE, 6) AS score FROM documents) WHERE score > 0",
    "keyword_split": f"""WITH {_QUEST}, w AS (SELECT query_id, list_filter(regexp_split_to_array(lower(trim(query)), '\\s+'), lambda w: w <> '') AS words, lower(regexp_split_to_array(query, '\\s+')[1]) AS f FROM asked)
      SELECT query_id, array_to_string(words, '|') AS words, CASE WHEN length(f) > 4 THEN f || '|' || substr(f, 1, length(f) // 2) || '|' || substr(f, length(f) // 2 + 1) ELSE f END AS halves FROM w""",
    "theme_detect": """WITH t AS (SELECT doc_id AS query_id, lower(text) AS low FROM documents),
      x AS (SELECT query_id, round((contains(low, 'license')::INT + contains(low, 'copyright')::INT) * 1.9::DOUBLE, 6) AS a, round((contains(low, 'the ')::INT + contains(low, 'and ')::INT) * 1.5::DOUBLE, 6) AS b,
        round((contains(low, 'les ')::INT + contains(low, 'que ')::INT) * 1.7::DOUBLE, 6) AS c FROM t)
      SELECT query_id, CASE WHEN greatest(a, b, c) = 0 THEN 'other' WHEN a = greatest(a, b, c) THEN 'legal' WHEN b = greatest(a, b, c) THEN 'article' ELSE 'romance' END AS theme, greatest(a, b, c) AS score FROM x""",
    "weighted_merge": f"WITH {_CAND}, s AS (SELECT query_id, id, round(sum(similarity * CASE strategy WHEN 'vector' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END), 8) AS score, array_to_string(list_sort(list(strategy)), ',') AS strategies FROM c GROUP BY ALL) SELECT query_id, id, {_RANK}, score, strategies FROM s",
    "weighted_merge_default": f"WITH {_CAND}, s AS (SELECT query_id, id, round(sum(similarity * 0.5::DOUBLE), 8) AS score, array_to_string(list_sort(list(strategy)), ',') AS strategies FROM c GROUP BY ALL) SELECT query_id, id, {_RANK}, score, strategies FROM s",
    "rrf_scaled": f"WITH {_CAND}, s AS (SELECT query_id, id, round(sum(CASE strategy WHEN 'vector' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END * 60 / (rank + 60)), 8) AS score, min(rank) AS best_rank FROM c GROUP BY ALL) SELECT query_id, id, {_RANK}, score, best_rank FROM s",
    "rrf_classic": f"WITH {_CAND}, s AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (rank + 60)), 8) AS score, min(rank) AS best_rank FROM c GROUP BY ALL) SELECT query_id, id, {_RANK}, score, best_rank FROM s",
    "rrf_components": f"WITH {_COMP}, s AS (SELECT query_id, id, rank_v, rank_k, is_vector, is_keyword, round(CASE WHEN is_vector THEN 0.6::DOUBLE / (rank_v + 60) ELSE 0 END + CASE WHEN is_keyword THEN 0.4::DOUBLE / (rank_k + 60) ELSE 0 END, 8) AS score FROM r) SELECT *, {_RANK} FROM s",
    "hybrid_service": f"""WITH {_COMP}, a AS (SELECT *, round(0.6::DOUBLE / (rank_v + 60) + 0.4::DOUBLE / (rank_k + 60), 8) AS rrf FROM r), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) <= 10),
      f AS (SELECT query_id, id, rrf, round(0.3::DOUBLE * greatest(sim_v, sim_k) + 0.5::DOUBLE * rrf + 0.2::DOUBLE / (1 + ln((rank_v + rank_k)::DOUBLE)), 8) AS fused FROM b)
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank, rrf, fused FROM f WHERE fused >= 0.1""",
    "hybrid_merge": f"WITH {_COMP}, s AS (SELECT query_id, id, is_vector, is_keyword, round(sim_v * 0.6::DOUBLE + sim_k * 0.4::DOUBLE, 8) AS score FROM r) SELECT *, {_RANK} FROM s QUALIFY rank <= 10",
    "fusion_merge": f"""WITH {_CAND}, w0 AS (SELECT query_id, id, round(sum(similarity * 0.5::DOUBLE), 8) AS score FROM c GROUP BY ALL), w AS (SELECT *, {_RANK} FROM w0 QUALIFY rank <= 20),
      r0 AS (SELECT query_id, id, round(sum(60.0::DOUBLE / (rank + 60)), 8) AS score FROM c GROUP BY ALL), r AS (SELECT *, {_RANK} FROM r0 QUALIFY rank <= 20),
      j AS (SELECT query_id, id, w.score AS ws, r.score AS rs FROM w FULL JOIN r USING (query_id, id)),
      s AS (SELECT query_id, id, round(0.5::DOUBLE * coalesce(ws / nullif(max(ws) OVER (PARTITION BY query_id), 0), 0) + 0.5::DOUBLE * coalesce(rs / max(rs) OVER (PARTITION BY query_id), 0), 8) AS score FROM j)
      SELECT query_id, id, {_RANK}, score FROM s QUALIFY rank <= 10""",
    "navigator_merge": f"""WITH {_LAB}, u AS (SELECT query_id, id, source, similarity, 1 AS side FROM v JOIN documents ON doc_id = id UNION ALL SELECT query_id, id, source, similarity, 2 FROM l JOIN documents ON doc_id = id),
      n AS (SELECT query_id, count(DISTINCT side) AS sides FROM u GROUP BY 1), x AS (SELECT query_id, id, source, side, round(similarity * CASE WHEN sides < 2 THEN 1.0 WHEN side = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END, 8) AS confidence FROM u JOIN n USING (query_id)),
      y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY confidence DESC, id, side) = 1)
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id, source) AS rank, source, confidence FROM y QUALIFY rank <= 10""",
    "dedupe_by_source": f"WITH {_VEC} SELECT query_id, id, rank, source FROM v JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1",
    "multi_query_merge": f"""WITH {_CAND}, s AS (SELECT query_id, id, round(greatest(arg_min(similarity, (strategy, rank)), max(similarity * CASE strategy WHEN 'vector' THEN 0.9::DOUBLE ELSE 1 END)), 8) AS score FROM c GROUP BY ALL)
      SELECT query_id, id, {_RANK}, score FROM s QUALIFY rank <= 10""",
    "variant_merge": f"WITH {_CAND}, s AS (SELECT query_id, id, round(max(similarity) * (1 + 0.1::DOUBLE * count(DISTINCT strategy)), 8) AS score FROM c GROUP BY ALL) SELECT query_id, id, {_RANK}, score FROM s QUALIFY rank <= 10",
    "query_variants": f"""WITH {_QUEST}, t(variant, template, weight) AS (VALUES (0, '{{}}', 1.0::DOUBLE), (1, 'what is {{}}', 0.9::DOUBLE), (2, '{{}} example', 0.85::DOUBLE), (3, '{{}} usage', 0.85::DOUBLE), (4, 'about {{}}', 0.8::DOUBLE))
      SELECT query_id, variant, replace(template, '{{}}', query) AS query, weight FROM asked, t""",
    "rerank_multi_factor": f"""WITH {_RICH}, s AS (SELECT query_id, id, round((0.4::DOUBLE * similarity + 0.3::DOUBLE * {_KF}
      + 0.2::DOUBLE * least(exp(-(date_diff('day', DATE '2023-12-01' + (id % 60)::INT, DATE '{AS_OF}'))::DOUBLE / 30), 1) + 0.1::DOUBLE * least(ln(1 + (id % 150)::DOUBLE) / ln(101), 1))
      * CASE WHEN contains(lower(content), 'license') THEN 1.2::DOUBLE ELSE 1 END, 6) AS score FROM h) SELECT query_id, id, {_RANK}, score FROM s""",
    "rerank_fallback": f"""WITH {_RICH}, s AS (SELECT query_id, id, round(0.6::DOUBLE * similarity + 0.3::DOUBLE * {_KF} + 0.1::DOUBLE * CASE WHEN length(content) < 10 THEN 0.3::DOUBLE WHEN length(content) < 100 THEN 0.7::DOUBLE
      WHEN length(content) < 500 THEN 1 ELSE greatest(0.5::DOUBLE, 1 - (length(content) - 500) / 1000.0::DOUBLE) END, 6) AS score FROM h) SELECT query_id, id, {_RANK}, score FROM s""",
    "rerank_cross_scores": f"""WITH {_RICH}, b AS (SELECT *, min(n_chars) OVER w AS lo, max(n_chars) OVER w AS hi FROM h WINDOW w AS (PARTITION BY query_id, (rank - 1) // 8)),
      x AS (SELECT query_id, id, similarity, round(coalesce((n_chars - lo)::DOUBLE / nullif(hi - lo, 0), 0.5::DOUBLE), 6) AS cross_score FROM b), s AS (SELECT query_id, id, cross_score, round(similarity * 0.6::DOUBLE + cross_score * 0.4::DOUBLE, 6) AS score FROM x)
      SELECT query_id, id, {_RANK}, cross_score, score FROM s""",
    "rerank_metadata": f"""WITH {_RICH}, s AS (SELECT query_id, id, round(0.6::DOUBLE * similarity + 0.3::DOUBLE * {_KF} + 0.1::DOUBLE * CASE WHEN length(content) < 10 THEN 0.3::DOUBLE WHEN length(content) < 100 THEN 0.7::DOUBLE
      WHEN length(content) < 500 THEN 1 ELSE greatest(0.5::DOUBLE, 1 - (length(content) - 500) / 1000.0::DOUBLE) END, 6) AS score FROM h)
      SELECT query_id, count(*) AS n, round(avg(score), 8) AS mean, arg_max(id, (score, -id)) AS top_id FROM s GROUP BY 1""",
    "query_complexity": f"WITH {_QUEST} SELECT query_id, {_CPX} AS complexity FROM asked",
    "adaptive_cutoff": f"""WITH {_RICH}, t AS (SELECT *, round(greatest(0.65::DOUBLE + (0.5::DOUBLE - {_CPX}) * 0.2::DOUBLE, 0.55::DOUBLE), 6) AS threshold, {_DROP} FROM h),
      u AS (SELECT *, min(CASE WHEN fall > 0.2 THEN rank END) OVER (PARTITION BY query_id) AS c1, min(CASE WHEN similarity < threshold THEN rank END) OVER (PARTITION BY query_id) AS c2, max(similarity) OVER (PARTITION BY query_id) AS top FROM t)
      SELECT query_id, id, rank, similarity, threshold FROM u WHERE rank < coalesce(CASE WHEN top >= threshold THEN c1 END, c2, 1000000000) AND rank <= 20""",
    "cliff_cutoff": f"WITH {_RICH}, t AS (SELECT *, {_DROP} FROM h WHERE rank <= 10), u AS (SELECT *, min(CASE WHEN fall > 0.1 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM t) SELECT query_id, id, rank, similarity FROM u WHERE rank < coalesce(cut, 1000000000)",
    "hybrid_cutoff": f"""WITH {_RICH}, t AS (SELECT *, {_DROP} FROM h), u AS (SELECT *, min(CASE WHEN fall > 0.3 THEN rank END) OVER (PARTITION BY query_id) AS cut FROM t)
      SELECT query_id, id, rank, similarity FROM u WHERE CASE WHEN cut IS NOT NULL THEN rank < cut ELSE similarity >= 0.6 END QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 15""",
    "per_source_limit": f"WITH {_RICH} SELECT query_id, id, rank, source, row_number() OVER (PARTITION BY query_id, source ORDER BY rank, id) AS place FROM h QUALIFY place <= 2",
    "result_metrics": f"WITH {_RICH} SELECT query_id, count(*) AS n, round(avg(similarity), 8) AS mean, min(similarity) AS least, max(similarity) AS most, round(stddev_pop(similarity), 8) AS deviation, round(count(DISTINCT source)::DOUBLE / count(*), 6) AS diversity FROM h GROUP BY 1",
}

SQL["hybrid_retrieval"] = f"""WITH {_BM25}, qg AS (SELECT query_id, query, {_TRI.format('query')} AS qg FROM asked), cg AS (SELECT doc_id AS id, text, {_TRI.format('text')} AS cg FROM documents),
  pg AS (SELECT query_id, id, contains(lower(text), lower(query)) AS anycase, CASE WHEN contains(text, query) THEN 1.0::DOUBLE
    ELSE round(len(list_intersect(qg, cg))::DOUBLE / (len(qg) + len(cg) - len(list_intersect(qg, cg))), 6) END AS similarity FROM qg, cg),
  tri AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pg WHERE similarity >= 0.1 OR anycase QUALIFY rank <= 20),
  un AS (SELECT query_id, id, rank FROM bm WHERE rank <= 20 UNION ALL SELECT * FROM tri), f0 AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (rank + 60)), 8) AS score FROM un GROUP BY ALL),
  f1 AS (SELECT *, {_RANK} FROM f0 QUALIFY rank <= 20), f2 AS (SELECT query_id, id, score / max(score) OVER (PARTITION BY query_id) AS similarity FROM f1),
  f3 AS (SELECT query_id, id, query, round(0.4::DOUBLE * similarity + 0.3::DOUBLE * {_KF} + 0.2::DOUBLE + 0.1::DOUBLE * least(ln(1 + n_chars::DOUBLE) / ln(101), 1), 6) AS score
    FROM (SELECT f2.*, text AS content, n_chars, query FROM f2 JOIN documents ON doc_id = id JOIN asked USING (query_id))),
  h AS (SELECT query_id, id, query, {_RANK}, score AS similarity FROM f3),
  t AS (SELECT *, round(greatest(0.65::DOUBLE + (0.5::DOUBLE - {_CPX}) * 0.2::DOUBLE, 0.55::DOUBLE), 6) AS threshold, {_DROP} FROM h),
  u AS (SELECT *, min(CASE WHEN fall > 0.2 THEN rank END) OVER (PARTITION BY query_id) AS c1, min(CASE WHEN similarity < threshold THEN rank END) OVER (PARTITION BY query_id) AS c2, max(similarity) OVER (PARTITION BY query_id) AS top FROM t)
  SELECT query_id, id, rank, similarity, threshold FROM u WHERE rank < coalesce(CASE WHEN top >= threshold THEN c1 END, c2, 1000000000) AND rank <= 20"""
