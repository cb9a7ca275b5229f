"""Queries of query rewriting, reply parsing and content signals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import understanding as U
from corvane.plans.quality_queries import CLASSES, _best
from corvane.plans.search_queries import _QUEST
from corvane.sources import tables as T

#: Stand-ins for the usual word lists, of words that the tables have.
PATTERNS, SIMPLE, COMPLEX = (r"^\w+ \w+\.?$",), ("the ", "les "), (" and ", " und ", " et ", " y ")
NEEDED = {"terminology": "what|the ", "usage": "how|with", "comparison": "and "}
PREFIXES = {"terminology": ("what is ", ("what is",), True), "usage": ("how to use ", ("how to",), False), "comparison": ("difference of ", ("difference",), False)}
SYNONYMS = {"the": ("the", "that", "this"), "les": ("les", "des"), "und": ("und", "oder")}
STOP = ("the", "and", "of", "to")
LEVELS = {"high": ("ness", "schaft"), "medium": ("ing ", "ung "), "low": ("the ", "les ")}
DOMAINS = {"legal": ("license", "copyright"), "english": ("the ", "and "), "french": ("les ", "des "), "german": ("der ", "und ")}
MARKERS = ("TODO", "license", "@", "http")
#: Skills with tone and layer, and the words that lead to them.
SKILLS = (("tutorial", "friendly", "base"), ("warning", "strict", "base"), ("analogy", "friendly", "art"), ("research", "strict", "art"))
LEADS = (("tutorial", "the ", 5), ("warning", "of ", 1), ("analogy", "que ", 3), ("research", "and ", 4), ("tutorial", "der ", 2))


def _turns(s, d):
    """Messages as short queries, numbered."""
    return T.messages(s, d).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("content").alias("query"))


def _classed(s, d):
    rows = _turns(s, d).withColumn("b", X.best_rule(F.col("query"), CLASSES, "general"))
    return rows.select("query_id", "query", F.col("b.name").alias("kind"), F.col("b.score").alias("confidence"))


def _signals(s, d):
    lead = [F.when(F.contains(F.lower("query"), F.lit(w)), F.struct(F.lit(k).alias("skill"), F.lit(p).alias("priority"))) for k, w, p in LEADS]
    return T.questions(s, d).select("query_id", F.explode(F.array_compact(F.array(*lead))).alias("x")).select("query_id", "x.skill", "x.priority")


def _replies(s, d):
    """A numbered list of a conversation's first words, and a JSON array of them, as replies."""
    rows = T.messages(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.element_at(F.split("content", r"\s+"), 1).alias("w")))).alias("w"))
    listed = F.array_join(F.transform("w", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["w"])), "\n")
    as_json = F.concat(F.lit("Here: "), F.to_json(F.transform("w", lambda x: F.struct(x["w"].alias("text"), F.when(x["turn"] > 1, "other").alias("type")))), F.lit(" done"))
    return rows.select("conv_id", F.concat(F.lit("相关查询:\n"), listed).alias("listed"), as_json.alias("json"))


QUERIES = {
    "simple_queries": lambda s, d: _turns(s, d).select("query_id", U.is_simple(F.col("query"), PATTERNS, SIMPLE, 12).alias("simple")),
    "complex_queries": lambda s, d: T.questions(s, d).unionByName(_turns(s, d)).select("query_id", U.is_complex(F.col("query"), COMPLEX).alias("complex")),
    "classification_valid": lambda s, d: _classed(s, d).select("query_id", U.class_holds(F.col("query"), F.col("kind"), F.col("confidence"), NEEDED).alias("valid")),
    "rule_rewrite": lambda s, d: _classed(s, d).select("query_id", U.rule_rewrite(F.col("query"), F.col("kind"), PREFIXES).alias("rewritten")),
    "rewrite_cached": lambda s, d: U.rewritten(
        T.questions(s, d), F.lit("general"), F.lit(0.5), T.questions(s, d).filter("query_id % 4 = 1").select("query", X.upper_letters(F.col("query")).alias("rewritten")).distinct()
    ),
    "query_normalise": lambda s, d: T.questions(s, d).select("query_id", U.normalised(F.col("query")).alias("query")),
    "query_synonyms": lambda s, d: T.questions(s, d).select("query_id", F.array_join(F.slice(U.with_synonyms(F.col("query"), SYNONYMS), 2, 20), "|").alias("words")),
    "fallback_intent": lambda s, d: T.questions(s, d)
    .select("query_id", U.fallback_intent(F.col("query"), STOP).alias("i"))
    .select("query_id", F.array_join("i.keywords", ",").alias("keywords"), "i.language", "i.confidence"),
    "reply_lines": lambda s, d: _replies(s, d).select("conv_id", F.posexplode(U.reply_lines(F.col("listed"), longer_than=2)).alias("place", "item")),
    "reply_variants": lambda s, d: _replies(s, d).select("conv_id", F.posexplode(U.reply_variants(F.col("json"))).alias("place", "v")).select("conv_id", "place", "v.*"),
    "default_variants": lambda s, d: T.questions(s, d).select("query_id", F.explode(U.default_variants(F.col("query"))).alias("v")).select("query_id", "v.*"),
    "content_signals": lambda s, d: U.content_signals(T.corpus(s, d), "content", MARKERS, LEVELS, DOMAINS).select("id", F.array_join("markers", ",").alias("markers"), "complexity", "domain"),
    "query_enrichment": lambda s, d: T.questions(s, d).select("query_id", U.first_of(F.col("query"), LEVELS, None).alias("complexity"), U.first_of(F.col("query"), DOMAINS, None).alias("domain")),
    "recommended_skill": lambda s, d: U.recommended(_signals(s, d), s.createDataFrame(list(SKILLS), "skill string, tone string, layer string"), "friendly", "art"),
}

_TURNS = "turns AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations)"
_WORDS = r"len(list_filter(regexp_split_to_array(trim(query), '\s+'), lambda w: w <> ''))"


def _any(column, words):
    return "(" + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + ")"


def _first(column, words, default):
    return "CASE " + " ".join(f"WHEN {_any(column, w)} THEN '{k}'" for k, w in words.items()) + (f" ELSE '{default}' END" if default is not None else " END")


_CLASSED = f"{_TURNS}, k AS (SELECT query_id, query, {_best(CLASSES).replace('AS intent', 'AS kind').replace('AS score', 'AS confidence')} FROM turns)"
_REPLIES = "w AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, turn, regexp_split_to_array(text, '\\s+')[1] AS w FROM conversations)"
_SYN = " || ".join(
    f"CASE WHEN contains(lower(query), '{t}') THEN list_filter([{', '.join(repr(w) for w in ws)}], lambda w: NOT contains(query, w)) ELSE [] END" for t, ws in SYNONYMS.items()
)

SQL = {
    "simple_queries": rf"""WITH {_TURNS} SELECT query_id, length(trim(query)) BETWEEN 5 AND 50 AND (regexp_matches(trim(query), '^[\pL\pN_]+ [\pL\pN_]+\.?$') OR ({_any('query', SIMPLE)} AND {_WORDS} <= 12)) AS simple FROM turns""",
    "complex_queries": f"WITH {_QUEST}, {_TURNS}, b AS (SELECT * FROM asked UNION ALL SELECT * FROM turns) SELECT query_id, {_WORDS} >= 10 OR ({_WORDS} >= 5 AND {_any('query', COMPLEX)}) AS complex FROM b",
    "classification_valid": f"""WITH {_CLASSED} SELECT query_id, confidence >= 0.3 AND CASE kind WHEN 'terminology' THEN regexp_matches(lower(query), 'what|the ') WHEN 'usage' THEN regexp_matches(lower(query), 'how|with')
      WHEN 'comparison' THEN regexp_matches(lower(query), 'and ') ELSE true END AS valid FROM k""",
    "rule_rewrite": f"""WITH {_CLASSED} SELECT query_id, CASE WHEN kind = 'terminology' AND NOT starts_with(lower(query), 'what is') THEN 'what is ' || trim(replace(query, 'what is', ''))
      WHEN kind = 'usage' AND NOT contains(lower(query), 'how to') THEN 'how to use ' || query WHEN kind = 'comparison' AND NOT contains(lower(query), 'difference') THEN 'difference of ' || query ELSE query END AS rewritten FROM k""",
    "rewrite_cached": f"""WITH {_QUEST}, c AS (SELECT DISTINCT query FROM asked WHERE query_id % 4 = 1) SELECT query_id, CASE WHEN c.query IS NOT NULL THEN upper(asked.query) ELSE asked.query END AS rewritten, 'general' AS kind,
      CASE WHEN c.query IS NOT NULL THEN 0.475::DOUBLE ELSE 0.5::DOUBLE END AS confidence, CASE WHEN c.query IS NOT NULL THEN 'cache' ELSE 'none' END AS path FROM asked LEFT JOIN c USING (query)""",
    "query_normalise": rf"WITH {_QUEST} SELECT query_id, trim(regexp_replace(query, '\s+', ' ', 'g')) AS query FROM asked",
    "query_synonyms": f"WITH {_QUEST} SELECT query_id, array_to_string({_SYN}, '|') AS words FROM asked",
    "fallback_intent": rf"""WITH {_QUEST} SELECT query_id, array_to_string(list_filter(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ('the', 'and', 'of', 'to'))[1:10], ',') AS keywords,
      CASE WHEN regexp_matches(query, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language, 0.5::DOUBLE AS confidence FROM asked""",
    "reply_lines": f"WITH {_REPLIES}, i AS (SELECT conv_id, place, trim(w) AS item FROM w WHERE length(trim(w)) > 2 AND NOT regexp_matches(w, '^[0-9.*-]')) SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY place) - 1)::INTEGER AS place, item FROM i",
    "reply_variants": f"WITH {_REPLIES} SELECT conv_id, place::INTEGER AS place, w AS text, CASE WHEN turn > 1 THEN 'other' ELSE 'semantic_variant' END AS type, 1.0::DOUBLE AS confidence FROM w",
    "default_variants": f"""WITH {_QUEST}, t(template, type, confidence) AS (VALUES ('{{}}', 'original', 1.0::DOUBLE), ('如何实现 {{}}', 'question_form', 0.9::DOUBLE), ('{{}} 示例代码', 'term_expansion', 0.85::DOUBLE))
      SELECT query_id, replace(template, '{{}}', query) AS text, type, confidence FROM asked, t""",
    "content_signals": f"""SELECT doc_id AS id, array_to_string(list_filter(['TODO', 'license', '@', 'http'], lambda m: contains(lower(text), lower(m))), ',') AS markers, {_first('text', LEVELS, 'medium')} AS complexity,
      {_first('text', DOMAINS, '')} AS domain FROM documents""",
    "query_enrichment": f"WITH {_QUEST} SELECT query_id, {_first('query', LEVELS, None)} AS complexity, {_first('query', DOMAINS, None)} AS domain FROM asked",
    "recommended_skill": f"""WITH {_QUEST}, l(skill, word, priority) AS (VALUES {', '.join(f"('{a}', '{b}', {c})" for a, b, c in LEADS)}), k(skill, tone, layer) AS (VALUES {', '.join(str(x) for x in SKILLS)}),
      s AS (SELECT query_id, skill, priority, tone, layer FROM asked, l JOIN k USING (skill) WHERE contains(lower(query), word)), a AS (SELECT * FROM s QUALIFY tone = 'friendly' OR NOT bool_or(tone = 'friendly') OVER (PARTITION BY query_id)),
      b AS (SELECT * FROM a QUALIFY layer = 'art' OR NOT bool_or(layer = 'art') OVER (PARTITION BY query_id)) SELECT query_id, arg_min(skill, (priority, skill)) AS skill FROM b GROUP BY 1""",
}
