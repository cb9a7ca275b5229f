"""Queries of fact checks, skip decisions and repair, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import checking as K
from corvane.plans.quality_queries import _SENT, _answers
from corvane.plans.search_queries import _RICH, _rich
from corvane.sources import tables as T

#: Stand-ins for names in code: capitalised words of four letters or more.
NAMES = {"function": r"(?:^|[^\p{L}])([A-Z][a-z]{5,})(?:$|[^\p{L}])", "class": r"(?:^|[^\p{L}])([A-Z][a-z]{3,4})(?:$|[^\p{L}])"}
TERMS = ("the ", "and ", "with ", "des ", "les ", "que ", "license", "und ", "der ", "for ")
SCOPE = {"strict": 3, "usual": 2, "loose": 1}


def _scored(s, d):
    rows = _rich(s, d).groupBy("query_id").agg(F.round(F.avg("similarity"), 6).alias("score"), F.count("*").alias("n"))
    return rows.withColumn("attempts", (F.col("query_id") % 5).cast("int"))


def _unknown(s, d):
    items, sources = _answers(s, d)
    named = K.names(items, NAMES).select("id", "name")
    known = sources.select("id", F.explode(F.split("content", r"[^\p{L}]+")).alias("name")).filter("name rlike '^[A-Z][a-z]{3,}$'").distinct()
    return named.join(known, ["id", "name"], "left_anti"), known


def _fenced(s, d):
    """Items with their first words as a definition in fenced code, their last as a call."""
    items, sources = _answers(s, d)
    words = F.filter(F.split("content", r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    text = F.concat(F.lit("```\ndef "), F.element_at(words, 1), F.lit("(x)\nfunction "), F.reverse(F.element_at(words, 2)), F.lit("(y)\n```\n`"), F.element_at(words, -1), F.lit("()`"))
    return items.select("id", text.alias("content")), sources


def _verdict(s, d):
    rows = T.messages(s, d).select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "VALID").otherwise("INVALID"), F.lit("\n- "), F.regexp_replace("content", "\n", " "), F.lit("\n•  \nrest")).alias("reply"))
    return rows.select("conv_id", "turn", K.reply_verdict(F.col("reply")).alias("v"))


QUERIES = {
    "source_index": lambda s, d: K.source_index(_answers(s, d)[1]).select("id", F.array_join("keywords", ",").alias("keywords"), F.array_join("snippets", "|").alias("snippets")),
    "sentence_verdicts": lambda s, d: K.sentence_verdicts(*_answers(s, d), NAMES),
    "text_verdicts": lambda s, d: K.text_verdicts(K.sentence_verdicts(*_answers(s, d), NAMES)),
    "finding_kinds": lambda s, d: T.messages(s, d)
    .select("conv_id", "turn", K.kind_of(F.col("content"), {"code": ("the ",), "source": ("les ",), "logic": ("und ",), "fact": ("que ",)}, {"version": r"\d\d", "temporal": r"\d"}, "fact").alias("kind"))
    .select("conv_id", "turn", "kind", K.severity(F.col("kind")).alias("severity"), K.suggestion(F.col("kind")).alias("suggestion")),
    "similar_names": lambda s, d: K.similar_names(*_unknown(s, d)),
    "verified_names": lambda s, d: K.verified_names(K.names(_answers(s, d)[0], NAMES), K.names(_answers(s, d)[1], NAMES)),
    "repaired_texts": lambda s, d: K.repaired(_answers(s, d)[0], K.similar_names(*_unknown(s, d)), {"teh ": "the "}),
    "prompt_constraints": lambda s, d: K.constraints(_answers(s, d)[1], NAMES),
    "heuristic_findings": lambda s, d: K.heuristic_findings(*_fenced(s, d)),
    "reply_verdicts": lambda s, d: _verdict(s, d).select("conv_id", "turn", "v.valid", F.array_join("v.findings", "|").alias("findings")),
    "verify_scope": lambda s, d: K.verify_scope(_rich(s, d), SCOPE),
    "smart_quality": lambda s, d: _rich(s, d).select("query_id", "id", K.smart_quality(F.col("content"), F.col("query"), TERMS).alias("quality")),
    "skip_decisions": lambda s, d: _scored(s, d).select("query_id", K.skip_decision(F.col("score"), F.col("n") / 40.0, F.col("attempts") == 1).alias("k")).select("query_id", "k.*"),
    "next_actions": lambda s, d: _scored(s, d).select("query_id", K.next_action(F.col("score"), F.col("attempts")).alias("action")),
}

_SRC = f"{_RICH}, src AS (SELECT query_id AS id, content FROM h WHERE rank <= 3)"
_KNOWN = rf"kn AS (SELECT DISTINCT id, unnest(regexp_split_to_array(content, '[^\p{{L}}\p{{N}}_]+')) AS name FROM src)"
_F, _C = NAMES["function"], NAMES["class"]
_NM = f"unnest(list_distinct(regexp_extract_all({{0}}, '{_F}', 1) || regexp_extract_all({{0}}, '{_C}', 1))) AS name".replace("{5,}", "{{5,}}").replace("{3,4}", "{{3,4}}").replace("\\p{L}", "\\p{{L}}")
_SENTS = f"st AS (SELECT id, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS content FROM (SELECT item_id AS id, {_SENT.format('text')} AS l FROM benchmark))"
_VERD = f"""{_SRC}, {_KNOWN}, {_SENTS}, nm AS (SELECT DISTINCT id, place, {_NM.format('content')} FROM st), un AS (SELECT id, place, count(DISTINCT name) AS unknown FROM nm ANTI JOIN kn USING (id, name) GROUP BY ALL),
v AS (SELECT id, place, coalesce(unknown, 0) AS unknown, CASE WHEN unknown > 0 THEN 'code' END AS kind, CASE WHEN unknown > 0 THEN 'critical' END AS severity FROM st LEFT JOIN un USING (id, place))"""
_SC = "mean AS (SELECT query_id, round(avg(similarity), 6) AS score, count(*) AS n, query_id % 5 AS attempts FROM h GROUP BY 1)"
_WD = r"list_filter(regexp_split_to_array(text, '[^\p{L}]+'), lambda w: length(w) > 2)"

SQL = {
    "source_index": rf"""WITH {_SRC}, a AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '[^\p{{L}}\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z_][a-z0-9_]{{2,}}'))[1:100] AS k,
      list_transform(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x))[1:20], lambda x: length(x) > 20), lambda x: left(lower(x), 100)) AS s FROM src)
      SELECT id, array_to_string(list_sort(list_distinct(flatten(list(k)))), ',') AS keywords, array_to_string(list_sort(list_distinct(flatten(list(s)))), '|') AS snippets FROM a GROUP BY 1""",
    "sentence_verdicts": f"WITH {_VERD} SELECT * FROM v",
    "text_verdicts": f"""WITH {_VERD} SELECT id, count(*) AS sentences, count(*) FILTER (severity = 'critical') AS critical, 0::BIGINT AS high, 0::BIGINT AS medium, 0::BIGINT AS low, count(*) FILTER (severity = 'critical') = 0 AS valid FROM v GROUP BY 1""",
    "finding_kinds": r"""WITH k AS (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the ') THEN 'code' WHEN contains(lower(text), 'les ') THEN 'source' WHEN contains(lower(text), 'und ') THEN 'logic' WHEN contains(lower(text), 'que ') THEN 'fact'
      WHEN regexp_matches(text, '\d\d') THEN 'version' WHEN regexp_matches(text, '\d') THEN 'temporal' ELSE 'fact' END AS kind FROM conversations),
      t(kind, severity, suggestion) AS (VALUES """
    + ", ".join(f"('{k}', '{K.SEVERITY[k]}', '{K.SUGGESTION[k]}')" for k in K.SEVERITY)
    + ") SELECT * FROM k JOIN t USING (kind)",
    "prompt_constraints": rf"""WITH {_SRC}, f AS (SELECT id, regexp_extract_all(content, '{_F}', 1) AS f, regexp_extract_all(content, '{_C}', 1) AS c FROM src),
      g AS (SELECT id, list_sort(list_distinct(flatten(list(f)))) AS f, list_sort(list_distinct(flatten(list(c)))) AS c FROM f GROUP BY 1) SELECT id, array_to_string(f[1:30], ', ') AS functions, array_to_string(c[1:20], ', ') AS classes FROM g WHERE len(f) + len(c) > 0""",
    "heuristic_findings": rf"""WITH {_SRC}, {_KNOWN}, w AS (SELECT item_id AS id, {_WD} AS w FROM benchmark),
      f AS (SELECT id, 'definition' AS rule, w[1] AS name FROM w UNION SELECT id, 'definition', reverse(w[2]) FROM w UNION SELECT id, 'reference_0', w[len(w)] FROM w)
      SELECT * FROM f SEMI JOIN src USING (id) ANTI JOIN kn USING (id, name)""",
    "reply_verdicts": r"""SELECT conv_id, turn, turn % 2 = 0 AS valid, CASE WHEN turn % 2 = 0 THEN '' ELSE trim(regexp_replace(trim(replace(text, chr(10), ' ')), '^[-•]+', '')) END AS findings FROM conversations""",
    "verify_scope": f"WITH {_RICH}, m(mode, n) AS (VALUES ('strict', 3), ('usual', 2), ('loose', 1)) SELECT query_id, mode, id, rank FROM h, m WHERE rank <= n",
    "smart_quality": f"""WITH {_RICH}, g AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(query), '\\s+'), lambda w: w <> '')) AS qw, list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: w <> '')) AS cw FROM h)
      SELECT query_id, id, CASE WHEN trim(content) = '' THEN 0 ELSE round(least(0.2::DOUBLE * least(length(content) / 5000.0::DOUBLE, 1) + CASE WHEN len(string_split(content, '```')) >= 3 THEN 0.2::DOUBLE ELSE 0 END
        + CASE WHEN contains(content, '##') OR contains(content, '**') OR contains(content, '- ') THEN 0.15::DOUBLE ELSE 0 END
        + 0.2::DOUBLE * least(({' + '.join(f"contains(content, '{t}')::INT" for t in TERMS)}) / 10.0::DOUBLE, 1) + 0.25::DOUBLE * coalesce(len(list_intersect(qw, cw))::DOUBLE / nullif(len(qw), 0), 0), 1), 6) END AS quality FROM g""",
    "skip_decisions": f"""WITH {_RICH}, {_SC} SELECT query_id, (score >= 0.8)::INT + (n / 40.0::DOUBLE < 0.3)::INT + (attempts = 1)::INT >= 1 AS skip,
      CASE WHEN score >= 0.8 THEN score WHEN score < 0.5 THEN round(1 - score, 6) ELSE 0.5::DOUBLE END AS confidence FROM mean""",
    "next_actions": f"""WITH {_RICH}, {_SC} SELECT query_id, CASE WHEN score < 0.7 AND attempts >= 3 THEN 'give_up' WHEN score >= 0.7 THEN 'continue' WHEN score >= 0.5 THEN 'refine' WHEN score >= 0.3 THEN 'expand' ELSE 'rewrite' END AS action FROM mean""",
}
