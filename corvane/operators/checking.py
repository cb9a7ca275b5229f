"""Fact checks of generated texts against their sources: indexes, verdicts by sentence, severities, repair, replies and skip decisions.

Names are extracted once from texts and sources and meet by joins on (id, name); a text's sources are its own few documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions import text as X

#: Patterns of names in code, by kind (fixed values); the name is the first group.
NAMES = {
    "function": r"(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(", "class": r"class\s+([A-Za-z_]\w*)", "import": r"(?:from|import)\s+([A-Za-z_][\w.]*)",
    "decorator": r"@([A-Za-z_]\w*)",
}
#: Severity of each kind of finding, and how to handle it.
SEVERITY = {"code": "critical", "version": "high", "fact": "high", "logic": "medium", "source": "low", "temporal": "medium"}
SUGGESTION = {
    "code": "replace by a known name, or write again", "version": "state the right version", "fact": "correct it, or mark it as uncertain", "logic": "arrange it anew",
    "source": "name the source, or drop the reference", "temporal": "check and update",
}
#: Words of each kind of finding, in order of precedence, and the patterns behind them (fixed values).
KIND_WORDS = {
    "code": ("函数", "方法", "类", "参数", "返回值", "import", "def ", "class "), "source": ("文档", "来源", "根据", "依据", "引用"),
    "logic": ("首先", "然后", "因此", "所以", "因为", "但是", "然而"), "fact": ("版本", "特性", "支持", "提供", "基于", "使用"),
}
KIND_PATTERNS = {"version": r"v\d+\.\d+", "temporal": r"\d{4}年|\d+年前|最近|目前"}
#: Names in fenced code and in references (fixed values).
FENCED = (r"def\s+(\w+)\s*\(", r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\()")
REFERENCES = (r"`(\w+)\(\)`", r"`(\w+)`\s*类")


#: Letters from seldom to frequent; others count as more seldom.
SELDOM = "jqxzkvbywgpfmucdlhrsnioate"


def names(texts: DataFrame, patterns: Mapping[str, str] = NAMES, stop: Sequence[str] = ()) -> DataFrame:
    """(id, kind, name) of (id, content): names that the patterns find, each once, without those of ``stop``."""

    def of_kind(kind: str, pattern: str) -> Column:
        every = F.array_distinct(F.regexp_extract_all("content", F.lit(f"(?U){pattern}"), 1))
        return F.transform(every, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))

    found = [of_kind(kind, pattern) for kind, pattern in patterns.items()]
    rows = texts.select("id", F.explode(F.flatten(F.array(*found))).alias("n")).select("id", "n.kind", "n.name").distinct()
    return rows.filter(~F.col("name").isin(*stop)) if stop else rows


def source_index(sources: DataFrame, words: int = 100, lines: int = 20) -> DataFrame:
    """(id, keywords, snippets) of a text's sources: their first words of three characters or more, and what their first longer lines begin with."""
    tokens = F.filter(F.split(F.lower("content"), r"[^\p{L}\p{N}_]+"), lambda t: t.rlike("^[a-z_][a-z0-9_]{2,}$"))
    tokens = F.slice(tokens, 1, words)
    first = F.slice(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), 1, lines)
    heads = F.transform(F.filter(first, lambda x: F.length(x) > 20), lambda x: F.left(F.lower(x), F.lit(100)))
    rows = sources.select("id", tokens.alias("k"), heads.alias("s"))
    return rows.groupBy("id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("k")))).alias("keywords"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("snippets")
    )


def kind_of(text: Column, words: Mapping[str, Sequence[str]] = KIND_WORDS, patterns: Mapping[str, str] = KIND_PATTERNS, default: str = "fact") -> Column:
    """The kind of a finding: the first with a word in the lower-cased text, else the first whose pattern the text has."""
    out, low = F.lit(default), F.lower(text)
    for kind, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    for kind, terms in reversed(words.items()):
        hit = F.lit(False)
        for term in terms:
            hit = hit | F.contains(low, F.lit(term))
        out = F.when(hit, kind).otherwise(out)
    return out


def _looked_up(kind: Column, table: Mapping[str, str], default: str) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def severity(kind: Column) -> Column:
    return _looked_up(kind, SEVERITY, "medium")


def suggestion(kind: Column) -> Column:
    return _looked_up(kind, SUGGESTION, "as the case may be")


def sentence_verdicts(texts: DataFrame, sources: DataFrame, patterns: Mapping[str, str], stop: Sequence[str] = ()) -> DataFrame:
    """(id, place, unknown, kind, severity): each sentence with the number of names that no source of its text has as a word."""
    rows = texts.select("id", F.posexplode(X.sentences(F.col("content"))).alias("place", "content"))
    named = names(rows.select(F.struct("id", "place").alias("id"), "content"), patterns, stop).select("id.id", "id.place", "name")
    known = sources.select("id", F.explode(F.array_distinct(F.split("content", r"[^\p{L}\p{N}_]+"))).alias("name")).distinct()
    unknown = named.join(known, ["id", "name"], "left_anti").groupBy("id", "place").agg(F.count_distinct("name").alias("unknown"))
    rows = rows.join(unknown, ["id", "place"], "left").withColumn("unknown", F.coalesce("unknown", F.lit(0)))
    kind = F.when(F.col("unknown") > 0, "code")
    return rows.select("id", F.col("place").cast("bigint").alias("place"), "unknown", kind.alias("kind"), F.when(F.col("unknown") > 0, severity(kind)).alias("severity"))


def text_verdicts(verdicts: DataFrame) -> DataFrame:
    """(id, sentences, critical, high, medium, low, valid): valid without critical or high findings."""
    counts = [F.count_if(F.coalesce(F.col("severity") == s, F.lit(False))).alias(s) for s in ("critical", "high", "medium", "low")]
    rows = verdicts.groupBy("id").agg(F.count("*").alias("sentences"), *counts)
    return rows.withColumn("valid", (F.col("critical") == 0) & (F.col("high") == 0))


def heuristic_findings(texts: DataFrame, sources: DataFrame, fenced: Sequence[str] = FENCED, references: Sequence[str] = REFERENCES) -> DataFrame:
    """(id, rule, name): definitions in fenced code, and names in references, that no source of the text has as a whole word. Texts without sources have none."""
    blocks = F.array_join(F.regexp_extract_all("content", F.lit(r"(?s)(```.*?```)"), 1), "\n")

    def found(text: Column, patterns: Sequence[str], rule: str) -> Column:
        every = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), 1) for p in patterns])))
        return F.transform(every, lambda n: F.struct(F.lit(rule).alias("rule"), n.alias("name")))

    rules = F.concat(found(blocks, fenced, "definition"), *[found(F.col("content"), [p], f"reference_{i}") for i, p in enumerate(references)])
    rows = texts.join(sources.select("id").distinct(), "id", "left_semi").select("id", F.explode(rules).alias("f")).select("id", "f.rule", "f.name")
    known = sources.select("id", F.explode(F.array_distinct(F.split("content", r"[^\p{L}\p{N}_]+"))).alias("name")).distinct()
    return rows.join(known, ["id", "name"], "left_anti").select("id", "rule", "name")


@F.pandas_udf(T.DoubleType())
def _block_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over both lengths: the longest common run, then the same left and right of it."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right, strict=True)], dtype="float64")


def _letters(name: str) -> Column:
    """Each letter of a name with the number of its occurrence, rare ones first: further occurrences, then letters by how seldom they are used."""
    each = F.array_sort(F.split(F.col(name), ""))
    counted = F.transform(each, lambda c, i: F.struct((F.array_position(each, c) - i).alias("n"), F.call_function("locate", F.lower(c), F.lit(SELDOM)).alias("r"), c.alias("c")))
    return F.array_sort(counted)


def similar_names(unknown: DataFrame, known: DataFrame, least: float = 0.6, digits: int = 6) -> DataFrame:
    """(id, name, best, ratio): for each unknown name the most alike known one of its ``id`` with a ratio over ``least``, else null.

    The ratio is that of matching blocks. Names of lengths m and n can only exceed ``least`` if they share over least / 2 * (m + n) letters, so
    of each name's letters, rare ones first, only so many are looked up that two such names always meet at one; pairs are then held against the exact
    bounds of length and shared letters before their blocks are matched. No match is lost. Letters are as they are written; empty names match nothing.
    Ties go to the first in order.
    """
    part = least / 2
    # the fewest letters that any name over the ratio shares with this one, and so how many of its own may be skipped
    shared = F.floor(part / (1 - part) * F.length("name")) + 1

    def looked_up(rows: DataFrame) -> DataFrame:
        letters = _letters("name")
        return rows.filter("name <> ''").select("id", "name", letters.alias("letters"), F.explode(F.slice(letters, 1, (F.length("name") - shared + 1).cast("int"))).alias("letter"))

    a = looked_up(unknown.select("id", "name").distinct())
    b = looked_up(known.select("id", "name").distinct()).select("id", F.col("name").alias("other"), F.col("letters").alias("others"), "letter")
    both = F.length("name") + F.length("other")
    rows = a.join(b, ["id", "letter"]).filter(F.least(F.length("name"), F.length("other")) > part * both)
    rows = rows.filter(F.size(F.array_intersect("letters", "others")) > part * both).select("id", "name", "other").distinct()
    rows = rows.withColumn("ratio", _block_ratio("name", "other")).filter(F.col("ratio") > least)
    best = rows.groupBy("id", "name").agg(F.min_by(F.struct("other", "ratio"), F.struct(-F.col("ratio"), "other")).alias("b"))
    return unknown.select("id", "name").distinct().join(best, ["id", "name"], "left").select("id", "name", F.col("b.other").alias("best"), F.round("b.ratio", digits).alias("ratio"))


def verified_names(named: DataFrame, known: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, kind, name, how): whether a text's (id, kind, name) is a name of that kind in its sources ("exact"), like one of them ("similar", functions only), or neither (null)."""
    exact = known.select("id", "kind", "name").distinct().withColumn("_exact", F.lit(True))
    rows = named.select("id", "kind", "name").distinct().join(exact, ["id", "kind", "name"], "left")
    functions = F.col("kind").isin("function", "method")
    asked = rows.filter(functions & F.col("_exact").isNull())
    alike = similar_names(asked, known.filter("kind = 'function'"), least).filter("best is not null").select("id", "name", F.lit(True).alias("_alike"))
    rows = rows.join(alike, ["id", "name"], "left")
    return rows.select("id", "kind", "name", F.when(F.col("_exact"), "exact").when(functions & F.col("_alike"), "similar").alias("how"))


def repaired(texts: DataFrame, similar: DataFrame, typos: Mapping[str, str] | None = None) -> DataFrame:
    """(id, content, repairs): known typos replaced, then each unknown name that has a similar one; longer names first."""
    content = F.col("content")
    for wrong, right in (typos or {}).items():
        content = F.replace(content, F.lit(wrong), F.lit(right))
    found = similar.filter("best is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("n"), "name", "best"))).alias("found"))
    rows = texts.select("id", content.alias("content")).join(found, "id", "left").withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<n: int, name: string, best: string>>)")))
    mended = F.aggregate("found", F.col("content"), lambda text, f: F.replace(text, f["name"], f["best"]))
    return rows.select("id", mended.alias("content"), F.size("found").cast("bigint").alias("repairs"))


def constraints(sources: DataFrame, patterns: Mapping[str, str], functions: int = 30, classes: int = 20) -> DataFrame:
    """(id, functions, classes): names that a text may use, in order, comma-joined, up to so many of each."""
    rows = names(sources, patterns).groupBy("id")
    listed = [
        F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))), 1, n), ", ").alias(column)
        for kind, n, column in (("function", functions, "functions"), ("class", classes, "classes"))
    ]
    return rows.agg(*listed)


def reply_verdict(reply: Column) -> Column:
    """Struct (valid, findings) of a reply: "INVALID" and a list of findings, or anything else."""
    text = F.trim(reply)
    invalid = F.startswith(text, F.lit("INVALID"))
    lines = F.transform(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.rlike("^[-•]")), lambda x: F.trim(F.regexp_replace(x, "^[-•]+", "")))
    return F.struct((~invalid).alias("valid"), F.when(invalid, F.filter(lines, lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("findings"))


def verify_scope(hits: DataFrame, strictness: Mapping[str, int]) -> DataFrame:
    """(query_id, mode, id, rank): the first documents that each strictness reads."""
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(n).alias("n")) for m, n in strictness.items()]))
    rows = hits.withColumn("m", modes).filter(F.col("rank") <= F.col("m.n"))
    return rows.select("query_id", F.col("m.mode").alias("mode"), "id", F.col("rank").cast("bigint").alias("rank"))


def smart_quality(content: Column, context: Column, terms: Sequence[str]) -> Column:
    """0.2 of the length (up to 5000), 0.2 for fenced code, 0.15 for structure, 0.2 of the terms (up to ten), 0.25 of the share of the context's words in it."""
    hits = sum((F.contains(content, F.lit(t)).cast("int") for t in terms), F.lit(0))
    fences = F.size(F.split(content, "```")) >= 3
    structured = F.lit(False)
    for mark in ("##", "**", "- "):
        structured = structured | F.contains(content, F.lit(mark))
    words = [F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (context, content)]
    shared = F.coalesce(F.try_divide(F.size(F.array_intersect(*words)).cast("double"), F.size(words[0]).cast("double")), F.lit(0.0))
    score = 0.2 * F.least(F.length(content) / 5000.0, F.lit(1.0)) + F.when(fences, 0.2).otherwise(0.0) + F.when(structured, 0.15).otherwise(0.0)
    score = score + 0.2 * F.least(hits / 10.0, F.lit(1.0)) + 0.25 * shared
    return F.when(F.trim(content) == "", 0.0).otherwise(F.round(F.least(score, F.lit(1.0)), 6))


def skip_decision(quality: Column, complexity: Column, cached: Column, high: float = 0.8, low: float = 0.5) -> Column:
    """Struct (skip, confidence): votes of a high quality, a low complexity and a cached answer; half of the three is enough."""
    votes = (quality >= high).cast("int") + (complexity < 0.3).cast("int") + cached.cast("int")
    confidence = F.when(quality >= high, quality).when(quality < low, F.round(1 - quality, 6)).otherwise(0.5)
    return F.struct((votes >= 1).alias("skip"), confidence.alias("confidence"))


def next_action(score: Column, attempts: Column, most: int = 3) -> Column:
    """What an evaluation leads to: go on, refine, widen, or after ``most`` attempts, give up."""
    action = F.when(score >= 0.7, "continue").when(score >= 0.5, "refine").when(score >= 0.3, "expand").otherwise("rewrite")
    return F.when((score < 0.7) & (attempts >= most), "give_up").otherwise(action)
